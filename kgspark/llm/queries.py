"""The registered queries of the dealt operators: whole tables in, whole results out."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from . import oracles
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _register(name: str, module: str, function: str, source: str, columns: list[str] | None = None, oracle: str | None = None) -> None:
    """The module is imported when the query runs."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = getattr(import_module(f".{module}", __package__), function)(table(spark, sf_dir, source))
        return out.select(*columns) if columns else out

    QUERIES[name] = query
    if oracle:
        ORACLES[name] = oracle


_register(
    "op2_url_graph", "url_graph", "verdicts", "pages", ["page_id", "host", "path", "rule", "verdict"], oracles.url_graph()
)
_register(
    "op4_poisson_mix", "mixing", "mix", "documents", ["doc_id", "source", "lang", "text", "n_chars", "copy", "rate", "shuffle_key"], oracles.POISSON_MIX
)
_register(
    "op10_warc", "warc", "archive_pages", "pages", ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"], oracles.WARC
)
_register("op5_best_fit_packing", "packing", "pack", "documents")
_register("op8_language_id", "langid", "predict_ids", "documents", ["doc_id", "held_out", "lang_pred", "score", "rejected"])
_register("op1_max_scoring_text", "extract", "extract", "pages")
_register("op9_kdtree_topk", "kdtree", "top_k", "embeddings", None, oracles.TOP_K)
_register("op3_pca_tiles", "vector_links", "links", "embeddings")
_register("op7_probminhash", "minhash", "near_duplicates", "documents")
_register("op6_katz_backoff", "katz", "score", "documents")
_register("op13_token_alignment", "alignment", "align", "documents")
_register("op12_quartile_digest", "fingerprint", "edited_fingerprints", "documents", None, oracles.FINGERPRINT)
_register("op11_collocations", "phrases", "collocations", "documents", None, oracles.PHRASES)
