"""Seed-then-expand retrieval for many queries at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import expand as X
from ..operators.history import with_current_type
from ..operators.knn import bounded, nearest
from ..schema import BRAINDUMP_TOP_K, EXPAND_DEPTH, SEED_SIMILARITY_FLOOR, SEED_TOP_K, empty
from ..session import cut


@dataclass
class Retrieval:
    """``notes(query_id, user_id, braindump_id, score, source)``, ``paths``, ``modes(query_id, user_id, mode)``."""

    notes: DataFrame
    paths: DataFrame
    modes: DataFrame
    hops: DataFrame


def seeds_of(queries: DataFrame, concept_embeddings: DataFrame, floor: float = SEED_SIMILARITY_FLOOR,
             k: int = SEED_TOP_K, **knn) -> DataFrame:
    """Top ``k`` concepts per query, then the floor (inclusive)."""
    return nearest(queries, concept_embeddings, "concept_id", k, **knn).where(F.col("similarity") >= floor)


def _with_table(queries: DataFrame, knn: dict) -> dict:
    if knn.get("strategy", "auto") != "auto":
        return knn
    table = bounded(queries)
    return {**knn, "query_table": table} if table is not None else {**knn, "strategy": "grid"}


def paths_of(hops: DataFrame, edges: DataFrame, history: DataFrame, concepts: DataFrame) -> DataFrame:
    """Edges between visited concepts, per query. Only edges that some query touches are met with their history."""
    visited = cut(hops.select("user_id", "concept_id").distinct(), "visited")
    touched = edges
    for end in ("source_concept_id", "target_concept_id"):
        touched = touched.join(visited.withColumnRenamed("concept_id", end), ["user_id", end], "left_semi")
    touched = cut(touched, "touched")
    told = history.join(touched.select("user_id", "edge_id"), ["user_id", "edge_id"], "left_semi")
    return X.induced_edges(hops, with_current_type(touched, told), concepts)


def retrieve_paths(
    queries: DataFrame, concepts: DataFrame, edges: DataFrame, history: DataFrame, concept_embeddings: DataFrame,
    floor: float = SEED_SIMILARITY_FLOOR, seed_k: int = SEED_TOP_K, depth: int = EXPAND_DEPTH, **knn,
) -> DataFrame:
    """The ``paths`` of :func:`retrieve` alone, for callers that need no notes."""
    seeds = cut(seeds_of(queries, concept_embeddings, floor, seed_k, **_with_table(queries, knn)), "seeds")
    return paths_of(X.expand(seeds, edges, concepts, depth), edges, history, concepts)


def retrieve(
    queries: DataFrame,
    concepts: DataFrame,
    edges: DataFrame,
    history: DataFrame,
    concept_provenance: DataFrame | Callable[[], DataFrame],
    braindumps: DataFrame,
    concept_embeddings: DataFrame,
    braindump_embeddings: DataFrame,
    floor: float = SEED_SIMILARITY_FLOOR,
    seed_k: int = SEED_TOP_K,
    note_k: int = BRAINDUMP_TOP_K,
    depth: int = EXPAND_DEPTH,
    **knn,
) -> Retrieval:
    """Seeds by vector, two undirected hops, notes of the subgraph, strays by vector; else notes by vector alone.

    The note hits are computed once and serve both the backfill (minus the subgraph's notes, after the limit) and
    the queries that found no seed. ``concept_provenance`` may be given as a function, which is called only if there are seeds.
    """
    knn = _with_table(queries, knn)
    seeds = cut(seeds_of(queries, concept_embeddings, floor, seed_k, **knn), "seeds")
    asked = queries.select("query_id", "user_id")
    seeded = seeds.select("query_id", "user_id").distinct()
    modes = asked.join(seeded.withColumn("hit", F.lit(True)), ["query_id", "user_id"], "left").select(
        "query_id", "user_id",
        F.when(F.col("hit"), F.lit("seed_then_expand")).otherwise(F.lit("no_seed_fallback")).alias("mode"),
    )

    known_notes = braindumps.select("user_id", "braindump_id")
    hops = X.expand(seeds, edges, concepts, depth)
    if callable(concept_provenance):
        none = empty(queries.sparkSession, "concept_provenance")
        concept_provenance = concept_provenance() if seeds.head(1) else none
    subgraph = X.subgraph_notes(hops, concept_provenance).withColumn("source", F.lit("subgraph"))
    hits = (
        nearest(queries, braindump_embeddings, "braindump_id", note_k, **knn)
        .select("query_id", "user_id", "braindump_id", F.col("similarity").alias("score"))
    )
    strays = (
        hits.join(modes, ["query_id", "user_id"])
        .withColumn(
            "source",
            F.when(F.col("mode") == "seed_then_expand", F.lit("backfill")).otherwise(F.lit("vector_direct")),
        )
        .drop("mode")
        .join(subgraph.select("query_id", "user_id", "braindump_id"), ["query_id", "user_id", "braindump_id"], "left_anti")
    )
    notes = (
        subgraph.unionByName(strays)
        .join(known_notes, ["user_id", "braindump_id"], "left_semi")
        .select("query_id", "user_id", "braindump_id", "score", "source")
    )
    return Retrieval(notes, paths_of(hops, edges, history, concepts), modes, hops)


def ranked(notes: DataFrame) -> DataFrame:
    """Presentation order: score down, note id up, per query. Sorting happens here, at the sink."""
    return notes.orderBy("query_id", "user_id", F.desc("score"), "braindump_id")
