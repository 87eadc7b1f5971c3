"""Batch ingest of extracted notes, and edits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import text_vector
from ..operators.accrete import Accretion, accrete_placed
from ..operators.identity import resolve_identity
from ..operators.retract import retract
from ..schema import ACCRETION_SIMILARITY, DEFAULT_DIM, SUGGESTION_FLOOR_SIMILARITY, empty
from ..session import cut, spread
from ..sources.chunks import Chunks, chunked_notes, place
from ..sources.notes import correct_notes, first_notes, settle_notes

NOTE = ["user_id", "braindump_id"]


class Grown(dict):
    """Tables after an ingest; ``added`` holds the rows of those that are the table before and these rows, nothing else."""

    def __init__(self, tables: dict[str, DataFrame]):
        super().__init__(tables)
        self.added: dict[str, DataFrame] = {}

    def grow(self, name: str, rows: DataFrame, alone: bool) -> None:
        rows = rows.select(*self[name].columns)
        self[name] = self[name].unionByName(rows)
        if alone:
            self.added[name] = rows


def _all_new(arrived: DataFrame, held: DataFrame) -> bool:
    """Whether each note arrived once and none is held; ids alone are read."""
    here, there = arrived.withColumn("n", F.lit(1)), held.withColumn("n", F.lit(2))
    return not here.unionByName(there).groupBy(*NOTE).agg(F.sum("n").alias("n"), F.min("n").alias("low")).where("low = 1 AND n > 1").head(1)


def _counts(chunks: Chunks, born: DataFrame, suggestions: DataFrame, edges: Accretion) -> DataFrame:
    """Counters per note, each from rows of its own: labels that made no concept joined one."""
    names = ["concepts_created", "concepts_accreted", "merge_suggestions", "edges_created", "edges_accreted", "edges_rejected"]
    number = lambda name, c: c.cast("bigint").alias(name)
    parts = [
        chunks.notes.where("reason IS NULL AND user_id IS NOT NULL").select(*NOTE, number("concepts_accreted", F.size("words"))),
        born.select(*NOTE, number("concepts_created", F.lit(1)), number("concepts_accreted", F.lit(-1))),
        suggestions.select(*NOTE, number("merge_suggestions", F.lit(1))), edges.note_counts,
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole.groupBy(*NOTE).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])


def batch_ingest(
    tables: dict[str, DataFrame],
    raw: DataFrame,
    at: int,
    embed: Callable[[Column], Column] | None = None,
    dim: int = DEFAULT_DIM,
    accrete: float = ACCRETION_SIMILARITY,
    floor: float = SUGGESTION_FLOOR_SIMILARITY,
    once: bool = False,
) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """Ingest ``raw(user_id, braindump_id, verbatim, payload)``: (tables after, counters per note, rejected notes).

    Notes count in id order. What a note asserted before is retracted first, so ingesting again replaces it. Every note
    is in ``braindumps`` afterwards, complete or failed; the reasons of failed ones are kept in ``ingest_rejects``.
    ``once``: each use of ``raw`` would read all its columns again (a stream's batch), so its texts are written with the parsed notes.
    """
    embed = embed or (lambda t: text_vector(t, dim))
    chunks = chunked_notes(raw if once else spread(raw), ("verbatim",) if once else ())
    rejects = cut(chunks.notes.where("reason IS NOT NULL").select(*NOTE, "reason"), "rejects")
    raw = chunks.notes.select(*NOTE, "verbatim") if once else raw
    notes = raw.join(rejects, NOTE, "left_anti").select(*NOTE, "verbatim")
    keys = cut(notes.select(*NOTE), "ingest_keys")
    known = cut(keys.join(
        tables["concept_provenance"].select(*NOTE).unionByName(tables["edge_provenance"].select(*NOTE))
        .unionByName(tables["braindump_embeddings"].select(*NOTE)).distinct(),
        NOTE, "left_semi",
    ), "reingested")
    again = bool(known.head(1))
    out = Grown(retract(tables, known, at) if again else tables)

    identity = resolve_identity(chunks.entries, out["concept_embeddings"], accrete, floor, embed=embed, every=chunks.every)
    found = identity.occurrences.select("chunk", "word", F.when(F.col("each"), F.col("braindump_id")).alias("at"), "concept_id")
    placed = place(chunks, found)
    edges = accrete_placed(placed.select(*NOTE, F.inline("edges")), out["ontology"], out["edges"], at, marked=True)
    born = cut(identity.leaders, "born")
    outcome = keys.join(_counts(chunks, born, identity.suggestions, edges), NOTE, "left").na.fill(0)

    stamp = F.lit(at).cast("bigint")
    # The notes assert nothing yet (what they did before is retracted), so what they assert is added as it is.
    added = {
        "concepts": born.select("user_id", "concept_id", "label", stamp.alias("created_at")),
        "concept_embeddings": born.select("user_id", "concept_id", "embedding"),
        "concept_provenance": placed.select("user_id", F.explode("concepts").alias("concept_id"), "braindump_id"),
        "edges": edges.new_edges, "edge_type_history": edges.history, "edge_provenance": edges.provenance,
        "braindump_embeddings": notes.select(*NOTE, embed(F.col("verbatim")).alias("embedding")),
    }
    labelled = born.select("user_id", F.col("concept_id").alias("new_concept_id"), F.col("label").alias("new_concept_label"))
    added["merge_suggestions"] = identity.suggestions.join(labelled, ["user_id", "new_concept_id"]).select(
        "user_id", "suggestion_id", "braindump_id", "new_concept_label", "new_concept_id", "existing_concept_id",
        "similarity", F.lit("pending").alias("status"), stamp.alias("created_at"),
    )
    for name, rows in added.items():
        out.grow(name, rows, alone=not again)
    arrived = raw.select(*NOTE, "verbatim")
    if once and _all_new(arrived.select(*NOTE), out["braindumps"].select(*NOTE)):
        out.grow("braindumps", first_notes(arrived, rejects, at), alone=not again)
    else:
        out["braindumps"] = settle_notes(out["braindumps"], arrived, rejects, at)
    refused = tables.get("ingest_rejects")
    refused = empty(raw.sparkSession, "ingest_rejects") if refused is None else refused
    out["ingest_rejects"] = refused.join(raw.select(*NOTE), NOTE, "left_anti").select(*NOTE, "reason", "rejected_at").unionByName(
        rejects.select(*NOTE, "reason", stamp.alias("rejected_at"))
    )
    return out, outcome, rejects


def edit_notes(
    tables: dict[str, DataFrame], edits: DataFrame, at: int, **kw
) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """Replace the text of known notes and ingest their new extraction.

    ``edits(user_id, braindump_id, verbatim, cleaned, payload)``; an edit of an unknown note is ignored.
    """
    known = edits.join(tables["braindumps"].select(*NOTE), NOTE, "left_semi")
    corrected = dict(tables)
    corrected["braindumps"] = correct_notes(
        tables["braindumps"], known.select(*NOTE, "verbatim", "cleaned", F.lit(at).alias("corrected_at"))
    )
    return batch_ingest(corrected, known.select(*NOTE, "verbatim", "payload"), at, **kw)
