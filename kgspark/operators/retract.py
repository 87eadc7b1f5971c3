"""Taking notes back: provenance, orphans, tombstones and the endpoint cascade."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .provenance import orphan_concepts, orphan_edges, with_both_ends

NOTE = ["user_id", "braindump_id"]
EDGE = ["user_id", "edge_id"]
CONCEPT = ["user_id", "concept_id"]


@dataclass
class Gone:
    """Keys of what vanishes: orphan edges, orphan concepts, and edges that lose an endpoint."""

    edges: DataFrame
    concepts: DataFrame
    cascaded: DataFrame


def without(table: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return table.join(keys.select(*on), on, "left_anti")


def find_gone(tables: dict[str, DataFrame], notes: DataFrame, materialize: bool = False) -> Gone:
    """What is left without support once ``notes(user_id, braindump_id)`` are retracted, in their tenants."""
    tenants = notes.select("user_id").distinct()
    concept_prov = without(tables["concept_provenance"], notes, NOTE)
    edge_prov = without(tables["edge_provenance"], notes, NOTE)
    in_scope = tables["edges"].join(tenants, "user_id", "left_semi")
    edges = orphan_edges(in_scope, edge_prov, tables["edge_inference_provenance"]).select(*EDGE)
    concepts = orphan_concepts(tables["concepts"].join(tenants, "user_id", "left_semi"), concept_prov).select(*CONCEPT)
    if materialize:
        edges, concepts = cut(edges, "gone_edges"), cut(concepts, "gone_concepts")
    # The few edges at lost concepts are found first, so orphan edges are taken out of them and not twice out of all edges.
    ends = in_scope.select(*EDGE, "source_concept_id", "target_concept_id")
    at_lost = ends.join(
        concepts.withColumnRenamed("concept_id", "source_concept_id"), ["user_id", "source_concept_id"], "left_semi"
    ).select(*EDGE).unionByName(
        ends.join(
            concepts.withColumnRenamed("concept_id", "target_concept_id"), ["user_id", "target_concept_id"], "left_semi"
        ).select(*EDGE)
    ).distinct()
    touching = without(at_lost, edges, EDGE)
    return Gone(edges, concepts, cut(touching, "gone_cascade") if materialize else touching)


def tombstone_rows(gone: Gone, at: int, cascades: bool = False) -> DataFrame:
    """Tombstones for orphans; edges lost to the endpoint cascade get one only when asked for."""
    edges = gone.edges.unionByName(gone.cascaded) if cascades else gone.edges
    stamp = F.lit(at).cast("bigint").alias("created_at")
    return edges.select("user_id", F.lit("edge").alias("kind"), F.col("edge_id").alias("entity_id"), stamp).unionByName(
        gone.concepts.select("user_id", F.lit("concept").alias("kind"), F.col("concept_id").alias("entity_id"), stamp)
    )


def retract(
    tables: dict[str, DataFrame], notes: DataFrame, at: int, tombstone_cascades: bool = False
) -> dict[str, DataFrame]:
    """All tables after retracting the notes' extractions.

    The vanishing keys are found and written once; every table then drops them with one anti-join.
    """
    gone = find_gone(tables, notes, materialize=True)
    lost_edges = gone.edges.unionByName(gone.cascaded)
    out = dict(tables)
    out["concepts"] = without(tables["concepts"], gone.concepts, CONCEPT)
    out["edges"] = without(tables["edges"], lost_edges, EDGE)
    out["concept_provenance"] = without(without(tables["concept_provenance"], notes, NOTE), gone.concepts, CONCEPT)
    out["edge_provenance"] = without(without(tables["edge_provenance"], notes, NOTE), lost_edges, EDGE)
    for name in ("edge_type_history", "edge_inference_provenance"):
        if name in tables:
            out[name] = without(tables[name], lost_edges, EDGE)
    if "concept_embeddings" in tables:
        out["concept_embeddings"] = without(tables["concept_embeddings"], gone.concepts, CONCEPT)
    if "braindump_embeddings" in tables:
        out["braindump_embeddings"] = without(tables["braindump_embeddings"], notes, NOTE)
    if "merge_suggestions" in tables:
        kept = without(tables["merge_suggestions"], notes, NOTE)
        for end in ("new_concept_id", "existing_concept_id"):
            kept = without(kept, gone.concepts.withColumnRenamed("concept_id", end), ["user_id", end])
        out["merge_suggestions"] = kept
    stones = tombstone_rows(gone, at, tombstone_cascades)
    out["graph_tombstones"] = (
        tables["graph_tombstones"].unionByName(stones) if "graph_tombstones" in tables else stones
    )
    return out


def delete_notes(tables: dict[str, DataFrame], notes: DataFrame, at: int) -> tuple[dict[str, DataFrame], DataFrame]:
    """Retract and drop the notes; the second result says per request whether the note existed."""
    asked = notes.select(*NOTE).distinct()
    found = tables["braindumps"].select(*NOTE).withColumn("hit", F.lit(True))
    outcome = asked.join(found, NOTE, "left").select(*NOTE, F.coalesce("hit", F.lit(False)).alias("deleted"))
    known = outcome.where("deleted").select(*NOTE)
    out = retract(tables, known, at)
    out["braindumps"] = without(tables["braindumps"], known, NOTE)
    return out, outcome


__all__ = ["Gone", "delete_notes", "find_gone", "retract", "tombstone_rows", "with_both_ends", "without"]
