"""Concept merges and their snapshot-side twins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .retract import without

REF = ["user_id", "concept_id"]


def decide_merges(requests: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Outcome of approval requests applied in order: ``approved``, ``not_found`` or ``same_concept``.

    ``requests(user_id, ord, suggestion_id)``. A merge removes its fold concept, and with it every later request
    that names that concept. The sequential result is found in rounds: a request is approved once no undecided or
    approved earlier request folds one of its concepts, and refused once an approved earlier one does. Per round
    only the earliest folder of each concept is kept, so a concept named by very many requests stays one row.
    """
    once = requests.groupBy("user_id", "suggestion_id").agg(F.min("ord").alias("first"))
    known = suggestions.select(
        "user_id", "suggestion_id", F.col("new_concept_id").alias("fold_id"), F.col("existing_concept_id").alias("keep_id")
    )
    asked = requests.join(once, ["user_id", "suggestion_id"]).join(known, ["user_id", "suggestion_id"], "left").withColumn(
        "state",
        F.when(F.col("fold_id").isNull() | (F.col("ord") > F.col("first")), F.lit("not_found"))
        .when(F.col("fold_id") == F.col("keep_id"), F.lit("same_concept"))
        .otherwise(F.lit("open")),
    ).drop("first")
    state = cut(asked, "merge_requests")
    while state.where("state = 'open'").limit(1).count():
        state = cut(_merge_round(state), "merge_round")
    return state


def _merge_round(state: DataFrame) -> DataFrame:
    folders = (
        state.where("state IN ('open', 'approved')")
        .groupBy("user_id", F.col("fold_id").alias("concept_id"))
        .agg(
            F.min(F.when(F.col("state") == "open", F.col("ord"))).alias("open_at"),
            F.min(F.when(F.col("state") == "approved", F.col("ord"))).alias("done_at"),
        )
    )
    out = state
    for end in ("fold", "keep"):
        out = out.join(
            folders.select(
                "user_id", F.col("concept_id").alias(f"{end}_id"),
                F.col("open_at").alias(f"{end}_open"), F.col("done_at").alias(f"{end}_done"),
            ),
            ["user_id", f"{end}_id"], "left",
        )
    before = lambda c: F.coalesce(F.col(c) < F.col("ord"), F.lit(False))
    refused = before("fold_done") | before("keep_done")
    waits = before("fold_open") | before("keep_open")
    return out.withColumn(
        "state",
        F.when(F.col("state") != "open", F.col("state")).when(refused, F.lit("not_found"))
        .when(waits, F.lit("open")).otherwise(F.lit("approved")),
    ).select(*state.columns)


def fold_map(decided: DataFrame) -> DataFrame:
    """``user_id, concept_id, root_id, depth, ord``: where each folded concept ends up, by pointer doubling."""
    links = cut(
        decided.where("state = 'approved'").select(
            "user_id", F.col("fold_id").alias("concept_id"), F.col("keep_id").alias("root_id"), F.lit(1).alias("depth"), "ord"
        ),
        "fold_links",
    )
    while True:
        up = links.select(
            "user_id", F.col("concept_id").alias("root_id"), F.col("root_id").alias("next_id"), F.col("depth").alias("more")
        )
        stepped = cut(
            links.join(up, ["user_id", "root_id"], "left").select(
                "user_id", "concept_id", F.coalesce("next_id", "root_id").alias("root_id"),
                (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), "ord",
                F.col("next_id").isNotNull().alias("moved"),
            ),
            "fold_step",
        )
        links = stepped.drop("moved")
        if not stepped.where("moved").limit(1).count():
            return links


def repoint(edges: DataFrame, folds: DataFrame) -> DataFrame:
    """Edges with ``new_source``, ``new_target`` and how far each end moved."""
    out = edges
    for end in ("source", "target"):
        out = out.join(
            folds.select(
                "user_id", F.col("concept_id").alias(f"{end}_concept_id"), F.col("root_id").alias(f"{end}_root"),
                F.col("depth").alias(f"{end}_depth"), F.col("ord").alias(f"{end}_ord"),
            ),
            ["user_id", f"{end}_concept_id"], "left",
        )
    return out.select(
        *edges.columns,
        F.coalesce("source_root", "source_concept_id").alias("new_source"),
        F.coalesce("target_root", "target_concept_id").alias("new_target"),
        (F.coalesce("source_depth", F.lit(0)) + F.coalesce("target_depth", F.lit(0))).alias("moved"),
        F.coalesce(F.least("source_ord", "target_ord"), F.lit(-1)).alias("moved_at"),
    )


@dataclass
class Merged:
    edges: DataFrame
    survivors: DataFrame


def collapse(edges: DataFrame, folds: DataFrame) -> Merged:
    """Repoint and collapse equal (source, original type, target); ``survivors`` maps every edge to its keeper.

    The keeper is the edge that moved least (so one already there wins), then the earliest moved, then lowest id.
    """
    moved = repoint(edges, folds)
    key = ["user_id", "new_source", "original_type", "new_target"]
    keeper = moved.groupBy(*key).agg(
        F.min(F.struct("moved", "moved_at", "edge_id", "created_at")).alias("k")
    )
    kept = keeper.select(
        "user_id", F.col("k.edge_id").alias("edge_id"), F.col("new_source").alias("source_concept_id"),
        F.col("new_target").alias("target_concept_id"), "original_type", F.col("k.created_at").alias("created_at"),
    )
    survivors = moved.select(*key, "edge_id").join(keeper, key).select(
        "user_id", "edge_id", F.col("k.edge_id").alias("keeper_id")
    )
    return Merged(kept, survivors)


def move_provenance(provenance: DataFrame, survivors: DataFrame) -> DataFrame:
    """Edge provenance carried to the keepers, as a set."""
    return (
        provenance.join(survivors, ["user_id", "edge_id"])
        .drop("edge_id").withColumnRenamed("keeper_id", "edge_id").select(*provenance.columns).dropDuplicates()
    )


def move_extractors(concept_provenance: DataFrame, folds: DataFrame) -> DataFrame:
    return (
        concept_provenance.join(folds.select("user_id", "concept_id", "root_id"), REF, "left")
        .select("user_id", F.coalesce("root_id", "concept_id").alias("concept_id"), "braindump_id").distinct()
    )


def merge_concepts(
    tables: dict[str, DataFrame], requests: DataFrame, parity: bool = False, at: int | None = None,
    emit_merge_changes: bool = False,
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Approve merge suggestions in request order; returns the new tables and the outcome per request.

    With ``parity`` a collapsed edge's inference provenance goes with it; by default it moves to the keeper.
    ``emit_merge_changes`` adds tombstones for folded concepts and collapsed edges.
    """
    decided = decide_merges(requests, tables["merge_suggestions"])
    folds = fold_map(decided)
    merged = collapse(tables["edges"], folds)
    survivors = cut(merged.survivors, "survivors")
    out = dict(tables)
    out["edges"] = merged.edges.select(*tables["edges"].columns)
    out["edge_provenance"] = move_provenance(tables["edge_provenance"], survivors)
    collapsed = survivors.where("edge_id <> keeper_id").select("user_id", "edge_id")
    if "edge_inference_provenance" in tables:
        inferred = tables["edge_inference_provenance"]
        out["edge_inference_provenance"] = (
            without(inferred, collapsed, ["user_id", "edge_id"]) if parity else move_provenance(inferred, survivors)
        )
    if "edge_type_history" in tables:
        out["edge_type_history"] = without(tables["edge_type_history"], collapsed, ["user_id", "edge_id"])
    out["concept_provenance"] = move_extractors(tables["concept_provenance"], folds)
    for name in ("concepts", "concept_embeddings"):
        if name in tables:
            out[name] = without(tables[name], folds, REF)
    kept = tables["merge_suggestions"]
    for end in ("new_concept_id", "existing_concept_id"):
        kept = without(kept, folds.withColumnRenamed("concept_id", end), ["user_id", end])
    out["merge_suggestions"] = kept
    if emit_merge_changes:
        stamp = F.lit(at).cast("bigint").alias("created_at")
        stones = collapsed.select("user_id", F.lit("edge").alias("kind"), F.col("edge_id").alias("entity_id"), stamp)
        stones = stones.unionByName(
            folds.select("user_id", F.lit("concept").alias("kind"), F.col("concept_id").alias("entity_id"), stamp)
        )
        out["graph_tombstones"] = tables["graph_tombstones"].unionByName(stones)
    return out, decided.select("user_id", "ord", "suggestion_id", F.col("state").alias("outcome"))


def reject_suggestions(suggestions: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop rejected suggestions; the outcome names requests without a row."""
    key = ["user_id", "suggestion_id"]
    asked = requests.select(*key).distinct()
    outcome = asked.join(suggestions.select(*key).withColumn("hit", F.lit(True)), key, "left").select(
        *key, F.when(F.col("hit"), F.lit("rejected")).otherwise(F.lit("not_found")).alias("outcome")
    )
    return without(suggestions, asked, key), outcome


# --- snapshot side: the view a reader holds -------------------------------------------------------
def merge_in_view(concepts: DataFrame, edges: DataFrame, partitions: DataFrame, folds: DataFrame):
    """Fold concepts in a held snapshot: self-loops go, duplicates stay (unlike the stored merge)."""
    held = folds.join(concepts.select(*REF), REF, "left_semi")
    touched = held.select("user_id").distinct().withColumn("touched", F.lit(True))
    rest = [c for c in edges.columns if c not in ("source_concept_id", "target_concept_id")]
    view = (
        repoint(edges, held)
        .join(touched, "user_id", "left")
        .where("touched IS NULL OR new_source <> new_target")
        .select(*rest, F.col("new_source").alias("source_concept_id"), F.col("new_target").alias("target_concept_id"))
    )
    return without(concepts, held, REF), view, without(partitions, held, REF)


def retype_in_view(edges: DataFrame, from_type: str, to_type: str) -> DataFrame:
    return edges.withColumn(
        "current_type", F.when(F.col("current_type") == from_type, F.lit(to_type)).otherwise(F.col("current_type"))
    )
