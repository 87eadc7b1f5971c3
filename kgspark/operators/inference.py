"""Proposed edges from chat: validation, frozen snapshots, endorsement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import blank_to_null, edge_key
from ..schema import STRUCTURAL, THEMATIC
from . import queues
from .lookups import traversable
from .provenance import add_provenance, cluster_evidence


def path_fault(path: Column, source: Column, target: Column) -> Column:
    """Null for a usable evidence path, else what is wrong with it."""
    n = F.size(path)
    joined = F.zip_with(
        F.slice(path, 1, F.greatest(n - 1, F.lit(0))), F.slice(path, 2, F.greatest(n - 1, F.lit(0))),
        lambda a, b: a["target_concept_id"] == b["source_concept_id"],
    )
    return (
        F.when(path.isNull() | (n == 0), F.lit("empty_path"))
        .when(F.element_at(path, 1)["source_concept_id"] != source, F.lit("wrong_start"))
        .when(F.element_at(path, -1)["target_concept_id"] != target, F.lit("wrong_end"))
        .when(~F.forall(joined, lambda ok: ok), F.lit("not_connected"))
    )


def cluster_members(ids: Column) -> Column:
    return F.array_sort(F.array_distinct(ids))


def cluster_fault(ids: Column, source: Column, target: Column) -> Column:
    return (
        F.when(source == target, F.lit("same_ends"))
        .when(ids.isNull() | (F.size(ids) == 0), F.lit("empty_cluster"))
        .when(~(F.array_contains(ids, source) & F.array_contains(ids, target)), F.lit("end_outside_cluster"))
    )


def _sanctioned(requests: DataFrame, ontology: DataFrame) -> DataFrame:
    known = ontology.select("user_id", F.col("slug").alias("proposed_type"), F.lit(True).alias("sanctioned")).distinct()
    return requests.join(known, ["user_id", "proposed_type"], "left")


def untraversable(requests: DataFrame, edges: DataFrame, history: DataFrame) -> DataFrame:
    """Proposals with at least one hop that no edge wears as its current type."""
    hops = requests.select("user_id", "proposal_id", F.explode("evidence_path").alias("hop")).select(
        "user_id", "proposal_id", "hop.source_concept_id", "hop.edge_type", "hop.target_concept_id"
    )
    keys = ["user_id", "source_concept_id", "edge_type", "target_concept_id"]
    real = traversable(hops.select(*keys).distinct(), edges, history)
    return hops.join(real, keys, "left_anti").select("user_id", "proposal_id").distinct()


def propose_structural(
    requests: DataFrame, ontology: DataFrame, edges: DataFrame, history: DataFrame, at: int
) -> DataFrame:
    """Structural proposals with ``status`` pending, or null and a ``reason``."""
    shaped = requests.withColumn(
        "shape_fault",
        F.when(F.trim("proposed_type") == "", F.lit("blank_type")).otherwise(
            path_fault(F.col("evidence_path"), F.col("source_concept_id"), F.col("target_concept_id"))
        ),
    ).withColumn("proposed_type", F.trim("proposed_type"))
    broken = untraversable(shaped, edges, history).withColumn("broken", F.lit(True))
    return (
        _sanctioned(shaped, ontology)
        .join(broken, ["user_id", "proposal_id"], "left")
        .withColumn(
            "reason",
            F.when(F.col("shape_fault").isNotNull(), F.col("shape_fault"))
            .when(F.col("sanctioned").isNull(), F.lit("unknown_type"))
            .when(F.col("broken"), F.lit("not_traversable")),
        )
        .select(
            "user_id", "proposal_id", F.lit(STRUCTURAL).alias("mode"), "source_concept_id", "target_concept_id",
            "proposed_type", "evidence_path", blank_to_null(F.col("rationale")).alias("rationale"),
            F.lit(None).cast("string").alias("snapshot_id"),
            F.when(F.col("reason").isNull(), F.lit("pending")).alias("status"),
            F.lit(at).cast("bigint").alias("created_at"), F.lit(None).cast("bigint").alias("resolved_at"), "reason",
        )
    )


def propose_thematic(
    requests: DataFrame, ontology: DataFrame, concepts: DataFrame, edges: DataFrame, edge_provenance: DataFrame, at: int
) -> tuple[DataFrame, DataFrame]:
    """(proposals, frozen snapshots). ``requests`` carry ``cluster_concept_ids``.

    The snapshot's notes are computed from the graph: those asserting edges inside the cluster.
    """
    shaped = requests.withColumn("members", cluster_members(F.col("cluster_concept_ids"))).withColumn(
        "shape_fault",
        F.when(F.trim("proposed_type") == "", F.lit("blank_type")).otherwise(
            cluster_fault(F.col("members"), F.col("source_concept_id"), F.col("target_concept_id"))
        ),
    ).withColumn("proposed_type", F.trim("proposed_type"))
    key = ["user_id", "proposal_id"]
    members = shaped.where("shape_fault IS NULL").select(*key, F.explode("members").alias("concept_id"))
    missing = members.join(concepts.select("user_id", "concept_id"), ["user_id", "concept_id"], "left_anti").select(
        *key
    ).distinct().withColumn("missing", F.lit(True))
    evidence = (
        cluster_evidence(members.withColumnRenamed("proposal_id", "cluster_id"), edges, edge_provenance)
        .groupBy("user_id", F.col("cluster_id").alias("proposal_id"))
        .agg(F.sort_array(F.collect_set("braindump_id")).alias("braindump_ids"))
    )
    judged = (
        _sanctioned(shaped, ontology).join(missing, key, "left").join(evidence, key, "left")
        .withColumn(
            "reason",
            F.when(F.col("shape_fault").isNotNull(), F.col("shape_fault"))
            .when(F.col("sanctioned").isNull(), F.lit("unknown_type"))
            .when(F.col("missing"), F.lit("unknown_member"))
            .when(F.col("braindump_ids").isNull(), F.lit("no_evidence")),
        )
        .withColumn("snapshot_id", F.when(F.col("reason").isNull(), F.concat(F.lit("t:"), F.col("proposal_id"))))
    )
    proposals = judged.select(
        *key, F.lit(THEMATIC).alias("mode"), "source_concept_id", "target_concept_id", "proposed_type",
        F.array().cast("array<struct<source_concept_id:string,edge_type:string,target_concept_id:string>>").alias("evidence_path"),
        blank_to_null(F.col("rationale")).alias("rationale"), "snapshot_id",
        F.when(F.col("reason").isNull(), F.lit("pending")).alias("status"),
        F.lit(at).cast("bigint").alias("created_at"), F.lit(None).cast("bigint").alias("resolved_at"), "reason",
    )
    snapshots = judged.where("reason IS NULL").select(
        "user_id", "snapshot_id", "braindump_ids", F.col("members").alias("concept_ids"),
        F.lit(at).cast("bigint").alias("captured_at"),
    )
    return proposals, snapshots


def endorse(tables: dict[str, DataFrame], requests: DataFrame, at: int) -> tuple[dict[str, DataFrame], DataFrame]:
    """Endorse pending proposals: find or create the edge, add inference provenance, resolve the queue row."""
    proposals = tables["chat_inference_proposals"]
    decided = queues.decide(requests.withColumn("action", F.lit("endorsed")), proposals, "proposal_id")
    key = ["user_id", "source_concept_id", "original_type", "target_concept_id"]
    won = (
        decided.where("outcome = 'endorsed'").select("user_id", "proposal_id")
        .join(proposals, ["user_id", "proposal_id"])
        .withColumnRenamed("proposed_type", "original_type")
    )
    held = tables["edges"].select(*key, F.col("edge_id").alias("held_id"))
    stamp = F.lit(at).cast("bigint")
    resolved = won.join(held, key, "left").withColumn(
        "edge_id",
        F.coalesce("held_id", edge_key(F.col("source_concept_id"), F.col("original_type"), F.col("target_concept_id"))),
    )
    new = resolved.where("held_id IS NULL").select("edge_id", *key, stamp.alias("created_at")).distinct()
    out = dict(tables)
    out["edges"] = tables["edges"].unionByName(new.select(*tables["edges"].columns))
    out["edge_type_history"] = tables["edge_type_history"].unionByName(
        new.select("user_id", "edge_id", F.lit(0).cast("bigint").alias("seq_index"),
                   F.col("original_type").alias("type_slug"), "created_at")
    )
    added = resolved.select(
        "user_id", "edge_id", F.col("proposal_id").alias("chat_inference_id"), "mode", "snapshot_id", stamp.alias("created_at")
    )
    out["edge_inference_provenance"] = add_provenance(tables["edge_inference_provenance"], added)
    out["chat_inference_proposals"] = queues.resolve(proposals, decided, "proposal_id", at)
    return out, decided.drop("action")


def endorsed_in_view(links: DataFrame, concepts: DataFrame, endorsed: DataFrame) -> DataFrame:
    """A held view with endorsed edges added, unless an endpoint is unknown or the link is already there.

    ``links(user_id, source_concept_id, target_concept_id, label)``.
    """
    from .provenance import with_both_ends

    cols = ["user_id", "source_concept_id", "target_concept_id", "label"]
    new = with_both_ends(
        endorsed.select("user_id", "source_concept_id", "target_concept_id", F.col("proposed_type").alias("label")).distinct(),
        concepts,
    )
    return links.select(*cols).unionByName(new.join(links, cols, "left_anti").select(*cols))
