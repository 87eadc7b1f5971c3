"""Who asserted what: extractors, asserters, origins, cluster evidence, orphans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import BRAINDUMP
from ..session import cut


def of_known_parents(provenance: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Provenance rows whose parent row belongs to the same tenant."""
    return provenance.join(parents.select("user_id", key), ["user_id", key], "left_semi")


def packed(provenance: DataFrame, key: str) -> DataFrame:
    """One row per parent with its sorted distinct notes."""
    return provenance.groupBy("user_id", key).agg(
        F.sort_array(F.collect_set("braindump_id")).alias("braindump_ids")
    )


def add_provenance(existing: DataFrame, added: DataFrame) -> DataFrame:
    """Insert-or-ignore: the union as a set."""
    return existing.unionByName(added.select(*existing.columns)).dropDuplicates()


def origins(edge_provenance: DataFrame, inference_provenance: DataFrame) -> DataFrame:
    """Every asserter of every edge, tagged with its origin."""
    notes = edge_provenance.select(
        "user_id", "edge_id", F.lit(BRAINDUMP).alias("origin"), F.col("braindump_id").alias("asserter_id")
    )
    inferred = inference_provenance.select(
        "user_id", "edge_id", F.col("mode").alias("origin"), F.col("chat_inference_id").alias("asserter_id")
    )
    return notes.unionByName(inferred).dropDuplicates()


def origin_rollup(edge_provenance: DataFrame, inference_provenance: DataFrame) -> DataFrame:
    return origins(edge_provenance, inference_provenance).groupBy("user_id", "edge_id", "origin").agg(
        F.count(F.lit(1)).alias("asserters")
    )


def cluster_evidence(members: DataFrame, edges: DataFrame, edge_provenance: DataFrame) -> DataFrame:
    """Distinct notes asserting a non-self edge with both ends in the cluster.

    ``members(user_id, cluster_id, concept_id)`` -> ``user_id, cluster_id, braindump_id``.
    """
    src = members.select("user_id", "cluster_id", F.col("concept_id").alias("source_concept_id"))
    tgt = members.select("user_id", "cluster_id", F.col("concept_id").alias("target_concept_id"))
    inner = (
        edges.where("source_concept_id <> target_concept_id")
        .select("user_id", "edge_id", "source_concept_id", "target_concept_id")
        .join(src, ["user_id", "source_concept_id"])
        .join(tgt, ["user_id", "cluster_id", "target_concept_id"], "left_semi")
    )
    return (
        inner.select("user_id", "edge_id", "cluster_id")
        .join(edge_provenance, ["user_id", "edge_id"])
        .select("user_id", "cluster_id", "braindump_id")
        .distinct()
    )


def orphan_edges(edges: DataFrame, edge_provenance: DataFrame, inference_provenance: DataFrame) -> DataFrame:
    """Edges with neither a note nor an inference behind them."""
    asserted = edge_provenance.select("user_id", "edge_id").unionByName(
        inference_provenance.select("user_id", "edge_id")
    )
    return edges.join(asserted, ["user_id", "edge_id"], "left_anti")


def orphan_concepts(concepts: DataFrame, concept_provenance: DataFrame) -> DataFrame:
    return concepts.join(concept_provenance, ["user_id", "concept_id"], "left_anti")


def with_both_ends(edges: DataFrame, concepts: DataFrame) -> DataFrame:
    """Edges whose two endpoints are still concepts of the tenant.

    Edges are not shuffled by their ends: the ends that are no concepts are few and written once, and edges at them are left out.
    """
    source, target = "source_concept_id", "target_concept_id"
    edges = edges.dropna(subset=["user_id", source, target])
    ends = [edges.select("user_id", F.col(end).alias("concept_id")).distinct() for end in (source, target)]
    lost = cut(ends[0].unionByName(ends[1]).join(concepts.select("user_id", "concept_id"), ["user_id", "concept_id"], "left_anti").distinct(), "lost_ends")
    for end in (source, target):
        edges = edges.join(lost.withColumnRenamed("concept_id", end), ["user_id", end], "left_anti")
    return edges
