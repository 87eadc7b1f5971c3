"""Point reads, listings and enrichments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import snippet
from .history import with_current_type


def of_tenant(df: DataFrame, user_id: str) -> DataFrame:
    return df.where(F.col("user_id") == user_id)


def concept_ids_by_label(concepts: DataFrame) -> DataFrame:
    """Lowest id per exact label."""
    return concepts.groupBy("user_id", "label").agg(F.min("concept_id").alias("concept_id"))


def known_concepts(ids: DataFrame, concepts: DataFrame) -> DataFrame:
    return ids.join(concepts.select("user_id", "concept_id"), ["user_id", "concept_id"], "left_semi")


def find_edges(keys: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges by identity key (source, original type, target)."""
    key = ["user_id", "source_concept_id", "original_type", "target_concept_id"]
    return edges.join(keys.select(*key).distinct(), key, "left_semi")


def traversable(hops: DataFrame, edges: DataFrame, history: DataFrame) -> DataFrame:
    """``hops(user_id, source_concept_id, edge_type, target_concept_id)`` that some edge wears as current type."""
    typed = with_current_type(edges, history).select(
        "user_id", "source_concept_id", "target_concept_id", F.col("current_type").alias("edge_type")
    )
    return hops.join(typed, ["user_id", "source_concept_id", "edge_type", "target_concept_id"], "left_semi")


def endpoints_and_type(edges: DataFrame, history: DataFrame, concepts: DataFrame) -> DataFrame:
    """Both labels and the current type; edges without both endpoints drop out."""
    labels = concepts.select("user_id", "concept_id", "label")
    src = labels.select("user_id", F.col("concept_id").alias("source_concept_id"), F.col("label").alias("source_label"))
    tgt = labels.select("user_id", F.col("concept_id").alias("target_concept_id"), F.col("label").alias("target_label"))
    return (
        with_current_type(edges, history)
        .join(src, ["user_id", "source_concept_id"])
        .join(tgt, ["user_id", "target_concept_id"])
        .select("user_id", "edge_id", "source_label", "target_label", "current_type")
    )


def edge_endpoints(edges: DataFrame) -> DataFrame:
    return edges.select("user_id", "source_concept_id", "target_concept_id")


def suggestion_details(suggestions: DataFrame, concepts: DataFrame, braindumps: DataFrame) -> DataFrame:
    """Suggestions with the existing concept's label and a snippet of the note; '' where either is gone."""
    labels = concepts.select(
        "user_id", F.col("concept_id").alias("existing_concept_id"), F.col("label").alias("existing_concept_label")
    )
    notes = braindumps.select("user_id", "braindump_id", snippet(F.col("verbatim")).alias("braindump_snippet"))
    return (
        suggestions.join(labels, ["user_id", "existing_concept_id"], "left")
        .join(notes, ["user_id", "braindump_id"], "left")
        .withColumn("existing_concept_label", F.coalesce("existing_concept_label", F.lit("")))
        .withColumn("braindump_snippet", F.coalesce("braindump_snippet", F.lit("")))
    )


def proposals_with_snapshot(proposals: DataFrame, snapshots: DataFrame) -> DataFrame:
    return proposals.join(
        snapshots.select("user_id", "snapshot_id", "braindump_ids", "concept_ids", "captured_at"),
        ["user_id", "snapshot_id"], "left",
    )


def housekeeping_queue(details: DataFrame, type_proposals: DataFrame, ontology: DataFrame) -> DataFrame:
    """Concept suggestions and type proposals with a near match, in one review queue."""
    concepts = details.select(
        "user_id", F.col("suggestion_id").cast("string").alias("item_id"), F.lit("concept").alias("kind"),
        F.col("new_concept_label").alias("left_label"), F.col("existing_concept_label").alias("right_label"),
        F.col("similarity"), "braindump_snippet",
    )
    names = ontology.select("user_id", F.col("slug").alias("near_match_slug"), F.col("label").alias("near_label"))
    types = (
        type_proposals.where("near_match_slug IS NOT NULL")
        .join(names, ["user_id", "near_match_slug"], "left")
        .select(
            "user_id", F.col("proposal_id").cast("string").alias("item_id"), F.lit("type").alias("kind"),
            F.col("label").alias("left_label"), F.coalesce("near_label", "near_match_slug").alias("right_label"),
            F.coalesce("near_match_similarity", F.lit(0.0)).alias("similarity"),
            F.lit(None).cast("string").alias("braindump_snippet"),
        )
    )
    return concepts.unionByName(types)


def pending(queue: DataFrame) -> DataFrame:
    return queue.where("status = 'pending'")


def slug_exists(slugs: DataFrame, ontology: DataFrame) -> DataFrame:
    return slugs.join(ontology.select("user_id", "slug"), ["user_id", "slug"], "left_semi")
