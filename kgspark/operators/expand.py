"""Hop-limited expansion, induced subgraph and the notes it rests on. Keyed by query, many queries per job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import hop_score
from ..schema import EXPAND_DEPTH
from ..session import cut


def neighbours(edges: DataFrame) -> DataFrame:
    """Undirected neighbour pairs, one row per direction (``user_id, concept_id, neighbour_id``)."""
    both = F.array(
        F.struct(F.col("source_concept_id").alias("concept_id"), F.col("target_concept_id").alias("neighbour_id")),
        F.struct(F.col("target_concept_id").alias("concept_id"), F.col("source_concept_id").alias("neighbour_id")),
    )
    return edges.where("source_concept_id <> target_concept_id").select("user_id", F.inline(both))


def expand(seeds: DataFrame, edges: DataFrame, concepts: DataFrame, depth: int = EXPAND_DEPTH) -> DataFrame:
    """Minimum hop per concept from ``seeds(query_id, user_id, concept_id)``, up to ``depth`` hops, undirected.

    Ids that are not concepts are ignored, as seeds and as neighbours. Each frontier is written once: its real size
    then decides how it meets the edges (a small one is broadcast and the edges are scanned in place, a large one is
    shuffled), and the result is written because retrieval reads it several times. A frontier is not reduced by what
    was visited before it; the final minimum settles that.
    """
    adjacency = neighbours(edges)
    known = concepts.select("user_id", "concept_id")
    columns = ["query_id", "user_id", "concept_id"]
    frontier = cut(
        seeds.select(*columns).distinct().join(known, ["user_id", "concept_id"], "left_semi").select(*columns), "frontier"
    )
    reached = frontier.withColumn("hops", F.lit(0))
    for hop in range(1, depth + 1):
        met = (
            frontier.join(adjacency, ["user_id", "concept_id"])
            .select("query_id", "user_id", F.col("neighbour_id").alias("concept_id"))
            .distinct()
        )
        frontier = cut(met.join(known, ["user_id", "concept_id"], "left_semi").select(*columns), "frontier")
        reached = reached.unionByName(frontier.withColumn("hops", F.lit(hop)))
    return cut(reached.groupBy(*columns).agg(F.min("hops").cast("int").alias("hops")), "hops")


def induced_edges(hops: DataFrame, typed_edges: DataFrame, concepts: DataFrame) -> DataFrame:
    """All edges with both ends visited by a query, with labels and current type."""
    visited = hops.select("query_id", "user_id", "concept_id")
    labels = concepts.select("user_id", "concept_id", "label")
    src = visited.join(labels, ["user_id", "concept_id"]).select(
        "query_id", "user_id", F.col("concept_id").alias("source_concept_id"), F.col("label").alias("source_label")
    )
    tgt = visited.join(labels, ["user_id", "concept_id"]).select(
        "query_id", "user_id", F.col("concept_id").alias("target_concept_id"), F.col("label").alias("target_label")
    )
    return (
        typed_edges.select("user_id", "edge_id", "source_concept_id", "target_concept_id", "current_type")
        .join(src, ["user_id", "source_concept_id"])
        .join(tgt, ["user_id", "query_id", "target_concept_id"])
        .select(
            "query_id", "user_id", "edge_id", "source_concept_id", "source_label",
            "target_concept_id", "target_label", F.col("current_type").alias("edge_type"),
        )
    )


def subgraph_notes(hops: DataFrame, concept_provenance: DataFrame) -> DataFrame:
    """Best hop score per note over the visited concepts it extracted (edge provenance plays no part)."""
    return (
        hops.join(concept_provenance.select("user_id", "concept_id", "braindump_id"), ["user_id", "concept_id"])
        .groupBy("query_id", "user_id", "braindump_id")
        .agg(F.min("hops").alias("hops"))
        .select("query_id", "user_id", "braindump_id", hop_score(F.col("hops")).alias("score"))
    )
