"""Edge type history: current type, next sequence number, retagged edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_types(history: DataFrame) -> DataFrame:
    """Last type per edge (``user_id, edge_id, current_type``), combined map-side."""
    return history.groupBy("user_id", "edge_id").agg(F.max_by("type_slug", "seq_index").alias("current_type"))


def latest_rows(history: DataFrame) -> DataFrame:
    """The whole last history row per edge; the rank filter prunes before the shuffle."""
    w = Window.partitionBy("user_id", "edge_id").orderBy(F.desc("seq_index"))
    return history.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def with_current_type(edges: DataFrame, history: DataFrame) -> DataFrame:
    """Edges plus ``current_type``; '' for an edge without history."""
    return edges.join(latest_types(history), ["user_id", "edge_id"], "left").withColumn(
        "current_type", F.coalesce("current_type", F.lit(""))
    )


def edges_wearing(edges: DataFrame, history: DataFrame, slug: str) -> DataFrame:
    return with_current_type(edges, history).where(F.col("current_type") == slug)


def next_seq(edges: DataFrame, history: DataFrame) -> DataFrame:
    """``user_id, edge_id, next_seq`` = last sequence number + 1, 0 for an edge without history."""
    tops = history.groupBy("user_id", "edge_id").agg(F.max("seq_index").alias("top"))
    return edges.select("user_id", "edge_id").join(tops, ["user_id", "edge_id"], "left").select(
        "user_id", "edge_id", (F.coalesce("top", F.lit(-1)) + 1).cast("bigint").alias("next_seq")
    )


def append_types(retags: DataFrame, history: DataFrame, at: int) -> DataFrame:
    """History rows to append for ``retags(user_id, edge_id, type_slug)``, one per edge."""
    return (
        retags.join(next_seq(retags, history), ["user_id", "edge_id"])
        .select(
            "user_id", "edge_id", F.col("next_seq").alias("seq_index"), "type_slug", F.lit(at).cast("bigint").alias("created_at")
        )
    )


def first_history(edges: DataFrame, at: int | None = None) -> DataFrame:
    """Sequence 0 of new edges: the original type."""
    stamp = F.col("created_at") if at is None else F.lit(at).cast("bigint")
    return edges.select(
        "user_id", "edge_id", F.lit(0).cast("bigint").alias("seq_index"),
        F.col("original_type").alias("type_slug"), stamp.alias("created_at"),
    )


def retagged_since(edges: DataFrame, history: DataFrame, since: int) -> DataFrame:
    """Edges known at ``since`` that got a later type after it, with their current type.

    One pass over the history gives both the current type and whether a late entry exists.
    """
    late = F.bool_or((F.col("seq_index") > 0) & (F.col("created_at") > since))
    folded = (
        history.groupBy("user_id", "edge_id")
        .agg(F.max_by("type_slug", "seq_index").alias("current_type"), late.alias("late"))
        .where("late")
        .drop("late")
    )
    return edges.where(F.col("created_at") <= since).join(folded, ["user_id", "edge_id"])
