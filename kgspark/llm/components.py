"""Connected components by alternating large and small stars; no adjacency list is ever gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """Edges (u, v) of longs to (u, v): each node that is not the smallest of its component, and that smallest node.

    A node with very many neighbours only ever meets their minimum, a combined aggregate. The minima are written before
    they are joined: a join of an aggregate on its own key would keep all rows of such a node in one task, a join of two tables
    Spark splits. Every round is written to the shared folder, so plans stay short.
    """
    now = stage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges", few=True)
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "lowest", few=True)
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stage(large, "large_star", few=True)
        low = stage(large.groupBy("u").agg(F.min("v").alias("m")), "lowest", few=True)
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = stage(small.select("e.u", "e.v").where("u <> v").distinct(), "small_star", few=True)
        after = _mark(now)
        if after == mark:
            break
        mark = after
    return now
