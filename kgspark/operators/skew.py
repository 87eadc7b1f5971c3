"""Helpers that keep a hot key from landing in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def ranked(df: DataFrame, partition: list[str], order: list[Column], name: str = "rank", parts: int | None = None) -> DataFrame:
    """1-based row number per ``partition`` in ``order``, without gathering a partition in one task.

    Rows are range-partitioned on (partition, order), numbered inside each range, and shifted by the sizes of the
    ranges before. The numbered ranges are written once, because a re-run could sample other range bounds.
    """
    keys = [F.col(c) for c in partition]
    pieces = df.repartitionByRange(parts, *keys, *order) if parts else df.repartitionByRange(*keys, *order)
    pieces = cut(pieces.withColumn("_piece", F.spark_partition_id()), "ranked")
    local = Window.partitionBy(*partition, "_piece").orderBy(*order)
    numbered = pieces.withColumn("_local", F.row_number().over(local))
    # One row per (key, range): at most the number of ranges per key.
    sizes = pieces.groupBy(*partition, "_piece").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*partition).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return (
        numbered.join(offsets, [*partition, "_piece"])
        .withColumn(name, (F.col("_local") + F.col("_offset")).cast("bigint"))
        .drop("_piece", "_local", "_offset")
    )
