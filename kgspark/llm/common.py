"""Small helpers that the operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, freeing_shuffles, scratch_path

__all__ = ["cut", "scratch_path", "table", "fold_of", "freeing_shuffles", "small_batches", "stage"]

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(doc_id: Column | str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    text = F.coalesce(F.col(doc_id) if isinstance(doc_id, str) else doc_id, F.lit(None)).cast("string")
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary")) % folds


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let batches of texts on their way to Python hold fewer rows; a smaller setting of the session's own stays."""
    now = int(spark.conf.get(_BATCH, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(_BATCH, str(rows))


def stage(df: DataFrame, name: str, few: bool = False) -> DataFrame:
    """``cut`` that leaves no shuffle files behind: what is read later is the written table.

    ``few`` is for tables that are small beside the input, as ids and links are: one file per core at most instead of one per
    shuffle partition. Every file costs the store calls of its own.
    """
    spark = df.sparkSession
    with freeing_shuffles(spark):
        return cut(df.coalesce(max(1, spark.sparkContext.defaultParallelism)) if few else df, name)
