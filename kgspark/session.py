"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "kgspark", master: str | None = None, **conf) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


_LOCAL: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """Folder that every executor can reach, taken from ``spark.checkpoint.dir``.

    Only a local session without the setting gets a folder of its own; a cluster must name one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    if "root" not in _LOCAL:
        _LOCAL["root"] = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
    return _LOCAL["root"]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/kgspark/{name}-{uuid.uuid4().hex}"


_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freeing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the statements inside go as soon as each statement ends (Spark's own switch)."""
    before = spark.conf.get(_FREE, None)
    if before is None:
        yield
        return
    spark.conf.set(_FREE, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREE, before)


def cut(df: DataFrame, name: str = "stage", codec: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This ends the lineage (so an iterative plan stays small), survives the loss of an executor and gives
    the next plan real file sizes to choose join strategies from. What is read later is the written table, so the shuffle
    files behind it go. ``codec`` replaces the session's compression, for tables that are as large as the input.
    """
    path = scratch_path(df.sparkSession, name)
    writer = df.write.option("compression", codec) if codec else df.write
    with freeing_shuffles(df.sparkSession):
        writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def settings(spark: SparkSession, **conf: str) -> Iterator[None]:
    """Session settings (``__`` for dots) for the jobs started inside."""
    names = {key.replace("__", "."): value for key, value in conf.items()}
    before = {name: spark.conf.get(name, None) for name in names}
    try:
        for name, value in names.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


# Input estimated below this many bytes per core may sit in fewer files than there are cores.
SPREAD_BYTES = 16 << 20


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate, without running anything; for a plain scan the size of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame) -> DataFrame:
    """Small input over as many partitions as there are cores, for stages that compute much per row.

    Decided from the optimizer's size estimate, without running anything; larger input is left as it is, and so are rows that
    their plan deals out already.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if estimated_bytes(df) >= cores * SPREAD_BYTES or "Repartition" in df._jdf.queryExecution().optimizedPlan().toString():
        return df
    return df.repartition(cores)
