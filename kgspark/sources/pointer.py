"""Small JSON documents in the shared store that are replaced as a whole."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


def file_system(spark: SparkSession, root: str):
    """(hadoop.fs package, file system, configuration) of a folder."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    return hadoop, hadoop.Path(root).getFileSystem(conf), conf


def read_pointer(spark: SparkSession, path: str) -> dict | None:
    hadoop, fs, _ = file_system(spark, path)
    if not fs.exists(hadoop.Path(path)):
        return None
    stream = fs.open(hadoop.Path(path))
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def write_pointer(spark: SparkSession, path: str, state: dict) -> None:
    """Readers see the old document or the new one: it is written beside and renamed over."""
    hadoop, fs, conf = file_system(spark, path)
    fresh = hadoop.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(fresh)
    out.write(bytearray(json.dumps(state).encode()))
    out.close()
    rename = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    rename[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(fs.getUri(), conf).rename(fresh, hadoop.Path(path), rename)


def remove(spark: SparkSession, path: str) -> None:
    hadoop, fs, _ = file_system(spark, path)
    fs.delete(hadoop.Path(path), True)
