"""Embedding collections: store, delete, look for missing vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import checked_dim


def insert_vectors(collection: DataFrame, added: DataFrame, key: str, dim: int) -> DataFrame:
    """Insert-or-ignore by id; a vector of the wrong width is an error."""
    fresh = added.select("user_id", key, checked_dim(F.col("embedding"), dim).alias("embedding")).dropDuplicates(["user_id", key])
    return collection.unionByName(fresh.join(collection.select("user_id", key), ["user_id", key], "left_anti"))


def delete_vectors(collection: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return collection.join(ids.select("user_id", key), ["user_id", key], "left_anti")


def with_vector(ids: DataFrame, collection: DataFrame, key: str) -> DataFrame:
    return ids.join(collection.select("user_id", key), ["user_id", key], "left_semi")


def without_vector(ids: DataFrame, collection: DataFrame, key: str) -> DataFrame:
    return ids.join(collection.select("user_id", key), ["user_id", key], "left_anti")
