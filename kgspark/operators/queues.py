"""Review queues: a pending item is resolved once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def decide(requests: DataFrame, queue: DataFrame, key: str) -> DataFrame:
    """``requests(user_id, <key>, ord, action)`` with ``outcome``: the action, ``conflict`` or ``not_found``.

    The earliest request for a pending item wins, of several at once the one whose action comes first in the alphabet, and
    of equal requests one; every other request for a known item conflicts.
    """
    on = ["user_id", key]
    earliest = requests.groupBy(*on).agg(F.min(F.struct("ord", "action")).alias("first"))
    equals = Window.partitionBy(*on, "ord", "action").orderBy("ord")
    requests = requests.withColumn("turn", F.row_number().over(equals))
    held = queue.select(*on, F.col("status").alias("held")).join(earliest, on)
    return (
        requests.join(held, on, "left")
        .withColumn(
            "outcome",
            F.when(F.col("held").isNull(), F.lit("not_found"))
            .when((F.col("held") == "pending") & (F.struct("ord", "action") == F.col("first")) & (F.col("turn") == 1), F.col("action"))
            .otherwise(F.lit("conflict")),
        )
        .drop("held", "first", "turn")
    )


def resolve(queue: DataFrame, decided: DataFrame, key: str, at: int) -> DataFrame:
    """The queue with accepted transitions applied (``status`` and ``resolved_at``)."""
    won = decided.where("outcome = action").select("user_id", key, F.col("action").alias("new_status"))
    return queue.join(won, ["user_id", key], "left").select(
        *[
            F.coalesce("new_status", "status").alias("status") if c == "status"
            else F.when(F.col("new_status").isNotNull(), F.lit(at).cast("bigint")).otherwise(F.col("resolved_at")).alias("resolved_at")
            if c == "resolved_at" else F.col(c)
            for c in queue.columns
        ]
    )
