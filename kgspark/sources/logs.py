"""Log tail over an append-only log table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import LOG_TAIL_CAPACITY, LOG_TAIL_LIMIT


def tail(logs: DataFrame, limit: int = LOG_TAIL_LIMIT, capacity: int = LOG_TAIL_CAPACITY) -> DataFrame:
    """The newest ``min(limit, capacity)`` entries, newest first (a top-k, no full sort)."""
    return logs.orderBy(F.desc("timestamp"), F.desc("log_id")).limit(min(limit, capacity))


def search(logs: DataFrame, level: str | None = None, text: str = "") -> DataFrame:
    """Entries of a level whose message, target or fields contain ``text``, ignoring case."""
    out = logs if level is None else logs.where(F.col("level") == level)
    needle = text.strip().lower()
    if needle:
        out = out.where(F.contains(F.lower(F.concat_ws(" ", "message", "target", "fields")), F.lit(needle)))
    return out


def levels(logs: DataFrame) -> DataFrame:
    return logs.select("level").distinct()
