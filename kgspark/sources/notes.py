"""Notes: arrival, corrections, ingest status, tenant backfill."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import ranked
from ..schema import empty

KEY = ["user_id", "braindump_id"]


def insert_notes(arrivals: DataFrame, existing: DataFrame, at: int, order: list[str]) -> DataFrame:
    """Rows to append for non-blank ``arrivals(user_id, verbatim, <order>)``: pending, not yet cleaned.

    Ids follow arrival order after the largest stored id; the numbering is distributed.
    """
    top = existing.agg(F.coalesce(F.max("braindump_id"), F.lit(0))).head()[0]
    kept = arrivals.where(F.length(F.trim("verbatim")) > 0)
    numbered = ranked(kept, [], [F.col(c) for c in order])
    return numbered.select(
        "user_id", (F.lit(top) + F.col("rank")).cast("bigint").alias("braindump_id"), "verbatim",
        F.lit("").alias("cleaned"), F.lit(at).cast("bigint").alias("created_at"), F.lit("pending").alias("ingest_status"),
        F.lit(0).alias("ingest_attempts"), F.lit(None).cast("bigint").alias("last_attempt_at"),
    )


def correct_notes(notes: DataFrame, corrections: DataFrame) -> DataFrame:
    """Newest correction per note in place of its texts; id and creation time stay.

    ``corrections(user_id, braindump_id, verbatim, cleaned, corrected_at)``.
    """
    newest = corrections.groupBy(*KEY).agg(
        F.max_by(F.struct("verbatim", "cleaned"), F.struct("corrected_at", "verbatim")).alias("new")
    )
    return notes.join(newest, KEY, "left").select(
        *[
            F.coalesce(F.col(f"new.{c}"), F.col(c)).alias(c) if c in ("verbatim", "cleaned") else F.col(c)
            for c in notes.columns
        ]
    )


def first_notes(ingested: DataFrame, rejects: DataFrame, at: int) -> DataFrame:
    """``settle_notes`` for notes that are all seen for the first time, one row each: nothing is grouped or joined but the few rejects."""
    stamp = F.lit(at).cast("bigint")
    return ingested.join(rejects.select(*KEY, "reason"), KEY, "left").select(
        *KEY, "verbatim", F.lit("").alias("cleaned"), stamp.alias("created_at"),
        F.when(F.col("reason").isNull(), "complete").otherwise("failed").alias("ingest_status"), F.lit(1).alias("ingest_attempts"),
        stamp.alias("last_attempt_at"),
    )


def settle_notes(notes: DataFrame, ingested: DataFrame, rejects: DataFrame, at: int) -> DataFrame:
    """Notes after an ingest of ``ingested(user_id, braindump_id, verbatim)``: complete, or failed if among ``rejects``.

    A note seen for the first time is added; a known one keeps its texts and counts one attempt more.
    """
    stamp = F.lit(at).cast("bigint")
    tried = ingested.groupBy(*KEY).agg(F.min("verbatim").alias("arrived")).join(rejects.select(*KEY, "reason"), KEY, "left")
    tried = tried.select(*KEY, "arrived", F.when(F.col("reason").isNull(), "complete").otherwise("failed").alias("outcome"))
    fresh = {
        "verbatim": F.coalesce("verbatim", "arrived"), "cleaned": F.coalesce("cleaned", F.lit("")), "created_at": F.coalesce("created_at", stamp),
        "ingest_status": F.coalesce("outcome", "ingest_status"), "last_attempt_at": F.when(F.col("outcome").isNotNull(), stamp).otherwise(F.col("last_attempt_at")),
        "ingest_attempts": F.coalesce("ingest_attempts", F.lit(0)) + F.col("outcome").isNotNull().cast("int"),
    }
    return notes.join(tried, KEY, "full").select(*[fresh[c].alias(c) if c in fresh else F.col(c) for c in notes.columns])


def fold_attempts(attempts: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Status per note from its attempts in order: the first final outcome (complete or failed) decides.

    A transient failure leaves the note pending; attempts after a final outcome never ran.
    """
    key = key or ["braindump_id"]
    final = F.min(F.when(F.col("outcome") != "transient", F.struct("attempt", "outcome", "attempted_at")))
    last = F.max(F.struct("attempt", "attempted_at"))
    return attempts.groupBy(*key).agg(final.alias("f"), last.alias("l")).select(
        *key, F.coalesce("f.outcome", F.lit("pending")).alias("ingest_status"),
        F.coalesce("f.attempt", "l.attempt").cast("int").alias("ingest_attempts"),
        F.coalesce("f.attempted_at", "l.attempted_at").alias("last_attempt_at"),
    )


def pending_notes(notes: DataFrame) -> DataFrame:
    return notes.where("ingest_status = 'pending'").select(*KEY)


def upgrade(old: DataFrame, name: str, default_user: str) -> DataFrame:
    """Bring rows of an older layout to the current schema: missing columns, null tenant, null status."""
    blank = empty(old.sparkSession, name)
    full = blank.unionByName(old, allowMissingColumns=True)
    fills = {"user_id": F.lit(default_user), "ingest_status": F.lit("complete"), "ingest_attempts": F.lit(0)}
    return full.select(
        *[F.coalesce(F.col(c), fills[c]).alias(c) if c in fills else F.col(c) for c in blank.columns]
    )
