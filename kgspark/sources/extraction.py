"""Extraction JSON: concepts and edges per note, with a reject side."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import EXTRACTION
from ..session import cut, estimated_bytes

NOTE = ["user_id", "braindump_id"]

# Notes grow some fiftyfold when they are taken apart, so a task gets few bytes of them, whatever their number.
TASK_BYTES = 4 << 20
MOST_TASKS = 8192


@dataclass
class Extraction:
    concepts: DataFrame
    edges: DataFrame
    rejects: DataFrame
    # Concepts and edges lie in so many partitions by note.
    parts: int = 0


def note_parts(notes: DataFrame) -> int:
    """Partitions for whole notes that will be taken apart; a size that is not known (a stream's batch) gives the session's number."""
    spark, size = notes.sparkSession, estimated_bytes(notes)
    least = spark.sparkContext.defaultParallelism
    if size > 1 << 50:
        return int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(MOST_TASKS, -(-size // TASK_BYTES)))


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(c) == "", F.lit(True))


def read_payloads(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``user_id, braindump_id, <keep>, concepts, edges, reason``: the JSON of each note, and why it is refused (else null)."""
    # Rows of a generator are computed once; in a plain column the JSON would be parsed for each use of a field.
    once = raw.select(*NOTE, *keep, "payload", F.inline(F.array(F.struct(F.from_json("payload", EXTRACTION).alias("x")))))
    parsed = once.select(
        *NOTE, *keep,
        F.coalesce("x.concepts", F.array().cast("array<struct<label:string>>")).alias("concepts"),
        F.coalesce("x.edges", F.array().cast("array<struct<source:string,type:string,target:string>>")).alias("edges"),
        (F.col("x").isNull() | ~F.startswith(F.ltrim("payload"), F.lit("{"))).alias("broken"),
    )
    return parsed.withColumn(
        "reason",
        F.when(F.col("broken"), F.lit("not_json"))
        .when(F.exists("concepts", lambda c: _blank(c["label"])), F.lit("concept_label"))
        .when(
            F.exists("edges", lambda e: _blank(e["source"]) | _blank(e["type"]) | _blank(e["target"])), F.lit("edge_field")
        ),
    ).drop("broken")


def parse_extractions(raw: DataFrame, materialize: bool = False) -> Extraction:
    """``raw(user_id, braindump_id, payload)`` -> trimmed concepts and edges with positions, and rejected notes.

    A missing array is empty; a blank or missing field rejects the whole note, as does text that is not JSON.
    ``materialize`` writes the parsed notes once, for callers that use more than one result.
    A note is shuffled whole and taken apart behind the shuffle, so what is grouped by note afterwards is not shuffled again.
    """
    raw = raw.select(*NOTE, "payload")
    parts = 0 if materialize else note_parts(raw)
    parsed = read_payloads(raw if materialize else raw.repartition(parts, *NOTE))
    if materialize:
        parsed = cut(parsed, "parsed")
    good = parsed.where("reason IS NULL")
    parts = parts or note_parts(parsed)
    good = good.repartition(parts, *NOTE) if materialize else good
    concepts = good.select(*NOTE, F.posexplode("concepts").alias("pos", "c")).select(
        *NOTE, "pos", F.trim("c.label").alias("label")
    )
    edges = good.select(*NOTE, F.posexplode("edges").alias("pos", "e")).select(
        *NOTE, "pos", F.trim("e.source").alias("source"), F.trim("e.type").alias("type"), F.trim("e.target").alias("target")
    )
    return Extraction(concepts, edges, parsed.where("reason IS NOT NULL").select(*NOTE, "reason"), parts)
