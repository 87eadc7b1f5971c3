"""Grounded context per query and gating of the answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import cites_cluster
from ..schema import SILENCE_TEXT

KEY = ["query_id", "user_id"]
PREAMBLE = (
    "Answer only from the notes and edges below. Cite notes as [bd:<id>] and edges as [edge:<source> -<type>→ <target>]. "
    "Follow only the listed edges. Clusters show structure and are never cited. "
    f'When the context does not answer, reply exactly: "{SILENCE_TEXT}".'
)


def _lines(rows: DataFrame, order: list[Column], line: Column, name: str, keys: list[str]) -> DataFrame:
    """The lines of one context section in order. A section is one prompt's text and goes to one model call."""
    packed = F.sort_array(F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], line.alias("line"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(packed, lambda s: s["line"]), "").alias(name))


def grounded_context(
    queries: DataFrame, notes: DataFrame, paths: DataFrame, braindumps: DataFrame, clusters: DataFrame
) -> DataFrame:
    """``query_id, user_id, context``: clusters, notes with their cleaned text, edges; ``(none)`` for an empty part.

    ``notes(query_id, user_id, braindump_id, score)``, ``paths`` from retrieval, and
    ``clusters(user_id, partition_id, cluster_label, concept_id, label)``.
    """
    cluster_line = clusters.groupBy("user_id", "partition_id", "cluster_label").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("concept_id", "label"))), lambda s: s["label"]), ", ").alias("members")
    )
    cluster_part = _lines(
        cluster_line, [F.col("partition_id")],
        F.concat(F.lit("["), "cluster_label", F.lit("] "), "members", F.lit("\n")), "clusters", ["user_id"],
    )
    note_part = _lines(
        notes.join(braindumps.select("user_id", "braindump_id", "cleaned"), ["user_id", "braindump_id"]),
        [-F.col("score"), F.col("braindump_id")],
        F.concat(F.lit("[bd:"), "braindump_id", F.lit("] "), "cleaned", F.lit("\n")), "notes", KEY,
    )
    path_part = _lines(
        paths, [F.col("edge_id")],
        F.concat("source_label", F.lit(" -"), "edge_type", F.lit("→ "), "target_label", F.lit("\n")), "paths", KEY,
    )
    none = lambda c: F.coalesce(F.col(c), F.lit("(none)\n"))
    return (
        queries.select(*KEY).join(note_part, KEY, "left").join(path_part, KEY, "left").join(cluster_part, "user_id", "left")
        .select(
            *KEY,
            F.concat(
                F.lit("Clusters:\n"), none("clusters"), F.lit("\nNotes:\n"), none("notes"), F.lit("\nEdges:\n"), none("paths")
            ).alias("context"),
        )
    )


def gate(answers: DataFrame, noted: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Silence answers without notes, silent answers, and answers that cite a cluster.

    ``noted`` holds the keys of queries with at least one note. A silent row carries no citations or paths.
    """
    key = key or KEY
    backed = noted.select(*key).distinct().withColumn("backed", F.lit(True))
    silent = (
        F.col("backed").isNull() | F.col("answer").isNull() | (F.trim("answer") == SILENCE_TEXT) | cites_cluster(F.col("answer"))
    )
    return answers.join(backed, key, "left").withColumn("silent", silent).withColumn(
        "answer", F.when(F.col("silent"), F.lit(SILENCE_TEXT)).otherwise(F.col("answer"))
    ).drop("backed")


def citations(gated: DataFrame, notes: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Notes (or paths) of the queries that were answered."""
    key = key or KEY
    return notes.join(gated.where("NOT silent").select(*key), key, "left_semi")
