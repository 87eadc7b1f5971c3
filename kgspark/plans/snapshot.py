"""Whole-graph snapshot, change feed and applying changes to a held snapshot."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import history as H
from ..operators.cluster import partition_ids
from ..operators.provenance import with_both_ends
from ..schema import NO_PARTITION
from ..session import cut
from ..sources.changes import ChangeLog

EDGE_VIEW = ["user_id", "edge_id", "source_concept_id", "target_concept_id", "original_type", "current_type", "created_at"]
CONCEPT_VIEW = ["user_id", "concept_id", "label", "created_at"]


@dataclass
class Snapshot:
    concepts: DataFrame
    edges: DataFrame
    partitions: DataFrame


def topology(concepts: DataFrame, edges: DataFrame, history: DataFrame, assignment: DataFrame | None = None) -> Snapshot:
    """Concepts, edges with current type, and partition ids for a given cluster assignment."""
    none = concepts.where("false").select("user_id", "concept_id", F.lit(0).alias("partition_id"))
    return Snapshot(
        concepts.select(*CONCEPT_VIEW),
        H.with_current_type(edges, history).select(*EDGE_VIEW),
        partition_ids(assignment) if assignment is not None else none,
    )


def view_nodes(snapshot: Snapshot) -> DataFrame:
    """Nodes with their cluster, -1 for none."""
    return snapshot.concepts.join(snapshot.partitions, ["user_id", "concept_id"], "left").select(
        "user_id", "concept_id", "label", F.coalesce("partition_id", F.lit(NO_PARTITION)).alias("group")
    )


def view_edges(snapshot: Snapshot) -> DataFrame:
    """Drawable edges: both ends known, no self-loops."""
    return with_both_ends(snapshot.edges.where("source_concept_id <> target_concept_id"), snapshot.concepts).select(
        "user_id", "edge_id", "source_concept_id", "target_concept_id", F.col("current_type").alias("label")
    )


@dataclass
class Delta:
    """What changed after a cursor; ``cursor`` is the one to ask with next."""

    added_concepts: DataFrame
    added_edges: DataFrame
    deleted_concepts: DataFrame
    deleted_edges: DataFrame
    retagged: DataFrame
    cursor: int

    def rows(self) -> DataFrame:
        """All changes as one feed of ``user_id, change, id, payload``."""
        parts = [
            self.added_concepts.select("user_id", F.lit("add_concept").alias("change"), F.col("concept_id").alias("id"), F.col("label").alias("payload")),
            self.added_edges.select("user_id", F.lit("add_edge").alias("change"), F.col("edge_id").alias("id"), F.col("current_type").alias("payload")),
            self.deleted_concepts.select("user_id", F.lit("delete_concept").alias("change"), F.col("concept_id").alias("id"), F.lit("").alias("payload")),
            self.deleted_edges.select("user_id", F.lit("delete_edge").alias("change"), F.col("edge_id").alias("id"), F.lit("").alias("payload")),
            self.retagged.select("user_id", F.lit("retag_edge").alias("change"), F.col("edge_id").alias("id"), F.col("current_type").alias("payload")),
        ]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out


def delta_since(
    concepts: DataFrame, edges: DataFrame, history: DataFrame, tombstones: DataFrame, since: int, now: int
) -> Delta:
    """Rows created strictly after ``since``, ids tombstoned after it, and known edges that were retagged.

    Additions and retags share one pass over the type history.
    """
    late = F.bool_or((F.col("seq_index") > 0) & (F.col("created_at") > since)).alias("late")
    folded = history.groupBy("user_id", "edge_id").agg(F.max_by("type_slug", "seq_index").alias("current_type"), late)
    typed = edges.join(folded, ["user_id", "edge_id"], "left").withColumn("current_type", F.coalesce("current_type", F.lit("")))
    recent = tombstones.where(F.col("created_at") > since)
    return Delta(
        concepts.where(F.col("created_at") > since).select(*CONCEPT_VIEW),
        typed.where(F.col("created_at") > since).select(*EDGE_VIEW),
        recent.where("kind = 'concept'").select("user_id", F.col("entity_id").alias("concept_id")),
        recent.where("kind = 'edge'").select("user_id", F.col("entity_id").alias("edge_id")),
        typed.where((F.col("created_at") <= since) & F.col("late")).select(
            "user_id", "edge_id", "source_concept_id", "target_concept_id", "original_type", "current_type"
        ),
        now,
    )


def net_changes(changes: DataFrame, cursor: int) -> Delta:
    """What a reader that holds everything before ``changes`` has to do: for each entity the last word of its rows.

    Inside a version an entity is added, then retagged, then deleted; over several versions the later one counts. An entity added
    and deleted since is listed as deleted, one deleted and added anew as deleted and added (a delta's deletions come first for it).
    """
    kind = F.element_at(F.split("change", "_"), 2)
    of = lambda change, value: F.max(F.when(F.col("change").startswith(change), value))
    row = F.struct("version", "label", "source_concept_id", "target_concept_id", "original_type", "current_type", "created_at")
    folded = changes.groupBy("user_id", kind.alias("kind"), "id").agg(
        of("add_", row).alias("added"), of("delete_", F.col("version")).alias("deleted"),
        of("retag_", F.struct("version", "created_at", "current_type")).alias("retag"),
    )
    # Five lists are read from it.
    folded = cut(folded, "net_changes")
    stays = F.col("deleted").isNull() | (F.col("added.version") > F.col("deleted"))
    fresh = folded.where(F.col("added").isNotNull() & stays)
    newer = F.when(F.col("retag.version") >= F.col("added.version"), F.col("retag.current_type"))
    edges = fresh.where("kind = 'edge'").select(
        "user_id", F.col("id").alias("edge_id"), "added.source_concept_id", "added.target_concept_id", "added.original_type",
        F.coalesce(newer, "added.current_type").alias("current_type"), "added.created_at",
    )
    gone = folded.where(F.col("deleted").isNotNull() & F.coalesce(F.col("added.version") <= F.col("deleted"), F.lit(True)))
    return Delta(
        fresh.where("kind = 'concept'").select("user_id", F.col("id").alias("concept_id"), "added.label", "added.created_at"),
        edges,
        gone.where("kind = 'concept'").select("user_id", F.col("id").alias("concept_id")),
        gone.where("kind = 'edge'").select("user_id", F.col("id").alias("edge_id")),
        folded.where("kind = 'edge' AND added IS NULL AND deleted IS NULL AND retag IS NOT NULL").select(
            "user_id", F.col("id").alias("edge_id"), "retag.current_type"
        ),
        cursor,
    )


def delta_since_version(log: ChangeLog, since: int, upto: int | None = None, epoch: int | None = None) -> Delta:
    """The net changes of the versions in ``(since, upto]``; the delta's cursor is the newest version it holds.

    Reading on from that cursor loses and repeats nothing, whatever second the rows were written in. ``epoch`` keeps rows
    strictly after a time instead, as :func:`delta_since` does.
    """
    upto = max(since, log.head()) if upto is None else upto
    return net_changes(log.rows(since, upto, epoch), upto)


def merge_by_id(existing: DataFrame, additions: DataFrame, key: list[str]) -> DataFrame:
    """Union by id; a row already held wins."""
    return existing.unionByName(additions.dropDuplicates(key).join(existing.select(*key), key, "left_anti"))


def apply_delta(snapshot: Snapshot, delta: Delta) -> Snapshot:
    """Adds, then deletions (with edges and partitions of deleted concepts), then retags. Idempotent."""
    gone = delta.deleted_concepts.select("user_id", "concept_id").distinct()
    concepts = merge_by_id(snapshot.concepts, delta.added_concepts, ["user_id", "concept_id"]).join(
        gone, ["user_id", "concept_id"], "left_anti"
    )
    edges = merge_by_id(snapshot.edges, delta.added_edges, ["user_id", "edge_id"]).join(
        delta.deleted_edges.select("user_id", "edge_id"), ["user_id", "edge_id"], "left_anti"
    )
    for end in ("source_concept_id", "target_concept_id"):
        edges = edges.join(gone.withColumnRenamed("concept_id", end), ["user_id", end], "left_anti")
    retags = delta.retagged.select("user_id", "edge_id", F.col("current_type").alias("retag")).dropDuplicates(["user_id", "edge_id"])
    edges = edges.join(retags, ["user_id", "edge_id"], "left").withColumn(
        "current_type", F.coalesce("retag", "current_type")
    ).select(*EDGE_VIEW)
    return Snapshot(concepts, edges, snapshot.partitions.join(gone, ["user_id", "concept_id"], "left_anti"))


def write_snapshot(snapshot: Snapshot, path: str) -> None:
    """The snapshot as gzip JSON lines, one folder per list."""
    for name in ("concepts", "edges", "partitions"):
        getattr(snapshot, name).write.mode("overwrite").option("compression", "gzip").json(f"{path}/{name}")


def read_snapshot(spark, path: str) -> Snapshot:
    concept = "user_id string, concept_id string, label string, created_at bigint"
    edge = ("user_id string, edge_id string, source_concept_id string, target_concept_id string, original_type string, "
            "current_type string, created_at bigint")
    part = "user_id string, concept_id string, partition_id int"
    read = lambda name, schema: spark.read.schema(schema).json(f"{path}/{name}")
    return Snapshot(read("concepts", concept), read("edges", edge), read("partitions", part))
