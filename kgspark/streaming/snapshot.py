"""A held snapshot kept current by a stream of changes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.snapshot import Delta, Snapshot, apply_delta, net_changes
from ..session import scratch_path
from ..sources.changes import CHANGE
from ..sources.pointer import read_pointer, remove, write_pointer

__all__ = ["CHANGE", "HeldSnapshot", "delta_of", "start_snapshot"]

_PARTS = ("concepts", "edges", "partitions")


def delta_of(changes: DataFrame, cursor: int) -> Delta:
    """The five parts of a delta from one batch of change rows."""
    return net_changes(changes, cursor)


class HeldSnapshot:
    """The newest written snapshot with its cursor and batch, behind one pointer below ``root``.

    A batch writes its snapshot beside the old one and replaces the pointer last. Started again, the snapshot, the cursor and the
    batch are read back from the pointer, so a batch that was cut short is applied again to what it started from, a batch
    that was finished is not, and versions at or below the cursor are passed over even if the stream's checkpoint is lost.
    The snapshot before the newest stays for those who still read it; older ones are removed.
    """

    def __init__(self, spark: SparkSession, start: Snapshot, cursor: int = 0, root: str | None = None):
        self.spark, self.root = spark, (root or scratch_path(spark, "held")).rstrip("/")
        self.current, self.cursor, self.batch, self.paths = start, cursor, -1, []
        self._schemas = {name: getattr(start, name).schema for name in _PARTS}
        found = read_pointer(spark, self._pointer)
        if found:
            self.cursor, self.batch, self.paths = found["cursor"], found["batch"], found["paths"]
            self.current = self._read(self.paths[-1]) if self.paths else start

    @property
    def _pointer(self) -> str:
        return f"{self.root}/_held"

    def _read(self, path: str) -> Snapshot:
        return Snapshot(*[self.spark.read.schema(self._schemas[name]).parquet(f"{path}/{name}") for name in _PARTS])

    def apply(self, changes: DataFrame, batch_id: int) -> None:
        if batch_id <= self.batch:
            return
        changes = changes.where(F.col("version") > self.cursor)
        top = changes.agg(F.max("version")).head()[0]
        paths, cursor, current = self.paths, self.cursor, self.current
        if top is not None:
            after = apply_delta(self.current, delta_of(changes, top))
            # A path of its own for each try, so a try that was cut short leaves nothing that a later one reads.
            path = f"{self.root}/batch={batch_id}-{uuid.uuid4().hex}"
            for name in _PARTS:
                getattr(after, name).select(*self._schemas[name].names).write.parquet(f"{path}/{name}")
            paths, cursor, current = [*self.paths[-1:], path], top, self._read(path)
        write_pointer(self.spark, self._pointer, {"cursor": cursor, "batch": batch_id, "paths": paths})
        for old in set(self.paths) - set(paths):
            remove(self.spark, old)
        self.current, self.cursor, self.batch, self.paths = current, cursor, batch_id, paths


def start_snapshot(changes: DataFrame, held: HeldSnapshot, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    return (
        changes.writeStream.foreachBatch(held.apply).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )
