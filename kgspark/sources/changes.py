"""The change log: every committed batch of graph changes under a version of its own.

Versions are folders (``version=N``) that appear whole, by a rename, and never change. A reader names the versions it wants,
above its cursor and up to the newest one it saw, so rows committed in one second, or while it reads, are neither lost
nor repeated; only those folders are scanned. ``epoch`` is the clock of the writer, for readers that still hold a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pointer import file_system

# Columns of a change; attributes that a kind of change lacks are null.
CHANGE = (
    "user_id string, change string, id string, label string, source_concept_id string, target_concept_id string, "
    "original_type string, current_type string, created_at bigint, version bigint"
)
COLUMNS = [c.split()[0] for c in CHANGE.split(", ")]


class ChangeLog:
    """One writer at a time appends; a second one that takes the same number fails and may try again."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def versions(self) -> list[int]:
        hadoop, fs, _ = file_system(self.spark, self.root)
        if not fs.exists(hadoop.Path(self.root)):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(hadoop.Path(self.root))]
        return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version="))

    def head(self) -> int:
        """The newest version, 0 before the first."""
        return max(self.versions(), default=0)

    def append(self, changes: DataFrame, version: int | None = None) -> int:
        """Commit ``changes`` as the next version (or one given, as a stream's batch id) and return it. A version that is there already stays."""
        hadoop, fs, conf = file_system(self.spark, self.root)
        version = self.head() + 1 if version is None else version
        if version in self.versions():
            return version
        fresh = f"{self.root}/_new-{uuid.uuid4().hex}"
        have = set(changes.columns)
        changes.select(*[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in COLUMNS[:-1]]).write.parquet(fresh)
        # Without the option to overwrite, a rename onto another writer's version fails.
        none = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
        hadoop.FileContext.getFileContext(fs.getUri(), conf).rename(hadoop.Path(fresh), hadoop.Path(f"{self.root}/version={version}"), none)
        return version

    def rows(self, since: int = 0, upto: int | None = None, epoch: int | None = None) -> DataFrame:
        """Changes of the versions in ``(since, upto]``, of which those after ``epoch`` if one is given."""
        upto = self.head() if upto is None else upto
        wanted = [v for v in self.versions() if since < v <= upto]
        if not wanted:
            return self.spark.createDataFrame([], CHANGE)
        paths = [f"{self.root}/version={v}" for v in wanted]
        found = self.spark.read.schema(CHANGE).option("basePath", self.root).parquet(*paths)
        return found if epoch is None else found.where(F.col("created_at") > epoch)
