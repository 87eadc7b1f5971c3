"""Graph tables as versioned parquet behind one pointer.

A commit writes the changed tables next to the old ones and replaces the pointer last, by an atomic rename. A job
that fails before that leaves every reader on the old version.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import TABLES, empty
from ..session import freeing_shuffles
from .pointer import read_pointer, write_pointer

# Clustering key next to the tenant; files sorted by it skip row groups on tenant and id filters.
_SORT = {
    "braindumps": "braindump_id", "ontology": "ontology_id", "concepts": "concept_id", "concept_provenance": "concept_id",
    "edges": "edge_id", "edge_provenance": "edge_id", "edge_type_history": "edge_id", "concept_embeddings": "concept_id",
    "braindump_embeddings": "braindump_id", "type_embeddings": "ontology_id",
    "ingest_rejects": "braindump_id",
}


def _parts(paths: str | list[str]) -> list[str]:
    """The folders of a table: one as a whole commit wrote it, and one of each commit that added rows since."""
    return [paths] if isinstance(paths, str) else paths


class GraphStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def state(self) -> dict:
        return read_pointer(self.spark, f"{self.root}/_current") or {"version": 0, "batch": None, "tables": {}}

    # --- tables -------------------------------------------------------------------------------
    def read(self, name: str, state: dict | None = None) -> DataFrame:
        paths = (state or self.state())["tables"]
        if name not in paths:
            return empty(self.spark, name)
        return self.spark.read.schema(TABLES[name]).parquet(*_parts(paths[name]))

    def tables(self) -> dict[str, DataFrame]:
        state = self.state()
        return {name: self.read(name, state) for name in TABLES}

    def commit(self, changed: dict[str, DataFrame], batch: int | None = None, added: dict[str, DataFrame] | None = None) -> int:
        """Write the changed tables and the rows added to others as the next version and move the pointer. Returns the version.

        Rows that are only added lie beside those before, in files sorted like them, so a commit costs what it adds.
        """
        state = self.state()
        version = state["version"] + 1
        paths = dict(state["tables"])
        for name, df in changed.items():
            out = self._columns(name, df)
            if name in _SORT:
                # Ranges over (tenant, id): a large tenant spreads over files, a small one sits in few row groups.
                out = out.repartitionByRange("user_id", _SORT[name])
            paths[name] = self._write(name, out, version)
        for name, df in (added or {}).items():
            paths[name] = [*_parts(paths.get(name, [])), self._write(name, self._columns(name, df), version)]
        write_pointer(self.spark, f"{self.root}/_current", {"version": version, "batch": state["batch"] if batch is None else batch, "tables": paths})
        return version

    def _columns(self, name: str, df: DataFrame) -> DataFrame:
        return df.select(*empty(self.spark, name).columns)

    def _write(self, name: str, df: DataFrame, version: int) -> str:
        path = f"{self.root}/{name}/v={version}-{uuid.uuid4().hex[:8]}"
        out = df.sortWithinPartitions("user_id", _SORT[name]) if name in _SORT else df
        # What is read later is the written table.
        with freeing_shuffles(self.spark):
            out.write.parquet(path)
        return path

    def point_read(self, name: str, user_id: str, key: str, value) -> DataFrame:
        """One row by tenant and id; both filters reach the parquet scan."""
        return self.read(name).where((F.col("user_id") == user_id) & (F.col(key) == value))
