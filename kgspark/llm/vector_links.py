"""Embedding near-duplicates: all pairs with a cosine at or above a threshold, by PCA-ordered tiles.

Equal vectors shrink to one row with a count. A rotation to principal axes, fitted on all vectors, puts the large
components first. Vectors lie in tiles along their angle to the first axis; two tiles whose angles are further apart than the threshold
allows never meet. Where tiles meet, the leading components are multiplied first; the Cauchy-Schwarz bound of the rest,
the product of both suffix norms, is one more component of the same product. Only pairs whose bound reaches the threshold
go on to more components, and those left are decided by the cosine of the vectors as given, in double precision. A task returns
a link count and one smaller relative per vector, never its pairs; relatives are joined to components afterwards.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of different
length do not link; rows that share an id share their count of links and their component; a null id links with nothing and is kept;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage
from .components import components

THRESHOLD, TILE = 0.9, 4096
# Components added per step, rows of a tile multiplied at once, candidate pairs looked at together.
STEP, ROWS, PAIRS = 16, 512, 1 << 16
SLACK = 1e-9


def usable(embedding: Column) -> Column:
    odd = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(embedding, lambda x: x != 0)
    return F.coalesce(embedding.isNotNull() & ~odd & some, F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1) if len(flat) else np.zeros((0, 0))


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each vector length the orthonormal axes, by falling second moment of the unit vectors."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes = np.array([len(v) for v in batch.column("embedding")])
            for d in np.unique(sizes):
                y = unit(matrix(batch.column("embedding").filter(pa.array(sizes == d))))
                sums[int(d)] = sums.get(int(d), 0) + y.T @ y
        for d, m in sums.items():
            yield pa.RecordBatch.from_pydict({"d": np.full(d * d, d), "i": np.arange(d * d), "x": m.ravel()})

    # A task sends d x d sums, and Spark adds them up before the driver sees d x d numbers.
    added = vectors.select("embedding").mapInArrow(moments, "d bigint, i bigint, x double").groupBy("d", "i").agg(F.sum("x").alias("x"))
    axes: dict[int, np.ndarray] = {}
    for r in added.collect():
        axes.setdefault(r["d"], np.zeros((r["d"], r["d"])))[divmod(r["i"], r["d"])] = r["x"]
    return {d: np.linalg.eigh(m)[1][:, ::-1].copy() for d, m in axes.items()}


class Links:
    """Link counts and a union-find forest over the vectors of two tiles."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.parent, self.count = ids, list(range(len(ids))), np.zeros(len(ids), np.int64)

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            i, j = self.root(i), self.root(j)
            if i != j:
                # The smaller id leads.
                i, j = (i, j) if self.ids[i] < self.ids[j] else (j, i)
                self.parent[j] = i


def tile_links(left: np.ndarray, right: np.ndarray, same: bool, axes: np.ndarray, threshold: float, step: int = STEP) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (in left, in right) of the linked pairs of two tiles of unit vectors; each pair once if they are the same."""
    d = left.shape[1]
    x, y = left @ axes, right @ axes
    suffix = lambda v, m: np.sqrt(np.maximum(0, 1 - (v[:, :m] ** 2).sum(axis=1)))
    m = min(step, d)
    wide = lambda v: np.concatenate([v[:, :m], suffix(v, m)[:, None]], axis=1)
    xw, yw = wide(x), wide(y)
    for at in range(0, len(x), ROWS):
        bound = xw[at : at + ROWS] @ yw.T
        a, b = np.nonzero(bound >= threshold - SLACK)
        a += at
        if same:
            keep = a < b
            a, b = a[keep], b[keep]
        for p in range(0, len(a), PAIRS):
            i, j, n = a[p : p + PAIRS], b[p : p + PAIRS], m
            part = np.einsum("ij,ij->i", x[i, :n], y[j, :n])
            while n < d and len(i):
                n, before = min(n + step, d), n
                part = part + np.einsum("ij,ij->i", x[i, before:n], y[j, before:n])
                fits = part + suffix(x, n)[i] * suffix(y, n)[j] >= threshold - SLACK
                i, j, part = i[fits], j[fits], part[fits]
            exact = np.einsum("ij,ij->i", left[i], right[j]) >= threshold
            if exact.any():
                yield i[exact], j[exact]


RESULT = "id bigint, links bigint, low bigint"


def _meeting(axes: dict[int, np.ndarray], threshold: float):
    schema = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("low", pa.int64())])

    def run(key: tuple, one: pa.Table, two: pa.Table) -> pa.Table:
        if not one.num_rows or not two.num_rows:
            return schema.empty_table()
        same = key[1].as_py() == key[2].as_py()
        a = unit(matrix(one["embedding"]))
        ids, copies = one["id"].to_numpy(), one["n"].to_numpy()
        if same:
            b, base = a, 0
        else:
            b, base = unit(matrix(two["embedding"])), len(a)
            ids, copies = np.concatenate([ids, two["id"].to_numpy()]), np.concatenate([copies, two["n"].to_numpy()])
        found = Links(ids)
        for i, j in tile_links(a, b, same, axes[a.shape[1]], threshold):
            j = j + base
            np.add.at(found.count, i, copies[j])
            np.add.at(found.count, j, copies[i])
            found.join(i, j)
        hit = np.flatnonzero(found.count)
        low = [ids[found.root(i)] for i in hit.tolist()]
        return pa.Table.from_pydict({"id": ids[hit], "links": found.count[hit], "low": np.array(low, np.int64)}, schema=schema)

    return run


def _placing(cuts: np.ndarray, parts: np.ndarray | None = None, reach: float = 0.0):
    """Tile of every row by a binary search in the sorted cuts: row counts by tile or, given the parts of each tile, the rows with the
    numbers of their part (``t``) and of the first and last part that may hold partners (``a``, ``z``).
    """
    if parts is not None:
        low, high = np.append(-np.inf, cuts), np.append(cuts, np.inf)
        # Tiles along the angle: those that may hold partners of one tile are neighbours in a row.
        last = np.searchsorted(low, high + reach + SLACK, "right") - 1
        start = np.searchsorted(last, np.arange(len(low)), "left")
        base = np.append(0, np.cumsum(parts))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = np.zeros(len(cuts) + 1, np.int64)
        for batch in batches:
            sizes += np.bincount(np.searchsorted(cuts, batch.column("angle").to_numpy(), "right"), minlength=len(sizes))
        t = np.flatnonzero(sizes)
        yield pa.RecordBatch.from_pydict({"t": t, "n": sizes[t]})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = np.searchsorted(cuts, batch.column("angle").to_numpy(), "right")
            part = base[t] + batch.column("h").to_numpy() % parts[t]
            more = {"t": part, "a": base[start[t]], "z": base[last[t] + 1] - 1}
            names = ["embedding", "id", "n", "dim"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array(v.astype(np.int32)) for v in more.values())], names=[*names, *more])

    return count if parts is None else place


def _tiles(vectors: DataFrame, axes: dict[int, np.ndarray], threshold: float, tile: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of all meetings: keyed by (dim, first tile, second tile).

    Equal angles share a tile whatever their number, so a tile of more than two tiles' rows is split by a hash of the id.
    """
    reach = math.acos(threshold)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    sizes = {r["dim"]: r["n"] for r in vectors.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    lefts, rights = [], []
    for d, n in sorted(sizes.items()):
        first = F.array(*[F.lit(float(c)) for c in axes[d][:, 0]])
        dot = F.aggregate(F.zip_with("embedding", first, lambda x, c: x.cast("double") * c), F.lit(0.0), lambda s, x: s + x)
        # Out of the range of doubles only for huge or tiny vectors, which then share the middle.
        turned = vectors.where(F.col("dim") == d).withColumn("angle", F.coalesce(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.nanvl(F.try_divide(dot, norm), F.lit(0.0))))), F.lit(math.pi / 2)))
        count = max(1, -(-n // tile))
        if count == 1:
            one = turned.withColumn("i", F.lit(0)).withColumn("j", F.lit(0)).drop("angle")
            lefts.append(one)
            rights.append(one)
            continue
        cuts = np.unique(turned.approxQuantile("angle", [k / count for k in range(1, count)], 0.1 / count))
        held = np.zeros(len(cuts) + 1, np.int64)
        for r in turned.select("angle").mapInArrow(_placing(cuts), "t bigint, n bigint").groupBy("t").agg(F.sum("n").alias("n")).collect():
            held[r["t"]] = r["n"]
        parts = np.where(held > 2 * tile, -(-held // tile), 1)
        hashed = turned.withColumn("h", F.pmod(F.xxhash64("id"), F.lit((1 << 31) - 1)))
        schema = f"embedding {vectors.schema['embedding'].dataType.simpleString()}, id bigint, n bigint, dim int, t int, a int, z int"
        placed = hashed.mapInArrow(_placing(cuts, parts, reach), schema)
        lefts.append(placed.withColumn("j", F.explode(F.sequence("t", "z"))).withColumnRenamed("t", "i").drop("a", "z"))
        rights.append(placed.withColumn("i", F.explode(F.sequence("a", "t"))).withColumnRenamed("t", "j").drop("a", "z"))
    left, right = lefts[0], rights[0]
    for a, b in zip(lefts[1:], rights[1:], strict=True):
        left, right = left.unionByName(a), right.unionByName(b)
    return left, right


def links(embeddings: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row. ``threshold`` is above 0."""
    rows = embeddings.select(F.col("vec_id").cast("bigint"), "embedding")
    good = rows.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    distinct = stage(
        good.groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n")).withColumn("dim", F.size("embedding")), "vectors"
    )
    if distinct.isEmpty():
        return rows.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    axes = principal_axes(distinct)
    left, right = _tiles(distinct, axes, threshold, tile)
    keys = ["dim", "i", "j"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_meeting(axes, threshold), RESULT)
    met = stage(met, "vector_links")
    counts = met.groupBy("id").agg(F.sum("links").alias("links"))
    low = components(met.select(F.col("id").alias("u"), F.col("low").alias("v"))).select(F.col("u").alias("id"), F.col("v").alias("low"))
    # Only vectors with copies need looking up; the others are their own representative.
    twins = stage(distinct.where("n > 1").select("embedding", "id", "n"), "vector_twins")
    named = rows.join(twins, "embedding", "left").select(
        "vec_id", F.coalesce("id", "vec_id").alias("id"), (F.coalesce("n", F.lit(1)) - 1).alias("copies")
    )
    out = named.join(counts, "id", "left").join(low, "id", "left")
    out = out.select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("copies")).cast("bigint").alias("n_links"), F.coalesce("low", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
