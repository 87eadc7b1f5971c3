"""Exact top-k by inner product: a KD-tree per shard of rows, searched best-first.

Vectors become integers (floor of ``scale`` times each component), so scores are exact. Rows are dealt to shards of
bounded size by a hash of their id. In a shard a KD-tree splits at medians of the widest dimension and keeps tight
boxes; the largest inner product a box allows orders the traversal, which ends when no box left can reach the kth score.
A query first searches the shard it lies in; the kth score found there travels with it to all other shards, where it
prunes from the start. Queries meet shards in blocks of bounded size.

Defined results: vectors that are null, empty or hold null or non-finite components, and rows without an id, take no part;
vectors are compared with those of the same length only; rows that carry the query's own id are its own row and no candidates; a
repeated query row gets its own list each time; ties go to the smaller id; an empty table gives an empty result.
A score that does not fit 64 bits raises an error.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

K, SCALE, QUERY_STEP = 10, 1024, 100
SHARD, BLOCK, LEAF = 8192, 4096, 128


class KDTree:
    """Median splits down to ``leaf`` rows; boxes are tight around the rows of a node."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        self.low, self.high, self.span, self.children = [], [], [], []
        self._split(points, 0, len(points), leaf)
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.points = points[self.order]

    def _split(self, points: np.ndarray, first: int, end: int, leaf: int) -> int:
        node, mine = len(self.span), points[self.order[first:end]]
        low, high = mine.min(axis=0), mine.max(axis=0)
        self.low.append(low)
        self.high.append(high)
        self.span.append((first, end))
        self.children.append(None)
        wide = int((high - low).argmax())
        if end - first > leaf and high[wide] > low[wide]:
            half = (end - first) // 2
            self.order[first:end] = self.order[first:end][np.argpartition(mine[:, wide], half, kind="introselect")]
            self.children[node] = (self._split(points, first, first + half, leaf), self._split(points, first + half, end, leaf))
        return node


def exact_type(points: np.ndarray, queries: np.ndarray) -> type:
    """Floats while every sum stays below 2**53, else 64-bit integers while below 2**63."""
    top = lambda x: max((abs(int(x.min())), abs(int(x.max())))) if x.size else 0
    most = top(points) * top(queries) * max(1, points.shape[1])
    if most >= 1 << 63:
        raise ValueError("inner products do not fit 64 bits")
    return np.float64 if most < 1 << 53 else np.int64


def search(tree: KDTree, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, bounds: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, scores) of each query's best rows in the tree, at most k, none below its bound. ``ids`` in tree order."""
    # The largest inner product inside a box, for all queries and boxes at once.
    reach = np.maximum(queries, 0) @ tree.high.T + np.minimum(queries, 0) @ tree.low.T
    out = []
    for q, mine, bound, up in zip(queries, own, bounds, reach, strict=True):
        got_ids, got, kth = np.zeros(0, np.int64), np.zeros(0, reach.dtype), bound
        heap = [(-up[0], 0)]
        while heap and -heap[0][0] >= kth:
            node = heapq.heappop(heap)[1]
            if tree.children[node]:
                for child in tree.children[node]:
                    if up[child] >= kth:
                        heapq.heappush(heap, (-up[child], child))
                continue
            first, end = tree.span[node]
            scores = tree.points[first:end] @ q
            hit = np.flatnonzero((scores >= kth) & (ids[first:end] != mine))
            if len(hit):
                got_ids, got = np.concatenate([got_ids, ids[first:end][hit]]), np.concatenate([got, scores[hit]])
                if len(got) > k:
                    best = np.lexsort((got_ids, -got))[:k]
                    got_ids, got = got_ids[best], got[best]
                if len(got) >= k:
                    kth = max(kth, got.min())
        out.append((got_ids, got))
    return out


RESULT = "_query bigint, query_id bigint, vec_id bigint, score bigint"


def _searcher(k: int, leaf: int):
    schema = pa.schema([("_query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        flat = column.combine_chunks()
        return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1) if len(flat) else np.zeros((0, 0), np.int64)

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out = {n: [] for n in schema.names}
        if rows.num_rows and asked.num_rows:
            points, queries = matrix(rows["vector"]), matrix(asked["vector"])
            kind = exact_type(points, queries)
            tree = KDTree(points.astype(kind), leaf)
            ids = rows["vec_id"].to_numpy()[tree.order]
            lowest = -np.inf if kind is np.float64 else np.iinfo(np.int64).min
            bounds = [lowest if b is None else b for b in asked["bound"].to_pylist()]
            own = asked["vec_id"].to_numpy()
            found = search(tree, ids, queries.astype(kind), own, np.array(bounds, kind), k)
            for number, query, (hits, scores) in zip(asked["_query"].to_pylist(), own.tolist(), found, strict=True):
                out["_query"] += [number] * len(hits)
                out["query_id"] += [query] * len(hits)
                out["vec_id"] += hits.tolist()
                out["score"] += [int(s) for s in scores]
        return pa.Table.from_pydict(out, schema=schema)

    return run


def integers(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, vector) of the rows that take part."""
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where((F.size("embedding") > 0) & ~odd)
    return rows.select(F.col("vec_id").cast("bigint"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("bigint")).alias("vector"))


def top_k(
    embeddings: DataFrame, k: int = K, step: int = QUERY_STEP, scale: int = SCALE, shard: int = SHARD, block: int = BLOCK, leaf: int = LEAF
) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for every row whose id is divisible by ``step``."""
    points = integers(embeddings, scale)
    sizes = points.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("vec_id") % step == 0, 1)).alias("q")).first()
    shards, blocks = max(1, -(-sizes["n"] // shard)), max(1, -(-sizes["q"] // block))
    home = F.pmod(F.xxhash64("vec_id"), F.lit(shards))
    points = points.withColumn("_shard", home).withColumn("_dim", F.size("vector"))
    queries = points.where(F.col("vec_id") % step == 0).withColumn("_query", F.monotonically_increasing_id())
    # Written, so that the numbers of the queries stay the same in both rounds.
    queries = stage(queries.withColumn("_block", F.pmod(F.xxhash64("_query", F.lit(1)), F.lit(blocks))), "topk_queries")
    run = _searcher(k, leaf)
    here = ["_shard", "_dim"]
    # About one row in ``step`` of a shard is a query, so the queries of a home shard are few.
    first = stage(
        points.groupBy(*here).cogroup(queries.withColumn("bound", F.lit(None).cast("bigint")).groupBy(*here)).applyInArrow(run, RESULT), "topk_home"
    )
    kth = first.groupBy("_query").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low"))
    bounds = kth.select("_query", F.when(F.col("n") >= k, F.col("low")).alias("bound"))
    found = first
    if shards > 1:
        asked = queries.join(bounds, "_query", "left").withColumnRenamed("_shard", "_home")
        asked = asked.withColumn("_shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint")))).where("_shard <> _home").drop("_home")
        spread = points.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
        keys = ["_shard", "_block", "_dim"]
        found = first.unionByName(spread.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(run, RESULT))
    order = Window.partitionBy("_query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
