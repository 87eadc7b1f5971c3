"""Nearest-neighbour joins between a query set and an embedding collection, per tenant.

Two exact strategies share one block kernel that never emits pairs, only each block's best ``k`` per query:

* ``broadcast`` - a query set within a checked byte bound travels to the tasks; the collection is scanned once
  where it lies, without a shuffle.
* ``grid`` - beyond the bound both sides are cut into cells of bounded size by hashed ids, so one large tenant
  spreads over many tasks; each (query cell, collection cell) is one bounded co-group. Copies of a vector enter it once,
  with their ``k`` lowest ids. Where only pairs above a similarity count (``near_grid``), cells gather round pivots and
  those too far apart never meet.
* ``lookup`` - the mirror image of broadcast, for many queries against a small checked collection: every query
  finds its best rows in its own task, with no shuffle at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import SIMILARITY_DECIMALS
from ..session import cut, spread

BROADCAST_ROWS = 4096
BROADCAST_BYTES = 64 << 20
CELL_ROWS = 16_384
# A tenant's side is cut into so many cells at most, each copied to all cells of the other side, until a cell holds so many bytes of floats.
CELLS, CELL_BYTES = 8, 16 << 20
# Similarities held at once by a block kernel (8 bytes each, and a few copies): blocks are compared in tiles of rows.
TILE_VALUES = 1 << 22
BLOCK_COLUMNS = 4096
# Pivots of a tenant on average, and of all tenants together, that may travel to the tasks.
PIVOTS, PIVOT_ROWS = 64, 1 << 16
OUT = "user_id string, query_id {q}, {id} {t}, similarity double"


# --- block kernel (runs inside tasks) -----------------------------------------------------------
def _unit_rows(vectors: pa.Array) -> np.ndarray:
    """Rows scaled to unit length in double; a zero vector stays zero, so its cosine is 0."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    n = len(vectors)
    if n == 0:
        return np.zeros((0, 0))
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
    norms = np.sqrt((flat * flat).sum(axis=1, keepdims=True))
    return np.divide(flat, norms, out=np.zeros_like(flat), where=norms > 0)


def _first_k(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, order: np.ndarray, k: int):
    """The ``k`` best per row: value down, then ``order`` of the column up; rows come out in order."""
    sort = np.lexsort((order[columns], -values, rows))
    rows, columns, values = rows[sort], columns[sort], values[sort]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[keep], columns[keep], values[keep]


def row_tiles(rows: int, columns: int, values: int | None = None) -> Iterator[slice]:
    """Slices of ``rows`` whose similarities to ``columns`` others fit the bound."""
    step = max(1, (values or TILE_VALUES) // max(1, columns))
    return (slice(low, min(rows, low + step)) for low in range(0, rows, step))


def block_best(query_unit, unit, order, k, floor):
    """(query rows, collection rows, similarities) of the best ``k`` within one block.

    Tiles are compared in single precision first; what its rounding error leaves as a candidate is compared in double. A row's
    bar rises with the best seen, so the later tiles of a block leave few.
    """
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    at, there = (np.flatnonzero(np.isfinite(x).all(axis=1)) for x in (query_unit, unit))
    if len(at) and len(there):
        ours, theirs = query_unit[at].astype(np.float32), unit[there].astype(np.float32)
        # Rounding of vectors and of their products, and of similarities to their decimals.
        longest = max(1.0, *(np.sqrt(np.einsum("ij,ij->i", x, x).max()) for x in (ours, theirs))) ** 2
        error = np.float32((unit.shape[1] + 8) * 2.0**-23 * longest + 10.0**-SIMILARITY_DECIMALS)
        width = min(len(there), max(BLOCK_COLUMNS, 4 * k))
        for tile in row_tiles(len(at), width):
            some, best = ours[tile], found[0]
            bar = np.full(len(some), -np.inf if floor is None else floor - error, np.float32)
            for low in range(0, len(there), width):
                rough = some @ theirs[low : low + width].T
                if low == 0 and width > k:
                    bar = np.maximum(bar, np.partition(rough, width - k, axis=1)[:, width - k] - 2 * error)
                rows, columns = np.nonzero(rough >= bar[:, None])
                columns = there[columns + low]
                sims = np.concatenate([
                    np.round(np.einsum("ij,ij->i", query_unit[at[tile][rows[piece]]], unit[columns[piece]]), SIMILARITY_DECIMALS)
                    for piece in row_tiles(len(rows), unit.shape[1])
                ] or [np.zeros(0)])
                keep = slice(None) if floor is None else sims >= floor
                best = _first_k(*(np.concatenate(x) for x in zip(best, (rows[keep], columns[keep], sims[keep]))), order, k)
                full = np.flatnonzero(np.bincount(best[0], minlength=len(some)) == k)
                last = np.searchsorted(best[0], full, side="right") - 1
                bar[full] = np.maximum(bar[full], best[2][last].astype(np.float32) - error)
            found.append((at[tile][best[0]], best[1], best[2]))
    return tuple(np.concatenate(part) for part in zip(*found))


def _id_order(ids: pa.Array) -> np.ndarray:
    """Rank of each id within the block (ids ascending), for tie-breaks on any id type."""
    if isinstance(ids, pa.ChunkedArray):
        ids = ids.combine_chunks()
    sort = pa.compute.sort_indices(ids).to_numpy()
    rank = np.empty(len(ids), dtype=np.int64)
    rank[sort] = np.arange(len(ids))
    return rank


# --- strategies ---------------------------------------------------------------------------------
def _final_top(partial: DataFrame, id_col: str, k: int) -> DataFrame:
    w = Window.partitionBy("user_id", "query_id").orderBy(F.desc("similarity"), F.asc(id_col))
    return (
        partial.withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= k)
        .withColumn("rank", F.col("rank").cast("int"))
    )


def _out_schema(queries: DataFrame, collection: DataFrame, id_col: str) -> str:
    return OUT.format(
        q=queries.schema["query_id"].dataType.simpleString(),
        id=id_col,
        t=collection.schema[id_col].dataType.simpleString(),
    )


def _broadcast_partial(query_table: pa.Table, collection: DataFrame, id_col: str, k: int, floor, schema: str):
    units = _unit_rows(query_table["embedding"])
    users = np.asarray(query_table["user_id"].to_pylist(), dtype=object)
    ids = query_table["query_id"].combine_chunks()
    by_user = {u: np.flatnonzero(users == u) for u in set(users.tolist())}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, pa.Table] = {}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            codes = table["user_id"].combine_chunks().dictionary_encode()
            code = codes.indices.to_numpy(zero_copy_only=False)
            for i, user in enumerate(codes.dictionary.to_pylist()):
                q_rows = by_user.get(user)
                if q_rows is None:
                    continue
                part = table.take(pa.array(np.flatnonzero(code == i)))
                unit = _unit_rows(part["embedding"])
                keys = part[id_col].combine_chunks()
                q, c, sim = block_best(units[q_rows], unit, _id_order(keys), k, floor)
                found = pa.table(
                    {
                        "user_id": pa.array([user] * len(q), pa.string()),
                        "query_id": ids.take(pa.array(q_rows[q])),
                        id_col: keys.take(pa.array(c)),
                        "similarity": pa.array(sim),
                    }
                )
                held[user] = _fold(held.get(user), found, id_col, k)
        for found in held.values():
            yield from found.to_batches()

    return spread(collection.select("user_id", id_col, "embedding")).mapInArrow(scan, schema)


def _fold(kept, found: pa.Table, id_col: str, k: int) -> pa.Table:
    """Best ``k`` per query over what the partition has seen, so a task's output never grows with its input."""
    if kept is None:
        return found
    both = pa.concat_tables([kept, found]).combine_chunks()
    both = both.sort_by([("query_id", "ascending"), ("similarity", "descending"), (id_col, "ascending")])
    q = both["query_id"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    first = np.r_[0, np.flatnonzero(np.diff(q)) + 1] if len(q) else np.zeros(0, dtype=np.int64)
    run = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
    return both.take(pa.array(np.flatnonzero(run < k)))


def with_cells(rows: DataFrame, key: str, cell: str, cell_rows: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` with a hashed cell number per tenant, and the tenant's cell count (one row per tenant).

    Cells of ``cell_rows`` rows, or of more where a tenant would have over ``CELLS`` of them, up to ``CELL_BYTES`` of floats: all rows
    of the other side are copied once per cell, so their number must not grow with the tenant before memory asks for it.
    """
    n, most = F.count(F.lit(1)), F.greatest(F.lit(cell_rows), F.floor(CELL_BYTES / (4 * F.max(F.greatest(F.size("embedding"), F.lit(1))))))
    sizes = rows.groupBy("user_id").agg(
        F.greatest(F.least(F.ceil(n / F.lit(cell_rows)), F.lit(CELLS)), F.ceil(n / most)).cast("int").alias(f"{cell}_count")
    )
    placed = rows.join(sizes, "user_id").withColumn(
        cell, F.pmod(F.xxhash64(*[F.col(c) for c in key.split(",")]), F.col(f"{cell}_count")).cast("int")
    )
    return placed.drop(f"{cell}_count"), sizes


def grid(left: DataFrame, left_key: str, right: DataFrame, right_key: str, cell_rows: int = CELL_ROWS):
    """Both sides cut into bounded cells and replicated so that every left cell meets every right cell once."""
    lefts, left_sizes = with_cells(left, left_key, "left_cell", cell_rows)
    # Fresh column identities, so a set can meet itself.
    rights, right_sizes = with_cells(right.toDF(*right.columns), right_key, "right_cell", cell_rows)
    lefts = lefts.join(right_sizes, "user_id").withColumn(
        "right_cell", F.explode(F.sequence(F.lit(0), F.col("right_cell_count") - 1))
    )
    rights = rights.join(left_sizes, "user_id").withColumn(
        "left_cell", F.explode(F.sequence(F.lit(0), F.col("left_cell_count") - 1))
    )
    keys = ["user_id", "left_cell", "right_cell"]
    return lefts.drop("right_cell_count").groupBy(*keys), rights.drop("left_cell_count").groupBy(*keys)


def pivots_of(rows: DataFrame, key: str, cell_rows: int) -> dict[str, np.ndarray] | None:
    """Some unit vectors of each tenant, drawn by a hash of the key: about four per cell, ``PIVOTS`` on average at most. None if they pass the bound."""
    sizes = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    few = F.least(F.lit(PIVOTS), F.ceil(F.col("n") / F.lit(cell_rows)) * 4)
    drawn = rows.join(sizes, "user_id").where(F.pmod(F.xxhash64(F.lit("pivot"), key), F.ceil(F.col("n") / few)) == 0)
    table = drawn.select("user_id", "embedding").limit(PIVOT_ROWS + 1).toArrow()
    if table.num_rows > PIVOT_ROWS or table.nbytes > BROADCAST_BYTES:
        return None
    users = np.asarray(table["user_id"].to_pylist(), dtype=object)
    return {u: np.unique(_unit_rows(table["embedding"].take(pa.array(np.flatnonzero(users == u)))), axis=0) for u in set(users.tolist())}


def in_cells(rows: DataFrame, pivots: dict[str, np.ndarray]) -> DataFrame:
    """``rows`` with the nearest pivot of their tenant (``cell``, 0 where it has none) and the angle to it."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            unit, users = _unit_rows(table["embedding"]), np.asarray(table["user_id"].to_pylist(), dtype=object)
            cell, angle = np.zeros(batch.num_rows, np.int32), np.full(batch.num_rows, np.pi)
            for user in set(users.tolist()) & pivots.keys():
                at = np.flatnonzero(users == user)
                sims = unit[at] @ pivots[user].T
                cell[at], angle[at] = sims.argmax(axis=1), np.arccos(np.clip(sims.max(axis=1), -1.0, 1.0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(angle)], names=[*batch.schema.names, "cell", "angle"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return spread(rows).mapInArrow(place, f"{schema}, cell int, angle double")


def near_cells(pivots: np.ndarray, left: dict[int, float], right: dict[int, float], min_similarity: float) -> list[tuple[int, int]]:
    """Pairs of (left cell, right cell) that can hold vectors at least so similar: their pivots are no further apart than the threshold's
    angle and both radii (triangle inequality of angles)."""
    a, b = np.array(sorted(left), np.int64), np.array(sorted(right), np.int64)
    apart = np.arccos(np.clip(pivots[a] @ pivots[b].T, -1.0, 1.0))
    reach = np.arccos(np.clip(min_similarity, -1.0, 1.0)) + np.array([left[i] for i in a.tolist()])[:, None] + np.array([right[i] for i in b.tolist()])[None, :]
    # The margin is far above what rounding of similarities can move an angle.
    at = np.nonzero(apart <= reach + 1e-4)
    return list(zip(a[at[0]].tolist(), b[at[1]].tolist()))


def near_grid(left: DataFrame, left_key: str, right: DataFrame, right_key: str, min_similarity: float, cell_rows: int = CELL_ROWS):
    """As :func:`grid`, without the cells that are too far apart to hold a pair at least so similar; None where the pivots pass their bound.

    A row is copied to the cells near its own, not to all; a cell of more than ``cell_rows`` rows is split by a hash.
    """
    pivots = pivots_of(right, right_key, cell_rows)
    if pivots is None:
        return None
    lefts, rights = cut(in_cells(left, pivots), "left_cells"), cut(in_cells(right.toDF(*right.columns), pivots), "right_cells")
    # One row per cell, as many as there are pivots.
    sizes = [side.groupBy("user_id", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius")).toArrow().to_pylist() for side in (lefts, rights)]
    told: list[dict] = [{}, {}]
    for side, rows in zip(told, sizes):
        for r in rows:
            side.setdefault(r["user_id"], {})[r["cell"]] = (r["radius"], -(-r["n"] // cell_rows))
    pairs = []
    for user in told[0].keys() & told[1].keys():
        mine, theirs = (side[user] for side in told)
        some = pivots.get(user, np.zeros((1, 1)))
        for i, j in near_cells(some, {c: r for c, (r, _) in mine.items()}, {c: r for c, (r, _) in theirs.items()}, min_similarity):
            pairs.append((user, i, j, mine[i][1], theirs[j][1]))
    pairs = F.broadcast(left.sparkSession.createDataFrame(pairs, "user_id string, left_cell int, right_cell int, left_parts int, right_parts int"))
    part = lambda key, parts: F.pmod(F.xxhash64(*[F.col(c) for c in key.split(",")]), F.col(parts)).cast("int")
    all_of = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    keys = ["user_id", "left_cell", "right_cell", "left_part", "right_part"]
    lefts = lefts.withColumnRenamed("cell", "left_cell").join(pairs, ["user_id", "left_cell"]).withColumn("left_part", part(left_key, "left_parts"))
    rights = rights.withColumnRenamed("cell", "right_cell").join(pairs, ["user_id", "right_cell"]).withColumn("right_part", part(right_key, "right_parts"))
    lefts, rights = lefts.withColumn("right_part", all_of("right_parts")), rights.withColumn("left_part", all_of("left_parts"))
    return lefts.select(*keys, *left.columns[1:]).groupBy(*keys), rights.select(*keys, *right.columns[1:]).groupBy(*keys)


def meet(left: DataFrame, left_key: str, right: DataFrame, right_key: str, kernel, schema: str,
         cell_rows: int = CELL_ROWS, min_similarity: float | None = None) -> DataFrame:
    """``kernel(left rows, right rows)`` over left and right blocks of a tenant; its outputs are united.

    A right side within the broadcast bound travels to the tasks and the left side is scanned in place; beyond it
    both sides meet in the grid. With ``min_similarity`` the kernel does not need pairs below it, and blocks that are too far apart do not
    meet. The kernel must give the union over blocks the meaning it wants.
    """
    small = right.limit(BROADCAST_ROWS + 1).toArrow()
    if small.num_rows > BROADCAST_ROWS or small.nbytes > BROADCAST_BYTES:
        near = near_grid(left, left_key, right, right_key, min_similarity, cell_rows) if min_similarity and min_similarity > 0 else None
        lefts, rights = near or grid(left, left_key, right, right_key, cell_rows)
        return lefts.cogroup(rights).applyInArrow(
            lambda l, r: kernel(l, r) if l.num_rows and r.num_rows else kernel(l.slice(0, 0), r.slice(0, 0)), schema
        )
    small = small.combine_chunks()
    users = np.asarray(small["user_id"].to_pylist(), dtype=object)
    parts = {u: small.take(pa.array(np.flatnonzero(users == u))) for u in set(users.tolist())}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            codes = table["user_id"].combine_chunks().dictionary_encode()
            code = codes.indices.to_numpy(zero_copy_only=False)
            for i, user in enumerate(codes.dictionary.to_pylist()):
                if user in parts:
                    rows = pa.array(np.flatnonzero(code == i))
                    yield from kernel(table.take(rows), parts[user]).to_batches()

    return spread(left).mapInArrow(scan, schema)


def distinct_vectors(collection: DataFrame, id_col: str, k: int) -> DataFrame:
    """One row per tenant and vector: ``user_id, embedding, ids``, the ``k`` lowest ids that have it, ascending.

    128 bits stand for the vector where only equality matters. Ids are cut to ``k`` before and after the shuffle, so a vector with very many
    copies is never gathered.
    """
    copy = ["user_id", "copy_a", "copy_b"]
    rows = collection.select("user_id", id_col, "embedding", F.xxhash64("embedding").alias("copy_a"), F.xxhash64(F.lit(1), "embedding").alias("copy_b"))
    place = F.row_number().over(Window.partitionBy(*copy).orderBy(id_col))
    lowest = rows.select(*copy, id_col).withColumn("_place", place).where(F.col("_place") <= k)
    lists = lowest.groupBy(*copy).agg(F.sort_array(F.collect_list(id_col)).alias("ids"))
    vectors = rows.groupBy(*copy).agg(F.min_by("embedding", id_col).alias("embedding"))
    return vectors.join(lists, copy).select("user_id", "embedding", "ids")


def _grid_partial(queries: DataFrame, collection: DataFrame, id_col: str, k: int, floor, schema: str, cell_rows: int):
    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        lists, qids = right["ids"].combine_chunks(), left["query_id"].combine_chunks()
        keys, sizes = lists.flatten(), pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
        if len(sizes) and len(qids):
            starts, rank = np.cumsum(sizes) - sizes, _id_order(keys)
            q, c, sim = block_best(_unit_rows(left["embedding"]), _unit_rows(right["embedding"]), rank[starts], k, floor)
            # A vector stands for the ids that have it.
            each = np.repeat(np.arange(len(q)), sizes[c])
            nth = np.arange(len(each)) - np.searchsorted(each, each)
            q, c, sim = _first_k(q[each], starts[c[each]] + nth, sim[each], rank, k)
        else:
            q = c = np.zeros(0, dtype=np.int64)
            sim = np.zeros(0)
        user = (left if len(qids) else right)["user_id"][0].as_py()
        return pa.table(
            {
                "user_id": pa.array([user] * len(q), pa.string()),
                "query_id": qids.take(pa.array(q)),
                id_col: keys.take(pa.array(c)),
                "similarity": pa.array(sim),
            }
        )

    vectors = cut(distinct_vectors(collection, id_col, k), "distinct_vectors")
    lefts, rights = grid(queries.select("user_id", "query_id", "embedding"), "query_id", vectors, "ids", cell_rows)
    return lefts.cogroup(rights).applyInArrow(meet, schema)


def bounded(queries: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> pa.Table | None:
    """The query set as one Arrow table when it fits the bounds, else None. Reads at most one row beyond."""
    table = queries.select("user_id", "query_id", "embedding").limit(max_rows + 1).toArrow()
    return table if table.num_rows <= max_rows and table.nbytes <= max_bytes else None


def _lookup(queries: DataFrame, collection: pa.Table, id_col: str, k: int, floor, schema: str) -> DataFrame:
    units = _unit_rows(collection["embedding"])
    users = np.asarray(collection["user_id"].to_pylist(), dtype=object)
    keys = collection[id_col].combine_chunks()
    order = _id_order(keys)
    by_user = {u: np.flatnonzero(users == u) for u in set(users.tolist())}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            codes = table["user_id"].combine_chunks().dictionary_encode()
            code = codes.indices.to_numpy(zero_copy_only=False)
            for i, user in enumerate(codes.dictionary.to_pylist()):
                rows = by_user.get(user)
                if rows is None:
                    continue
                part = table.take(pa.array(np.flatnonzero(code == i)))
                q, c, sim = block_best(_unit_rows(part["embedding"]), units[rows], order[rows], k, floor)
                found = pa.table(
                    {
                        "user_id": pa.array([user] * len(q), pa.string()),
                        "query_id": part["query_id"].combine_chunks().take(pa.array(q)),
                        id_col: keys.take(pa.array(rows[c])),
                        "similarity": pa.array(sim),
                        # block_best returns each query's picks in rank order
                        "rank": pa.array((np.arange(len(q)) - np.searchsorted(q, q) + 1).astype(np.int32)),
                    }
                )
                yield from found.to_batches()

    return spread(queries).mapInArrow(scan, schema + ", rank int")


def nearest(
    queries: DataFrame,
    collection: DataFrame,
    id_col: str,
    k: int,
    min_similarity: float | None = None,
    strategy: str = "auto",
    cell_rows: int = CELL_ROWS,
    query_table: pa.Table | None = None,
) -> DataFrame:
    """Top ``k`` of the collection per query: ``user_id, query_id, <id>, similarity, rank``.

    ``queries(user_id, query_id, embedding)`` meet only the collection rows of their tenant. Ties go to the
    lowest id. ``min_similarity`` is inclusive and, as in a filter after the limit, never changes who ranks.
    ``query_table`` is the result of :func:`bounded`, when a caller uses one query set several times.
    """
    schema = _out_schema(queries, collection, id_col)
    queries = queries.select("user_id", "query_id", "embedding")
    table = query_table
    if table is None and strategy in ("auto", "broadcast"):
        table = bounded(queries)
    if table is None and strategy == "broadcast":
        raise ValueError("the query set exceeds the broadcast bound")
    if strategy == "lookup":
        small = bounded(collection.withColumnRenamed(id_col, "query_id"))
        if small is not None:
            return _lookup(queries, small.rename_columns(["user_id", id_col, "embedding"]), id_col, k, min_similarity, schema)
    if table is not None:
        partial = _broadcast_partial(table, collection, id_col, k, min_similarity, schema)
    else:
        partial = _grid_partial(queries, collection, id_col, k, min_similarity, schema, cell_rows)
    return _final_top(partial, id_col, k)
