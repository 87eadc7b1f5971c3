"""Best-fit packing of tokenised documents into sequences, improved by bin completion.

Documents are encoded once (``pieces``); only those longer than a sequence are cut. Pieces are dealt evenly to shards of
bounded size. A shard is packed best-fit decreasing; if that uses more sequences than its volume needs, bin completion
branches over the undominated fillings around the largest piece left, prunes by the waste it may still spend and
keeps the best packing found. Each shard then hands its emptiest sequences on, to be packed again with those of
other shards, until one shard is left: the number of sequences does not grow with the number of shards.

Defined results: null text counts as empty; an empty text is the end id alone; null ids and repeated rows are packed
like any other row, once each; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stage
from .tokens import encoder, public_path

CAPACITY, END_ID = 4096, 1
# Pieces that one task packs, and the share of them that it may hand on.
SHARD, CARRY = 8192, 16
# Steps that bin completion may spend on a shard, and fillings it tries around one piece.
STEPS, WIDTH = 300_000, 6
# Steps of the enumeration around one piece; its first path, largest sizes first, always ends in a filling.
LOOK = 300

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document, with the ids themselves if asked for."""
    path = path or public_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import struct
        import zlib

        import numpy as np

        encode, end = encoder(path), struct.pack("<I", end_id)
        for batch in batches:
            out, ids = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}, []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                data = memoryview(encode(text.as_py() or "") + end)
                for n, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    for k, v in zip(out, (doc_id, n, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        out[k].append(v)
                    if with_ids:
                        ids.append(np.frombuffer(part, np.uint32).astype(np.int64))
            arrays = [pa.array(v, pa.int32() if k == "piece" else pa.int64()) for k, v in out.items()]
            names = list(out)
            if with_ids:
                arrays, names = [*arrays, pa.array(ids, pa.list_(pa.int64()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select("doc_id", "text").mapInArrow(run, PIECES + (", ids array<bigint>" if with_ids else ""))


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Positions per bin: each size, largest first, goes where it leaves the least room."""
    bins, room, free = [], {}, 0  # room: bins by what is left in them; free: the same as bits
    for at in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[at]
        fits = free >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                free &= ~(1 << left)
        else:
            b, left = len(bins), capacity
            bins.append([])
        bins[b].append(at)
        left -= size
        if left:
            room.setdefault(left, []).append(b)
            free |= 1 << left
    return bins


def _packs(inner: tuple, outer: tuple) -> bool:
    """Whether the sizes ``inner`` can be dealt into bins of the sizes ``outer``."""
    if not inner:
        return True
    tried = set()
    for i, room in enumerate(outer):
        if room >= inner[0] and room not in tried:
            tried.add(room)
            if _packs(inner[1:], outer[:i] + (room - inner[0],) + outer[i + 1 :]):
                return True
    return False


def fillings(counts: dict[int, int], bits: int, room: int, width: int = WIDTH) -> tuple[list[tuple], int]:
    """Fullest maximal sets of the sizes left that fit into ``room``, without dominated ones, and the steps it took.

    A filling is dominated when its sizes can be dealt into those of another (looked into for up to four sizes). Each
    level looks at the ``width`` largest sizes that fit.
    """
    found, most, steps = {}, width * width, 0

    def grow(chosen: tuple, left: int, top: int) -> None:
        nonlocal steps
        steps += 1
        below = bits & ((1 << (min(left, top) + 1)) - 1)
        seen = 0
        while below and seen < width and len(found) < most and steps < LOOK:
            size = below.bit_length() - 1
            below ^= 1 << size
            if chosen.count(size) < counts[size]:
                seen += 1
                grow((*chosen, size), left - size, size)
        if not seen and chosen:
            # Maximal only if nothing left fits, also nothing larger that was passed over.
            fit = bits & ((1 << (left + 1)) - 1)
            while fit:
                size = fit.bit_length() - 1
                fit ^= 1 << size
                if chosen.count(size) < counts[size]:
                    return
            found.setdefault(chosen, left)

    grow((), room, room)
    ordered = sorted(found, key=lambda f: (found[f], len(f)))[: 2 * width]
    kept: list[tuple] = []
    for f in ordered:
        if not any(len(f) <= 4 and len(k) <= 4 and _packs(f, k) for k in kept):
            kept.append(f)
    return kept[:width] or [()], steps + len(found)


def bin_completion(sizes: list[int], capacity: int = CAPACITY, steps: int = STEPS, width: int = WIDTH) -> list[list[int]]:
    """Positions per bin, in as few bins as the search finds; never more than best-fit decreasing uses."""
    bins = best_fit(sizes, capacity)
    total = sum(sizes)
    least = -(-total // capacity)
    if len(bins) <= least:
        return bins
    counts: dict[int, int] = {}
    for s in sizes:
        counts[s] = counts.get(s, 0) + 1
    bits = 0
    for s in counts:
        bits |= 1 << s

    def take(filling: tuple) -> None:
        nonlocal bits
        for s in filling:
            counts[s] -= 1
            if not counts[s]:
                bits &= ~(1 << s)

    def give(filling: tuple) -> None:
        nonlocal bits
        for s in filling:
            counts[s] += 1
            bits |= 1 << s

    best, allowed = None, (len(bins) - 1) * capacity - total
    path: list[tuple] = []  # the fillings chosen, the largest size of each first
    open_: list[list[tuple]] = []  # what remains to try at each depth
    waste = 0
    while steps > 0:
        if bits:  # descend: fill a bin around the largest size left
            top = bits.bit_length() - 1
            take((top,))
            filled, spent = fillings(counts, bits, capacity - top, width)
            options = [(top, *f) for f in filled]
            give((top,))
            steps -= spent
            open_.append([f for f in reversed(options) if waste + capacity - sum(f) <= allowed])
        else:  # all sizes placed within the allowed waste: fewer bins than before
            best = list(path)
            if len(best) <= least:
                break
            allowed = (len(best) - 1) * capacity - total
        while open_:
            if len(path) == len(open_):
                done = path.pop()
                give(done)
                waste -= capacity - sum(done)
            while open_[-1] and waste + capacity - sum(open_[-1][-1]) > allowed:
                open_[-1].pop()
            if open_[-1]:
                chosen = open_[-1].pop()
                take(chosen)
                path.append(chosen)
                waste += capacity - sum(chosen)
                break
            open_.pop()
        if not open_:
            break
    if best is None:
        return bins
    at: dict[int, list[int]] = {}
    for i, s in enumerate(sizes):
        at.setdefault(s, []).append(i)
    return [[at[s].pop() for s in filling] for filling in best]


def _packer(capacity: int, turn: int, spare: int):
    """Packs the rows of one shard; up to ``spare`` pieces, those of its emptiest sequences, stay open."""
    import pandas as pd

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        # An order of its own, so that a task that runs again packs the same way.
        rows = rows.sort_values("_row", ignore_index=True)
        sizes = rows["length"].tolist()
        bins = bin_completion(sizes, capacity)
        fill = [sum(sizes[i] for i in b) for b in bins]
        sequence, offset, open_ = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.zeros(len(rows), bool)
        base, room = (turn << 56) | (int(rows["_shard"].iloc[0]) << 20), spare
        for n in sorted(range(len(bins)), key=lambda n: fill[n]):
            keep = fill[n] < capacity and len(bins[n]) <= room
            room = room - len(bins[n]) if keep else 0  # the emptiest bins only
            at = 0
            for i in bins[n]:
                sequence[i], offset[i], open_[i] = base | n, at, keep
                at += sizes[i]
        rows["sequence_id"], rows["offset"], rows["_open"] = sequence, offset, open_
        return rows.drop(columns="_shard")

    return run


def pack(
    docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, shard: int = SHARD, with_ids: bool = False
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids if asked for)."""
    small_batches(docs.sparkSession)
    numbered = stage(pieces(docs, path, capacity, end_id, with_ids).withColumn("_row", F.monotonically_increasing_id()), "pieces")
    # Pandas has no null integers: a null id travels as 0 beside a flag.
    rest = numbered.drop("ids").withColumn("_null", F.col("doc_id").isNull()).na.fill(0, ["doc_id"])
    columns = rest.columns
    left, turn, closed = rest.count(), 0, None
    shape = f"{PIECES}, _row bigint, _null boolean, sequence_id bigint, offset bigint, _open boolean"

    while True:
        shards = max(1, -(-left // shard))
        last = shards == 1
        run = _packer(capacity, turn, 0 if last else max(1, shard // CARRY))
        dealt = rest.withColumn("_shard", F.pmod(F.xxhash64(F.col("_row"), F.lit(turn)), F.lit(shards)))
        done = stage(dealt.groupBy("_shard").applyInPandas(run, shape), "packed")
        final = done.where("NOT _open").drop("_open")
        closed = final if closed is None else closed.unionByName(final)
        rest = done.where("_open").select(*columns)
        turn += 1
        if last:
            break
        left = rest.count()
        if not left:
            break
    if with_ids:
        closed = closed.join(numbered.select("_row", "ids"), "_row")
    return closed.withColumn("doc_id", F.when(~F.col("_null"), F.col("doc_id"))).drop("_row", "_null")
