"""Document fingerprints: quartile digests of hashed byte triplets, and their bounded difference.

Every three neighbouring bytes of the UTF-8 text fall into one of ``BUCKETS`` buckets. The three quartiles of the bucket counts
give each bucket a code from 0 to 3, above how many quartiles its count lies. A fingerprint is the length of the text (a
logarithmic code of four steps an octave), the ratios of the lower quartiles to the upper one (sixteenths, wrapped), and
the codes, in hexadecimal. The difference of two adds up the distances of lengths, ratios and codes, a distance of three codes
counting twice; likeness falls from 1 to 0 as it grows to ``BOUND``, what two unrelated texts have on average.

Neighbours (the next document by id) need no global order in one task: ids are cut into ranges, each range is streamed in
order, and the first row of a range also goes to the end of the range before.

Defined results: a null text counts as the empty one, whose fingerprint is all zeros; a null id comes before all others;
rows that share an id are ordered by a hash of the text, then by the text; an only document is followed by itself; other columns
play no part; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from .common import small_batches

BUCKETS = 256
# 1.625 is the mean distance of two random codes; ratios and lengths have no share in the bound.
BOUND = 13 * BUCKETS // 8
DISTANCE = [0, 1, 2, 6]
# Bytes of text whose triplets are counted at once, and bytes of text of one range.
CHUNK, RANGE = 1 << 20, 32 << 20


def bucket_counts(texts: list[bytes]) -> np.ndarray:
    """texts x buckets: how many triplets of each text fall into each bucket."""
    sizes = np.array([len(t) for t in texts], np.int64)
    x = np.frombuffer(b"".join(texts) + bytes(2), np.uint8).astype(np.uint32)
    h = (x[:-2] << 16 | x[1:-1] << 8 | x[2:]) * np.uint32(2654435761)
    h = ((h ^ h >> 15) * np.uint32(73244475)) >> 24
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(h))  # bytes from here to the end of the text
    slot = np.repeat(np.arange(len(texts)), sizes) * BUCKETS + h
    return np.bincount(slot[left > 2], minlength=len(texts) * BUCKETS).reshape(-1, BUCKETS)


def digests(texts: list[bytes]) -> np.ndarray:
    """texts x (3 + buckets) small integers: length, two ratios, codes."""
    out = np.zeros((len(texts), 3 + BUCKETS), np.uint8)
    for low, high in _chunks([len(t) for t in texts], CHUNK):
        counts = bucket_counts(texts[low:high])
        q = np.partition(counts, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1], axis=1)
        q1, q2, q3 = (q[:, k * BUCKETS // 4 - 1] for k in (1, 2, 3))
        part = out[low:high]
        part[:, 0] = [length_code(len(t)) for t in texts[low:high]]
        part[:, 1], part[:, 2] = (v * 100 // np.maximum(q3, 1) % 16 for v in (q1, q2))
        for v in (q1, q2, q3):
            part[:, 3:] += counts > v[:, None]
    return out


def length_code(n: int) -> int:
    """Four steps an octave, 255 at most: the place of the leading bit, then the two bits behind it."""
    bits = n.bit_length()
    return min(255, n if bits < 3 else 4 * (bits - 2) + (n >> (bits - 3) & 3))


def written(digest: np.ndarray) -> list[str]:
    """A row of ``digests`` in hexadecimal: two digits for the length, one for each ratio and for each pair of codes."""
    pairs = digest[:, 3::2] * 4 + digest[:, 4::2]
    letters = np.array(list(b"0123456789abcdef"), np.uint8)
    values = np.concatenate([digest[:, :1] >> 4, digest[:, :1] & 15, digest[:, 1:3], pairs], axis=1)
    return [row.tobytes().decode() for row in letters[values]]


def read(fingerprint: str) -> np.ndarray:
    value = np.array([int(c, 16) for c in fingerprint], np.uint8)
    codes = np.stack([value[4:] >> 2, value[4:] & 3], axis=1).ravel()
    return np.concatenate([[value[0] * 16 + value[1]], value[2:4], codes]).astype(np.uint8)


def difference(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Row by row: steps of length, steps of the ratios around their circle, distances of codes."""
    apart = np.abs(one.astype(np.int64) - two)
    ratios = np.minimum(apart[:, 1:3], 16 - apart[:, 1:3]).sum(axis=1)
    return apart[:, 0] + ratios + np.array(DISTANCE)[apart[:, 3:]].sum(axis=1)


def likeness(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return 1.0 - np.minimum(difference(one, two), BOUND) / BOUND


def fingerprints(docs: DataFrame, column: str = "text", name: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of a column of texts."""

    def make(texts: pd.Series) -> pd.Series:
        return pd.Series(written(digests([(t or "").encode() for t in texts])), texts.index)

    small_batches(docs.sparkSession)
    return docs.withColumn(name, F.pandas_udf(make, "string")(F.col(column)))


def _chunks(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of positions whose sizes add up to ``most`` at most; a larger one comes alone."""
    low, held = 0, 0
    for i, size in enumerate(sizes):
        if i > low and held + size > most:
            yield low, i
            low, held = i, 0
        held += size
    if low < len(sizes):
        yield low, len(sizes)


def _range_starts(keyed: DataFrame, ranges: int) -> list[tuple]:
    """The smallest key of each of about ``ranges`` ranges of rows in order: that many small values."""
    key = F.struct(F.col("doc_id").isNotNull().alias("some"), F.coalesce("doc_id", F.lit(0)).alias("id"), "tie")
    parts = keyed.select(key.alias("key")).repartitionByRange(ranges, "key")
    return sorted(tuple(r["key"]) for r in parts.groupBy(F.spark_partition_id()).agg(F.min("key").alias("key")).collect())


def with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """(part, borrowed, doc_id, text): ranges of ``docs`` in order; the last, borrowed row of a range is the first of the next one."""
    spark = docs.sparkSession
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = keyed.withColumn("tie", F.xxhash64("text"))
    if ranges is None:
        size = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        ranges = max(1, -(-size // RANGE))
    starts = _range_starts(keyed, ranges)
    last = max(0, len(starts) - 1)
    places = spark.sparkContext.broadcast(starts)

    def place(ids: pd.Series, ties: pd.Series) -> pd.Series:
        keys = [(False, 0, t) if pd.isna(i) else (True, int(i), t) for i, t in zip(ids.astype("object"), ties.tolist())]
        return pd.Series([bisect_right(places.value, k) - 1 for k in keys], ids.index)

    def begins(ids: pd.Series, ties: pd.Series) -> pd.Series:
        firsts = set(places.value)
        return pd.Series([((False, 0, t) if pd.isna(i) else (True, int(i), t)) in firsts for i, t in zip(ids.astype("object"), ties.tolist())], ids.index)

    # Ids travel to Python as text: a column with nulls would lose digits as doubles.
    named = F.col("doc_id").cast("string")
    placed = keyed.withColumn("part", F.pandas_udf(place, IntegerType())(named, "tie")).withColumn("begins", F.pandas_udf(begins, "boolean")(named, "tie"))
    own = F.struct(F.col("part"), F.lit(False).alias("borrowed"))
    before = F.struct(F.when(F.col("part") == 0, last).otherwise(F.col("part") - 1).alias("part"), F.lit(True).alias("borrowed"))
    spread = placed.select(F.explode(F.when(F.col("begins"), F.array(own, before)).otherwise(F.array(own))).alias("at"), "doc_id", "tie", "text")
    spread = spread.select("at.part", "at.borrowed", "doc_id", "tie", "text")
    order = ["part", "borrowed", F.asc_nulls_first("doc_id"), "tie", "text"]
    return spread.repartition(len(starts) or 1, "part").sortWithinPartitions(*order).select("part", "borrowed", "doc_id", "text")


def _rows(held: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
    """Result rows of (doc_id, text, next text)."""
    edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for _, t, n in held]
    own, other, after = (digests([t.encode() for t in texts]) for texts in ([h[1] for h in held], edited, [h[2] for h in held]))
    return pa.RecordBatch.from_arrays(
        [pa.array([h[0] for h in held], pa.int64()), pa.array([len(h[1]) for h in held], pa.int64()),
         pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()), pa.array(written(own), pa.string()),
         pa.array(written(other), pa.string()), pa.array(likeness(own, other)), pa.array(likeness(own, after))],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def edited_fingerprints(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """The fingerprint of every text, of the text with its last half replaced by the start of the next document, and how like they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, held, size = None, [], 0
        for batch in batches:
            for part, borrowed, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("part", "borrowed", "doc_id", "text"))):
                # Of several borrowed rows the first is next; the others follow a borrowed row.
                if before and before[0] == part and not before[1]:
                    held.append((before[2], before[3], text))
                    size += len(before[3]) + len(text)
                    if size > CHUNK:
                        yield _rows(held)
                        held, size = [], 0
                before = part, borrowed, doc_id, text
        if held:
            yield _rows(held)

    small_batches(docs.sparkSession)
    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, ranges).mapInArrow(run, schema)
