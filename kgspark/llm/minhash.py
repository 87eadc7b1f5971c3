"""Near-duplicate documents: ProbMinHash signatures, banding and exact verification.

A document is the set of its shingles of five words, each weighted 1 + ln(its count). Every shingle is a Poisson process
whose rate is its weight; its arrivals fall on random registers, a register keeps the first arrival, and a shingle stops once its
next arrival comes after the latest register. The share of registers that agree estimates the probability Jaccard
similarity of the weights. Bands of registers propose candidates; a link needs a Jaccard similarity of the shingle
sets of at least the threshold, computed exactly. Repeated shingles can push the similarity of the weights far below that of the
sets, so a document that has some also lies in the bands of its distinct shingles, all weighted 1.

Documents with equal shingle sets shrink to one first. In each bucket the smallest id is compared with every other
member, which already joins groups of copies of any size into one class. Only buckets that still hold several classes
are searched for all their links, in blocks of members; a block pair returns a forest, never its pairs. Classes are
connected components.

Defined results: a document without a word (null or empty text) is a class of its own, as is one with a null id; fewer than five
words form one shingle; rows that share an id are one document with several sets, all in one class, of which ``deduplicate`` keeps the row with the smallest
text (equal texts: by a hash of the row); very long texts are shingled whole, alone in memory; other columns
pass through ``deduplicate``; an empty table gives an empty result. A class is named by its smallest id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stage
from .components import components

WORDS, THRESHOLD = 5, 0.8
# With equal weights the probability Jaccard similarity is |A n B| / max(|A|, |B|), at least the Jaccard similarity: at 0.8 a pair
# shares no band of its distinct shingles with probability (1 - 0.8**5)**25, about 5e-5, whatever their counts.
BANDS, ROWS = 25, 5
# Characters of text whose shingles are in memory at once; members of a bucket compared at once.
CHUNK, BLOCK = 1 << 20, 256
# So many candidate ids (8 bytes each) may travel to all tasks; beyond it they are joined.
BROADCAST_IDS = 4_000_000

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[str | None], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document number, shingle hash, count), by document and hash."""
    import pandas as pd

    split = [(t or "").lower().split() for t in texts]
    sizes = np.array([len(s) for s in split], np.int64)
    flat = [w for s in split for w in s]
    if not flat:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    codes, names = pd.factorize(np.array(flat, object))
    hashed = pd.util.hash_array(np.asarray(names, object), categorize=False)[codes]
    total = np.zeros(len(flat), np.uint64)
    ends = np.cumsum(sizes)
    doc = np.repeat(np.arange(len(texts)), sizes)
    left = ends[doc] - np.arange(len(flat))  # words from here to the end of the document
    for i in range(words):
        # Beyond the end of a short document there is nothing to add.
        here = np.zeros(len(flat), np.uint64)
        here[: max(0, len(flat) - i)] = hashed[i:]
        total = mixed(total + _GOLD) ^ np.where(left > i, here, np.uint64(i))
    first = np.arange(len(flat)) == (ends - sizes)[doc]
    keep = (left >= words) | (first & (sizes[doc] < words))
    doc, total = doc[keep], total[keep]
    order = np.lexsort((total, doc))
    doc, total = doc[order], total[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (total[1:] != total[:-1])
    at = np.flatnonzero(new)
    return doc[at], total[at], np.diff(np.append(at, len(doc)))


def probminhash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, docs: int, registers: int) -> np.ndarray:
    """docs x registers of the elements that arrive first; zero where a document has none."""
    first = np.full(docs * registers, np.inf)
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    active, time, turn = np.arange(len(doc)), np.zeros(len(doc)), 0
    latest, source = np.full(docs, np.inf), mixed(element)
    while len(active):
        turn += 1
        draw = mixed(source[active] + np.uint64(turn * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        # In (0, 1), so that a waiting time is positive and finite.
        u = ((draw >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52
        time = time - np.log(u) / weight[active]
        slot = (mixed(draw ^ _GOLD) % np.uint64(registers)).astype(np.int64)
        slot += doc[active] * registers
        new = time < first[slot]
        slot, when, who = slot[new], time[new], element[active[new]]
        np.minimum.at(first, slot, when)
        kept.append((slot, when, who))
        touched = np.unique(doc[active[new]])
        latest[touched] = first.reshape(docs, registers)[touched].max(axis=1)
        # Early termination: later arrivals of these cannot reach any register.
        going = time < latest[doc[active]]
        active, time = active[going], time[going]
    out = np.zeros(docs * registers, np.uint64)
    for slot, when, who in kept:
        won = when == first[slot]
        out[slot[won]] = who[won]
    return out.reshape(docs, registers)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    key = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(signature), 1))
    for r in range(rows):
        key = mixed(key + _GOLD) ^ signature[:, r::rows][:, :bands]
    return mixed(key).view(np.int64)


def _bands(doc: np.ndarray, element: np.ndarray, count: np.ndarray, docs: int, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and the documents they belong to, by document: of the weighted shingles and, where they differ, of the distinct ones."""
    keys = band_keys(probminhash(doc, element, 1.0 + np.log(count), docs, bands * rows), bands, rows)
    again = np.unique(doc[count > 1])
    of = np.isin(doc, again)
    plain = band_keys(probminhash(np.searchsorted(again, doc[of]), element[of], np.ones(of.sum()), len(again), bands * rows), bands, rows)
    other = plain != keys[again]
    owner = np.concatenate([np.repeat(np.arange(docs), bands), np.repeat(again, other.sum(axis=1))])
    order = np.argsort(owner, kind="stable")
    return np.concatenate([keys.ravel(), plain[other]])[order], owner[order]


def _chunks(texts: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, list[str | None]]]:
    """(position, texts) of slices of bounded size; a longer text comes alone."""
    at, held, size = 0, [], 0
    for i, t in enumerate(texts):
        t = t.as_py()
        if held and size + len(t or "") > most:
            yield at, held
            at, held, size = i, [], 0
        held.append(t)
        size += len(t or "")
    if held:
        yield at, held


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, words: int = WORDS) -> DataFrame:
    """(doc_id, n, d1, d2, bands): number of distinct shingles, a digest of their set, band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in _chunks(batch.column("text")):
                doc, element, count = shingles(texts, words)
                keys, owner = _bands(doc, element, count, len(texts), bands, rows)
                sizes, d1, d2 = _digests(doc, element, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, len(texts)), pa.array(sizes, pa.int64()), pa.array(d1), pa.array(d2),
                     pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(owner, minlength=len(texts)))).astype(np.int32)), pa.array(keys))],
                    names=["doc_id", "n", "d1", "d2", "bands"],
                )

    docs = docs.select(F.col("doc_id").cast("bigint"), "text")
    return docs.mapInArrow(run, "doc_id bigint, n bigint, d1 bigint, d2 bigint, bands array<bigint>")


def _digests(doc: np.ndarray, element: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of distinct shingles and two sums over them, per document."""
    d1, d2 = np.zeros(docs, np.uint64), np.zeros(docs, np.uint64)
    np.add.at(d1, doc, mixed(element + np.uint64(1)))
    np.add.at(d2, doc, mixed(element ^ _GOLD))
    return np.bincount(doc, minlength=docs), d1.view(np.int64), d2.view(np.int64)


def shingle_sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, n, d1, d2, set): the distinct shingle hashes of each row, sorted, with their number and digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in _chunks(batch.column("text")):
                doc, element, _ = shingles(texts, words)
                sizes, d1, d2 = _digests(doc, element, len(texts))
                sets = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(element.view(np.int64)))
                columns = [batch.column("doc_id").slice(at, len(texts)), pa.array(sizes, pa.int64()), pa.array(d1), pa.array(d2), sets]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "d1", "d2", "set"])

    docs = docs.select(F.col("doc_id").cast("bigint"), "text")
    return docs.mapInArrow(run, "doc_id bigint, n bigint, d1 bigint, d2 bigint, set array<bigint>")


def _block_links(threshold: float):
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(key: tuple, one: pa.Table, two: pa.Table) -> pa.Table:
        if not one.num_rows or not two.num_rows:
            return schema.empty_table()
        a, b = one["node"].to_numpy(), two["node"].to_numpy()
        second = two["set"].combine_chunks()
        values, sizes = second.flatten().to_numpy(), np.diff(second.offsets.to_numpy())
        owner = np.repeat(np.arange(len(b)), sizes)
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        first, root, out = one["set"].combine_chunks(), {}, ([], [])

        def lead(x: int) -> int:
            while root.get(x, x) != x:
                x = root[x]
            return x

        for i in range(len(a)):
            mine = first[i].values.to_numpy()
            low, high = np.searchsorted(values, mine, "left"), np.searchsorted(values, mine, "right")
            n = high - low
            # Positions of all postings of this document's shingles.
            at = np.repeat(high - np.cumsum(n), n) + np.arange(n.sum())
            common = np.bincount(owner[at], minlength=len(b))
            for j in np.flatnonzero(common >= threshold * (len(mine) + sizes - common)).tolist():
                u, v = lead(int(a[i])), lead(int(b[j]))
                if u != v:
                    root[max(u, v)] = min(u, v)
                    out[0].append(max(u, v))
                    out[1].append(min(u, v))
        return pa.Table.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], schema=schema)

    return run


def _numbered(members: DataFrame, block: int) -> DataFrame:
    """Members of each bucket dealt to blocks of about ``block`` by a hash; a large bucket is never gathered to be counted."""
    parts = F.ceil(F.col("size") / block).cast("int")
    return members.withColumn("parts", parts).withColumn("b", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))


def classes(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """(doc_id, class_id, n_shingles): one row per row of ``docs``."""
    small_batches(docs.sparkSession)
    signed = stage(signatures(docs, bands, rows, words), "signatures")
    real = signed.where("doc_id IS NOT NULL AND n > 0")
    same, repeats = ["n", "d1", "d2"], _repeats(signed)
    # A shingle set is the node that is linked. Its first document names it; where rows repeat ids, one id may name several sets, and they are numbered.
    sets = real.groupBy(*same).agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"))
    sets = stage(sets.withColumn("node", F.monotonically_increasing_id() if repeats else F.col("first")), "shingle_classes")
    # Buckets with company. The smallest node of a bucket and a digest of its members are combined aggregates.
    placed = sets.select(F.explode("bands").alias("key"), "node", "n")
    buckets = placed.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("hub"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("who"))
    buckets = buckets.where("size > 1").groupBy("size", "hub", "who").agg(F.min("key").alias("key"))
    members = stage(placed.join(buckets.select("key", "size", "hub"), "key").select("key", "size", "hub", "node", "n"), "buckets")
    edges = _links(docs, sets, members, repeats, threshold, words, block) if members.head(1) else None
    if repeats:
        return _classes_of_repeated_ids(signed, sets, edges)
    # Copies follow the document that stands for them; only those documents are linked.
    twins = real.join(sets.where("copies > 1").select(*same, "node"), same).select("doc_id", "node").where("doc_id <> node")
    named = signed.select("doc_id", F.col("n").alias("n_shingles")).join(twins, "doc_id", "left").withColumn("node", F.coalesce("node", "doc_id"))
    if edges is None:
        return named.select("doc_id", F.col("node").alias("class_id"), "n_shingles")
    low = components(edges).select(F.col("u").alias("node"), F.col("v").alias("low"))
    return named.join(low, "node", "left").select("doc_id", F.coalesce("low", "node").alias("class_id"), "n_shingles")


def _links(docs: DataFrame, sets: DataFrame, members: DataFrame, repeats: bool, threshold: float, words: int, block: int) -> DataFrame:
    """(u, v): links of nodes at or above the threshold, enough of them to join all that are linked."""
    wanted = stage(members.select("node").distinct(), "wanted", few=True)
    few = wanted.count() <= BROADCAST_IDS
    of = sets.join(F.broadcast(wanted) if few else wanted, "node", "left_semi").select("first", "node", "n", "d1", "d2") if repeats else wanted.select(F.col("node").alias("first"))
    ids = of.select(F.col("first").alias("doc_id")).distinct()
    chosen = docs.select(F.col("doc_id").cast("bigint"), "text").join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    found = shingle_sets(chosen, words)
    if repeats:
        # A row of such an id is told by its digest; equal rows have equal sets.
        found = found.join(of.withColumnRenamed("first", "doc_id"), ["doc_id", "n", "d1", "d2"]).dropDuplicates(["node"]).select("node", "set")
    else:
        found = found.select(F.col("doc_id").alias("node"), "set")
    found = stage(found, "shingle_sets")
    sized = members.select("hub", "node", "n").where("hub <> node").distinct()
    hubs = members.where("hub = node").select("hub", F.col("n").alias("m")).distinct()
    near = sized.join(hubs, "hub").where(F.least("n", "m") >= threshold * F.greatest("n", "m")).select("hub", "node")
    pairs = near.join(found, "node").withColumnRenamed("set", "one").join(found.select(F.col("node").alias("hub"), F.col("set").alias("two")), "hub")
    both = F.size(F.array_intersect("one", "two"))
    linked = pairs.where(both >= threshold * (F.size("one") + F.size("two") - both)).select(F.col("node").alias("u"), F.col("hub").alias("v"))
    stars = stage(linked, "star_links")
    low = components(stars)
    named = members.join(low.select(F.col("u").alias("node"), F.col("v").alias("low")), "node", "left").withColumn("low", F.coalesce("low", "node"))
    mixed_ = named.where("size > 2").groupBy("key").agg(F.min("low").alias("a"), F.max("low").alias("b")).where("a <> b").select("key")
    open_ = stage(members.join(mixed_, "key").select("key", "size", "node"), "open_buckets")
    if not open_.head(1):
        return stars
    keys = ["key", "i", "j"]
    blocks = stage(_numbered(open_, block).join(found, "node"), "bucket_blocks")
    left = blocks.select("key", F.col("b").alias("i"), F.explode(F.sequence(F.col("b"), F.col("parts") - 1)).alias("j"), "node", "set")
    right = blocks.select(F.col("key").alias("key"), F.explode(F.sequence(F.lit(0), F.col("b"))).alias("i"), F.col("b").alias("j"), F.col("node").alias("node"), F.col("set").alias("set"))
    rest = left.groupBy(*keys).cogroup(right.groupBy(*keys))
    return stars.unionByName(stage(rest.applyInArrow(_block_links(threshold), "u bigint, v bigint"), "block_links"))


def _classes_of_repeated_ids(signed: DataFrame, sets: DataFrame, edges: DataFrame | None) -> DataFrame:
    """The classes if some ids have several rows: all sets of an id are one class, which its smallest id names."""
    rows = stage(signed.where("doc_id IS NOT NULL AND n > 0").join(sets.select("n", "d1", "d2", "node"), ["n", "d1", "d2"]).select("doc_id", "node"), "rows_of_sets")
    first = stage(rows.groupBy("doc_id").agg(F.min("node").alias("hub")), "first_sets")
    together = rows.join(first, "doc_id").where("node <> hub").select(F.col("node").alias("u"), F.col("hub").alias("v"))
    low = components(together if edges is None else edges.unionByName(together)).select(F.col("u").alias("hub"), F.col("v").alias("low"))
    placed = stage(first.join(low, "hub", "left").select("doc_id", F.coalesce("low", "hub").alias("low")), "placed_ids")
    names = stage(placed.groupBy("low").agg(F.min("doc_id").alias("class_id")), "class_names")
    of = placed.join(names, "low").select("doc_id", "class_id")
    return signed.select("doc_id", F.col("n").alias("n_shingles")).join(of, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), "n_shingles")


def _repeats(signed: DataFrame) -> bool:
    return bool(signed.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").head(1))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, kept and n_shingles of every row."""
    return classes(docs).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True))).select("doc_id", "class_id", "kept", "n_shingles")


def deduplicate(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that stay: of each class the one with the smallest id."""
    found = stage(classes(docs, threshold), "classes", few=True)
    gone = stage(found.where("doc_id <> class_id").select("doc_id").distinct(), "gone", few=True)
    few = gone.count() <= BROADCAST_IDS
    left = docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti")
    twice = found.where("doc_id = class_id").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not twice.head(1):
        return left
    twice = stage(twice, "twice", few=True)
    plain = [c for c, kind in left.dtypes if "map<" not in kind and kind != "variant"]
    first = F.min_by(F.struct(*left.columns), F.struct("text", F.xxhash64(*plain))).alias("row")
    one = left.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(first).select("row.*")
    return left.join(twice, "doc_id", "left_anti").unionByName(one)
