"""Alignment of two tokenizers over the same text: a byte-level vocabulary (A) and a piece vocabulary (B).

A encodes a space and the text, B the text (it puts the space there itself), so both cover the same bytes. Tokens of a batch lie
one after the other, each document's in bytes of its own; ``pandas.merge_asof`` finds for each token start the other side's
token that covers it, and the union of both directions is every overlapping pair. Where both sides start a token, a group starts.

A single space between two ASCII signs or word characters is inside no token of either side, only at its front. Texts are cut there, so
each distinct word of a batch is encoded once. Ids are written once and read twice: to count pairs and to align. No pair crosses
a common start, so a text of any length is aligned in slices.

A pair's count is the number of documents that hold it. Pairs of a task are counted before they are shuffled. The table
of counted pairs travels to the tasks while it has at most ``BROADCAST_PAIRS`` rows; beyond that the distinct pairs
of every document are joined with it.

Defined results: a null or empty text, or one whose tokens do not spell a space and the text on both sides (a text that
holds U+2581), has no tokens: zeros and an empty ``groups_sha256``. Strings of special tokens are plain text. Each row is a document,
also when rows repeat an id or have none; other columns play no part; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stage
from .tokens import byte_letters, public_path

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
# Characters encoded and tokens aligned at once, words whose tokens one worker remembers, pairs a task counts before it hands them on.
CHUNK, TOKENS, REMEMBERED, HELD = 1 << 19, 1 << 17, 400_000, 1 << 19
# Rows of 13 bytes that may travel to all tasks.
BROADCAST_PAIRS = 2_000_000
# B's ids are below this and A's in 16 bits, so a pair fits 32 bits.
SIDE = 1 << 16

_SPACE = re.compile(r"(?<=[!-~\w]) (?=[!-~\w])")
COUNTS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


class _Lists:
    """Lists of ids, one behind the other."""

    def __init__(self):
        self.values, self.start, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        ids = np.fromiter(chain.from_iterable(lists), np.int32, int(size.sum()))
        self.start = np.append(self.start, len(self.values) + np.cumsum(size) - size)
        self.size = np.append(self.size, size)
        self.values = np.append(self.values, ids)
        return ids, size

    def of(self, codes: np.ndarray, owner: np.ndarray, owners: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these lists in turn, and how many each owner has."""
        size = self.size[codes]
        at = np.repeat(self.start[codes] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return self.values[at], np.bincount(owner, size, owners).astype(np.int64)


def _differ(text: list[bytes], ids: np.ndarray, size: np.ndarray, spelling: dict[int, bytes], spelled: np.ndarray) -> np.ndarray:
    """Which lists of ids, of so many ids each and one behind the other, do not spell their text."""
    ends = np.cumsum(size)
    wrong = np.diff(np.append(0, np.cumsum(spelled[ids])[ends - 1])) != np.fromiter(map(len, text), np.int64, len(text))
    if b"".join(map(spelling.__getitem__, ids.tolist())) != b"".join(text):
        for i in range(len(text)):
            wrong[i] |= b"".join(map(spelling.__getitem__, ids[ends[i] - size[i] : ends[i]].tolist())) != text[i]
    return wrong


class Sides:
    """Both tokenizers: the bytes of their tokens, and the ids of words, remembered under a code."""

    def __init__(self, a_path: str, b_path: str, remembered: int = REMEMBERED):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        byte = {letter: b for b, letter in byte_letters().items()}
        self.a_bytes = {i: bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t, i in self.a.get_vocab().items()}
        spelled = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = {i: bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(spelled)}
        self.codes: dict[str, int] = {}
        self.sides = [_Lists(), _Lists()]
        self.wrong = np.zeros(0, bool)
        self.spelled = self.sizes()
        self.remembered = remembered

    def learn(self, words: list[str]) -> np.ndarray:
        """The codes of all these words, under which their ids are remembered until ``learn`` is called again."""
        new = set(words) - self.codes.keys()
        if len(self.codes) + len(new) > self.remembered:
            self.codes, self.sides, self.wrong, new = {}, [_Lists(), _Lists()], self.wrong[:0], set(words)
        new = list(new)
        if new:
            a = [e.ids for e in self.a.encode_batch_fast([" " + w for w in new], add_special_tokens=False)]
            b = self.b.encode(new, num_threads=1)
            text = [b" " + w.encode() for w in new]
            differ = [_differ(text, *side.add(ids), *told) for side, ids, told in zip(self.sides, (a, b), zip((self.a_bytes, self.b_bytes), self.spelled))]
            self.wrong = np.append(self.wrong, differ[0] | differ[1])
            self.codes.update(zip(new, range(len(self.codes), len(self.codes) + len(new))))
        return np.fromiter(map(self.codes.__getitem__, words), np.int64, len(words))

    def ids(self, words: list[str], sizes: list[int]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray], np.ndarray]:
        """For texts of so many words each, one after the other: ids and numbers of ids of A, those of B, and which texts are not spelled."""
        codes, of = self.learn(words), np.repeat(np.arange(len(sizes)), sizes)
        bad = np.bincount(of[self.wrong[codes]], minlength=len(sizes)) > 0
        codes, of = codes[~bad[of]], of[~bad[of]]
        return *(side.of(codes, of, len(sizes)) for side in self.sides), bad

    def sizes(self) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of each id, A's and B's."""
        return tuple(np.array([len(of[i]) for i in range(max(of) + 1)], np.int64) for of in (self.a_bytes, self.b_bytes))


def _encoded(texts: list[str | None], sides: Sides, chunk: int) -> Iterator[tuple[int, list[tuple[np.ndarray, np.ndarray]]]]:
    """(number of texts, their ids and numbers of ids on both sides) of texts of ``chunk`` characters together; a longer one alone, learnt in slices."""
    at = 0
    while at < len(texts):
        end, held, size = at, [], 0
        while end < len(texts) and (end == at or size + len(texts[end] or "") <= chunk):
            held.append(_SPACE.split(texts[end]) if texts[end] else [])
            size += len(texts[end] or "")
            end += 1
        if size <= chunk:
            a, b, _ = sides.ids(list(chain.from_iterable(held)), [len(w) for w in held])
            yield end - at, [a, b]
        else:
            step = max(1, chunk // 8)
            parts = [sides.ids(words, [len(words)]) for words in (held[0][low : low + step] for low in range(0, len(held[0]), step))]
            if any(bad[0] for _, _, bad in parts):
                parts = [p for p in parts if p[2][0]][:1]
            yield 1, [tuple(np.concatenate(x) if k == 0 else np.sum(x, axis=0) for k, x in enumerate(zip(*(p[i] for p in parts)))) for i in (0, 1)]
        at = end


def encoded(docs: DataFrame, a_path: str, b_path: str, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, a, b): the ids of both sides; both empty where a text has no tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = None
        for batch in batches:
            sides, at = sides or Sides(a_path, b_path), 0
            for n, found in _encoded(batch.column("text").to_pylist(), sides, chunk):
                lists = [pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(ids)) for ids, size in found]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, n), *lists], names=["doc_id", "a", "b"])
                at += n

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, a array<int>, b array<int>")


def covering(a_start: np.ndarray, b_start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each A start the B token that covers it, and the other way round; both sides cover the same bytes without a gap."""
    import pandas as pd

    a, b = pd.DataFrame({"start": a_start, "a": np.arange(len(a_start))}), pd.DataFrame({"start": b_start, "b": np.arange(len(b_start))})
    return pd.merge_asof(a, b, on="start")["b"].to_numpy(), pd.merge_asof(b, a, on="start")["a"].to_numpy()


class Aligned:
    """Tokens, pairs and groups of several documents (or slices of one), each in bytes of its own."""

    def __init__(self, docs: list[tuple[np.ndarray, np.ndarray]], sizes: tuple[np.ndarray, np.ndarray]):
        self.a, self.b = (np.concatenate([d[i] for d in docs]) for i in (0, 1))
        self.n_a, self.n_b = (np.array([len(d[i]) for d in docs], np.int64) for i in (0, 1))
        a_size, b_size = sizes[0][self.a], sizes[1][self.b]
        a_start, b_start = np.cumsum(a_size) - a_size, np.cumsum(b_size) - b_size
        of_a, of_b = covering(a_start, b_start)
        a_first, b_first = b_start[of_a] == a_start, a_start[of_b] == b_start
        # A start that both share is found from either side; it counts once.
        rest = np.flatnonzero(~b_first)
        owner = np.repeat(np.arange(len(docs)), self.n_a)
        self.doc = np.concatenate([owner, owner[of_b[rest]]])
        self.pair = np.concatenate([self.a.astype(np.int64) * SIDE + self.b[of_a], self.a[of_b[rest]].astype(np.int64) * SIDE + self.b[rest]])
        self.a_group, self.b_group = np.cumsum(a_first) - 1, np.cumsum(b_first) - 1
        self.a_last, self.b_last = np.append(a_first[1:], True), np.append(b_first[1:], True)
        self.n_groups = np.bincount(owner[a_first], minlength=len(docs))

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, pair, how often) without repetitions."""
        both, n = np.unique(self.doc << 32 | self.pair, return_counts=True)
        return both >> 32, both & 0xFFFFFFFF, n

    def written(self) -> Iterator[bytes]:
        """Per document its groups as text, a ``;`` behind each."""
        groups = int(self.n_groups.sum())
        a_of = np.append(0, np.cumsum(np.bincount(self.a_group, minlength=groups)))
        b_of = np.append(0, np.cumsum(np.bincount(self.b_group, minlength=groups)))
        text = np.empty(len(self.a) + len(self.b), object)
        for ids, last, mark, place in (
            (self.a, self.a_last, "|", np.arange(len(self.a)) + b_of[self.a_group]),
            (self.b, self.b_last, ";", np.arange(len(self.b)) + a_of[self.b_group + 1]),
        ):
            kinds, which = np.unique(ids * 2 + last, return_inverse=True)
            text[place] = np.array([f"{k >> 1}{mark if k & 1 else ','}".encode() for k in kinds.tolist()], object)[which]
        ends = np.cumsum(self.n_a + self.n_b).tolist()
        for low, high in zip([0, *ends], ends):
            yield b"".join(text[low:high].tolist())


def _slices(a: np.ndarray, b: np.ndarray, sizes: tuple[np.ndarray, np.ndarray], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A long document in slices of about ``most`` tokens of A, cut where tokens of both sides end."""
    a_end, b_end = np.cumsum(sizes[0][a]), np.cumsum(sizes[1][b])
    low_a = low_b = 0
    while low_a < len(a):
        high = min(low_a + most, len(a))
        while b_end[at := np.searchsorted(b_end, a_end[high - 1])] != a_end[high - 1]:
            high += 1
        yield a[low_a:high], b[low_b : at + 1]
        low_a, low_b = high, at + 1


def _aligned(batch: pa.RecordBatch, sizes: tuple[np.ndarray, np.ndarray], most: int) -> Iterator[tuple[list[int], Aligned, bool]]:
    """(positions, alignment, last slice?) of the rows that have tokens, taken together up to ``most`` tokens. A longer one
    comes alone, in slices that follow one another."""
    held, size = {}, 0
    columns = []
    for name in ("a", "b"):
        values = batch.column(name)
        columns.append((values.flatten().to_numpy(), values.offsets.to_numpy() - values.offsets[0].as_py()))
    for i in range(batch.num_rows):
        a, b = (values[at[i] : at[i + 1]] for values, at in columns)
        if len(a) > most:
            before = None
            for part in _slices(a, b, sizes, most):
                if before:
                    yield [i], Aligned([before], sizes), False
                before = part
            yield [i], Aligned([before], sizes), True
            continue
        if held and size + len(a) > most:
            yield list(held), Aligned(list(held.values()), sizes), True
            held, size = {}, 0
        if len(a):
            held[i] = a, b
            size += len(a)
    if held:
        yield list(held), Aligned(list(held.values()), sizes), True


def counted_pairs(tokens: DataFrame, sizes: tuple[np.ndarray, np.ndarray], most: int = TOKENS) -> DataFrame:
    """(a, b, n): how many rows of ``tokens(a, b)`` hold each linked pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            pairs, which = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
            n = np.bincount(which, np.concatenate([c for _, c in held])).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array((pairs // SIDE).astype(np.int32)), pa.array((pairs % SIDE).astype(np.int32)), pa.array(n)], names=["a", "b", "n"])

        for batch in batches:
            open_ = []
            for _, found, last in _aligned(batch, sizes, most):
                pairs = found.distinct()[1]
                if not last:  # a slice: a pair counts once in the whole text
                    open_.append(pairs)
                    continue
                if open_:
                    pairs, open_ = np.unique(np.concatenate([*open_, pairs])), []
                held.append(np.unique(pairs, return_counts=True))
                size += len(held[-1][0])
                if size > HELD:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    found = tokens.select("a", "b").mapInArrow(run, "a int, b int, n bigint")
    return found.groupBy("a", "b").agg(F.sum("n").alias("n"))


def _per_row(tokens: DataFrame, sizes: tuple[np.ndarray, np.ndarray], most: int, table=None) -> DataFrame:
    """One row per row of ``tokens``. With the broadcast (pair, count, best) arrays its sums, without them its pairs and how often it has them."""
    wide = "" if table else ", pairs array<struct<a int, b int, links bigint>>"
    schema = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string" + wide
    listed = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("links", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, count, best = table.value if table else (None, None, None)
        for batch in batches:
            sums = np.zeros((batch.num_rows, len(COUNTS)), np.int64)
            digest, open_, pairs = [""] * batch.num_rows, None, [[] for _ in range(batch.num_rows)]
            for rows, found, last in _aligned(batch, sizes, most):
                size = len(rows)
                per = [found.n_a, found.n_b, found.n_groups, np.bincount(found.doc, minlength=size)]
                if table:
                    place = np.searchsorted(pair, found.pair)
                    total = np.zeros(size, np.int64)
                    np.add.at(total, found.doc, count[place])
                    per += [np.bincount(found.doc[best[place]], minlength=size), total]
                else:
                    for d, p, n in zip(*(x.tolist() for x in found.distinct())):
                        pairs[rows[d]].append({"a": p // SIDE, "b": p % SIDE, "links": n})
                sums[np.array(rows), : len(per)] += np.stack(per, axis=1)
                for i, text in zip(rows, found.written()):
                    open_ = open_ or hashlib.sha256()
                    open_.update(text[:-1] if last else text)
                    if last:
                        digest[i], open_ = open_.hexdigest(), None
            columns = [batch.column("doc_id"), *(pa.array(sums[:, k]) for k in range(len(COUNTS))), pa.array(digest, pa.string())]
            names = ["doc_id", *COUNTS, "groups_sha256"]
            if not table:
                columns, names = [*columns, pa.array(pairs, listed)], [*names, "pairs"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return tokens.mapInArrow(run, schema)


def links(tokens: DataFrame, sizes: tuple[np.ndarray, np.ndarray], most: int = TOKENS) -> DataFrame:
    """(a, b, n, best): the linked pairs of ids, in how many rows they are, and whether no other pair of that A id has more."""
    counted = stage(counted_pairs(tokens, sizes, most), "token_pairs")
    top = counted.groupBy("a").agg(F.max("n").alias("top"))
    return stage(counted.join(top, "a").select("a", "b", "n", (F.col("n") == F.col("top")).alias("best")), "token_links")


def align(
    docs: DataFrame, a_path: str | None = None, b_path: str | None = None, chunk: int = CHUNK, most: int = TOKENS, broadcast_pairs: int = BROADCAST_PAIRS
) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row."""
    a_path, b_path = a_path or public_path(A_FILE), b_path or public_path(B_FILE)
    spark, sizes = docs.sparkSession, Sides(a_path, b_path).sizes()
    small_batches(spark)
    tokens = stage(encoded(docs, a_path, b_path, chunk), "tokens")
    linked = links(tokens, sizes, most)
    if linked.count() <= broadcast_pairs:
        held = linked.toArrow()
        pair = held["a"].to_numpy().astype(np.int64) * SIDE + held["b"].to_numpy()
        order = np.argsort(pair)
        values = (pair[order], held["n"].to_numpy()[order], held["best"].to_numpy(zero_copy_only=False).astype(bool)[order])
        return _per_row(tokens, sizes, most, spark.sparkContext.broadcast(values))
    # Rows with the same id and the same groups have the same tokens, so they may share their sums.
    rows = stage(_per_row(tokens, sizes, most), "token_rows")
    key = ["doc_id", "groups_sha256"]
    held = stage(rows.where("n_links > 0").dropDuplicates(key).select(*key, F.inline("pairs")), "row_pairs")
    found = held.join(linked, ["a", "b"]).groupBy(*key).agg(
        F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("best_"), F.sum(F.col("links") * F.col("n")).alias("sum_")
    )
    found = found.select(F.col("doc_id").alias("of"), F.col("groups_sha256").alias("groups"), "best_", "sum_")
    match = F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("groups_sha256") == F.col("groups"))
    return rows.join(found, match, "left").select(
        "doc_id", *COUNTS[:4], F.coalesce("best_", F.lit(0)).alias("n_best"), F.coalesce("sum_", F.lit(0)).alias("count_sum"), "groups_sha256"
    )
