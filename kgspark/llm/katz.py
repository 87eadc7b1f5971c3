"""Language-model scores: Katz backoff with Good-Turing discounts and exactly normalised backoff weights.

A text is lower-cased (A-Z), split at white space and closed by an end token. Words, n-grams and contexts are known by 64-bit
hashes. P(w | h) = d(r) r / c(h) for an n-gram seen r times, else alpha(h) P(w | shorter h); the unigrams keep their discounted mass for one
unknown word. alpha(h) makes the probabilities after h sum to one over the training vocabulary and that word.

The corpus is encoded once, in pieces of bounded size. A level of the model is one exchange: each piece asks about its distinct n-grams
in sorted runs, one per hash range; the task of a range adds up the training counts, keeps them as its partition of
the level's table, and answers every piece. One more exchange by context hash adds up the discounted mass and the lower-order mass of each
context, each n-gram contributed by one piece only. A frequent word, pair or context so counts once per piece, wherever it
occurs. ``order`` is the longest n-gram; tables lie in ``<path>/ngrams=<n>/kind=table`` and ``<path>/weights=<n>/kind=table``.

Defined results: null and empty texts are the end token alone; a null id belongs to the fold of the empty text; repeated rows
are scored and counted each; without training tokens every score is that of the unknown word with probability one; other columns are ignored; an empty table
gives an empty result. A context all of whose n-grams are undiscounted counts one occurrence more, so that
some mass is left for backing off.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold_of, freeing_shuffles, scratch_path, small_batches

ORDER, FOLDS, HELD_OUT = 2, 7, 2
# Counts up to this one are discounted.
CUTOFF = 5
# Bytes of text in a piece; n-grams that one task adds up.
PIECE, RANGE = 8 << 20, 1_500_000
END, START = b"\n", b"\t"  # white space, so no word


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash(words: np.ndarray) -> np.ndarray:
    import pandas as pd

    return _mixed(pd.util.hash_array(np.asarray(words, object), categorize=False))


def extend(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of an n-gram from those of its context and its last word."""
    return _mixed(context * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD1B54A32D192ED03) ^ word)


def planes(x: np.ndarray) -> bytes:
    """An array byte plane by byte plane, packed: what sorted or small numbers have in common lies together."""
    z = zlib.compressobj(1, zlib.DEFLATED, -15, 9, zlib.Z_RLE)
    return z.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)) + z.flush()


def whole(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data, -15), np.uint8).reshape(size, -1).T).view(kind).ravel()


def runs(hashes: np.ndarray, ranges: int) -> list[tuple[int, int, int]]:
    """(range, first, end) of the non-empty runs of sorted hashes that fall into equal ranges of all hashes."""
    cuts = np.array([(i << 64) // ranges for i in range(1, ranges)], np.uint64)
    at = [0, *np.searchsorted(hashes, cuts).tolist(), len(hashes)]
    return [(i, a, b) for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) if b > a]


def discounts(counts: list[int], cutoff: int = CUTOFF) -> np.ndarray:
    """d(0) to d(cutoff) from the numbers of n-grams seen once, twice and so on; d is 1 beyond.

    Good-Turing with Katz's correction, with a lower cutoff where counts of counts are too sparse for it; with none
    left, singletons take the share of an absolute discount.
    """
    n = [0, *counts, *[0] * (cutoff + 2)]
    for k in range(cutoff, 0, -1):
        if not all(n[r] for r in range(1, k + 2)):
            continue
        common = (k + 1) * n[k + 1] / n[1]
        d = [((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if common < 1 else -1.0 for r in range(1, k + 1)]
        if all(0 < x <= 1 for x in d):
            return np.array([1.0, *d, *[1.0] * (cutoff - k)])
    share = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.0
    return np.array([1.0, 1 - min(max(share, 0.1), 0.9), *[1.0] * (cutoff - 1)])


class Level:
    """Counts of one order: discounts, number of tokens and of distinct n-grams."""

    def __init__(self, hist: list[int] | None):
        hist = hist or [0] * (CUTOFF + 3)
        self.tokens, self.types, self.d = int(hist[0]), int(hist[1]), discounts(list(map(int, hist[2:])))
        self.counts = list(map(int, hist[2:]))

    def discounted(self, r: np.ndarray) -> np.ndarray:
        return r * self.d[np.where(r <= CUTOFF, r, 0)]

    def unigram(self, r: np.ndarray) -> np.ndarray:
        """Probability of words seen r times; 0 stands for the unknown word."""
        if not self.tokens:
            return np.ones(len(r))
        lost = sum((1 - self.d[i]) * i * n for i, n in enumerate(self.counts[:CUTOFF], 1))
        total = self.tokens if lost > 0 else self.tokens + 1
        return np.where(r > 0, self.discounted(r), lost if lost > 0 else 1.0) / total


ENCODED = "piece bigint, words bigint, ids array<bigint>, held array<boolean>, sizes binary, tokens binary, vocabulary binary, seen binary"


def encode(docs: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT, piece: int = PIECE) -> DataFrame:
    """The corpus as pieces: sizes of the texts, word numbers (frequent ones small), hashes and training counts of the words."""

    def row(ids: list, held: list, texts: list) -> pa.RecordBatch:
        import pandas as pd
        from pyspark import TaskContext

        split = [[*(t or "").encode("utf-8", "replace").lower().split(), END] for t in texts]
        sizes = np.array([len(s) for s in split], np.int32)
        flat = np.empty(int(sizes.sum()), object)
        flat[:] = [w for s in split for w in s]
        codes, names = pd.factorize(flat)
        order = np.argsort(-np.bincount(codes), kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        codes = place[codes]
        learn = np.repeat(~np.array(held, bool), sizes)
        seen = np.bincount(codes[learn], minlength=len(order)).astype(np.uint32)
        row.number += 1
        context = TaskContext.get()
        number = ((context.partitionId() if context else 0) << 32) + row.number
        return pa.RecordBatch.from_arrays(
            [pa.array([number]), pa.array([len(flat)]), pa.array([ids], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.bool_())), pa.array([planes(sizes)]),
             pa.array([planes(codes)]), pa.array([planes(_hash(names)[order])]), pa.array([planes(seen)])],
            names=["piece", "words", "ids", "held", "sizes", "tokens", "vocabulary", "seen"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row.number = 0
        ids, held, texts, size = [], [], [], 0
        for batch in batches:
            for i, h, t in zip(batch.column("doc_id").to_pylist(), batch.column("held").to_pylist(), batch.column("text"), strict=True):
                text = t.as_py()
                if texts and size + len(text or "") > piece:
                    yield row(ids, held, texts)
                    ids, held, texts, size = [], [], [], 0
                ids.append(i)
                held.append(h)
                texts.append(text)
                size += len(text or "")
        if texts:
            yield row(ids, held, texts)

    flagged = docs.select(F.col("doc_id").cast("bigint"), "text", (fold_of("doc_id", folds) == held_out).alias("held"))
    return flagged.mapInArrow(run, ENCODED)


class Piece:
    """One encoded piece with the answers that have come so far."""

    def __init__(self, row: dict, answers: dict[str, np.ndarray], levels: list[Level]):
        self.sizes = whole(row["sizes"], np.int32).astype(np.int64)
        self.words = whole(row["tokens"], np.int32).astype(np.int64)
        self.held = np.repeat(np.array(row["held"], bool), self.sizes)
        self.vocabulary = whole(row["vocabulary"], np.uint64)
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])[:-1]
        self.answers, self.levels = answers, levels
        self.order = np.argsort(self.vocabulary)

    def word_counts(self) -> np.ndarray:
        """Training count of each word of the piece."""
        out = np.empty(len(self.order), np.int64)
        out[self.order] = self.answers["ngrams=1"].astype(np.int64)
        return out

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(n-gram of each token, context of each n-gram, word of each n-gram, hash of each context) for n > 1.

        Contexts are numbered within the piece; before its first word a text is preceded by start tokens.
        """
        inside = np.arange(len(self.words)) - np.repeat(self.first, self.sizes)
        names = np.append(self.vocabulary, _hash(np.array([START], object)))
        context, hashes = np.zeros(len(self.words), np.int64), np.zeros(1, np.uint64)
        for back in range(n - 1, 0, -1):
            word = np.full(len(self.words), len(self.vocabulary))
            word[back:] = np.where(inside[back:] >= back, self.words[:-back], word[back:])
            pairs, context = np.unique(context * len(names) + word, return_inverse=True)
            hashes = extend(hashes[pairs // len(names)], names[pairs % len(names)])
        pairs, gram = np.unique(context * len(self.vocabulary) + self.words, return_inverse=True)
        return gram, pairs // len(self.vocabulary), pairs % len(self.vocabulary), hashes

    def context_counts(self, n: int, contexts: int, gram: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Training occurrences of each context: those of its n-1 words, or of all texts if it holds starts only."""
        inside = np.arange(len(self.words)) - np.repeat(self.first, self.sizes)
        out = np.zeros(contexts, np.int64)
        at = context[gram]
        if n == 2:
            counts = self.word_counts()
            texts = counts[self.words[self.sizes.cumsum() - 1][0]]  # every text has one end
            before = np.where(inside > 0, counts[np.concatenate([[0], self.words[:-1]])], texts)
            out[at] = before
            return out
        shorter, r, _, _, _, _ = self.counted(n - 1)
        previous = np.where(inside > 0, np.concatenate([[0], r[shorter][:-1]]), 0)
        texts = self.word_counts()[self.words[self.sizes.cumsum() - 1][0]]
        out[at] = np.where(inside > 0, previous, texts)
        return out

    def counted(self, n: int) -> tuple:
        """(n-gram of each token, count, owned, context and word of each n-gram, hashes of contexts)."""
        gram, context, word, hashes = self.grams(n)
        order = np.argsort(extend(hashes[context], self.vocabulary[word]))
        told = np.empty(len(order), np.uint64)
        told[order] = self.answers[f"ngrams={n}"]
        return gram, (told >> np.uint64(1)).astype(np.int64), (told & np.uint64(1)).astype(bool), context, word, hashes

    def probability(self, n: int) -> np.ndarray:
        """P of each token after its n-1 words, recursively."""
        if n == 1:
            return self.levels[0].unigram(self.word_counts())[self.words]
        lower = self.probability(n - 1)
        gram, r, _, context, _, hashes = self.counted(n)
        order = np.argsort(hashes)
        weight = np.empty(len(order))
        weight[order] = self.answers[f"weights={n}"]
        # A negative weight marks a context that counts one occurrence more.
        total = self.context_counts(n, len(hashes), gram, context) + (weight < 0)
        at = context[gram]
        return np.where(r[gram] > 0, self.levels[n - 1].discounted(r)[gram] / np.maximum(total[at], 1), np.abs(weight)[at] * lower)


ASKED = "range int, piece bigint, hashes binary, a binary, b binary, c binary"
TOLD = "kind string, range int, piece bigint, hashes binary, told binary, hist array<bigint>"
_ASKED = pa.schema([("range", pa.int32()), ("piece", pa.int64()), *[(c, pa.binary()) for c in ("hashes", "a", "b", "c")]])
_TOLD = pa.schema([("kind", pa.string()), ("range", pa.int32()), ("piece", pa.int64()), ("hashes", pa.binary()), ("told", pa.binary()), ("hist", pa.list_(pa.int64()))])


def _ask(piece: int, hashes: np.ndarray, columns: list[np.ndarray], ranges: int) -> dict:
    """Questions about sorted hashes, one row per range."""
    out = {c: [] for c in _ASKED.names}
    for i, a, b in runs(hashes, ranges):
        parts = [planes(x[a:b]) for x in columns] + [None] * (3 - len(columns))
        for c, v in zip(_ASKED.names, (i, piece, planes(hashes[a:b]), *parts), strict=True):
            out[c].append(v)
    return out


def _add_counts(rows: pa.Table) -> pa.Table:
    """Counts of one hash range: answers 2 r + owned per question, the range's table, its counts of counts."""
    rows = rows.sort_by("piece")
    parts = [whole(h.as_py(), np.uint64) for h in rows["hashes"]]
    seen = np.concatenate([whole(a.as_py(), np.uint32) for a in rows["a"]])
    names, first, at = np.unique(np.concatenate(parts), return_index=True, return_inverse=True)
    r = np.bincount(at, weights=seen, minlength=len(names)).astype(np.int64)
    told = (r[at] << 1).astype(np.uint64)
    told[first[r > 0]] |= np.uint64(1)  # one piece speaks for each n-gram
    ends = np.cumsum([len(p) for p in parts])
    number = rows["range"][0].as_py()
    hist = [int(r.sum()), int((r > 0).sum()), *np.bincount(np.minimum(r, CUTOFF + 2), minlength=CUTOFF + 3)[1 : CUTOFF + 2].tolist()]
    out = [("answer", number, p, None, planes(told[e - len(h) : e]), None) for p, h, e in zip(rows["piece"].to_pylist(), parts, ends.tolist(), strict=True)]
    out.append(("table", number, None, planes(names[r > 0]), planes(r[r > 0].astype(np.uint64)), hist))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _TOLD, strict=True)], schema=_TOLD)


def _add_mass(rows: pa.Table) -> pa.Table:
    """Backoff weights of the contexts of one hash range."""
    rows = rows.sort_by("piece")
    parts = [whole(h.as_py(), np.uint64) for h in rows["hashes"]]
    total, high, low = (np.concatenate([whole(v.as_py(), kind) for v in rows[c]]) for c, kind in (("a", np.int64), ("b", np.float64), ("c", np.float64)))
    names, first, at = np.unique(np.concatenate(parts), return_index=True, return_inverse=True)
    total = total[first]
    high, low = np.bincount(at, weights=high, minlength=len(names)), np.bincount(at, weights=low, minlength=len(names))
    left = 1 - high / np.maximum(total, 1)
    full = (left < 1e-9) & (total > 0)
    left = np.where(full, 1 - high / (total + 1), left)
    weight = np.where(total > 0, left / np.maximum(1 - low, 1e-15), 1.0) * np.where(full, -1, 1)
    ends, number, told = np.cumsum([len(p) for p in parts]), rows["range"][0].as_py(), weight[at]
    out = [("answer", number, p, None, planes(told[e - len(h) : e]), None) for p, h, e in zip(rows["piece"].to_pylist(), parts, ends.tolist(), strict=True)]
    out.append(("table", number, None, planes(names[total > 0]), planes(weight[total > 0]), None))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _TOLD, strict=True)], schema=_TOLD)


class Exchange:
    """Questions and answers of one model, in tables below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.answered, self.levels = spark, path, [], []
        self.pieces = None
        self.ranges = 1

    def write(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        target = f"{self.path}/{name}"
        with freeing_shuffles(self.spark):
            (df.write.partitionBy(by) if by else df.write).parquet(target)
        return self.spark.read.schema(df.schema).parquet(target)

    def over_pieces(self, function, shape: str) -> DataFrame:
        """``function`` of every piece, given the answers to it so far."""
        levels, kinds = self.levels, {n: np.float64 if n.startswith("weights") else np.uint64 for n, _ in self.answered}

        def run(rows: pa.Table, told: pa.Table) -> pa.Table:
            answers: dict[str, list] = {}
            for name, at, data in sorted(zip(told["name"].to_pylist(), told["range"].to_pylist(), told["told"].to_pylist(), strict=True), key=lambda x: x[:2]):
                answers.setdefault(name, []).append(whole(data, kinds[name]))
            row = rows.to_pylist()[0]
            got = {n: np.concatenate(v) for n, v in answers.items()}
            if "ngrams=1" in got:
                got["ngrams=1"] = got["ngrams=1"] >> np.uint64(1)
            return function(row, Piece(row, got, levels))

        told = None
        for name, df in self.answered:
            part = df.where("kind = 'answer'").select("piece", F.lit(name).alias("name"), "range", "told")
            told = part if told is None else told.unionByName(part)
        return self.pieces.drop("seen", "words").groupBy("piece").cogroup(told.groupBy("piece")).applyInArrow(run, shape)

    def settle(self, asked: DataFrame, adder, name: str) -> DataFrame:
        told = self.write(asked.groupBy("range").applyInArrow(adder, TOLD), name, "kind")
        self.answered.append((name, told))
        return told

    def learn(self, order: int) -> None:
        ranges = self.ranges

        def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for number, vocabulary, seen in zip(*(batch.column(c).to_pylist() for c in ("piece", "vocabulary", "seen")), strict=True):
                    names = whole(vocabulary, np.uint64)
                    at = np.argsort(names)
                    yield pa.RecordBatch.from_pydict(_ask(number, names[at], [whole(seen, np.uint32)[at]], ranges), schema=_ASKED)

        self._count(self.pieces.select("piece", "vocabulary", "seen").mapInArrow(words, ASKED), 1)
        for n in range(2, order + 1):

            def grams(row: dict, piece: Piece, n=n) -> pa.Table:
                gram, context, word, hashes = piece.grams(n)
                names = extend(hashes[context], piece.vocabulary[word])
                seen = np.bincount(gram[~piece.held], minlength=len(names)).astype(np.uint32)
                at = np.argsort(names)
                return pa.Table.from_pydict(_ask(row["piece"], names[at], [seen[at]], ranges), schema=_ASKED)

            def masses(row: dict, piece: Piece, n=n) -> pa.Table:
                gram, r, owned, context, word, hashes = piece.counted(n)
                lower = piece.probability(n - 1)
                below = np.zeros(len(r))
                below[gram] = lower
                total = piece.context_counts(n, len(hashes), gram, context)
                high = np.bincount(context, weights=np.where(owned, piece.levels[n - 1].discounted(r), 0), minlength=len(hashes))
                low = np.bincount(context, weights=np.where(owned, below, 0), minlength=len(hashes))
                at = np.argsort(hashes)
                return pa.Table.from_pydict(_ask(row["piece"], hashes[at], [total[at], high[at], low[at]], ranges), schema=_ASKED)

            self._count(self.over_pieces(grams, ASKED), n)
            self.settle(self.over_pieces(masses, ASKED), _add_mass, f"weights={n}")

    def _count(self, asked: DataFrame, n: int) -> None:
        told = self.settle(asked, _add_counts, f"ngrams={n}")
        sums = told.where("kind = 'table'").select(*[F.sum(F.col("hist")[i]).alias(f"h{i}") for i in range(CUTOFF + 3)]).first()
        self.levels.append(Level([x or 0 for x in sums] if sums else None))


RESULT = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def score(docs: DataFrame, order: int = ORDER, folds: int = FOLDS, held_out: int = HELD_OUT, piece: int = PIECE, path: str | None = None) -> DataFrame:
    """Learn from all documents outside the held-out fold and score every document; tables stay below ``path``."""
    spark = docs.sparkSession
    small_batches(spark)
    model = Exchange(spark, path or scratch_path(spark, "katz"))
    model.pieces = model.write(encode(docs, folds, held_out, piece), "pieces")
    size = model.pieces.agg(F.sum("words").alias("n")).first()["n"]
    if size is None:
        return spark.createDataFrame([], RESULT)
    model.ranges = max(1, -(-int(size) // RANGE))
    model.learn(order)

    def scores(row: dict, p: Piece) -> pa.Table:
        counts, unigrams = p.word_counts()[p.words], p.levels[0]
        base = np.log10((counts + 1) / (unigrams.tokens + unigrams.types + 1))
        logs = np.log10(p.probability(order))
        add = lambda x: np.add.reduceat(x, p.first)
        n = len(p.sizes)
        return pa.table({
            "doc_id": pa.array(row["ids"], pa.int64()), "held_out": pa.array(row["held"], pa.bool_()), "n_tokens": pa.array(p.sizes, pa.int64()),
            "n_known": pa.array(add((counts > 0).astype(np.int64)), pa.int64()), "train_tokens": pa.array(np.full(n, unigrams.tokens, np.int64)),
            "base_score": pa.array(add(base)), "score": pa.array(add(logs)),
        })

    return model.over_pieces(scores, RESULT)
