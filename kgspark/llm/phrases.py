"""Phrases that stand together: frequent runs of two to four words per language, scored by their weakest cut.

A text in lower case (A-Z only) falls into pieces at ``.,;:!?`` and line ends, a piece into words at spaces and tabs. Words are counted
first. The suffixes of the pieces (up to four words from each position, ended by the first infrequent word) are routed over the
whole corpus by their leading words, so one task sees every occurrence of a phrase, and sorted there by multikey three-way
quicksort of their pointers: the suffixes equal to the pivot at one depth are those of one phrase, their number is its count;
a partition with fewer than ``least`` occurrences is abandoned.

Skew: a task sends each distinct suffix of a chunk once, with its number. Suffixes are routed by two words; by the third too if both
are hot (``HOT[0]`` occurrences), and by all four if the first three have ``HOT[1]``. The counts of pairs (threes) of such words
come from several tasks; those are not abandoned but added up behind the sort.

Which words are frequent, or hot, travels as a bitmap of their hashes, of at most ``BITS`` bits. A word that shares the bit of a
frequent one is carried along, to no effect on any result; a word that shares the bit of a hot one is routed as if it were hot.

Defined results: a null text has no words; a null language is ``und``; rows that repeat count again; ties of a score are settled as the
order says; other columns play no part; an empty table gives an empty result. A text of any length is cut at white space
into words at once: its task holds it whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, stage
from .minhash import mixed

LONGEST, LEAST, TOP = 4, 30, 2000
SCALE = 2_000_000
HOT, BITS = (1 << 20, 1 << 26), 1 << 26
# Bytes of text cut into words at once; suffixes of one task; words counted in a task before they are handed on; partitions finished by a plain sort.
CHUNK, ROWS, HELD, SMALL = 8 << 20, 1 << 20, 1 << 19, 256

# Words, and runs of the signs that end a piece. All of these are single bytes in UTF-8.
_PARTS = re.compile(rb"[^ \t.,;:!?\n-\r]+|[.,;:!?\n-\r]+")
_ENDS = frozenset(b".,;:!?\n\x0b\x0c\r")


def _by_language(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[tuple[str, bytes]]:
    """(language, texts) of about ``chunk`` bytes; a line end between two texts, so no phrase crosses it."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
            if text:
                held.setdefault(lang, []).append(text)
                size += len(text)
                if size >= chunk:
                    yield from ((k, b"\n".join(v).lower()) for k, v in held.items())
                    held, size = {}, 0
    yield from ((k, b"\n".join(v).lower()) for k, v in held.items())


def _marks(lang: str, words) -> np.ndarray:
    """Hashes of the words of a language."""
    prefix = lang.encode() + b"\0"
    return pd.util.hash_array(np.array([prefix + w for w in words] + [b""], object), categorize=False)[:-1]


def _coded(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the words in order, -1 between pieces; the distinct words."""
    codes, names = pd.factorize(np.array(_PARTS.findall(text) + [b"\n"], object))
    ends = np.array([n[0] in _ENDS for n in names])
    place = np.where(ends, -1, np.cumsum(~ends) - 1)
    return place[codes], names[~ends]


def _texts(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")


def word_counts(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(lang, word, n): every word of every language and how often it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, bytes], int] = {}

        def flush() -> pa.RecordBatch:
            langs, words = zip(*held)
            columns = [pa.array(langs, pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(held.values(), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["lang", "word", "n"])

        for lang, text in _by_language(batches, chunk):
            codes, names = _coded(text)
            for word, n in zip(names.tolist(), np.bincount(codes[codes >= 0], minlength=len(names)).tolist()):
                held[lang, word] = held.get((lang, word), 0) + n
            if len(held) > HELD:
                yield flush()
                held.clear()
        if held:
            yield flush()

    found = _texts(docs).mapInArrow(run, "lang string, word string, n bigint")
    return found.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def bitmap(words: DataFrame, most: int = BITS) -> np.ndarray:
    """Bits of the hashes of ``words(lang, word)``: sixteen a word, ``most`` at most."""
    bits = min(most, max(1024, 1 << (16 * words.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.zeros(batch.num_rows, np.uint64)
            langs, spelled = batch.column("lang").dictionary_encode(), np.array(batch.column("word").cast(pa.binary()).to_pylist() + [b""], object)[:-1]
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                mine = langs.indices.to_numpy() == i
                marks[mine] = _marks(lang, spelled[mine])
            at = (marks & np.uint64(bits - 1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))], names=["slot", "bit"])

    rows = words.select("lang", "word").mapInArrow(run, "slot bigint, bit bigint").groupBy("slot").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[rows["slot"].to_numpy()] = rows["bits"].to_numpy()
    return out.view(np.uint64)


def has(bits: np.ndarray, marks: np.ndarray) -> np.ndarray:
    at = marks & np.uint64(len(bits) * 64 - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def _suffixes(codes: np.ndarray, kept: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct suffixes of at least two words (positions x longest, -1 behind the end) and how often they occur."""
    codes = np.where((codes >= 0) & kept[codes], codes, -1)
    padded = np.append(codes, np.full(longest, -1))
    table = np.stack([padded[k : k + len(codes)] for k in range(longest)], axis=1)
    for k in range(1, longest):
        table[table[:, k - 1] < 0, k] = -1
    table = table[table[:, 1] >= 0]
    order = np.lexsort(table.T[::-1])
    table = table[order]
    new = np.flatnonzero(np.append(True, (table[1:] != table[:-1]).any(axis=1))) if len(table) else np.zeros(0, np.int64)
    return table[new], np.diff(np.append(new, len(table)))


def _joined(names: pa.Array, table: np.ndarray) -> pa.Array:
    """Each row's words with spaces between."""
    words = [names.take(pa.array(column, mask=column < 0)) for column in table.T]
    return pc.binary_join_element_wise(*words, " ", null_handling="skip")


def routed_suffixes(docs: DataFrame, frequent: np.ndarray, hot: list[np.ndarray], longest: int = LONGEST, chunk: int = CHUNK) -> DataFrame:
    """(route, lang, suffix, n): the suffixes of pieces; equal leading words have equal routes."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast((frequent, hot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, hot = held.value
        for lang, text in _by_language(batches, chunk):
            codes, names = _coded(text)
            if not len(names):
                continue
            marks = _marks(lang, names)
            table, n = _suffixes(codes, has(frequent, marks), longest)
            route = mixed(mixed(marks[table[:, 0]]) + marks[table[:, 1]])
            for k, bits in enumerate(hot[: longest - 2], 2):
                on = has(bits, marks)[table[:, :k]].all(axis=1) & (table[:, k - 1 : k + 1] >= 0).all(axis=1)
                route = np.where(on, mixed(route + marks[table[:, k]]), route)
            words = pa.array(names, pa.binary()).cast(pa.string())
            for low in range(0, len(table), 1 << 16):
                part = slice(low, low + (1 << 16))
                suffix = _joined(words, table[part])
                columns = [pa.array(route[part].view(np.int64)), pa.array([lang] * len(suffix), pa.string()), suffix, pa.array(n[part].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["route", "lang", "suffix", "n"])

    return _texts(docs).mapInArrow(run, "route bigint, lang string, suffix string, n int")


def multikey_counts(keys: list[np.ndarray], weight: np.ndarray, least: int, shared: list[int], small: int = SMALL) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per depth (pointer, count) of each run of equal leading keys that is counted at least ``least`` times, by three-way quicksort of pointers.

    ``keys[0]`` leads (the language), ``keys[d]`` are words, -1 behind the end. Runs at depth ``d`` whose words are all below ``shared[d]`` are
    listed whatever their count, since other tasks count them too.
    """
    found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in keys]

    def plain(rows: np.ndarray, depth: int, most: int) -> None:
        """A small partition: sorted by what is left of its keys; runs are counted where they lie."""
        rows = rows[np.lexsort([k[rows] for k in reversed(keys[depth:])])]
        new, high = np.zeros(len(rows), bool), np.full(len(rows), most)
        new[0] = True
        for d in range(depth, len(keys)):
            k = keys[d][rows]
            new[1:] |= k[1:] != k[:-1]
            high = np.maximum(high, k) if d else high
            at = np.flatnonzero(new)
            counts = np.add.reduceat(weight[rows], at)
            good = (k[at] >= 0) & ((counts >= least) | (high[at] < shared[d]))
            found[d].append((rows[at[good]], counts[good]))

    # Beside each partition its depth and the largest word of the keys before.
    stack = [(np.arange(len(weight)), 0, -1)] if len(weight) else []
    while stack:
        rows, depth, most = stack.pop()
        if len(rows) <= small:
            plain(rows, depth, most)
            continue
        k = keys[depth][rows]
        pivot = int(np.partition(k[[0, len(k) // 2, -1]], 1)[1])
        for side in (k < pivot, k > pivot):
            part = rows[side]
            # Abandoned: too few occurrences in all, and none of a run that other tasks add to.
            if len(part) and (depth == 0 or weight[part].sum() >= least or (most < max(shared[depth:]) and (k[side] < max(shared[depth:])).any())):
                stack.append((part, depth, most))
        if pivot < 0:
            continue
        same = rows[k == pivot]
        count, high = weight[same].sum(), max(most, pivot) if depth else most
        if count >= least or high < shared[depth]:
            found[depth].append((same[:1], np.array([count])))
        if depth + 1 < len(keys) and (count >= least or high < max(shared[depth:])):
            stack.append((same, depth + 1, high))
    none = np.zeros(0, np.int64)
    return [tuple(np.concatenate([f[i] for f in at] + [none]) for i in (0, 1)) for at in found]


def phrase_counts(suffixes: DataFrame, hot: list[np.ndarray], parts: int, longest: int = LONGEST, least: int = LEAST, small: int = SMALL) -> DataFrame:
    """(lang, phrase, size, a): every phrase of two to ``longest`` words that occurs at least ``least`` times."""
    spark = suffixes.sparkSession
    held = spark.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        langs = table["lang"].combine_chunks().dictionary_encode()
        split = pc.split_pattern(table["suffix"].combine_chunks(), " ")
        sizes, words = pc.list_value_length(split).to_numpy(), split.flatten().dictionary_encode()
        lang, names = langs.indices.to_numpy(), words.dictionary
        # The hottest words first. A word may be hot in one language only; it is enough that it is hot in any.
        heat = np.zeros(len(names), np.int64)
        spelled = names.cast(pa.binary()).to_pylist()
        for p in langs.dictionary.to_pylist():
            marks = _marks(p, spelled)
            heat = np.maximum(heat, sum(has(bits, marks).astype(np.int64) for bits in held.value))
        place = np.empty(len(spelled), np.int64)
        place[np.argsort(-heat, kind="stable")] = np.arange(len(spelled))
        # Pairs are shared if both words are hot, threes if all are hotter still, single words for the sake of their pairs.
        hotter = [int((heat >= k).sum()) for k in range(1, len(held.value) + 1)]
        shared = [0, 0, *hotter, *[0] * longest][: longest + 1]
        shared[longest] = 0
        code = place[words.indices.to_numpy()]
        starts = np.cumsum(sizes) - sizes
        keys = [lang.astype(np.int64)]
        for k in range(longest):
            keys.append(np.where(sizes > k, code[np.minimum(starts + k, len(code) - 1)], -1))
        weight = table["n"].to_numpy().astype(np.int64)
        back = pa.array(np.argsort(place))
        names = names.take(back)
        for depth, (at, n) in enumerate(multikey_counts(keys, weight, least, shared, small)):
            if depth < 2 or not len(at):
                continue
            phrase = _joined(names, np.stack([keys[d][at] for d in range(1, depth + 1)], axis=1))
            columns = [langs.dictionary.take(pa.array(lang[at])), phrase, pa.array(np.full(len(at), depth, np.int32)), pa.array(n)]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "size", "a"])

    found = suffixes.repartition(parts, "route").mapInArrow(run, "lang string, phrase string, size int, a bigint")
    return found.groupBy("lang", "phrase", "size").agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def _exact(column) -> F.Column:
    return column.cast("decimal(38,0)")


def scored(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """(lang, phrase, size, a, l, r, score): every phrase with its lowest-scoring cut. ``words(lang, phrase, a)`` are the single words."""
    counts = words.select("lang", "phrase", "a").unionByName(phrases.select("lang", "phrase", "a"))
    part = lambda low, length: F.concat_ws(" ", F.slice("words", low, length))
    cuts = phrases.withColumn("words", F.split("phrase", " ")).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "size", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    side = lambda name, n: counts.select("lang", F.col("phrase").alias(name), F.col("a").alias(n))
    cuts = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    score = F.expr(f"CAST({SCALE} * CAST(a AS DECIMAL(28, 0)) AS DECIMAL(38, 0)) div (CAST(l AS DECIMAL(20, 0)) + CAST(r AS DECIMAL(20, 0)))")
    low = F.min(F.struct(score.cast("bigint").alias("score"), "k", "l", "r")).alias("low")
    return cuts.groupBy("lang", "phrase", "size", "a").agg(low).select("lang", "phrase", "size", "a", "low.l", "low.r", "low.score")


def contained(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, of): the count of the most frequent phrase that is one word longer. A phrase inside a still longer one is inside one of these,
    which occurs at least as often."""
    longer = phrases.where("size > 2").withColumn("words", F.split("phrase", " "))
    ends = F.array(F.slice("words", F.lit(1), F.col("size") - 1), F.slice("words", F.lit(2), F.col("size") - 1))
    inside = longer.select("lang", "a", F.explode(ends).alias("words")).select("lang", F.concat_ws(" ", "words").alias("phrase"), "a")
    return inside.groupBy("lang", "phrase").agg(F.max("a").alias("of"))


def top_phrases(candidates: DataFrame, top: int = TOP, salts: int = 64) -> DataFrame:
    """The first ``top`` of each language, by score, count and phrase. A language is cut by hash first, so none is ordered whole in one task."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = candidates.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top).drop("salt")


def phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, hot: tuple[int, ...] = HOT, rows: int = ROWS, chunk: int = CHUNK, small: int = SMALL) -> tuple[DataFrame, DataFrame]:
    """Counted phrases (lang, phrase, size, a) and counted words (lang, word, n) of ``docs(lang, text)``."""
    words = stage(word_counts(docs, chunk), "words")
    frequent, hot_words = bitmap(words.where(F.col("n") >= least)), [bitmap(words.where(F.col("n") >= h)) for h in hot]
    total = words.agg(F.sum("n")).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // rows))
    found = phrase_counts(routed_suffixes(docs, frequent, hot_words, longest, chunk), hot_words, parts, longest, least, small)
    return stage(found, "phrases"), words


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST, **options) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the first phrases of each language."""
    found, words = phrases(docs, least=least, **options)
    singles = words.where(F.col("n") >= least).select("lang", F.col("word").alias("phrase"), F.col("n").alias("a"))
    inside = contained(found).select("lang", "phrase", "of")
    kept = scored(found, singles).join(inside, ["lang", "phrase"], "left").where(
        F.col("of").isNull() | (_exact(F.col("of")) * 100 < _exact(F.col("a")) * 80)
    )
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return top_phrases(kept, top).join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
