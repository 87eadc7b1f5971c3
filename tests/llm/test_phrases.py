"""Phrases by multikey quicksort against counting every run of words."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from helpers import documents

from kgspark.llm.phrases import _marks, bitmap, collocations, has, multikey_counts, scored


def brute(rows, least, top):
    counts, sizes = Counter(), Counter()
    for text, lang in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", lower):
            words = re.findall("[^ \t]+", piece)
            sizes[lang or "und"] += len(words)
            counts.update((lang or "und", tuple(words[i : i + k])) for k in range(1, 5) for i in range(len(words) - k + 1))
    frequent = {key: a for key, a in counts.items() if a >= least and len(key[1]) > 1}
    out = []
    for (lang, g), a in frequent.items():
        longer = [b for (other, h), b in frequent.items() if other == lang and len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1))]
        if any(100 * b >= 80 * a for b in longer):
            continue
        cuts = [(2000000 * a // (counts[lang, g[:k]] + counts[lang, g[k:]]), k) for k in range(1, len(g))]
        score, k = min(cuts)
        out.append((lang, " ".join(g), a, counts[lang, g[:k]], counts[lang, g[k:]], sizes[lang], score))
    ranked = []
    for lang in {r[0] for r in out}:
        mine = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(lang, n, *r[1:]) for n, r in enumerate(mine[:top], 1)]
    return sorted(ranked)


def corpus(n=120, seed=4):
    rng = random.Random(seed)
    words = ["the", "of", "And", "Straße", "ñ", "🙂", "New", "York", "x\x00y", " ", "it's"]
    out = []
    for i in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "!"]) for _ in range(rng.randint(0, 60)))
        out.append((i % 50 or None, text + " one very common line of words" * (i % 3 == 0), rng.choice(["en", "de", None, "und"])))
    return [*out, (1, None, "en"), (2, "", "de"), (3, "...", None), (4, "New York " * 300, "en")]


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize("options", [
    {}, {"hot": (3, 9), "chunk": 50, "small": 1, "rows": 40}, {"hot": (40, 60), "small": 2, "rows": 10}, {"least": 2, "top": 7, "hot": (10, 10)}, {"least": 1, "chunk": 500, "hot": (5, 7)},
])
def test_equals_counting_every_run(spark, options):
    rows = corpus()
    options = {"least": 5, "top": 2000, **options}
    got = collocations(documents(spark, rows), **options).select(*COLUMNS)
    assert sorted(tuple(r) for r in got.collect()) == brute([(t, lang) for _, t, lang in rows], options["least"], options["top"])


def test_empty_table_and_other_columns(spark):
    docs = documents(spark, [(1, "a b " * 40, "en")])
    assert collocations(docs.where("false")).collect() == []
    other = docs.withColumnsRenamed({"doc_id": "word", "source": "n", "n_chars": "phrase"})
    assert collocations(other).collect() == collocations(docs).collect() != []


def test_exact_beyond_64_bits(spark):
    many = 10**16 + 1
    found = scored(spark.createDataFrame([("en", "a b", 2, many)], "lang string, phrase string, size int, a bigint"),
                   spark.createDataFrame([("en", "a", many), ("en", "b", 3 * many)], "lang string, phrase string, a bigint")).first()
    assert (found["l"], found["r"], found["score"]) == (many, 3 * many, 500000)


@pytest.mark.parametrize("small", [1, 3, 1000])
def test_quicksort_equals_counting(small):
    rng = np.random.default_rng(5)
    keys = [rng.integers(0, 3, 4000), *(rng.zipf(1.6, 4000) % 30 for _ in range(3))]
    keys[3] = np.where(rng.random(4000) < 0.2, -1, keys[3])
    weight = rng.integers(1, 4, 4000)
    for shared in ([0, 0, 0, 0], [0, 0, 5, 2]):
        want = Counter()
        for row, w in zip(zip(*(k.tolist() for k in keys)), weight.tolist()):
            for d in range(4):
                if row[d] >= 0:
                    want[row[: d + 1]] += w
        want = {k: n for k, n in want.items() if n >= 30 or (len(k) > 1 and all(w < shared[len(k) - 1] for w in k[1:]))}
        found = multikey_counts(keys, weight, 30, shared, small)
        got = [(tuple(int(k[i]) for k in keys[: d + 1]), int(n)) for d, (at, counts) in enumerate(found) for i, n in zip(at, counts)]
        assert len(got) == len(set(got)) and dict(got) == want


def test_a_bitmap_has_all_its_marks(spark):
    marks = np.random.default_rng(6).integers(-(2**63), 2**63 - 1, 500)
    names = [f"w{m}" for m in marks.tolist()]
    words = spark.createDataFrame([(lang, w) for lang in ("en", "ñ") for w in names], "lang string, word string")
    bits = bitmap(words)
    assert all(has(bits, _marks(lang, [w.encode() for w in names])).all() for lang in ("en", "ñ")) and not has(bits, _marks("de", [b"w"] * 3)).all()
    assert has(bits, np.arange(10**5).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).mean() < 0.1
    assert not bitmap(words.where("false")).any() and len(bitmap(words, 1024)) == 16
