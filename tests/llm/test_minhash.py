import random
from collections import Counter

import numpy as np
import pytest
from helpers import DOCS, documents, rows_of
from pyspark.sql import functions as F

from kgspark.llm.minhash import classes, deduplicate, near_duplicates, probminhash, shingles


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(docs):
    sets = {i: grams(t) for i, t in docs if i is not None}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def corpus(seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(3, 120)))) for i in range(60)]
    n = 1000
    for i in range(0, 60, 4):  # near copies, some of copies, down to well below the threshold
        text = docs[i][1].split()
        for _ in range(6):
            for _ in range(rng.choice([0, 1, 1, 2, 5])):
                text[rng.randrange(len(text))] = rng.choice(words)
            docs.append((n, " ".join(text)))
            n += 1
    return docs


@pytest.mark.parametrize("block", [256, 3])
def test_classes_equal_brute_force(spark, block):
    docs = corpus()
    docs += [(2000, None), (2001, ""), (2002, "  \n "), (2003, "One two"), (2004, "one TWO"), (2005, "one two three"), (2006, "x " * 40_000), (2007, "x " * 30_000)]
    got = {r["doc_id"]: r["class_id"] for r in classes(documents(spark, docs), block=block).collect()}
    assert got == brute(docs)


def test_repeated_shingles_hide_no_links(spark):
    docs = []
    for i in range(30):
        base = [f"b{i}_{k}" for k in range(104)]
        # 100 common shingles; 23 (Jaccard 0.813) or 12 (0.893) more of one text, most of them repeated.
        docs += [(10 * i, " ".join(base)), (10 * i + 1, " ".join(base + [f"r{i}_{k}" for k in range((19, 8)[i % 2])] * (50, 1000)[i % 3 == 0]))]
    # A section of 40 shingles that one text repeats and the other has once.
    for i in range(30, 40):
        base, part = [f"b{i}_{k}" for k in range(104)], [f"s{i}_{k}" for k in range(36)]
        docs += [(10 * i, " ".join(base + part)), (10 * i + 1, " ".join(base + part * 20))]
    want = brute(docs)
    assert sum(i != low for i, low in want.items()) == 40
    assert {r["doc_id"]: r["class_id"] for r in classes(documents(spark, docs)).collect()} == want


def test_large_groups(spark):
    rng = random.Random(4)
    base = [f"b{i}" for i in range(200)]
    docs = [(i, " ".join(base)) for i in range(100)]
    for i in range(100, 220):
        words = list(base)
        words[rng.randrange(200)] = f"x{i}"
        docs.append((i, " ".join(words)))
    # Documents that share half of their words are no copies of each other.
    docs += [(i, " ".join(base[:60] + [f"y{i}_{k}" for k in range(60)])) for i in range(300, 400)]
    got = {r["doc_id"]: r["class_id"] for r in classes(documents(spark, docs).repartition(6)).collect()}
    assert {got[i] for i in range(220)} == {0} and all(got[i] == i for i in range(300, 400))


def test_deduplicate_and_odd_tables(spark):
    rows = [(1, "a b c d e f"), (2, "A b c d e f"), (3, "other words altogether here now"), (3, "other words altogether here now"), (None, "a b c d e f"), (None, None), (4, None), (5, "")]
    df = documents(spark, rows).withColumn("class_id", F.lit("clash"))
    kept = deduplicate(df)
    assert kept.columns == df.columns
    assert rows_of(kept, "doc_id", "text") == sorted([(1, "a b c d e f"), rows[2], rows[4], rows[5], rows[6], rows[7]], key=repr)
    assert rows_of(near_duplicates(df), "doc_id", "class_id", "kept") == sorted(
        [(1, 1, True), (2, 1, False), (3, 3, True), (3, 3, True), (None, None, True), (None, None, True), (4, 4, True), (5, 5, True)], key=repr
    )
    empty = spark.createDataFrame([], DOCS)
    assert deduplicate(empty).count() == near_duplicates(empty).count() == 0


def test_one_id_with_several_texts_joins_their_classes(spark):
    rows = [(5, "one two three four five six"), (5, "seven eight nine ten eleven"), (5, "alone"), (3, "one two three four five six"), (2, "seven eight nine ten eleven"), (9, "else")]
    got = rows_of(near_duplicates(documents(spark, rows)), "doc_id", "class_id")
    assert got == [(2, 2), (3, 2), (5, 2), (5, 2), (5, 2), (9, 9)]
    assert sorted(r["doc_id"] for r in deduplicate(documents(spark, rows)).collect()) == [2, 9]


def test_shingles_by_hand():
    doc, element, count = shingles(["a b c d e a b c d e a", None, "a b", "a b", "A  b\nc d e"])
    assert list(np.bincount(doc, minlength=5)) == [5, 0, 1, 1, 1]
    assert all(len(shingles([" ".join("abcdefgh"[:n])])[0]) == max(1, n - 4) for n in range(1, 9))
    assert sorted(count[doc == 0].tolist()) == [1, 1, 1, 2, 2]
    assert element[doc == 2] == element[doc == 3] != element[doc == 4] and element[doc == 4][0] in element[doc == 0]


def test_registers_estimate_probability_jaccard():
    rng = np.random.default_rng(6)
    a, b = ({int(k): float(w) for k, w in zip(rng.integers(1, 60, 40), rng.uniform(0.2, 3, 40), strict=True)} for _ in range(2))
    exact = sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in {*a, *b}) for d in a.keys() & b.keys())
    same, runs = 0, 40
    for run in range(runs):
        salt = np.uint64(rng.integers(1 << 62))
        sides = [np.array(sorted(x), np.uint64) * np.uint64(0x9E3779B97F4A7C15) + salt for x in (a, b)]
        sig = probminhash(np.repeat([0, 1], [len(a), len(b)]), np.concatenate(sides), np.array([x[k] for x in (a, b) for k in sorted(x)]), 2, 125)
        same += (sig[0] == sig[1]).sum()
    n = runs * 125
    assert abs(same / n - exact) < 4 * (exact * (1 - exact) / n) ** 0.5 + 0.01


def test_early_termination_changes_nothing():
    """Registers equal those of an arrival-by-arrival process that looks at all elements long enough."""
    doc, element = np.zeros(30, np.int64), np.arange(1, 31, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    weight = np.linspace(0.5, 4, 30)
    together = probminhash(np.concatenate([doc, doc + 1]), np.tile(element, 2), np.tile(weight, 2), 2, 64)
    assert (together[0] == together[1]).all() and (together[0] == probminhash(doc, element, weight, 1, 64)[0]).all()
    shares = Counter(together[0].tolist())
    assert set(shares) <= set(element.tolist()) and sum(shares.values()) == 64


@pytest.mark.parametrize("turn", [0, 1, 2])
def test_near_copies_of_every_text_of_an_id_are_linked(spark, turn):
    one, two = [f"a{k}" for k in range(60)], [f"b{k}" for k in range(60)]
    rows = [(5, " ".join(one)), (5, " ".join(two)), (3, " ".join([*one[:59], "x"])), (4, " ".join([*two[:59], "x"])), (7, "plain other words that nobody repeats here"), (5, None)]
    rows = rows[turn * 2 :] + rows[: turn * 2]
    got = rows_of(near_duplicates(documents(spark, rows)), "doc_id", "class_id")
    assert got == [(3, 3), (4, 3), (5, 3), (5, 3), (5, 3), (7, 7)]
    kept = deduplicate(documents(spark, [*rows, (1, "z z"), (1, "y y")]))
    assert rows_of(kept, "doc_id", "text") == [(1, "y y"), (3, rows[(2 - turn * 2) % 6][1]), (7, "plain other words that nobody repeats here")]
