import math
import random
from collections import Counter, defaultdict
from zlib import crc32

import pytest
from helpers import DOCS, documents, rows_of

from kgspark.llm.katz import discounts, score


def reference(docs, order):
    """Katz backoff in dictionaries, straight from its definition."""
    tokens = [(i, t, [*(t or "").encode().lower().split(), b"\n"]) for i, t in docs]
    held = {i: crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in docs}
    seen = [Counter() for _ in range(order + 1)]
    for i, _, words in tokens:
        if not held[i]:
            for n in range(1, order + 1):
                padded = [b"\t"] * (n - 1) + words
                seen[n].update(tuple(padded[k : k + n]) for k in range(len(words)))
    d = [None] + [discounts([sum(1 for c in seen[n].values() if c == r) for r in range(1, 7)]) for n in range(1, order + 1)]
    disc = lambda n, r: r * (d[n][r] if r <= 5 else 1)
    total = sum(seen[1].values())
    lost = sum((1 - d[1][r]) * r for r in seen[1].values() if r <= 5)
    followers = [defaultdict(list) for _ in range(order + 1)]
    for n in range(2, order + 1):
        for g in seen[n]:
            followers[n][g[:-1]].append(g[-1])
    memo = {}

    def uni(w):
        r = seen[1][(w,)]
        if not total:
            return 1.0
        return (disc(1, r) if r else (lost or 1.0)) / (total if lost > 0 else total + 1)

    def weight(n, h):
        if (n, h) not in memo:
            after = followers[n].get(h, [])
            c = sum(seen[n][(*h, w)] for w in after)
            if not c:
                memo[n, h] = (1.0, 1)
            else:
                high = sum(disc(n, seen[n][(*h, w)]) for w in after)
                if 1 - high / c < 1e-9:
                    c += 1
                low = sum(p(n - 1, h[1:], w) for w in after)
                memo[n, h] = ((1 - high / c) / (1 - low), c)
        return memo[n, h]

    def p(n, h, w):
        if n == 1:
            return uni(w)
        r, (alpha, c) = seen[n][(*h, w)], weight(n, h)
        return disc(n, r) / c if r else alpha * p(n - 1, h[1:], w)

    out = {}
    for i, t, words in tokens:
        padded = [b"\t"] * (order - 1) + words
        s = sum(math.log10(p(order, tuple(padded[k : k + order - 1]), padded[k + order - 1])) for k in range(len(words)))
        base = sum(math.log10((seen[1][(w,)] + 1) / (total + len(seen[1]) + 1)) for w in words)
        out[i, t] = (held[i], len(words), sum(seen[1][(w,)] > 0 for w in words), total, base, s)
    return out, p, seen, followers


def corpus(n, seed=3):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "Gamma", "delta", "über", "eta", "THETA", "iota,", "kappa", "x y"]
    return [(i, " ".join(rng.choices(words, range(10, 0, -1), k=rng.randint(0, 25)))) for i in range(n)]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_the_definition(spark, order):
    docs = [*corpus(60), (900, None), (901, ""), (None, "beta beta"), (902, " \t\x0b beta\r\nBETA ")]
    want, p, seen, followers = reference(docs, order)
    # Small pieces and several of them per task: the answer does not depend on how the corpus is cut.
    got = score(documents(spark, docs), order=order, piece=200).collect()
    assert len(got) == len(docs)
    texts = dict(docs)
    for r in got:
        w = want[r["doc_id"], texts[r["doc_id"]]]
        assert tuple(r)[1:5] == w[:4]
        assert r["base_score"] == pytest.approx(w[4], rel=1e-9) and r["score"] == pytest.approx(w[5], rel=1e-9)
    # Exactly normalised: the vocabulary and one unknown word share one.
    vocabulary = [g[0] for g in seen[1]]
    for n in range(2, order + 1):
        for h in list(followers[n])[:30]:
            assert sum(p(n, h, w) for w in [*vocabulary, b"never seen"]) == pytest.approx(1, abs=1e-9)


def test_ranges_and_repeats(spark, monkeypatch):
    import kgspark.llm.katz as katz

    docs = [*corpus(40), *corpus(3)]
    one = rows_of(score(documents(spark, docs)))
    monkeypatch.setattr(katz, "RANGE", 100)
    many = rows_of(score(documents(spark, docs).repartition(5)))
    assert len(one) == 43
    for a, b in zip(one, many, strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_nothing_to_learn_and_empty(spark):
    assert score(spark.createDataFrame([], DOCS)).count() == 0
    held = next(i for i in range(100) if crc32(str(i).encode()) % 7 == 2)
    [r] = score(documents(spark, [(held, "only held out")])).collect()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["score"]) == (4, 0, 0, 0.0)


def test_discounts():
    assert list(discounts([0] * 6)) == [1, 0.9, 1, 1, 1, 1]
    d = discounts([1000, 400, 200, 120, 80, 60])
    assert all(0 < x < 1 for x in d[1:]) and d[0] == 1
