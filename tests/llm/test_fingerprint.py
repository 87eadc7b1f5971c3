"""Quartile digests against triplet-by-triplet counting, and neighbours against a sorted list."""

import hashlib

import numpy as np
import pytest
from helpers import documents

from kgspark.llm.fingerprint import BOUND, BUCKETS, difference, digests, edited_fingerprints, fingerprints, length_code, likeness, read, written


def slow(text):
    data, counts = text.encode(), [0] * BUCKETS
    for a, b, c in zip(data, data[1:], data[2:]):
        h = (a << 16 | b << 8 | c) * 2654435761 % 2**32
        counts[((h ^ h >> 15) * 73244475 % 2**32) >> 24] += 1
    order = sorted(counts)
    q = [order[k * BUCKETS // 4 - 1] for k in (1, 2, 3)]
    codes = [sum(n > v for v in q) for n in counts]
    head = f"{length_code(len(data)):02x}{q[0] * 100 // max(q[2], 1) % 16:x}{q[1] * 100 // max(q[2], 1) % 16:x}"
    return head + "".join(f"{codes[i] * 4 + codes[i + 1]:x}" for i in range(0, BUCKETS, 2))


def slow_likeness(one, two):
    a, b = ([int(f[:2], 16), int(f[2], 16), int(f[3], 16), *(c for x in f[4:] for c in divmod(int(x, 16), 4))] for f in (one, two))
    apart = [abs(x - y) for x, y in zip(a, b)]
    total = apart[0] + sum(min(x, 16 - x) for x in apart[1:3]) + sum(6 if x == 3 else x for x in apart[3:])
    return 1.0 - min(total, BOUND) / BOUND


def brute(rows):
    """Rows without ties."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0]))
    out = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), slow(t), slow(edited), slow_likeness(slow(t), slow(edited)), slow_likeness(slow(t), slow(after))))
    return sorted(out, key=repr)


ROWS = [(5, "The quick brown fox"), (2, ""), (9, None), (1 << 60, "ß" * 11), (None, "no id"), (3, "ab"), (4, "x y z " * 4000), (-7, "日本 🙂 text"), (6, "The quick brown fox")]


@pytest.mark.parametrize("ranges", [None, 1, 3, 40])
def test_equals_brute_force(spark, ranges):
    got = edited_fingerprints(documents(spark, ROWS), ranges)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(ROWS)


def test_one_row_none_and_other_columns(spark):
    one = documents(spark, [(1, "alone here", "en")])
    assert [tuple(r) for r in edited_fingerprints(one).collect()] == brute([(1, "alone here")])
    assert edited_fingerprints(one.where("false")).collect() == []
    other = one.withColumnsRenamed({"lang": "part", "source": "tie", "n_chars": "borrowed"})
    assert edited_fingerprints(other).collect() == edited_fingerprints(one).collect()


@pytest.mark.parametrize("ranges", [1, 5])
def test_repeated_rows_are_a_chain(spark, ranges):
    rows = [(1, "same"), (1, "same"), (1, "other text"), (2, "last"), (1, "same")]
    got = edited_fingerprints(documents(spark, rows), ranges).collect()
    assert len(got) == 5
    # Rows of one id lie next to one another: two of the three equal rows are followed by an equal one.
    assert sum(r["near_next"] == 1.0 and r["doc_id"] == 1 for r in got) == 2


def test_reads_what_it_writes_and_bounds():
    texts = [t.encode() for t in ("", "abc", "some words " * 50, "other things entirely " * 40)]
    made = digests(texts)
    assert all((read(f) == d).all() for f, d in zip(written(made), made)) and written(made)[0] == "0" * (4 + BUCKETS // 2)
    assert (difference(made, made) == 0).all() and (likeness(made, made[::-1]) >= 0).all()
    codes = [length_code(n) for n in range(1 << 16)]
    assert codes == sorted(codes) and length_code(1 << 200) == 255


def test_copies_and_edits_stand_out(spark):
    words = [f"w{i}" for i in np.random.default_rng(3).integers(0, 500, 4000)]
    texts = [" ".join(words[k * 400 : (k + 1) * 400]) for k in range(9)]
    rows = fingerprints(documents(spark, [(0, texts[0]), (1, texts[0]), (2, texts[0].replace("w1", "v1", 5)), (3, texts[5])])).collect()
    found = {r["doc_id"]: read(r["fingerprint"])[None] for r in rows}
    assert rows[0]["fingerprint"] == rows[1]["fingerprint"]
    assert likeness(found[0], found[2])[0] > likeness(found[0], found[3])[0]
