import random
import struct
import zlib

from helpers import DOCS, documents
from tokenizers import Tokenizer

from kgspark.llm.packing import best_fit, bin_completion, pack, pieces
from kgspark.llm.tokens import encoder, public_path


def optimum(sizes, capacity):
    sizes, best = sorted(sizes, reverse=True), [len(sizes)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for j, left in enumerate(bins):
            if left >= sizes[i] and left not in bins[:j]:
                go(i + 1, bins[:j] + [left - sizes[i]] + bins[j + 1 :])
        go(i + 1, [*bins, capacity - sizes[i]])

    go(0, [])
    return best[0]


def test_bin_completion_is_optimal_on_small_shards():
    rng, better = random.Random(5), 0
    for _ in range(150):
        capacity = rng.choice([50, 100])
        sizes = [rng.randint(capacity // 6, capacity * 2 // 3) for _ in range(rng.randint(1, 12))]
        bins = bin_completion(sizes, capacity)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= capacity for b in bins)
        assert len(bins) == optimum(sizes, capacity)
        better += len(bins) < len(best_fit(sizes, capacity))
    assert better > 0


def test_encoder_equals_the_library():
    tokenizer, encode, rng = Tokenizer.from_file(public_path()), encoder(public_path(), remembered=50), random.Random(2)
    letters = [chr(c) for c in [*range(9, 14), *range(28, 127), *range(0x80, 0x250), 0x2019, 0x3A3, 0x300, 0x1F600, 0x130]]
    texts = ["", "Don't we'LL 12 ab_c <|endoftext|> x", "ÀÉ ñ½² Ÿ", *("".join(rng.choices(letters[: rng.choice([100, 250, 700])], k=rng.randint(0, 25))) for _ in range(3000))]
    for t in texts:
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        assert encode(t) == struct.pack(f"<{len(ids)}I", *ids)


def check(rows, docs, capacity):
    tokenizer = Tokenizer.from_file(public_path())
    want = []
    for i, t in docs:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        want += [(i, n, a, len(p := ids[a : a + capacity]), zlib.crc32(struct.pack(f"<{len(p)}I", *p))) for n, a in enumerate(range(0, len(ids), capacity))]
    assert sorted((tuple(r)[:5] for r in rows), key=repr) == sorted(want, key=repr)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), -(-sum(w[3] for w in want) // capacity)


def test_pack(spark):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choices(["alpha", "beta", "gamma", "xyzzy"], k=rng.randint(0, 60)))) for i in range(300)]
    docs += [(400, None), (401, ""), (None, "no id"), (7, "again again"), (7, "again again"), (402, "long " * 3000)]
    df = documents(spark, docs).withColumnRenamed("n_chars", "offset").withColumnRenamed("source", "ids")
    used, least = check(pack(df, capacity=64).collect(), docs, 64)
    assert used <= least + 2
    # Many shards that hand on their emptiest sequences use as few.
    used, _ = check(pack(df, capacity=64, shard=120).collect(), docs, 64)
    assert used <= least + 4
    with_ids = pack(df, capacity=64, with_ids=True).collect()
    assert all(zlib.crc32(struct.pack(f"<{len(r['ids'])}I", *r["ids"])) == r["ids_crc32"] for r in with_ids)
    assert pack(spark.createDataFrame([], DOCS)).count() == 0
    assert pieces(documents(spark, [(1, None)])).collect()[0][:4] == (1, 0, 0, 1)
