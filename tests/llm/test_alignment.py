"""Cross-tokenizer alignment against token-by-token comparison."""

import hashlib
from bisect import bisect_left
from collections import Counter

import public_tokenizers
import pytest
from helpers import documents
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from kgspark.llm.alignment import align

NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
TEXTS = [
    "The quick brown foxes' jumping, isn't it? 12345 6.7", "The quick brown foxes' jumping, isn't it? 12345 6.7", "", None,
    "  two  spaces \n\n  and\tlines \r\n here ", "Straße ñandú œuvre été é 　 日本語 text 🙂🙂 x", "a▁b stays out", "<|endoftext|> and <s> x </s> <0x41>",
    "\x00\x1c \x85 odd", " ", "word " * 400, "a" * 3000, "The quick one", "ﬁne 　wide",
]


def brute(rows):
    a_side, b_side = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    a_side.encode_special_tokens = True
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in kept)}
    found, linked = [], Counter()
    for doc_id, text in rows:
        if not text:
            found.append((doc_id, None))
            continue
        a, b = a_side.encode(" " + text, add_special_tokens=False), b_side.encode(text)
        a_parts = [bytes(byte[c] for c in t) for t in a.tokens]
        b_parts = [bytes([int(p[3:5], 16)]) if b_side.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, map(b_side.id_to_piece, b))]
        if b"".join(a_parts) != (" " + text).encode() or b"".join(b_parts) != (" " + text).encode():
            found.append((doc_id, None))
            continue
        spans = []
        for ids, parts in ((a.ids, a_parts), (b, b_parts)):
            at, side = 0, []
            for i, p in zip(ids, parts):
                side.append((at, at + len(p), i))
                at += len(p)
            spans.append(side)
        pairs, j = [], 0
        for s, e, i in spans[0]:
            while spans[1][j][1] <= s:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][0] < e:
                pairs.append((i, spans[1][k][2]))
                k += 1
        ends = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        parts = [{}, {}]
        for side, part in zip(spans, parts):
            for _, e, i in side:
                part.setdefault(bisect_left(ends, e), []).append(str(i))
        groups = ["|".join(",".join(part[g]) for part in parts) for g in range(len(ends))]
        found.append((doc_id, (len(a.ids), len(b), groups, pairs)))
        linked.update(set(pairs))
    top = {}
    for (i, _), n in linked.items():
        top[i] = max(top.get(i, 0), n)
    out = []
    for doc_id, got in found:
        if got is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, groups, pairs = got
            out.append((doc_id, n_a, n_b, len(groups), len(pairs), sum(linked[p] == top[p[0]] for p in pairs), sum(linked[p] for p in pairs),
                        hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("options", [{}, {"broadcast_pairs": 0}, {"chunk": 40, "most": 30}, {"chunk": 40, "most": 30, "broadcast_pairs": 0}])
def test_equals_token_by_token(spark, options):
    rows = [*enumerate(TEXTS), (3, "The same id again"), (None, "no id"), (None, "no id")]
    got = align(documents(spark, rows), **options)
    assert sorted((tuple(r) for r in got.select("doc_id", *NAMES).collect()), key=repr) == brute(rows)


def test_given_documents_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in align(docs).select("doc_id", *NAMES).collect()), key=repr) == brute(rows)


def test_empty_table_and_other_columns(spark):
    docs = documents(spark, [(1, "x y", "en")])
    assert align(docs.where("false")).collect() == []
    other = docs.withColumnsRenamed({"lang": "n", "source": "pairs", "n_chars": "a"})
    assert [r["n_links"] for r in align(other).collect()] == [r["n_links"] for r in align(docs).collect()]
