"""Language identification: averaged embeddings of hashed subwords under a linear softmax.

A text is lower-cased, everything but letters becomes a space, and its byte n-grams (2 to 4, none of two spaces in a
row) are hashed to rows of an embedding table; the mean of the rows goes through a linear softmax. Embeddings
and weights are trained by stochastic gradient descent in numpy on a bounded sample of labelled documents: at most about
``PER_LANG`` (and ``CHARS`` characters) per language, drawn by a hash of the id, of the ``MAX_LANGS`` labels that the most labelled rows have (ties: the smaller label). A fifth of the sample calibrates: a temperature for the
probabilities, and the score below which a prediction is rejected. Since the model is linear after the
mean, tasks carry the product of both tables, one number per n-gram and language.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and rejected, as is every text if there is
nothing to learn from; a null label teaches nothing, nor does one beyond the ``MAX_LANGS``; of equally likely languages the smaller name is
told; a text of any length counts whole, rows that repeat teach again; columns named like the results give way to them; every row gives one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType

from .common import fold_of, small_batches

ORDERS, BUCKETS, DIM = (2, 3, 4), 1 << 15, 16
PER_LANG, MAX_LANGS, CHARS = 500, 400, 8_000_000
EPOCHS, RATE, SEED = 6, 0.5, 11
FOLDS, HELD_OUT = 4, 2
# Share of right predictions that rejection may cost on the calibration sample, and the highest threshold it may set.
LOSS, HIGHEST = 0.001, 0.5
# Bytes of text whose n-grams are in memory at once.
CHUNK = 1 << 19


def subwords(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket per position and order, BUCKETS where there is none; first position of each text; n-grams per text)."""
    keep = np.full(256, 32, np.uint8)
    keep[128:] = np.arange(128, 256)
    keep[97:123] = np.arange(97, 123)
    parts = [b" " + (t or "").lower().encode("utf-8", "replace") + b"    " for t in texts]
    starts = np.cumsum([0, *map(len, parts)])[:-1]
    b = keep[np.frombuffer(b"".join(parts), np.uint8)]
    if not len(b):
        return np.zeros((0, len(ORDERS)), np.uint16), starts, np.zeros(0, np.int64)
    gap = b == 32
    padded = np.concatenate([b, np.full(max(ORDERS), 32, np.uint8)]).astype(np.uint32)
    gaps = np.concatenate([gap, np.ones(max(ORDERS), bool)])
    out = np.empty((len(b), len(ORDERS)), np.int32)
    for j, n in enumerate(ORDERS):
        key, none = np.full(len(b), n, np.uint32), np.zeros(len(b), bool)
        for i in range(n):
            key = key * np.uint32(0x01000193) ^ padded[i : i + len(b)]
            if i:
                none |= gaps[i - 1 : i - 1 + len(b)] & gaps[i : i + len(b)]
        key = (key * np.uint32(0x9E3779B1)) >> np.uint32(17)
        out[:, j] = np.where(none, BUCKETS, key)
    counts = np.add.reduceat((out != BUCKETS).sum(1), starts)
    return out, starts, counts


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


class Model:
    """Languages, the product of both tables with a zero row for no n-gram, biases, temperature and rejection threshold."""

    def __init__(self, langs: list[str], table: np.ndarray, bias: np.ndarray):
        self.langs, self.table, self.bias, self.temperature, self.threshold = langs, table, bias, 1.0, 0.0

    def logits(self, texts: list[str | None]) -> np.ndarray:
        buckets, starts, counts = subwords(texts)
        if not len(texts):
            return np.zeros((0, len(self.langs)))
        total = np.zeros((len(buckets), len(self.langs)), np.float32)
        for j in range(buckets.shape[1]):
            total += self.table[buckets[:, j]]
        sums = np.add.reduceat(total.astype(np.float64), starts, axis=0)
        return sums / np.maximum(counts, 1)[:, None] + self.bias

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        return softmax(self.logits(texts) / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[str], labels: list[str], epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model | None:
    """A calibrated model, or none without examples. Rows must come in an order of their own."""
    langs = sorted(set(labels))
    if not langs:
        return None
    y = np.array([langs.index(x) for x in labels])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    held = set(order[: len(texts) // 5].tolist())
    rows = []
    for i, text in enumerate(texts):
        buckets = subwords([text])[0].ravel()
        ids, n = np.unique(buckets[buckets != BUCKETS], return_counts=True)
        rows.append((ids, n / max(1, n.sum())))
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS + 1, DIM))
    emb[BUCKETS] = 0
    weights, bias = rng.normal(0, 1 / DIM**0.5, (DIM, len(langs))), np.zeros(len(langs))
    learn = [i for i in order if i not in held] or order.tolist()
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(learn):
            ids, w = rows[i]
            if not len(ids):
                continue
            mean = w @ emb[ids]
            p = softmax((mean @ weights + bias)[None])[0]
            p[y[i]] -= 1
            back = weights @ p
            weights -= step * np.outer(mean, p)
            bias -= 0.1 * step * p
            # In units of the text's own spread, so that long and short texts move their mean alike.
            emb[ids] -= (step / (w @ w)) * w[:, None] * back
    model = Model(langs, (emb @ weights).astype(np.float32), bias)
    check = sorted(held) or learn
    return calibrate(model, [texts[i] for i in check], y[check])


def calibrate(model: Model, texts: list[str], y: np.ndarray, loss: float = LOSS, highest: float = HIGHEST) -> Model:
    """Temperature of the least log loss; the threshold under which at most a share ``loss`` of right answers falls."""
    logits = np.concatenate([model.logits([t]) for t in texts])
    grid = np.geomspace(0.05, 20, 61)
    cost = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(cost))])
    p = softmax(logits / model.temperature)
    right = p.max(axis=1)[p.argmax(axis=1) == y]
    model.threshold = min(highest, float(np.quantile(right, loss))) if len(right) else 0.0
    return model


def fit(docs: DataFrame, per_lang: int = PER_LANG, max_langs: int = MAX_LANGS, chars: int = CHARS, folds: int = FOLDS, held_out: int = HELD_OUT) -> Model | None:
    """Train on labelled documents outside the held-out fold: a bounded sample, whole texts."""
    labelled = docs.where("text IS NOT NULL AND lang IS NOT NULL").where(fold_of("doc_id", folds) != held_out)
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
    share = None
    for r in sizes.orderBy(F.desc("n"), "lang").limit(max_langs).collect():
        here = F.lit(min(1.0, per_lang / r["n"], chars / max(1, r["chars"])))
        share = F.when(F.col("lang") == r["lang"], here) if share is None else share.when(F.col("lang") == r["lang"], here)
    share = F.lit(0.0) if share is None else share.otherwise(0.0)
    draw = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30)) / float(1 << 30)
    rows = labelled.where(draw < share).select("doc_id", "text", "lang").collect()
    rows = sorted((r for r in rows if has_letter(r["text"])), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["lang"], r["text"]))
    return train([r["text"] for r in rows], [r["lang"] for r in rows])


ADDED = ("lang_pred", "score", "rejected", "held_out")


def predict(docs: DataFrame, keep: list[str] | None = None, model: Model | None = None, folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """``docs`` (or its columns ``keep``) with lang_pred, score, rejected and held_out."""
    small_batches(docs.sparkSession)
    model = model or fit(docs, folds=folds, held_out=held_out)
    keep = [c for c in (keep or docs.columns) if c not in ADDED]
    flagged = docs.select(*dict.fromkeys(keep), F.col("text").alias("_text"), (fold_of("doc_id", folds) == held_out).alias("held_out"))
    shape = flagged.drop("_text", "held_out").schema.add("lang_pred", StringType()).add("score", DoubleType()).add("rejected", BooleanType()).add("held_out", BooleanType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            langs, scores, rejected, at = [], [], [], 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size < CHUNK):
                    size += len(texts[end] or "")
                    end += 1
                part = texts[at:end]
                known = [model is not None and has_letter(t) for t in part]
                p = model.probabilities(part) if model is not None else np.zeros((len(part), 1))
                for ok, best, q in zip(known, p.argmax(axis=1).tolist(), p.max(axis=1).tolist(), strict=True):
                    langs.append(model.langs[best] if ok else "und")
                    scores.append(min(1.0, q) if ok else 0.0)
                    rejected.append(not ok or q < model.threshold)
                at = end
            columns = [batch.column(c) for c in keep] + [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_()), batch.column("held_out")]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "lang_pred", "score", "rejected", "held_out"])

    return flagged.mapInArrow(run, shape)


def predict_ids(docs: DataFrame) -> DataFrame:
    return predict(docs, ["doc_id"])
