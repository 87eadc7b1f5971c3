"""Mixing sources to target weights by Poisson replication.

Every source gets a mean repetition rate: its target share of the tokens wanted, over the tokens it has. Each document
draws its number of copies from a Poisson distribution with that mean, by inverting the distribution at a number in
[0, 1) that a hash of the seed and the document's id fixes. Copies are exploded and shuffled over all partitions by a
second hash, so the outcome does not depend on how the input was partitioned, and a lost task repeats its rows exactly.

Without explicit ``weights`` a source's share is proportional to its size to the power ``alpha`` (tempered mixing).

Defined results: null sources form a source of their own; a null text has size 0; size is n words plus one, so no
document is free; null ids share one draw per source; rows that repeat an id get the same number of copies each; a source missing
in ``weights`` has weight 0; an empty table gives an empty result. A rate above ``PART`` is drawn as the sum of equal parts,
each by its own hash, which is the same distribution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

ALPHA, SEED = 0.5, 7
# The inversion sums the distribution term by term; at this mean 60 terms miss less than 1e-16 of it.
PART, TERMS = 16.0, 60


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an md5."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint") / F.lit(float(2**52))


def inverse_poisson(u: Column, start: Column, rate: Column) -> Column:
    """Smallest k whose cumulated probability exceeds ``u``; ``start`` is exp(-rate)."""
    zero = F.struct(F.lit(0).alias("k"), start.alias("p"), start.alias("cum"))

    def step(acc, i):
        p = acc["p"] * rate / i
        more = acc["cum"] <= u
        return F.struct(
            F.when(more, i).otherwise(acc["k"]).alias("k"), p.alias("p"), F.when(more, acc["cum"] + p).otherwise(acc["cum"]).alias("cum")
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), zero, step, lambda acc: acc["k"])


def size_of(text: Column) -> Column:
    """Words (runs of other than white space) plus one."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("bigint") + 1


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, budget: float | None = None) -> DataFrame:
    """(source, size, rate) for each source; ``budget`` is the number of words wanted, by default as many as there are."""
    sizes = docs.groupBy("source").agg(F.sum(size_of(F.col("text"))).alias("size"))
    if weights is None:
        weight = F.pow(F.col("size").cast("double"), F.lit(alpha))
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("source") == name, F.lit(float(w))).otherwise(weight)
    weighted = stage(sizes.withColumn("weight", weight), "mix_sizes")
    total = weighted.agg(F.sum("weight").alias("w"), F.sum("size").alias("n")).first()
    if total["n"] is None:
        return weighted.select("source", "size", F.lit(0.0).alias("rate"))
    want = float(budget if budget is not None else total["n"])
    return weighted.select("source", "size", (F.col("weight") / F.lit(total["w"] or 1.0) * F.lit(want) / F.col("size")).alias("rate"))


def draw(seed: int, source: Column, doc_id: Column, rate: Column) -> Column:
    """Number of copies of a document at a mean of ``rate``."""
    one = inverse_poisson(uniform(seed, source, doc_id), F.exp(-rate), rate)
    parts = F.ceil(rate / PART).cast("int")
    part = rate / parts
    more = F.aggregate(
        F.sequence(F.lit(1), parts), F.lit(0), lambda k, i: k + inverse_poisson(uniform(seed, source, doc_id, i), F.exp(-part), part)
    )
    return F.when(rate <= PART, one).otherwise(more)


def mix(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, budget: float | None = None, seed: int = SEED) -> DataFrame:
    """All columns of ``docs`` plus copy (from 0), rate and shuffle_key; every partition lies in the order of shuffle_key."""
    extra = [c for c in ("copy", "rate", "shuffle_key", "_rate", "_k") if c in docs.columns]
    docs = docs.drop(*extra)  # clashing names give way to the results
    rates = source_rates(docs.select("source", "text"), weights, alpha, budget)
    rates = rates.select(F.col("source").alias("_source"), F.col("rate").alias("_rate"))
    drawn = docs.join(rates, docs["source"].eqNullSafe(rates["_source"])).drop("_source")
    drawn = drawn.withColumn("_k", draw(seed, F.col("source"), F.col("doc_id"), F.col("_rate"))).where("_k > 0")
    copies = drawn.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    keyed = copies.withColumn("shuffle_key", F.md5(F.concat_ws("|", F.lit(str(seed + 1)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("copy")).cast("binary")))
    # The hash deals copies to partitions and orders them there: a global shuffle that needs no pass to sample bounds.
    return keyed.withColumnRenamed("_rate", "rate").drop("_k").repartition("shuffle_key").sortWithinPartitions("shuffle_key", "doc_id")
