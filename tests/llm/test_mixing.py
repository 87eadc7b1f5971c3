import math
from collections import Counter

from helpers import DOCS, documents, rows_of
from pyspark.sql import functions as F

from kgspark.llm.mixing import inverse_poisson, mix, source_rates


def test_inverse_is_exact(spark):
    us = [0.0, 0.1, 0.36787944, 0.36787945, 0.5, 0.9, 0.99, 0.9999999, 0.999999999]
    for rate in (0.01, 1.0, 3.7, 16.0):
        got = spark.createDataFrame([(u,) for u in us], "u double").select("u", inverse_poisson(F.col("u"), F.exp(F.lit(-rate)), F.lit(rate)).alias("k")).collect()
        for u, k in got:
            p, cum, n = math.exp(-rate), math.exp(-rate), 0
            while cum <= u and n < 60:
                n += 1
                p *= rate / n
                cum += p
            assert k == n


def test_shares_reach_the_target(spark):
    docs = documents(spark, [(i, "a b c", "en", "big" if i % 10 else "small") for i in range(4000)])
    got = Counter(r["source"] for r in mix(docs, weights={"big": 1.0, "small": 1.0}).collect())
    # 3600 and 400 documents towards 2000 each; five standard deviations of a Poisson sum.
    assert abs(got["big"] - 2000) < 5 * 2000**0.5 and abs(got["small"] - 2000) < 5 * (2000 * 6) ** 0.5


def test_partitioning_does_not_matter(spark):
    docs = documents(spark, [(i, "w " * (i % 7), "en", f"s{i % 3}") for i in range(200)])
    a, b = (rows_of(mix(x), "doc_id", "copy", "shuffle_key", "text") for x in (docs.repartition(1), docs.repartition(7)))
    assert a == b and len(a) > 100


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, None, None, None), (None, "", "en", "s"), (2, "x " * 50_000, "en", "s")]
    df = documents(spark, rows).withColumn("copy", F.lit("clash")).withColumn("rate", F.lit("clash")).withColumn("extra", F.lit(5))
    got = mix(df)
    assert set(got.columns) == {*(c.split()[0] for c in DOCS.split(", ")), "extra", "copy", "rate", "shuffle_key"}
    assert all(r["copy"] >= 0 and r["extra"] == 5 for r in got.collect())
    counts = Counter(r["doc_id"] for r in got.collect())
    assert counts[1] % 2 == 0  # repeated rows draw alike
    assert mix(spark.createDataFrame([], DOCS)).count() == 0
    assert source_rates(documents(spark, [(1, "a")]), weights={}).first()["rate"] == 0


def test_high_rates_are_drawn_in_parts(spark):
    docs = documents(spark, [*[(i, "a", "en", "tiny") for i in range(20)], *[(i, "a b", "en", "rest") for i in range(100, 1100)]])
    got = Counter(r["source"] for r in mix(docs, weights={"tiny": 1.0}).collect())
    # 3040 words towards a source of 40: each of its documents 76 times, in five parts.
    assert set(got) == {"tiny"} and abs(got["tiny"] - 1520) < 5 * 1520**0.5
