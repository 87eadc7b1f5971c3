"""The registered queries over the small tables, and the stages of the pipeline, against SQL or brute force."""

import duckdb
import pytest
from check_queries import differences, duck
from test_minhash import brute
from test_packing import check

import __spark_entry__ as entry
import corpus_pipeline
from kgspark.llm.oracles import POISSON_MIX
from kgspark.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
COUNTED = {"op1_": "pages", "op3_": "embeddings", "op6_": "documents", "op7_": "documents", "op8_": "documents", "op12_": "documents", "op13_": "documents"}


def test_all_are_registered():
    names = entry.queries().keys()
    assert QUERIES.keys() <= names and "pipeline" in names and ORACLES.keys() <= entry.oracle_sql().keys()
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_its_sql(spark, name):
    text, _ = differences(QUERIES[name](spark, SF).toArrow(), duck(SF), ORACLES[name])
    assert text == ""


@pytest.mark.parametrize("name", [n for n in QUERIES if n[: n.index("_") + 1] in COUNTED])
def test_query_has_a_row_for_each_row(spark, name):
    table = COUNTED[name[: name.index("_") + 1]]
    key = {"pages": "page_id", "embeddings": "vec_id", "documents": "doc_id"}[table]
    got = [r[key] for r in QUERIES[name](spark, SF).collect()]
    assert sorted(got) == sorted(r[key] for r in spark.read.parquet(f"{SF}/{table}.parquet").collect())


def test_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, step in corpus_pipeline.STAGES:
        kept[name] = (docs.toPandas(), step(spark, docs, SF))
        kept[name][1].write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == columns
    before, _ = kept["near_duplicates"]
    # Clean documents stay: only what has no recognisable language goes.
    assert len(before) >= 0.97 * len(kept["language"][0])
    classes = brute(list(zip(before["doc_id"].tolist(), before["text"].tolist(), strict=True)))
    after, _ = kept["mixture"]
    assert sorted(after["doc_id"].tolist()) == sorted(i for i, c in classes.items() if i == c)
    con = duckdb.connect()
    con.register("documents", after)
    want = con.execute(f"SELECT doc_id, count(*) AS n FROM ({POISSON_MIX}) q GROUP BY 1").fetchall()
    mixed, _ = kept["packing"]
    assert sorted(want) == sorted(mixed["doc_id"].value_counts().items())
    packed = spark.read.parquet(f"{tmp_path}/packing").collect()
    used, least = check(packed, list(zip(mixed["doc_id"].tolist(), mixed["text"].tolist(), strict=True)), 4096)
    assert used <= least + 1
    assert corpus_pipeline.run(spark, SF).count() == len(packed)
