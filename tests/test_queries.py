"""Every registered query equals its DuckDB twin."""

import pytest
from check_queries import differences, duck

import __spark_entry__ as entry
from kgspark.checks import load

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = load().QUERIES, load().ORACLES


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_twin(spark, con, name):
    got = QUERIES[name](spark, SF).toArrow()
    if name in ORACLES:
        text, _ = differences(got, con, ORACLES[name])
        assert text.split(" TYPES ")[0].strip() == "", text
    else:
        assert got.num_rows > 0


def test_every_twin_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLES) == {"louvain_partition"}
    assert QUERIES.keys() <= entry.queries().keys() and ORACLES.keys() <= entry.oracle_sql().keys()
