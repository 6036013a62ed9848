"""Every registered query against its DuckDB twin (the driver's correctness
gate), on the smallest scale factor."""

import pytest

import __spark_entry__ as E
from tillpoint.plans import registry
from check_oracle import compare, duck
from conftest import SMOKE

registry.load_all()
QUERIES, ORACLE = registry.QUERIES, registry.ORACLE   # the llm queries have tests of their own


@pytest.fixture(scope="module")
def con():
    return duck(SMOKE)


def test_every_query_has_a_twin():
    assert set(ORACLE) == set(QUERIES)


def test_entry_exposes_both_registries():
    assert set(QUERIES) <= set(E.queries()) and set(ORACLE) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    status, msg = compare(spark, con, name, QUERIES[name], ORACLE.get(name), SMOKE, tolerance=0.011)
    assert status == "ok", msg


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["label", "total"]
    assert len(rows) >= 1
