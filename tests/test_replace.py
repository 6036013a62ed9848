"""Tables are replaced in one step or not at all."""

import pytest

from tillpoint.sources import sinks as K


def rows(spark, table="mart.swap"):
    return sorted(r[0] for r in spark.table(table).collect())


def leftovers(spark, db="mart"):
    return [t.name for t in spark.catalog.listTables(db) if "__new_" in t.name or "__old_" in t.name]


@pytest.fixture(autouse=True)
def fresh(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS mart")
    spark.sql("DROP TABLE IF EXISTS mart.swap")
    for t in leftovers(spark):
        spark.sql(f"DROP TABLE mart.`{t}`")


def test_replace_counts_and_takes_another_schema(spark):
    assert K.load_mart(spark.range(3), "swap") == 3 and rows(spark) == [0, 1, 2]
    assert K.load_mart(spark.createDataFrame([("a", 1), ("b", 2)], "s string, n int"), "mart.swap") == 2
    assert rows(spark) == ["a", "b"] and spark.table("mart.swap").columns == ["s", "n"]
    assert K.load_mart(spark.range(0), "swap") == 0 and rows(spark) == [] and leftovers(spark) == []


def test_table_may_be_replaced_by_what_reads_it(spark):
    K.load_mart(spark.range(4), "swap")
    assert K.load_mart(spark.table("mart.swap").where("id > 1"), "swap") == 2 and rows(spark) == [2, 3]


def test_failing_write_leaves_the_old_rows(spark):
    K.load_mart(spark.range(3), "swap")
    bad = spark.range(100).selectExpr("id", "assert_true(id < 90, 'no') AS x")
    with pytest.raises(Exception):
        K.load_mart(bad, "swap")
    assert rows(spark) == [0, 1, 2] and leftovers(spark) == []
    done, report = K.load_raw(spark, {"/a/swap it.csv": spark.range(2)}, "mart")
    assert report.first().row_count == 2
    done, report = K.load_raw(spark, {"/a/swap it.csv": bad, "/a/other.csv": spark.range(1)}, "mart")
    assert {r.path: (r.status, r.table_name, r.row_count) for r in report.collect()} == {
        "/a/swap it.csv": ("failed", None, None), "/a/other.csv": ("loaded", "mart.raw_other", 1)}
    assert rows(spark, "mart.raw_swap_it") == [0, 1]


@pytest.mark.parametrize("step", [1, 2])
def test_failing_swap_is_turned_back(spark, monkeypatch, step):
    K.load_mart(spark.range(3), "swap")
    rename, calls = K._rename, []

    def fails(*a):
        calls.append(a)
        if len(calls) == step:
            raise RuntimeError("lost")
        rename(*a)

    monkeypatch.setattr(K, "_rename", fails)
    with pytest.raises(RuntimeError):
        K.load_mart(spark.range(9), "swap")
    assert rows(spark) == [0, 1, 2] and leftovers(spark) == []


def test_driver_lost_between_the_renames(spark):
    """The state that such a driver leaves, and the next load."""
    K.load_mart(spark.range(3), "swap")
    spark.sql("ALTER TABLE mart.swap RENAME TO mart.swap__old_0123abcd")
    assert K.repair_table(spark, "mart", "swap") and rows(spark) == [0, 1, 2] and not K.repair_table(spark, "mart", "swap")
    spark.sql("ALTER TABLE mart.swap RENAME TO mart.swap__old_0123abcd")
    bad = spark.range(100).selectExpr("id", "assert_true(id < 90, 'no') AS x")
    with pytest.raises(Exception):
        K.load_mart(bad, "swap")
    assert rows(spark) == [0, 1, 2] and leftovers(spark) == []
