"""J8 by type: least common types, grouping, provenance, relationships, DDL."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import types as T

from tillpoint.operators.unify import identifier, least_common, model_ddl, unify

I, L, S, D, F, TX = T.IntegerType(), T.LongType(), T.ShortType(), T.DoubleType(), T.FloatType(), T.StringType()
DATE, TS, NTZ = T.DateType(), T.TimestampType(), T.TimestampNTZType()


@pytest.mark.parametrize("a, b, want", [
    (I, I, I), (S, L, L), (I, D, D), (L, F, D), (F, F, F), (F, D, D), (T.DecimalType(10, 2), I, T.DecimalType(12, 2)), (T.DecimalType(5, 2), T.DecimalType(8, 4), T.DecimalType(8, 4)),
    (T.DecimalType(38, 0), T.DecimalType(10, 5), D), (T.DecimalType(10, 2), D, D), (I, TX, TX), (DATE, TS, TS), (DATE, NTZ, NTZ), (NTZ, TS, TS), (DATE, I, TX), (T.BooleanType(), I, TX),
    (T.NullType(), I, I), (T.ArrayType(I), T.ArrayType(I), T.ArrayType(I)), (T.ArrayType(I), I, TX)])
def test_least_common_type(a, b, want):
    assert least_common(a, b) == want == least_common(b, a)


def test_conflicting_files_become_one_table_per_type(spark):
    frames = {
        "a": spark.createDataFrame([(1, 2.5, dt.date(2020, 1, 2), "x")], "`Customer ID` int, Amount double, `Order Date` date, Qty string"),
        "b": spark.createDataFrame([(2**40, Decimal("7.25"), dt.date(2021, 1, 2), 3, "own")], "`customer id` bigint, AMOUNT decimal(9,2), `order date` date, quantity int, source_file string"),
        "c": spark.createDataFrame([("s", 1, "t")], "sku string, mrp int, category string"),
        "d": spark.createDataFrame([([1, 2], None)], "`Free Text` array<int>, n void"),
        "e": spark.createDataFrame([("q", 5)], "free_text string, n int"),
    }
    m = unify(spark, frames, "2026-01-01")
    assert set(m.tables) == {"sales_transactions", "product_catalog", "misc_data"}
    sales = m.tables["sales_transactions"]
    assert sales.columns == ["customer_id", "amount", "order_date", "qty", "quantity", "source_file_own", "source_file", "loaded_at"]
    rows = {r.source_file: r for r in sales.collect()}
    assert (rows["a"].customer_id, rows["a"].amount, rows["a"].quantity) == (1, 2.5, None)
    assert (rows["b"].customer_id, rows["b"].amount, rows["b"].qty, rows["b"].source_file_own) == (2**40, 7.25, None, "own")
    misc = {r.source_file: (r.free_text, r.n) for r in m.tables["misc_data"].collect()}
    assert misc == {"d": ("[1,2]", None), "e": ("q", 5)}
    info = {(r.table_name, r.column_name): (r.data_type, r.files, r.conflicting) for r in m.columns.collect()}
    assert info["sales_transactions", "amount"] == ("double", 2, True) and info["misc_data", "free_text"] == ("string", 2, True)
    assert info["product_catalog", "mrp"] == ("int", 1, False)
    link = m.relationships.first()
    assert (link.from_table, link.to_table, link.on_columns, link.found_columns) == ("sales_transactions", "product_catalog", ["SKU", "STYLE", "PRODUCT_ID"], [])
    ddl = {r.table_name: r.ddl for r in model_ddl(m.columns).collect()}
    assert ddl["product_catalog"] == ("CREATE TABLE product_catalog (\n    sku VARCHAR(255),\n    mrp INTEGER,\n    category VARCHAR(255),\n"
                                      "    source_file VARCHAR(255),\n    loaded_at TIMESTAMP DEFAULT CURRENT_TIMESTAMP\n);")


def test_same_identifier_twice_in_a_file_and_no_files(spark):
    df = spark.createDataFrame([(None, "b"), ("a", "c")], "`Full Name` string, full_name string")
    m = unify(spark, {"f": df})
    assert sorted(r.full_name for r in m.tables["misc_data"].collect()) == ["a", "b"] and identifier("Loaded AT") == "loaded_at_own"
    none = unify(spark, {})
    assert none.tables == {} and none.columns.count() == 0 and none.relationships.count() == 0 and model_ddl(none.columns).count() == 0


def test_many_files_keep_a_shallow_plan(spark):
    m = unify(spark, {f"f{i}": spark.range(i, i + 1).toDF("k") for i in range(60)})
    assert sorted(r.k for r in m.tables["misc_data"].collect()) == list(range(60))
