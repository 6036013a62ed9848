"""Registered queries of the data model by file type."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpoint.operators.unify import unify
from tillpoint.plans.registry import register
from tillpoint.sources.tables import load

LOADED = "2026-01-01"


def _model(spark, sf_dir):
    """Six files of three types from the given tables; equal names have other cases, blanks and types."""
    orders, lines, part = (load(spark, sf_dir, t) for t in ("orders", "lineitem", "part"))
    return unify(spark, {
        "web_orders.csv": orders.selectExpr("o_custkey AS `Customer ID`", "o_orderdate AS `Order Date`", "o_totalprice AS `Total Amount`",
                                            "cast(o_orderkey AS int) AS Pcs"),
        "shop_lines.csv": lines.selectExpr("concat('S', l_partkey) AS SKU", "cast(l_shipdate AS date) AS `order date`", "cast(l_extendedprice AS decimal(12,2)) AS `total amount`",
                                           "cast(l_suppkey AS int) AS `customer id`", "cast(l_quantity AS smallint) AS pcs"),
        "parts_list.csv": part.selectExpr("p_partkey AS SKU", "p_type AS Category", "cast(p_retailprice AS decimal(10,2)) AS MRP"),
        "parts_web.csv": part.selectExpr("concat('S', p_partkey) AS sku", "p_brand AS category", "p_size AS mrp", "cast(p_size AS string) AS Style"),
        "nation.csv": load(spark, sf_dir, "nation"),
        "region.csv": load(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey"),
    }, loaded_at=LOADED)


def _checked(table: str, rows: DataFrame, number: str, amount: str, text: str) -> DataFrame:
    """What came through of a table, by file."""
    return rows.groupBy("source_file").agg(
        F.lit(table).alias("table_name"), F.count(F.lit(1)).alias("rows"), F.sum(number).cast("bigint").alias("number_sum"),
        F.round(F.sum(F.col(amount).cast("double")), 0).alias("amount_sum"), F.count(text).alias("texts"), F.max(text).alias("last_text"),
        F.count_if(F.col("loaded_at") == F.lit(LOADED).cast("timestamp")).alias("loaded"))


@register("j8_by_type_rows", """
SELECT 'sales_transactions' AS table_name, 'web_orders.csv' AS source_file, count(*) AS rows, sum(o_custkey)::BIGINT AS number_sum,
  round(sum(o_totalprice), 0) AS amount_sum, 0 AS texts, NULL::VARCHAR AS last_text, count(*) AS loaded FROM orders
UNION ALL SELECT 'sales_transactions', 'shop_lines.csv', count(*), sum(l_suppkey)::BIGINT, round(sum(l_extendedprice::DECIMAL(12,2)::DOUBLE), 0), count(*),
  max('S' || l_partkey), count(*) FROM lineitem
UNION ALL SELECT 'product_catalog', 'parts_list.csv', count(*), sum(length(p_partkey::VARCHAR))::BIGINT, round(sum(p_retailprice::DECIMAL(10,2)::DOUBLE), 0), count(*),
  max(p_partkey::VARCHAR), count(*) FROM part
UNION ALL SELECT 'product_catalog', 'parts_web.csv', count(*), sum(length('S' || p_partkey))::BIGINT, round(sum(p_size)::DOUBLE, 0), count(*),
  max('S' || p_partkey), count(*) FROM part
UNION ALL SELECT 'misc_data', 'nation.csv', count(*), sum(n_regionkey)::BIGINT, round(sum(n_nationkey)::DOUBLE, 0), count(n_name), max(n_name), count(*) FROM nation
UNION ALL SELECT 'misc_data', 'region.csv', count(*), sum(r_regionkey)::BIGINT, NULL, 0, NULL, count(*) FROM region""")
def j8_by_type_rows(spark, sf_dir):
    """The rows of the three tables, file by file, after their columns met in one type."""
    t = _model(spark, sf_dir).tables
    catalog = t["product_catalog"].withColumn("size", F.length("sku"))
    return reduce(DataFrame.unionByName, (_checked("sales_transactions", t["sales_transactions"], "customer_id", "total_amount", "sku"),
                                          _checked("product_catalog", catalog, "size", "mrp", "sku"),
                                          _checked("misc_data", t["misc_data"], "n_regionkey", "n_nationkey", "n_name")))


@register("j8_by_type_links", """
WITH s AS (SELECT 'S' || l_partkey AS sku FROM lineitem),
c AS (SELECT DISTINCT sku FROM (SELECT p_partkey::VARCHAR AS sku FROM part UNION ALL SELECT 'S' || p_partkey FROM part))
SELECT 'sales_transactions' AS from_table, 'product_catalog' AS to_table, 'LEFT JOIN' AS join_type, 'SKU,STYLE,PRODUCT_ID' AS on_columns, 'SKU' AS found_columns,
  (SELECT count(*) FROM s) + (SELECT count(*) FROM orders) AS rows, (SELECT count(*) FROM s SEMI JOIN c USING (sku)) AS linked""")
def j8_by_type_links(spark, sf_dir):
    """The relationship, and how many facts find their product by it."""
    m = _model(spark, sf_dir)
    sales, keys = m.tables["sales_transactions"], m.tables["product_catalog"].select("sku").distinct().withColumn("there", F.lit(1))
    counts = sales.join(keys, "sku", "left").agg(F.count(F.lit(1)).alias("rows"), F.count("there").alias("linked"))
    return m.relationships.select("from_table", "to_table", "join_type", F.array_join("on_columns", ",").alias("on_columns"),
                                  F.array_join("found_columns", ",").alias("found_columns")).crossJoin(counts)      # one row beside one row
