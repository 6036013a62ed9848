"""Registered queries of the KPI block and the question catalogue over sales_wide."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tillpoint.operators import kpi
from tillpoint.operators.profile import describe, numeric_profile
from tillpoint.plans import questions as qs
from tillpoint.plans.registry import register, rounded
from tillpoint.plans.sales_wide import fact_rollup, order_rollup, sales_wide
from tillpoint.sources.tables import load

_SW_FROM = """lineitem
  LEFT JOIN orders ON l_orderkey = o_orderkey
  LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN part ON l_partkey = p_partkey
  LEFT JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN region ON n_regionkey = r_regionkey"""


def _top_dim_sql(dim: str, limit: int = 10, where: str = "") -> str:
    return f"""
SELECT {dim} AS label, round(sum(l_extendedprice), 2) AS total
FROM {_SW_FROM}
{where}
GROUP BY {dim}
ORDER BY total DESC NULLS LAST, label ASC NULLS LAST
LIMIT {limit}"""


def _top_dim(spark, sf_dir, dim, limit=10):
    r = rounded(fact_rollup(spark, sf_dir, dim).select("label", "total"))
    return kpi.top_of_rollup(r, limit)


@register("h1_top_category", _top_dim_sql("p_type"))
def h1_top_category(spark, sf_dir):
    return _top_dim(spark, sf_dir, "p_type")


@register("h1_top_channel", _top_dim_sql("o_orderpriority"))
def h1_top_channel(spark, sf_dir):
    return _top_dim(spark, sf_dir, "o_orderpriority")


@register("h1_top_region", _top_dim_sql("r_name"))
def h1_top_region(spark, sf_dir):
    return _top_dim(spark, sf_dir, "r_name")


@register("h1_top_nation_by_count", """
SELECT n_name AS label, count(*) AS total FROM """ + _SW_FROM + """
GROUP BY n_name ORDER BY total DESC NULLS LAST, label ASC NULLS LAST LIMIT 10""")
def h1_top_nation_by_count(spark, sf_dir):
    # H1 without an amount column: COUNT(*) per value, counted per key before the joins
    r = fact_rollup(spark, sf_dir, "n_name", None).select("label", F.col("n").alias("total"))
    return r.orderBy(F.col("total").desc_nulls_last(), F.col("label").asc_nulls_last()).limit(10)


@register("n8_top5_customers", _top_dim_sql("c_name", 5))
def n8_top5_customers(spark, sf_dir):
    return _top_dim(spark, sf_dir, "c_name", 5)


@register("n10_top_products", _top_dim_sql("p_brand"))
def n10_top_products(spark, sf_dir):
    return _top_dim(spark, sf_dir, "p_brand")


@register("n16_top_category_non_null", _top_dim_sql("p_type", 10, "WHERE p_type IS NOT NULL"))
def n16_top_category_non_null(spark, sf_dir):
    r = rounded(fact_rollup(spark, sf_dir, "p_type").where(F.col("label").isNotNull()).select("label", "total"))
    return kpi.top_of_rollup(r, 10)


@register("g1_g4_kpi_totals", """
SELECT count(*) AS row_count, round(sum(l_extendedprice), 2) AS total_sales,
       round(avg(l_extendedprice), 2) AS avg_order, round(sum(l_quantity), 2) AS total_units,
       min(TRY_CAST(o_orderdate AS DATE)) AS min_date, max(TRY_CAST(o_orderdate AS DATE)) AS max_date
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey""")
def g1_g4_kpi_totals(spark, sf_dir):
    sw = sales_wide(spark, sf_dir, ["l_extendedprice", "l_quantity", "o_orderdate"])
    return rounded(kpi.kpi_totals(sw, "l_extendedprice", "l_quantity", "o_orderdate"))


_MONTHLY_SQL = """
SELECT CAST(date_trunc('month', TRY_CAST(o_orderdate AS DATE)) AS DATE) AS month,
       sum(l_extendedprice) AS total
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE TRY_CAST(o_orderdate AS DATE) IS NOT NULL
GROUP BY 1"""


def _monthly(spark, sf_dir):
    orl = order_rollup(spark, sf_dir)
    return kpi.monthly_totals(orl, "o_orderdate", "line_total")


@register("h2_monthly_totals", f"SELECT month, round(total, 2) AS total FROM ({_MONTHLY_SQL}) ORDER BY month")
def h2_monthly_totals(spark, sf_dir):
    return rounded(_monthly(spark, sf_dir))


_DELTA_SQL = f"""
WITH m AS ({_MONTHLY_SQL}),
l AS (SELECT month, total, lag(total) OVER (ORDER BY month) AS prev_total FROM m)
SELECT month, round(total, 2) AS total, round(prev_total, 2) AS prev_total,
       round(CASE WHEN prev_total <> 0 THEN total - prev_total END, 2) AS delta,
       round(CASE WHEN prev_total <> 0 THEN (total - prev_total) / prev_total * 100 END, 2) AS delta_pct
FROM l"""


@register("i1_month_deltas", _DELTA_SQL)
def i1_month_deltas(spark, sf_dir):
    return rounded(kpi.period_deltas(_monthly(spark, sf_dir)))


@register("i1_last_month_delta", _DELTA_SQL + " ORDER BY month DESC LIMIT 1")
def i1_last_month_delta(spark, sf_dir):
    return rounded(kpi.last_period_delta(_monthly(spark, sf_dir)))


@register("h3_last_12_months",
          f"SELECT month, round(total, 2) AS total FROM ({_MONTHLY_SQL}) ORDER BY month DESC LIMIT 12")
def h3_last_12_months(spark, sf_dir):
    return rounded(kpi.last_n_periods(_monthly(spark, sf_dir), 12))


_YEARLY_SQL = """
SELECT CAST(year(o_orderdate) AS INTEGER) AS year, sum(l_extendedprice) AS total_amount,
       count(l_extendedprice) AS transactions, avg(l_extendedprice) AS avg_amount
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey
WHERE year(o_orderdate) IS NOT NULL GROUP BY 1"""


@register("h5_yearly_sales", f"""
SELECT year, round(total_amount, 2) AS total_amount, transactions, round(avg_amount, 2) AS avg_amount
FROM ({_YEARLY_SQL})""")
def h5_yearly_sales(spark, sf_dir):
    orl = order_rollup(spark, sf_dir)
    return rounded(qs.yearly_from_rollup(orl))


@register("h6_quarterly_recent_year", """
SELECT CAST(quarter(o_orderdate) AS INTEGER) AS quarter, round(sum(l_extendedprice), 2) AS total_amount,
       count(l_extendedprice) AS transactions
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey
WHERE year(o_orderdate) = (SELECT max(year(o_orderdate)) FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey)
GROUP BY 1""")
def h6_quarterly_recent_year(spark, sf_dir):
    return rounded(kpi.quarterly_from_rollup(order_rollup(spark, sf_dir)))


@register("i2_yoy_growth", f"""
WITH y AS (SELECT year, total_amount AS total FROM ({_YEARLY_SQL})),
l AS (SELECT year, total, lag(total) OVER (ORDER BY year) AS prev_total FROM y)
SELECT year, round(total, 2) AS total, round(prev_total, 2) AS prev_total,
       round(CASE WHEN prev_total <> 0 THEN total - prev_total END, 2) AS delta,
       round(CASE WHEN prev_total <> 0 THEN (total - prev_total) / prev_total * 100 END, 2) AS delta_pct
FROM l""")
def i2_yoy_growth(spark, sf_dir):
    y = qs.yearly_from_rollup(order_rollup(spark, sf_dir)).select("year", F.col("total_amount").alias("total"))
    return rounded(kpi.period_deltas(y, "year"))


@register("g6_business_metrics", """
SELECT round(sum(l_extendedprice), 2) AS total_sales, round(avg(l_extendedprice), 2) AS avg_transaction,
       round(quantile_cont(l_extendedprice, 0.5), 2) AS median_transaction,
       round(max(l_extendedprice), 2) AS max_transaction, round(min(l_extendedprice), 2) AS min_transaction
FROM lineitem""")
def g6_business_metrics(spark, sf_dir):
    return rounded(kpi.business_metrics(load(spark, sf_dir, "lineitem"), "l_extendedprice"))


@register("g7_unique_customers", "SELECT count(DISTINCT o_custkey) AS unique_customers FROM orders")
def g7_unique_customers(spark, sf_dir):
    return kpi.unique_count(load(spark, sf_dir, "orders"), "o_custkey")


_LI_NUM = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
           "l_extendedprice", "l_discount", "l_tax")


@register("g5_numeric_profile", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, round(CAST(min({c}) AS DOUBLE), 2) AS min_val, "
    f"round(CAST(max({c}) AS DOUBLE), 2) AS max_val, round(avg({c}), 2) AS avg_val FROM lineitem"
    for c in _LI_NUM))
def g5_numeric_profile(spark, sf_dir):
    return rounded(numeric_profile(load(spark, sf_dir, "lineitem")))


@register("g8_describe_lineitem", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c}) AS count, round(avg({c}), 2) AS mean, "
    f"round(stddev_samp({c}), 2) AS std, round(CAST(min({c}) AS DOUBLE), 2) AS min, "
    f"round(quantile_cont({c}, 0.25), 2) AS p25, round(quantile_cont({c}, 0.5), 2) AS p50, "
    f"round(quantile_cont({c}, 0.75), 2) AS p75, round(CAST(max({c}) AS DOUBLE), 2) AS max FROM lineitem"
    for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")))
def g8_describe_lineitem(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    return rounded(describe(li, [f.name for f in li.schema.fields if isinstance(f.dataType, NumericType)]))


@register("g11_explorer_totals", """
SELECT round(sum(TRY_CAST(o_totalprice AS DOUBLE)), 2) AS total_amount,
       round(avg(TRY_CAST(o_totalprice AS DOUBLE)), 2) AS avg_amount FROM orders""")
def g11_explorer_totals(spark, sf_dir):
    return rounded(kpi.numeric_totals(load(spark, sf_dir, "orders"), "o_totalprice", None))


@register("g11_explorer_totals_text", f"""
SELECT round(sum(TRY_CAST(amt AS DOUBLE)), 2) AS total_amount, round(avg(TRY_CAST(amt AS DOUBLE)), 2) AS avg_amount,
       round(CAST(sum(TRY_CAST(qty AS DOUBLE)) AS DOUBLE), 2) AS total_units
FROM (SELECT CASE WHEN l_linenumber = 3 THEN 'n/a' ELSE CAST(l_extendedprice AS VARCHAR) END AS amt,
             CASE WHEN l_returnflag = 'R' THEN '' ELSE CAST(l_quantity AS VARCHAR) END AS qty FROM lineitem)""")
def g11_explorer_totals_text(spark, sf_dir):
    """Text columns with values that are no numbers: coerced, the others count nothing."""
    li = load(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_linenumber") == 3, "n/a").otherwise(F.col("l_extendedprice").cast("string")).alias("amt"),
        F.when(F.col("l_returnflag") == "R", "").otherwise(F.col("l_quantity").cast("string")).alias("qty"))
    return rounded(kpi.numeric_totals(li, "amt", "qty"))


@register("h7_facts_top_returnflag", """
SELECT l_returnflag AS value, round(CAST(coalesce(sum(l_extendedprice), 0) AS DOUBLE), 2) AS sum_l_extendedprice
FROM lineitem GROUP BY 1 ORDER BY sum_l_extendedprice DESC, value ASC NULLS LAST LIMIT 10""")
def h7_facts_top_returnflag(spark, sf_dir):
    return rounded(kpi.facts_top(load(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice"))


@register("h8_sample_rows", "SELECT * FROM nation ORDER BY n_nationkey LIMIT 3")
def h8_sample_rows(spark, sf_dir):
    return kpi.sample_rows(load(spark, sf_dir, "nation"), "n_nationkey", 3)


# ---- question catalogue (N1-N16) ------------------------------------------

@register("n1_total_sales", "SELECT round(sum(l_extendedprice), 2) AS total_sales FROM lineitem")
def n1_total_sales(spark, sf_dir):
    return rounded(qs.total_sales(load(spark, sf_dir, "lineitem"), "l_extendedprice"))


@register("n2_top10_transactions", """
SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice, 2) AS l_extendedprice FROM lineitem
ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity LIMIT 10""")
def n2_top10_transactions(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    top = qs.top_transactions(li, "l_extendedprice", 10,
                              ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"])
    return rounded(top.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"))


@register("n3_sales_in_year", """
SELECT round(sum(l_extendedprice), 2) AS total_sales
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey WHERE year(o_orderdate) = 1998""")
def n3_sales_in_year(spark, sf_dir):
    sw = sales_wide(spark, sf_dir, ["o_orderdate", "l_extendedprice"])
    return rounded(qs.sales_in_year(sw, "o_orderdate", "l_extendedprice", 1998))


@register("n5_q1_vs_q2", """
SELECT CAST(year(o_orderdate) AS INTEGER) AS year,
       round(coalesce(sum(CASE WHEN quarter(o_orderdate) = 1 THEN l_extendedprice END), 0), 2) AS q1_sales,
       round(coalesce(sum(CASE WHEN quarter(o_orderdate) = 2 THEN l_extendedprice END), 0), 2) AS q2_sales
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE o_orderdate IS NOT NULL GROUP BY 1""")
def n5_q1_vs_q2(spark, sf_dir):
    orl = order_rollup(spark, sf_dir)
    return rounded(qs.quarter_compare(orl, "o_orderdate", "line_total", 1, 2))


@register("n7_top_customer_purchases", """
WITH top AS (
  SELECT c_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  WHERE c_name IS NOT NULL GROUP BY c_name ORDER BY count(*) DESC, c_name LIMIT 1)
SELECT c_name, l_orderkey, l_linenumber, l_partkey, round(l_extendedprice, 2) AS l_extendedprice
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
WHERE c_name IN (SELECT c_name FROM top)""")
def n7_top_customer_purchases(spark, sf_dir):
    return rounded(qs.purchases_of_top_customer(spark, sf_dir))


@register("n9_unique_customers", """
SELECT count(DISTINCT c_name) AS unique_customers
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey""")
def n9_unique_customers(spark, sf_dir):
    return kpi.unique_count(fact_rollup(spark, sf_dir, "c_name", None).withColumnRenamed("label", "c_name"), "c_name")


@register("n11_avg_price_per_product", """
SELECT p_brand AS product, round(avg(p_retailprice), 2) AS avg_price
FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def n11_avg_price_per_product(spark, sf_dir):
    return rounded(qs.average_price_per_product(spark, sf_dir))


@register("n12_sales_by_category", """
SELECT p_type AS category, round(sum(l_extendedprice), 2) AS total_sales
FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def n12_sales_by_category(spark, sf_dir):
    r = fact_rollup(spark, sf_dir, "p_type")
    return rounded(r.select(F.col("label").alias("category"), F.col("total").alias("total_sales")))


@register("n13_category_by_channel", """
SELECT p_type AS category, o_orderpriority AS channel, round(sum(l_extendedprice), 2) AS total_sales
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey
GROUP BY 1, 2""")
def n13_category_by_channel(spark, sf_dir):
    return rounded(qs.category_by_channel(spark, sf_dir))


@register("n14_monthly_avg_order_value", """
SELECT CAST(date_trunc('month', TRY_CAST(o_orderdate AS DATE)) AS DATE) AS month,
       round(avg(l_extendedprice), 2) AS avg_order_value
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE TRY_CAST(o_orderdate AS DATE) IS NOT NULL GROUP BY 1""")
def n14_monthly_avg_order_value(spark, sf_dir):
    return rounded(qs.monthly_average_from_rollup(order_rollup(spark, sf_dir), "o_orderdate"))


@register("n15_best_month", f"""
SELECT month, round(total, 2) AS total FROM ({_MONTHLY_SQL}) ORDER BY total DESC, month LIMIT 1""")
def n15_best_month(spark, sf_dir):
    return rounded(qs.best_period(_monthly(spark, sf_dir)))


@register("h4_value_counts_orders", """
WITH t AS (SELECT count(*) AS n FROM orders),
l AS (SELECT 'o_orderstatus' AS column_name, o_orderstatus AS value FROM orders
      UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders
      UNION ALL SELECT 'o_custkey', CAST(o_custkey AS VARCHAR) FROM orders),
c AS (SELECT column_name, value, count(*) AS count FROM l WHERE value IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY count DESC, value) AS rank FROM c)
SELECT column_name, value, count, CAST(rank AS INTEGER) AS rank, round(count / (SELECT n FROM t) * 100, 2) AS pct
FROM r WHERE rank <= 10""")
def h4_value_counts_orders(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    return rounded(kpi.value_counts_top(o, ["o_orderstatus", "o_orderpriority", "o_custkey"], 10)
                   .withColumn("rank", F.col("rank").cast("int")))


@register("n_example_questions", """
WITH y AS (SELECT max(y) AS y2, min(y) AS y1, count(*) AS ny FROM (
             SELECT DISTINCT year(o_orderdate) AS y FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey
             WHERE year(o_orderdate) IS NOT NULL ORDER BY y DESC LIMIT 2)),
c AS (SELECT c_name FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey
      WHERE c_name IS NOT NULL GROUP BY c_name ORDER BY count(*) DESC, c_name LIMIT 1),
q AS (SELECT * FROM (VALUES
  (1, 'What is the total sales amount?'), (2, 'Show me the top 10 transactions by amount'),
  (3, 'What were the total sales in 2021?'), (4, 'Show me sales trend by month'), (5, 'Compare Q1 vs Q2 sales')) t(seq, question)
  UNION ALL SELECT 6, 'What is the year-over-year growth from ' || y1 || ' to ' || y2 || '?' FROM y WHERE ny >= 2
  UNION ALL SELECT 7, 'Show me all purchases by ' || c_name FROM c
  UNION ALL SELECT * FROM (VALUES (8, 'Who are the top 5 customers by sales amount?'),
    (9, 'How many unique customers do we have?'), (10, 'Which products generated the most revenue?'),
    (11, 'What is the average price per product style?'), (12, 'Show me sales breakdown by p_type'),
    (13, 'Compare p_type performance across different o_orderpriority'),
    (14, 'What is the monthly average order value trend?'), (15, 'Which month had the highest sales?')) t(seq, question))
SELECT CAST(row_number() OVER (ORDER BY seq) AS INTEGER) AS seq, question FROM q""")
def n_example_questions(spark, sf_dir):
    from tillpoint.plans.explore import example_questions
    from tillpoint.plans.sales_wide import SALES_WIDE_ROLES
    years = order_rollup(spark, sf_dir).select(F.year("o_orderdate").alias("y"))
    return example_questions(spark, SALES_WIDE_ROLES, years, fact_rollup(spark, sf_dir, "c_name", None), ["p_type", "o_orderpriority"])


@register("n17_insight_bundle", """
WITH o AS (SELECT * FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey
             LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
             LEFT JOIN region ON n_regionkey = r_regionkey),
m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS k, sum(l_extendedprice) AS t FROM o WHERE o_orderdate IS NOT NULL GROUP BY 1),
y AS (SELECT year(o_orderdate) AS k, sum(l_extendedprice) AS t FROM o WHERE o_orderdate IS NOT NULL GROUP BY 1)
SELECT 'kpis' AS part, 'total' AS label, round(sum(l_extendedprice), 2) AS value FROM lineitem
UNION ALL SELECT 'kpis', 'avg', round(avg(l_extendedprice), 2) FROM lineitem
UNION ALL SELECT 'kpis', 'count', CAST(count(*) AS DOUBLE) FROM lineitem
UNION ALL SELECT 'top_category', * FROM (SELECT p_type, round(sum(l_extendedprice), 2) AS v FROM o GROUP BY 1 ORDER BY v DESC, 1 LIMIT 10)
UNION ALL SELECT 'top_region', * FROM (SELECT r_name, round(sum(l_extendedprice), 2) AS v FROM o GROUP BY 1 ORDER BY v DESC, 1 LIMIT 10)
UNION ALL SELECT 'monthly_deltas', CAST(k AS VARCHAR), round(t, 2) FROM m
UNION ALL SELECT 'yoy', CAST(k AS VARCHAR), round(t, 2) FROM y""")
def n17_insight_bundle(spark, sf_dir):
    """The bundle's parts as one long table."""
    b = qs.insight_bundle(spark, sf_dir)
    part = lambda name, df, label, value: df.select(
        F.lit(name).alias("part"), F.col(label).cast("string").alias("label"), F.col(value).cast("double").alias("value"))
    kpis = b["kpis"].select(F.explode(F.array(*(F.struct(F.lit(c).alias("label"), F.col(c).cast("double").alias("value"))
                                                for c in ("total", "avg", "count")))).alias("s")).select("s.*")
    out = part("kpis", kpis, "label", "value")
    for name, label in (("top_category", "label"), ("top_region", "label"), ("monthly_deltas", "month"), ("yoy", "year")):
        out = out.union(part(name, b[name], label, "total"))
    return rounded(out)
