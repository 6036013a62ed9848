"""The questions the explorer suggests, as DataFrame jobs over a sales
table with known roles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpoint.functions.dates import safe_date
from tillpoint.operators import kpi
from tillpoint.plans.sales_wide import fact_rollup, order_rollup
from tillpoint.sources.tables import load


def total_sales(df: DataFrame, amount: str) -> DataFrame:
    """N1."""
    return df.agg(F.sum(amount).alias("total_sales"))


def top_transactions(df: DataFrame, amount: str, n: int = 10, tie_break=()) -> DataFrame:
    """The ``n`` largest rows by amount; ``tie_break`` makes the order total."""
    return df.orderBy(F.col(amount).desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in tie_break]).limit(n)


def sales_in_year(df: DataFrame, date: str, amount: str, year: int) -> DataFrame:
    """Total in one calendar year (the filter reaches the scan as a range)."""
    return df.where(F.year(F.col(date)) == year).agg(F.sum(amount).alias("total_sales"))


def quarter_compare(df: DataFrame, date: str, amount: str, qa: int = 1, qb: int = 2) -> DataFrame:
    """Per year the totals of two quarters side by side (conditional sums)."""
    q = F.quarter(F.col(date))
    return (df.where(F.col(date).isNotNull()).groupBy(F.year(F.col(date)).alias("year"))
              .agg(F.coalesce(F.sum(F.when(q == qa, F.col(amount))), F.lit(0.0)).alias(f"q{qa}_sales"),
                   F.coalesce(F.sum(F.when(q == qb, F.col(amount))), F.lit(0.0)).alias(f"q{qb}_sales")))


def purchases_of_top_customer(spark, sf_dir: str) -> DataFrame:
    """Every row of the customer with the most rows (ties -> smallest name).

    Rows are counted per order and customer key before any join (``fact_rollup``); the
    one name then picks its customer keys, those their orders, and those the line rows,
    so each table is read with a small key set on the other side."""
    top = (fact_rollup(spark, sf_dir, "c_name", None).where(F.col("label").isNotNull())
           .orderBy(F.col("n").desc(), F.col("label")).limit(1).select(F.col("label").alias("c_name")))
    keys = load(spark, sf_dir, "customer").select("c_custkey", "c_name").join(top, "c_name")
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(keys, F.col("o_custkey") == F.col("c_custkey"))
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return (lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .select("c_name", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"))


def average_price_per_product(spark, sf_dir: str) -> DataFrame:
    """Mean retail price over the rows of each brand; rows are counted per part first."""
    by_part = load(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    part = load(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice")
    priced = by_part.join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
    known = F.when(F.col("p_retailprice").isNotNull(), F.col("n"))
    return priced.groupBy(F.col("p_brand").alias("product")).agg(
        F.try_divide(F.sum(F.col("p_retailprice") * F.col("n")), F.sum(known)).alias("avg_price"))


def category_by_channel(spark, sf_dir: str) -> DataFrame:
    """Totals per category and channel.  Lines are shuffled once, to their orders (a
    sum per order and part first would hardly be fewer rows, and would be dealt by other
    keys); amounts are summed per part and channel in the join's tasks, before the part join, so
    a part with a third of the rows is a few rows there."""
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.col("l_extendedprice").alias("t"))
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    by = (lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")
          .groupBy("l_partkey", "o_orderpriority").agg(F.sum("t").alias("t")))
    part = load(spark, sf_dir, "part").select("p_partkey", "p_type")
    return (by.join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
            .groupBy(F.col("p_type").alias("category"), F.col("o_orderpriority").alias("channel"))
            .agg(F.sum("t").alias("total_sales")))


def yearly_from_rollup(orl: DataFrame, date: str = "o_orderdate") -> DataFrame:
    """H5 on per-order pre-aggregates: sums of sums and counts, mean = sum / count."""
    y = F.year(F.col(date))
    return (orl.where(y.isNotNull()).groupBy(y.alias("year"))
               .agg(F.sum("line_total").alias("total_amount"),
                    F.sum("line_amounts").alias("transactions"),
                    F.try_divide(F.sum("line_total"), F.sum("line_amounts")).alias("avg_amount")))


def monthly_average_from_rollup(orl: DataFrame, date: str = "o_orderdate") -> DataFrame:
    """Monthly average order value from per-order pre-aggregates."""
    d = safe_date(date)
    return (orl.where(d.isNotNull()).groupBy(F.trunc(d, "MM").alias("month"))
               .agg(F.try_divide(F.sum("line_total"), F.sum("line_amounts")).alias("avg_order_value")))


def best_period(periodic: DataFrame, period: str = "month", total: str = "total") -> DataFrame:
    """The period with the highest total (ties -> earliest)."""
    return periodic.orderBy(F.col(total).desc_nulls_last(), F.col(period)).limit(1)


def insight_bundle(spark, sf_dir: str, category: str = "p_type", region: str = "r_name") -> dict[str, DataFrame]:
    """KPIs, top category / region, monthly trend deltas and YoY together, each on
    the rollups of the star view: no view is built or persisted."""
    orl = order_rollup(spark, sf_dir)
    lines = load(spark, sf_dir, "lineitem")
    top = lambda dim: (fact_rollup(spark, sf_dir, dim).select("label", "total")
                       .orderBy(F.col("total").desc_nulls_last(), F.col("label").asc_nulls_last()).limit(10))
    d = safe_date("o_orderdate")
    monthly = (orl.where(d.isNotNull()).groupBy(F.trunc(d, "MM").alias("month")).agg(F.sum("line_total").alias("total")))
    yearly = yearly_from_rollup(orl).select("year", F.col("total_amount").alias("total"))
    return {"kpis": lines.agg(F.sum("l_extendedprice").alias("total"), F.avg("l_extendedprice").alias("avg"),
                              F.count(F.lit(1)).alias("count")),
            "top_category": top(category), "top_region": top(region),
            "monthly_deltas": kpi.period_deltas(monthly), "yoy": kpi.period_deltas(yearly, "year")}
