"""KPI block: ungrouped totals, monthly trend and delta, top-N by dimension,
yearly and quarterly rollups (G1-G4, G6, G7, G11, H1-H3, H5-H8, I1, I2, C6, C8).

All metrics that share a scan are fused into one ``agg`` (the reference runs one
query per metric).  Windows without a partition key run only on month- or
year-level aggregates, whose size is bounded by the calendar, never on rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillpoint.functions.dates import safe_date


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def kpi_totals(df: DataFrame, amount: str | None = None, quantity: str | None = None,
               date: str | None = None) -> DataFrame:
    """G1-G4 in one scan: row_count, total_sales, avg_order, total_units,
    min_date, max_date (dates are ``TRY_CAST(.. AS DATE)``, nulls ignored)."""
    aggs = [F.count(F.lit(1)).alias("row_count")]
    if amount:
        aggs += [F.sum(amount).alias("total_sales"), F.avg(amount).alias("avg_order")]
    if quantity:
        aggs.append(F.sum(quantity).alias("total_units"))
    if date:
        d = safe_date(date)
        aggs += [F.min(d).alias("min_date"), F.max(d).alias("max_date")]
    return df.agg(*aggs)


def business_metrics(df: DataFrame, amount: str) -> DataFrame:
    """Total, mean, median, max, min of the amount.  The median is exact
    and comes from the distributed rank search (Spark's ``median`` would merge
    a value map of the whole column in one task)."""
    from tillpoint.operators.quantiles import exact_quantiles
    a = F.col(amount)
    med = exact_quantiles(df, amount, [0.5])[0]
    return df.agg(F.sum(a).alias("total_sales"), F.avg(a).alias("avg_transaction"),
                  F.lit(med).cast("double").alias("median_transaction"), F.max(a).alias("max_transaction"),
                  F.min(a).alias("min_transaction"))


def unique_count(df: DataFrame, column: str, exclude_flag: str | None = None) -> DataFrame:
    """Distinct non-null values, optionally skipping rows where a flag is true."""
    if exclude_flag:
        df = df.where(~F.coalesce(F.col(exclude_flag), F.lit(False)))
    return df.agg(F.count_distinct(column).alias("unique_customers"))


def numeric_totals(df: DataFrame, amount: str | None, quantity: str | None) -> DataFrame:
    """Explorer totals after numeric coercion of text columns."""
    aggs = []
    if amount:
        a = _c(amount).try_cast("double")
        aggs += [F.sum(a).alias("total_amount"), F.avg(a).alias("avg_amount")]
    if quantity:
        aggs.append(F.sum(_c(quantity).try_cast("double")).alias("total_units"))
    return df.agg(*aggs)


def monthly_totals(df: DataFrame, date: str, amount: str) -> DataFrame:
    """H2 (+C6): ``(month, total)`` with month = first day of the month of
    ``TRY_CAST(date AS DATE)``, rows without a date left out, ascending."""
    d = safe_date(date)
    return (df.where(d.isNotNull())
              .groupBy(F.trunc(d, "MM").alias("month"))
              .agg(F.sum(amount).alias("total"))
              .orderBy("month"))


def period_deltas(periodic: DataFrame, period: str = "month", total: str = "total") -> DataFrame:
    """I1/I2 series form: previous *present* period's total, delta and delta %.

    delta (and delta %) are null when there is no previous period or its total
    is 0 or null.  The window has no partition key on purpose: it runs on a
    period-level aggregate (one row per month / year).
    """
    w = Window.orderBy(period)
    prev = F.lag(total).over(w)
    ok = prev.isNotNull() & (prev != 0)
    return (periodic
            .withColumn("prev_total", prev)
            .withColumn("delta", F.when(ok, F.col(total) - F.col("prev_total")))
            .withColumn("delta_pct", F.when(ok, F.try_divide(F.col("delta"), F.col("prev_total")) * 100)))


def last_period_delta(periodic: DataFrame, period: str = "month", total: str = "total") -> DataFrame:
    """The last period with the previous present one, its delta and delta %."""
    return period_deltas(periodic, period, total).orderBy(F.col(period).desc()).limit(1)


def last_n_periods(periodic: DataFrame, n: int = 12, period: str = "month") -> DataFrame:
    """H3: the latest ``n`` periods (a top-k, planned as TakeOrderedAndProject)."""
    return periodic.orderBy(F.col(period).desc()).limit(n)


def top_dimension(df: DataFrame, dim: str, amount: str | None = None, limit: int = 10) -> DataFrame:
    """H1: ``(label, total)`` per value of ``dim`` – ``SUM(amount)``, or
    ``COUNT(*)`` without an amount – largest first, the null group kept, ties
    broken by label.  Partial aggregation runs map-side, so a hot value costs
    one row per map task in the shuffle."""
    agg = F.sum(amount) if amount else F.count(F.lit(1))
    return (df.groupBy(F.col(dim).alias("label")).agg(agg.alias("total"))
              .orderBy(F.col("total").desc_nulls_last(), F.col("label").asc_nulls_last())
              .limit(limit))


def top_of_rollup(rollup: DataFrame, limit: int = 10, total: str = "total") -> DataFrame:
    """Top-k over an already aggregated ``(label, total)`` frame."""
    return (rollup.select("label", total)
                  .orderBy(F.col(total).desc_nulls_last(), F.col("label").asc_nulls_last())
                  .limit(limit))


def yearly_summary(df: DataFrame, date_col: Column | str, amount: str) -> DataFrame:
    """H5: per year ``total_amount``, ``transactions`` (non-null amounts) and
    ``avg_amount``; rows without a year are left out (pandas drops NaN keys)."""
    y = F.year(_c(date_col))
    a = _c(amount).try_cast("double")
    return (df.where(y.isNotNull()).groupBy(y.alias("year"))
              .agg(F.sum(a).alias("total_amount"), F.count(a).alias("transactions"),
                   F.avg(a).alias("avg_amount")))


def quarterly_recent_year(df: DataFrame, date_col: Column | str, amount: str) -> DataFrame:
    """H6: per quarter ``total_amount`` and ``transactions`` in the latest year.

    One pass: the few (year, quarter) groups are formed once and the latest year is
    chosen among them."""
    a = _c(amount).try_cast("double")
    groups = (df.where(_c(date_col).isNotNull())
              .groupBy(F.year(_c(date_col)).alias("year"), F.quarter(_c(date_col)).alias("quarter"))
              .agg(F.sum(a).alias("total_amount"), F.count(a).alias("transactions")))
    return _latest_year(groups)


def quarterly_from_rollup(orl: DataFrame, date: str = "o_orderdate") -> DataFrame:
    """H6 on per-order pre-aggregates."""
    d = F.col(date)
    groups = (orl.where(d.isNotNull()).groupBy(F.year(d).alias("year"), F.quarter(d).alias("quarter"))
              .agg(F.sum("line_total").alias("total_amount"), F.sum("line_amounts").alias("transactions")))
    return _latest_year(groups)


def _latest_year(groups: DataFrame) -> DataFrame:
    """The rows of the latest year of a (year, quarter) table, which is small."""
    w = Window.orderBy(F.col("year").desc())
    return groups.withColumn("_r", F.rank().over(w)).where("_r = 1").drop("_r", "year")


def facts_top(df: DataFrame, dim: str, metric: str, limit: int = 10) -> DataFrame:
    """H7: top contributors of one dimension for the facts summary; the null
    value is its own group and an all-null group sums to 0 (pandas semantics)."""
    return (df.groupBy(F.col(dim).alias("value"))
              .agg(F.coalesce(F.sum(metric), F.lit(0)).cast("double").alias(f"sum_{metric}"))
              .orderBy(F.col(f"sum_{metric}").desc(), F.col("value").asc_nulls_last())
              .limit(limit))


def sample_rows(df: DataFrame, order_by, n: int = 3) -> DataFrame:
    """H8: ``n`` sample rows in an explicit order (the reference's LIMIT has none)."""
    cols = [order_by] if isinstance(order_by, (str, Column)) else list(order_by)
    return df.orderBy(*[_c(c).asc_nulls_last() for c in cols]).limit(n)


def value_counts_top(df: DataFrame, columns, k: int = 10) -> DataFrame:
    """H4: per column, the ``k`` most frequent values with their count and %
    of ALL rows (nulls left out of the groups, kept in the denominator); ties
    by value.  One unpivot to ``(column, value)``, one grouped count (partial
    aggregation), and ``row_number() <= k`` planned as a partial
    WindowGroupLimit – no column is gathered into one task."""
    cols = list(columns)
    total = df.select(F.count(F.lit(1))).scalar()
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in cols]))
        .alias("x")).select("x.*").where(F.col("value").isNotNull())
    counts = long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy("column_name").orderBy(F.col("count").desc(), F.col("value"))
    return (counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
                  .withColumn("pct", F.try_divide(F.col("count"), total) * 100))
