"""X: the explorer's outputs as DataFrames – example questions built from the
data (A11 / N question list)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The explorer's question texts, in its order; {…} parts are
# filled from the data.
Q_TOTAL = "What is the total sales amount?"
Q_TOP10 = "Show me the top 10 transactions by amount"
Q_YEAR = "What were the total sales in 2021?"
Q_TREND = "Show me sales trend by month"
Q_Q1Q2 = "Compare Q1 vs Q2 sales"
Q_YOY = "What is the year-over-year growth from {y1} to {y2}?"
Q_CUSTOMER = "Show me all purchases by {customer}"
Q_TOP5 = "Who are the top 5 customers by sales amount?"
Q_UNIQUE = "How many unique customers do we have?"
Q_PRODUCTS = "Which products generated the most revenue?"
Q_AVG_PRICE = "What is the average price per product style?"
Q_BREAKDOWN = "Show me sales breakdown by {cat1}"
Q_COMPARE = "Compare {cat1} performance across different {cat2}"
Q_AOV = "What is the monthly average order value trend?"
Q_BEST_MONTH = "Which month had the highest sales?"


def example_questions(spark, roles, years: DataFrame | None = None, customers: DataFrame | None = None,
                      categorical=()) -> DataFrame:
    """``(seq, question)``.  ``years`` holds the years ``y`` of the date role and
    ``customers`` the rows ``n`` per customer ``label``, both as rollups: the two latest
    years and the most frequent non-null customer (ties -> smallest) are found there."""
    cols = {}
    if roles.date:
        last = years.where("y is not null").distinct().orderBy(F.col("y").desc()).limit(2)
        one = last.agg(F.max("y").alias("y2"), F.min("y").alias("y1"), F.count(F.lit(1)).alias("ny"))
        picked = one.select(F.struct("y2", "y1", "ny")).scalar()
        cols.update(y2=picked["y2"], y1=picked["y1"], ny=picked["ny"])
    if roles.customer:
        top = customers.where(F.col("label").isNotNull()).orderBy(F.col("n").desc(), F.col("label")).limit(1)
        cols["top_customer"] = top.select(F.max(F.col("label").cast("string"))).scalar()
    # one row whose values are scalar subqueries over the data (no join)
    facts = spark.range(1).select(*[v.alias(k) for k, v in cols.items()]) if cols else spark.range(1)
    qs = []
    if roles.amount:
        qs += [F.lit(Q_TOTAL), F.lit(Q_TOP10)]
    if roles.date:
        qs += [F.lit(Q_YEAR), F.lit(Q_TREND), F.lit(Q_Q1Q2),
               F.when(F.col("ny") >= 2, F.replace(F.replace(F.lit(Q_YOY), F.lit("{y1}"), F.col("y1").cast("string")),
                                                  F.lit("{y2}"), F.col("y2").cast("string")))]
    if roles.customer:
        qs += [F.when(F.col("top_customer").isNotNull(),
                      F.replace(F.lit(Q_CUSTOMER), F.lit("{customer}"), F.col("top_customer"))),
               F.lit(Q_TOP5), F.lit(Q_UNIQUE)]
    if roles.product:
        qs += [F.lit(Q_PRODUCTS), F.lit(Q_AVG_PRICE)]
    cats = list(categorical)
    if cats:
        qs.append(F.lit(Q_BREAKDOWN.format(cat1=cats[0])))
        if len(cats) > 1:
            qs.append(F.lit(Q_COMPARE.format(cat1=cats[0], cat2=cats[1])))
    if roles.amount and roles.date:
        qs += [F.lit(Q_AOV), F.lit(Q_BEST_MONTH)]
    out = facts.select(F.posexplode(F.array(*qs)).alias("pos", "question")).where(F.col("question").isNotNull())
    # one row of facts -> at most 15 questions: numbering them in one partition is bounded
    return out.select((F.row_number().over(Window.orderBy("pos"))).cast("int").alias("seq"), "question")
