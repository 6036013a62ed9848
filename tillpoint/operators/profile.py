"""Column profiles: numeric min/max/avg, describe, null/unique counts, sample
values (G5, G8, G9, G10).

Profiles are computed as ONE aggregate pass over the table where possible and
returned in long form, one row per column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from tillpoint.functions.text import text_key
from tillpoint.operators.dedup import binary_string
from tillpoint.operators.quantiles import exact_quantiles_many, value_count
from tillpoint.session import spread


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def numeric_profile(df: DataFrame, columns=None) -> DataFrame:
    """``(column_name, min_val, max_val, avg_val)`` for every numeric
    column, all from a single aggregate, unpivoted with ``stack``."""
    cols = list(columns) if columns is not None else numeric_columns(df)
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.min(c).cast("double").alias(f"mn{i}"), F.max(c).cast("double").alias(f"mx{i}"),
                 F.avg(c).alias(f"av{i}")]
    wide = df.agg(*aggs)
    args = ", ".join(f"'{c}', mn{i}, mx{i}, av{i}" for i, c in enumerate(cols))
    return wide.selectExpr(f"stack({len(cols)}, {args}) AS (column_name, min_val, max_val, avg_val)")


def describe(df: DataFrame, columns=None) -> DataFrame:
    """Count, mean, std (sample), min, 25/50/75 % (exact, linear), max per
    numeric column.  Not ``DataFrame.summary()``: its quantiles are approximate
    and its values strings."""
    cols = list(columns) if columns is not None else numeric_columns(df)
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.count(c).alias(f"n{i}"), F.avg(c).alias(f"av{i}"), F.stddev_samp(c).alias(f"sd{i}"),
                 F.min(c).cast("double").alias(f"mn{i}"), F.max(c).cast("double").alias(f"mx{i}"),
                 value_count(c).alias(f"vc{i}")]
    # one pass gives the moments and the counts the quantile search starts from
    moments = df.agg(*aggs).first()
    quant = exact_quantiles_many(df, cols, [0.25, 0.5, 0.75],
                                 counts={c: moments[f"vc{i}"] for i, c in enumerate(cols)})
    vals = []
    for i, c in enumerate(cols):
        vals += [F.lit(moments[f"{k}{i}"]).cast(t).alias(f"{k}{i}")
                 for k, t in (("n", "bigint"), ("av", "double"), ("sd", "double"), ("mn", "double"), ("mx", "double"))]
        vals += [F.lit(q).cast("double").alias(f"q{j}_{i}") for j, q in enumerate(quant[c])]
    wide = df.sparkSession.range(1).select(*vals)
    rows = ", ".join(f"'{c}', n{i}, av{i}, sd{i}, mn{i}, q0_{i}, q1_{i}, q2_{i}, mx{i}" for i, c in enumerate(cols))
    return wide.selectExpr(f"stack({len(cols)}, {rows}) AS (column_name, count, mean, std, min, p25, p50, p75, max)")


def _kind(dt) -> str:
    if isinstance(dt, NumericType):
        return "numeric"
    if isinstance(dt, StringType):
        return "string"
    return "other"


def column_profile(df: DataFrame, table: str) -> DataFrame:
    """G9 (+ numeric min/max for J3): one row per column with ``table_name,
    column_name, ordinal, dtype, kind, n, null_count, null_pct, unique_count,
    unique_pct, min_num, max_num``.

    One aggregate computes every count.  The distinct counts are Spark's
    multi-distinct plan (Expand + two-level aggregation): each column's values
    are shuffled by value, so no column is gathered into one task.  Nulls are
    not a value (pandas ``nunique``).  Strings are counted through
    ``text_key``, so long texts are shuffled as digests."""
    df = spread(df)
    fields = df.schema.fields
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, f in enumerate(fields):
        c = F.col(f"`{f.name}`")
        u = text_key(c) if binary_string(f.dataType) else c
        aggs += [F.count(c).alias(f"nn{i}"), F.count_distinct(u).alias(f"u{i}")]
        if isinstance(f.dataType, NumericType):
            aggs += [F.min(c).cast("double").alias(f"mn{i}"), F.max(c).cast("double").alias(f"mx{i}")]
    wide = df.agg(*aggs)
    rows = []
    for i, f in enumerate(fields):
        num = isinstance(f.dataType, NumericType)
        rows.append(f"'{table}', '{f.name}', {i + 1}, '{f.dataType.simpleString()}', '{_kind(f.dataType)}', n, "
                    f"n - nn{i}, u{i}, {f'mn{i}' if num else 'CAST(NULL AS DOUBLE)'}, "
                    f"{f'mx{i}' if num else 'CAST(NULL AS DOUBLE)'}")
    out = wide.selectExpr(f"stack({len(fields)}, {', '.join(rows)}) AS "
                          "(table_name, column_name, ordinal, dtype, kind, n, null_count, unique_count, min_num, max_num)")
    return out.select("table_name", "column_name", F.col("ordinal").cast("int").alias("ordinal"), "dtype", "kind",
                      F.col("n").cast("bigint").alias("n"), F.col("null_count").cast("bigint").alias("null_count"),
                      (F.try_divide(F.col("null_count"), F.col("n")) * 100).alias("null_pct"),
                      F.col("unique_count").cast("bigint").alias("unique_count"),
                      (F.try_divide(F.col("unique_count"), F.col("n")) * 100).alias("unique_pct"),
                      "min_num", "max_num")


def sample_values(df: DataFrame, k: int = 5, order_by=None) -> DataFrame:
    """The first ``k`` non-null values per column, "first" by ``order_by``
    (default: the value itself), as ``(column_name, rank, value)``.  Planned as
    a partial ``WindowGroupLimit`` per column before the shuffle."""
    from pyspark.sql import Window
    order = list(order_by) if order_by else []
    fields = df.schema.fields
    vals = df.select(*[F.col(c) for c in order], F.explode(F.array(*[
        F.struct(F.lit(f.name).alias("column_name"), F.col(f"`{f.name}`").cast("string").alias("value"))
        for f in fields])).alias("x")).select(*order, "x.*").where(F.col("value").isNotNull())
    w = Window.partitionBy("column_name").orderBy(*([F.col(c) for c in order] or [F.col("value")]))
    return (vals.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
                .select("column_name", "rank", "value"))
