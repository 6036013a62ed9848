"""Date-format choice (B7, B8): one aggregate pass measures every candidate
format, the driver picks from those few numbers, a projection parses."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillpoint.functions.dates import (AUTO_DAYFIRST_PATTERNS, AUTO_PATTERNS, CLEAN_DATE_FORMATS,
                                       EXPLORE_DATE_FORMATS, parse_any, parse_with)


@dataclass(frozen=True)
class DateChoice:
    format: str            # strftime name, "auto_dayfirst" or "auto"
    stats: DataFrame       # per candidate: idx, format, success_rate, distinct_months, span_days
    expr: Column           # parse expression for the chosen format


def _candidate_exprs(col: str, with_dayfirst: bool):
    cands = [(f, parse_with(col, p)) for f, p in CLEAN_DATE_FORMATS]
    if with_dayfirst:
        cands.append(("auto_dayfirst", parse_any(col, AUTO_DAYFIRST_PATTERNS)))
    return cands


def format_stats(df: DataFrame, col: str, candidates) -> DataFrame:
    """Per candidate: success rate over ALL rows (nulls in the denominator),
    distinct parsed months, and span in days.

    The text is first reduced to its distinct values with their row counts (a
    partial aggregate: dates repeat, so this is small) and every candidate
    parses each distinct value once; the rates are count-weighted.  Distinct
    months are a ``collect_set`` of month starts, bounded by the calendar."""
    vals = df.groupBy(F.col(f"`{col}`").alias(col)).agg(F.count(F.lit(1)).alias("_w"))
    aggs = [F.sum("_w").alias("n")]
    for i, (_, e) in enumerate(candidates):
        aggs += [F.sum(F.when(e.isNotNull(), F.col("_w")).otherwise(0)).alias(f"ok{i}"),
                 F.size(F.collect_set(F.trunc(e, "MM"))).alias(f"m{i}"),
                 F.datediff(F.max(e), F.min(e)).alias(f"s{i}")]
    wide = vals.agg(*aggs)
    rows = ", ".join(f"{i}, '{f}', ok{i} / n, m{i}, s{i}" for i, (f, _) in enumerate(candidates))
    return wide.selectExpr(
        f"stack({len(candidates)}, {rows}) AS (idx, format, success_rate, distinct_months, span_days)"
    ).selectExpr("CAST(idx AS INT) AS idx", "format", "CAST(success_rate AS DOUBLE) AS success_rate",
                 "CAST(distinct_months AS INT) AS distinct_months",
                 "CAST(coalesce(span_days, 0) AS INT) AS span_days")


def choose_date_format(df: DataFrame, col: str) -> DateChoice:
    """Keep candidates with success >= 0.9; best by (success, distinct
    months, span); ties -> earliest candidate.  None qualifies -> "auto"."""
    cands = _candidate_exprs(col, True)
    stats = format_stats(df, col, cands)
    rows = stats.where("success_rate >= 0.9").orderBy(
        F.col("success_rate").desc(), F.col("distinct_months").desc(), F.col("span_days").desc(),
        F.col("idx")).limit(1).collect()
    if rows:
        i = rows[0]["idx"]
        return DateChoice(cands[i][0], stats, cands[i][1])
    return DateChoice("auto", stats, parse_any(col, AUTO_PATTERNS))


def detect_date_format(df: DataFrame, col: str) -> DateChoice:
    """B8 (explorer): the first of five formats with success > 0.9 wins, else auto."""
    cands = [(f, parse_with(col, p)) for f, p in EXPLORE_DATE_FORMATS]
    stats = format_stats(df, col, cands)
    rows = stats.where("success_rate > 0.9").orderBy("idx").limit(1).collect()
    if rows:
        i = rows[0]["idx"]
        return DateChoice(cands[i][0], stats, cands[i][1])
    return DateChoice("auto", stats, parse_any(col, AUTO_PATTERNS))


def parse_by_value(df: DataFrame, col: str, expr: Column, out: str, keys_from: DataFrame | None = None,
                   derived=None) -> DataFrame:
    """``df`` with ``out = expr`` (a parse of ``col``), computed once per
    distinct text instead of once per row; so are the columns that ``derived``
    gives by name for the column ``out``.

    Date texts repeat (they are bounded by the calendar and a few formats), and
    a multi-pattern parse costs several regexes per row.  The distinct texts
    (of ``keys_from``, default ``df``) are parsed, written to the shared
    checkpoint folder and joined on the text; Spark broadcasts them while they are
    under its threshold.  Null texts parse to null."""
    from tillpoint.session import materialize

    c = F.col(f"`{col}`")
    src = keys_from if keys_from is not None else df
    keys = src.select(c.alias(col)).where(c.isNotNull()).distinct()
    parsed = keys.select(c.alias("_date_text"), expr.alias(out))
    mapping = materialize(parsed.withColumns(derived(F.col(f"`{out}`"))) if derived else parsed, "date-map")
    new = [x for x in mapping.columns if x != "_date_text"]
    joined = df.drop(*new).join(mapping, c == F.col("_date_text"), "left")
    # like withColumn: an existing column is replaced in place, a new one appended
    return joined.select(*[F.col(f"`{x}`") for x in [*df.columns, *(n for n in new if n not in df.columns)]])
