"""Row-level validation flags and their issue counts.

Flags are ``false`` (never null) when an input is null, as pandas compares NaN
as false.  "Now" is the ``as_of`` parameter so results are reproducible.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillpoint.functions import text as T
from tillpoint.functions.dates import time_dimensions

FLAG_ORDER = ("flag_negative_qty", "flag_negative_rate", "flag_amount_mismatch", "flag_amount_outlier",
              "flag_future_date", "flag_invalid_date", "flag_invalid_customer")


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def _false(e: Column) -> Column:
    return F.coalesce(e, F.lit(False))


def as_of_col(as_of) -> Column:
    return F.current_timestamp().cast("timestamp_ntz") if as_of is None else F.lit(as_of).cast("timestamp_ntz")


def flag_exprs(roles, bounds=None, date_col: str | None = None, as_of=None) -> dict[str, Column]:
    """The flag expressions that apply to the given roles."""
    out: dict[str, Column] = {}
    if roles.quantity:
        out["flag_negative_qty"] = _false(_q(roles.quantity) < 0)
    if roles.rate:
        out["flag_negative_rate"] = _false(_q(roles.rate) < 0)
    if roles.quantity and roles.rate and roles.amount:
        out["flag_amount_mismatch"] = _false(
            F.abs(_q(roles.quantity) * _q(roles.rate) - _q(roles.amount)) > 1.0)
    if roles.amount:
        if bounds is None or bounds[0] is None:
            out["flag_amount_outlier"] = F.lit(False)
        else:
            q1, q3 = bounds
            iqr = q3 - q1
            a = _q(roles.amount)
            out["flag_amount_outlier"] = _false((a < q1 - 3 * iqr) | (a > q3 + 3 * iqr))
    if date_col:
        now = as_of_col(as_of)
        out["flag_future_date"] = _false(_q(date_col) > now)
        out["flag_invalid_date"] = _false(F.year(_q(date_col)) > F.year(now) + 1)
    if roles.customer:
        out["flag_invalid_customer"] = _false(_q(roles.customer).rlike(T.MONTH_LABEL))
    return out


def add_flags(df: DataFrame, roles, bounds=None, date_col: str | None = None, as_of=None,
              time_dims: bool = True) -> tuple[DataFrame, list[str]]:
    """Add the flags, null implausible-year dates (E7), recompute the
    time dimensions from the cleaned date, and OR the flags into
    ``has_quality_issues``."""
    flags = flag_exprs(roles, bounds, date_col, as_of)
    names = [f for f in FLAG_ORDER if f in flags]
    df = df.select("*", *[flags[n].alias(n) for n in names])
    if date_col:
        df = df.withColumn(date_col, F.when(~F.col("flag_invalid_date"), _q(date_col)))
        if time_dims:
            df = df.withColumns(time_dimensions(_q(date_col)))
    if names:
        df = df.withColumn("has_quality_issues", reduce(lambda a, b: a | b, [F.col(n) for n in names]))
    return df, names


@dataclass(frozen=True)
class IssueSpec:
    """One candidate quality issue: the rows for which ``when`` is true are counted,
    reported with ``template`` (``{n}`` is the count) when there are any."""

    seq: int
    type: str
    severity: str
    when: Column
    template: str


def validation_issue_specs(roles, date_col, as_of, start_seq: int = 100) -> list[IssueSpec]:
    """E1-E8 counts over a frame that already has the flags (the date column
    still holds implausible years, i.e. before E7 nulls them)."""
    now = as_of_col(as_of)
    out = []
    s = start_seq
    if roles.quantity:
        out.append(IssueSpec(s, "Negative Values", "ERROR", F.col("flag_negative_qty"),
                             f"{roles.quantity}: {{n}} negative quantities"))
    if roles.rate:
        out.append(IssueSpec(s + 1, "Negative Values", "ERROR", F.col("flag_negative_rate"),
                             f"{roles.rate}: {{n}} negative rates"))
    if roles.quantity and roles.rate and roles.amount:
        out.append(IssueSpec(s + 2, "Business Logic", "WARNING", F.col("flag_amount_mismatch"),
                             "{n} rows where amount ≠ qty × rate (±1.0)"))
    if roles.amount:
        out.append(IssueSpec(s + 3, "Outliers", "INFO", F.col("flag_amount_outlier"),
                             f"{{n}} extreme outliers in {roles.amount}"))
    if date_col:
        out.append(IssueSpec(s + 4, "Date Range", "WARNING", F.col("flag_future_date"),
                             "{n} future dates found"))
        out.append(IssueSpec(s + 5, "Date Range", "INFO", _q(date_col) < F.add_months(now, -120),
                             "{n} dates older than 10 years"))
        out.append(IssueSpec(s + 6, "Date Range", "WARNING", F.col("flag_invalid_date"),
                             "{n} dates beyond year {max_year}"))
    if roles.customer:
        out.append(IssueSpec(s + 7, "Data Quality", "ERROR", F.col("flag_invalid_customer"),
                             "{n} customer entries are month names"))
    return out


def security_issue_specs(columns, start_seq: int = 200) -> list[IssueSpec]:
    """Per string column and SQL pattern, rows that match (data unchanged)."""
    out = []
    s = start_seq
    for c in columns:
        for _, pat in T.SQL_PATTERNS:
            out.append(IssueSpec(s, "Security", "WARNING", T.sql_pattern(_q(c), pat),
                                 f"{c}: {{n}} potential SQL patterns detected"))
            s += 1
    return out


def issue_rows(specs, counts: dict, **fmt) -> list[tuple]:
    """(seq, type, details, severity) for the specs whose observed count is > 0."""
    rows = []
    for sp in specs:
        n = counts.get(f"i{sp.seq}", 0) or 0
        if n > 0:
            rows.append((sp.seq, sp.type, sp.template.format(n=n, **fmt), sp.severity))
    return rows


ISSUE_SCHEMA = "seq int, type string, details string, severity string"


def sql_pattern_counts(df: DataFrame, columns) -> DataFrame:
    """C12 as a table: ``(column_name, pattern, matches)`` from one aggregate."""
    aggs, rows = [], []
    i = 0
    for c in columns:
        for name, pat in T.SQL_PATTERNS:
            aggs.append(F.count_if(T.sql_pattern(_q(c), pat)).alias(f"m{i}"))
            rows.append(f"'{c}', '{name}', m{i}")
            i += 1
    return df.agg(*aggs).selectExpr(f"stack({i}, {', '.join(rows)}) AS (column_name, pattern, matches)")


def sanitize(df: DataFrame, columns) -> DataFrame:
    """B13 + B14 on the given string columns (nulls stay null)."""
    cols = set(columns)
    return df.select(*[T.strip_control(T.strip_html(_q(c))).alias(c) if c in cols else _q(c)
                       for c in df.columns])
