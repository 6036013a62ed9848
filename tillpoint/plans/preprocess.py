"""P: the seven-step cleaning job as one Spark plan with few, small actions.

ingest -> clean (B1, B2, B4, B5, C1, B3, C2, C3) -> de-duplicate (D1) ->
normalize (J11a, B6, B7+B9, B10, B11) -> validate (E1-E9) -> sanitize (C12, B13,
B14) -> summarize (E10, G12).

Passes over the data:

1. source -> clean -> de-duplicate, written to the shared checkpoint folder
   (``materialize``).  The C1/C2/C3 row counts and the per-column non-null
   counts of B3 are *observed* during that write, not computed by a scan of
   their own.
2. date-format statistics over the distinct date texts (B7, small).
3. exact amount quartiles and median (distributed rank search on one column).
4. normalize -> validate -> sanitize, written once more.  What a row is counted for
   (conversion, flag, SQL pattern, missing value) is written with it as bits of a few
   numbers (``marked``); the totals of the summary are observed during that write.
5. the rows per set of marks (``tally``) and the distinct customers of the written
   result (G7 part of G12).

The issue list and the summary are built from those numbers.  The row counts observed
within pass 4 also end a generated method each: all its steps in one would be more byte
code than the JVM compiles (8,000 bytes a method), and would run interpreted.

Deliberate deviations, all documented: null tokens and whitespace are handled
before C1/B3 (pandas' CSV reader had already turned the tokens into NaN); the
output schema is fixed (every flag whose role exists is present, see
``drop_empty_flags``); nulls stay null through the sanitize step; a source
column whose name clashes with a derived time column is renamed ``<name>_src``.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tillpoint.functions import text as T
from tillpoint.functions.dates import time_dimensions
from tillpoint.operators import clean as C
from tillpoint.operators import validate as V
from tillpoint.operators.dates import choose_date_format, parse_by_value
from tillpoint.operators.quantiles import exact_quantiles
from tillpoint.operators.roles import roles_of
from tillpoint.plans.sales_wide import Roles
from tillpoint.session import discard, materialize

NUMERIC_NAME_TOKENS = ("rate", "price", "amount", "amt", "gross", "total")
TIME_COLUMNS = ("year", "quarter", "month", "month_name", "day_of_week", "week_of_year")


#: Conditions that share one column of marks.
MARKS = 16


@dataclass
class Preprocessed:
    data: DataFrame            # cleaned rows (read back from the checkpoint folder)
    issues: DataFrame          # seq, type, details, severity
    summary: DataFrame         # one row
    header_rows: DataFrame     # up to 3 header-like rows, as found
    roles: Roles
    date_format: str | None
    date_stats: DataFrame | None
    flags: list


def _q(c: str):
    return F.col(f"`{c}`")


def _bit(i: int):
    return F.lit(1 << i).cast("bigint")


def marked(df: DataFrame, conds: dict, name: str, apart: bool = False) -> tuple[DataFrame, dict]:
    """``df`` with one bit per condition (null is false), ``MARKS`` bits a column, and the
    column and bit number of each condition's key; with ``apart`` each column of marks is
    made in a generated method of its own."""
    keys, where = list(conds), {}
    for at in range(0, len(keys), MARKS):
        part, col = keys[at:at + MARKS], f"{name}{at // MARKS}"
        where.update({k: (col, i) for i, k in enumerate(part)})
        bits = [F.when(conds[k], _bit(i)).otherwise(F.lit(0).cast("bigint")) for i, k in enumerate(part)]
        df = df.select("*", reduce(lambda a, b: a.bitwiseOR(b), bits).alias(col))
        if apart:
            df = df.observe(Observation(col), F.count(F.lit(1)).alias("rows"))
    return df, where


def tally(df: DataFrame, where: dict) -> dict:
    """Rows per key of ``marked``, from the rows of each set of marks."""
    if not where:
        return {}
    sets = df.groupBy(*sorted({c for c, _ in where.values()})).agg(F.count(F.lit(1)).alias("_n"))
    return sets.agg(*[F.coalesce(F.sum(F.when(F.col(c).bitwiseAND(_bit(i)) != 0, F.col("_n"))), F.lit(0)).alias(k)
                      for k, (c, i) in where.items()]).first().asDict()


def preprocess(df: DataFrame, roles: Roles | None = None, as_of=None, index_col: str = "INDEX",
               size_col: str | None = None, drop_empty_flags: bool = False) -> Preprocessed:
    spark = df.sparkSession
    # ---- 2. clean ----------------------------------------------------------
    df = C.drop_unnamed(C.clean_headers(df))
    strings = set(C.string_columns(df))
    df = C.trim_and_standardize(df)
    empty = C.all_null(df)
    junk = C.junk_index(index_col) if index_col in strings else F.lit(False)
    head = C.header_like(df)
    header_rows = df.where(~empty & ~junk & head).orderBy(*[_q(c).asc_nulls_last() for c in df.columns]).limit(3)

    # ---- 3. de-duplicate (pass 1, materialized) ----------------------------
    # Exact duplicates are one group of the all-column aggregate (what
    # dropDuplicates plans, plus the multiplicity ``_n``).  The cleaning counts
    # are observed on the groups, weighted by ``_n``: the observation then runs
    # in the write's result stage, whose accumulator updates Spark applies once
    # per partition even when lost shuffle output makes a map stage run again.
    # The flags are functions of the row, so copies share them, and filtering
    # before or after the de-duplication keeps the same rows.
    # the three flags are computed once per row on the map side (before the partial
    # aggregate) and ride along as grouping keys: they are functions of the row
    flagged = df.select("*", empty.alias("_empty"), (~empty & junk).alias("_junk"),
                        (~empty & ~junk & head).alias("_head"))
    groups = flagged.groupBy(*[_q(c) for c in flagged.columns]).agg(F.count(F.lit(1)).alias("_n"))
    n_w = F.col("_n")

    def _wsum(cond, name):
        return F.coalesce(F.sum(F.when(cond, n_w)), F.lit(0)).alias(name)

    obs_clean = Observation("clean")
    observed = groups.observe(obs_clean, _wsum(F.lit(True), "n"), _wsum(F.col("_empty"), "empty"),
                              _wsum(F.col("_junk"), "junk"), _wsum(F.col("_head"), "head"),
                              *[_wsum(_q(c).isNotNull(), f"c{i}") for i, c in enumerate(df.columns)])
    kept = observed.where(~F.col("_empty") & ~F.col("_junk") & ~F.col("_head"))
    stage = materialize(kept.drop("_n", "_empty", "_junk", "_head"), "dedup")
    s1 = obs_clean.get
    empty_cols = [c for i, c in enumerate(df.columns) if s1[f"c{i}"] == 0]
    stage = stage.drop(*empty_cols)
    header_rows = header_rows.drop(*empty_cols)
    n_dedup = stage.count()
    n_dups = s1["n"] - s1["empty"] - s1["junk"] - s1["head"] - n_dedup

    # ---- 4. normalize ------------------------------------------------------
    roles = roles or roles_of(stage)
    if roles.date and roles.date in stage.columns:
        clash = {c for c in stage.columns if c.lower() in TIME_COLUMNS + ("date_parsed",)}
        if clash:
            ren = {c: c + "_src" for c in clash}
            stage = stage.toDF(*[ren.get(c, c) for c in stage.columns])
            roles = replace(roles, **{k: ren[v] for k, v in asdict(roles).items() if v in ren})
    types = dict(stage.dtypes)
    numeric = [c for c in (roles.quantity, roles.rate, roles.amount) if c and c in stage.columns]
    numeric += [c for c in stage.columns if c not in numeric and any(t in c.lower() for t in NUMERIC_NAME_TOKENS)]
    texts = [c for c in numeric if types[c] == "string"]
    work, given = marked(stage, {c: _q(c).isNotNull() for c in texts}, "_given")
    work = C.to_numeric_columns(work, numeric)
    conv_specs = [V.IssueSpec(50 + i, "Numeric Conversion", "WARNING",
                              (F.col(given[c][0]).bitwiseAND(_bit(given[c][1])) != 0) & _q(c).isNull(),
                              f"{c}: {{n}} values couldn't be converted") for i, c in enumerate(texts)]

    date_col, choice = None, None
    if roles.date and roles.date in stage.columns:
        choice = choose_date_format(stage, roles.date)
        date_col = "date_parsed"
        # parsed once per distinct text (keys read from the stage, so no observation fires early)
        work = parse_by_value(work, roles.date, choice.expr, date_col, keys_from=stage, derived=time_dimensions)
    if roles.customer and roles.customer in stage.columns:
        work = C.normalize_text_column(work, roles.customer)
    size = size_col or ("SIZE" if "SIZE" in stage.columns else roles.size)
    if size and size in stage.columns:
        work = C.normalize_size_column(work, size)

    # ---- 5. validate -------------------------------------------------------
    quart = None
    if roles.amount and roles.amount in stage.columns:
        amounts = stage.select(T.to_number(_q(roles.amount)).alias("a")) if types[roles.amount] == "string" \
            else stage.select(_q(roles.amount).cast("double").alias("a"))
        quart = exact_quantiles(amounts, "a", [0.25, 0.5, 0.75])
    work, flags = V.add_flags(work, roles, (quart[0], quart[2]) if quart else None, date_col, as_of, time_dims=False)
    val_specs = V.validation_issue_specs(roles, date_col, as_of)

    # ---- 6. sanitize -------------------------------------------------------
    str_cols = C.string_columns(work)
    sec_specs = V.security_issue_specs(str_cols)
    specs = conv_specs + val_specs + sec_specs
    work = work.observe(Observation("validate"), F.count(F.lit(1)).alias("rows"))
    work, where = marked(work, {f"i{sp.seq}": sp.when for sp in specs}, "_marks", apart=True)
    work = work.drop(*{c for c, _ in given.values()})
    if date_col:
        # E7 has nulled implausible dates: their time columns go too
        work = work.withColumns({c: F.when(~F.col("flag_invalid_date"), F.col(c)) for c in TIME_COLUMNS})
        order = [c for c in work.columns if c not in TIME_COLUMNS]
        at = order.index(date_col) + 1
        work = work.select(*[_q(c) for c in order[:at] + list(TIME_COLUMNS) + order[at:]])
    work = V.sanitize(work, str_cols)

    out_cols = [c for c in work.columns if c not in {m for m, _ in where.values()}]
    work, more = marked(work, {**{f"null{i}": _q(c).isNull() for i, c in enumerate(out_cols)},
                               **{f"flag{i}": F.col(f) for i, f in enumerate(flags)}}, "_found")
    where.update(more)
    sum_aggs = [F.count(F.lit(1)).alias("rows")]
    if date_col:
        sum_aggs += [F.min(date_col).alias("date_start"), F.max(date_col).alias("date_end")]
    if quart:
        a = _q(roles.amount)
        sum_aggs += [F.sum(a).alias("total_sales"), F.avg(a).alias("avg_transaction"),
                     F.max(a).alias("max_transaction"), F.min(a).alias("min_transaction")]
    obs_sum = Observation("summary")
    work = work.observe(obs_sum, *sum_aggs)

    # ---- pass 4: write the result once, with the marks that are counted after it ----
    written = materialize(work, "preprocessed")
    data = written.select(*[_q(c) for c in out_cols])
    # one row per date format; it reads the stage, so it is fetched before the stage goes
    date_stats = spark.createDataFrame(choice.stats.collect(), choice.stats.schema) if choice else None
    discard(work)      # the de-duplicated stage and the date map were read for the last time
    counts = tally(written, where)
    sv = {**obs_sum.get, **counts}

    if drop_empty_flags and flags:
        gone = [f for i, f in enumerate(flags) if sv[f"flag{i}"] == 0]
        flags = [f for f in flags if f not in gone]
        data = data.drop(*gone)
        data = data.drop("has_quality_issues") if not flags else \
            data.withColumn("has_quality_issues", F.greatest(*[F.col(f) for f in flags]))

    # ---- 7. issues and summary ---------------------------------------------
    now_year = (spark.range(1).select(F.year(V.as_of_col(as_of))).first()[0])
    rows = []
    if s1["empty"] > 0:
        rows.append((10, "Empty Rows", f"Removed {s1['empty']} completely empty rows", "INFO"))
    if s1["junk"] > 0:
        rows.append((20, "Data Quality", f"Found {s1['junk']} rows with text in INDEX column", "WARNING"))
    if n_dups > 0:
        rows.append((30, "Duplicates", f"Found {n_dups} exact duplicate records", "WARNING"))
    rows += V.issue_rows(specs, counts, max_year=now_year + 1)
    issues = spark.createDataFrame(rows, V.ISSUE_SCHEMA)

    summary = {"total_rows_processed": sv["rows"], "columns": len(data.columns)}
    if date_col:
        summary.update(date_start=sv["date_start"], date_end=sv["date_end"])
    if quart:
        summary.update(total_sales=sv["total_sales"], avg_transaction=sv["avg_transaction"],
                       median_transaction=quart[1], max_transaction=sv["max_transaction"],
                       min_transaction=sv["min_transaction"])
    types = {"total_rows_processed": "bigint", "columns": "int", "date_start": "timestamp_ntz",
             "date_end": "timestamp_ntz", "median_transaction": "double"}
    ddl = ", ".join(f"{k} {types.get(k, 'double')}" for k in summary)
    summary_df = spark.createDataFrame([tuple(summary.values())], ddl)
    if roles.customer and roles.customer in data.columns:
        keep = ~F.col("flag_invalid_customer") if "flag_invalid_customer" in data.columns else F.lit(True)
        uc = data.agg(F.count_distinct(F.when(keep, _q(roles.customer))))
        summary_df = summary_df.withColumn("unique_customers", uc.scalar())
    missing = {c: sv[f"null{i}"] for i, c in enumerate(out_cols) if c in data.columns}
    summary_df = summary_df.withColumn(
        "missing_values", F.create_map(*[x for k, v in missing.items() for x in (F.lit(k), F.lit(v))])
    ).withColumn("validation_flags", F.array(*[F.lit(f) for f in flags]).cast("array<string>"))
    return Preprocessed(data, issues, summary_df, header_rows, roles,
                        choice.format if choice else None, date_stats, flags)
