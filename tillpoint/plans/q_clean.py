"""Registered queries of the cleaning / validation block (P, B*, C*, D*, E*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillpoint.functions import text as T
from tillpoint.functions.dates import AUTO_DAYFIRST_FORMATS, CLEAN_DATE_FORMATS, EXPLORE_DATE_FORMATS, time_dimensions
from tillpoint.operators import clean as C
from tillpoint.operators import validate as V
from tillpoint.operators.dates import detect_date_format
from tillpoint.operators.dedup import deduplicate, duplicate_count
from tillpoint.operators.quantiles import exact_quantiles
from tillpoint.plans import sqltext as S
from tillpoint.plans.dirty_sales import dirty_sales, dirty_sales_sql_for_duckdb
from tillpoint.plans.preprocess import preprocess
from tillpoint.plans.registry import register, rounded
from tillpoint.sources.tables import load

AS_OF = "2026-01-01 00:00:00"


def _prep(spark, sf_dir):
    """The cleaning job over the derived sales table; each P query runs it."""
    return preprocess(dirty_sales(spark, sf_dir), as_of=AS_OF, index_col="IDX")


# ---------------------------------------------------------------- SQL twin --
_RAW = ["idx", "order_date_txt", "customer_txt", "size_txt", "qty_txt", "rate_txt", "amount_txt", "note_txt"]
_UP = [c.upper() for c in _RAW]


_VALUES = "[" + ", ".join(f"lower(trim(CAST({u} AS VARCHAR)))" for u in _UP) + "]"
_HEADS = (f"(coalesce(len(list_filter({_VALUES}, lambda v: v LIKE '%heads%')) > 0, false) AND "
          f"coalesce(len(list_filter({_VALUES}, lambda v: v LIKE '%price%')) > 0, false))")


def _date_candidates(x: str, formats) -> list[str]:
    return [S.strptime_guarded(x, f) for f, _ in formats]


def _auto_dayfirst(x: str) -> str:
    return "coalesce(" + ", ".join(S.strptime_guarded(x, f) for f, _ in AUTO_DAYFIRST_FORMATS) + ")"


def _prep_ctes() -> str:
    a_cols = ",\n  ".join(f"{S.null_tokens(S.collapse_ws(c))} AS {u}" for c, u in zip(_RAW, _UP))
    allnull = " AND ".join(f"{u} IS NULL" for u in _UP)
    heads = _HEADS
    cands = _date_candidates("ORDER_DATE_TXT", CLEAN_DATE_FORMATS) + [_auto_dayfirst("ORDER_DATE_TXT")]
    pcols = ",\n  ".join(f"{e} AS p{i}" for i, e in enumerate(cands))
    stats = "\n  UNION ALL ".join(
        f"SELECT {i} AS idx, count(p{i}) / count(*) AS s, count(DISTINCT date_trunc('month', p{i})) AS m, "
        f"coalesce(datediff('day', min(p{i}), max(p{i})), 0) AS span FROM p" for i in range(len(cands)))
    pick = " ".join(f"WHEN {i} THEN p{i}" for i in range(len(cands)))
    return f"""
ds AS ({dirty_sales_sql_for_duckdb()}),
a AS (SELECT
  {a_cols}
  FROM ds),
b AS (SELECT DISTINCT * FROM a
  WHERE NOT ({allnull})
    AND NOT coalesce(regexp_matches(IDX, '^[A-Z]{{2,}}'), false)
    AND NOT {heads}),
p AS (SELECT *,
  {pcols}
  FROM b),
st AS ({stats}),
ch AS (SELECT idx FROM st WHERE s >= 0.9 ORDER BY s DESC, m DESC, span DESC, idx LIMIT 1),
c AS (SELECT IDX, ORDER_DATE_TXT, CUSTOMER_TXT, SIZE_TXT,
  {S.to_number('QTY_TXT')} AS QTY_TXT, {S.to_number('RATE_TXT')} AS RATE_TXT,
  {S.to_number('AMOUNT_TXT')} AS AMOUNT_TXT, NOTE_TXT,
  CASE (SELECT idx FROM ch) {pick} END AS date_parsed
  FROM p),
q AS (SELECT quantile_cont(AMOUNT_TXT, 0.25) AS q1, quantile_cont(AMOUNT_TXT, 0.75) AS q3 FROM c),
f AS (SELECT c.*,
  coalesce(QTY_TXT < 0, false) AS flag_negative_qty,
  coalesce(RATE_TXT < 0, false) AS flag_negative_rate,
  coalesce(abs(QTY_TXT * RATE_TXT - AMOUNT_TXT) > 1.0, false) AS flag_amount_mismatch,
  coalesce(AMOUNT_TXT < q1 - 3 * (q3 - q1) OR AMOUNT_TXT > q3 + 3 * (q3 - q1), false) AS flag_amount_outlier,
  coalesce(date_parsed > TIMESTAMP '{AS_OF}', false) AS flag_future_date,
  coalesce(year(date_parsed) > year(TIMESTAMP '{AS_OF}') + 1, false) AS flag_invalid_date,
  coalesce(regexp_matches(CUSTOMER_TXT, {S.lit(T.MONTH_LABEL)}), false) AS flag_invalid_customer
  FROM c, q),
g AS (SELECT * REPLACE (CASE WHEN NOT flag_invalid_date THEN date_parsed END AS date_parsed) FROM f),
h AS (SELECT *,
  CAST(year(date_parsed) AS INTEGER) AS year, CAST(quarter(date_parsed) AS INTEGER) AS quarter,
  CAST(month(date_parsed) AS INTEGER) AS month, strftime(date_parsed, '%b-%y') AS month_name,
  CAST(isodow(date_parsed) - 1 AS INTEGER) AS day_of_week, CAST(week(date_parsed) AS INTEGER) AS week_of_year,
  {S.normalize_text('CUSTOMER_TXT')} AS CUSTOMER_TXT_normalized,
  {S.map_size('SIZE_TXT')} AS size_normalized,
  (flag_negative_qty OR flag_negative_rate OR flag_amount_mismatch OR flag_amount_outlier
   OR flag_future_date OR flag_invalid_date OR flag_invalid_customer) AS has_quality_issues
  FROM g)"""


_STRINGS = ["IDX", "ORDER_DATE_TXT", "CUSTOMER_TXT", "SIZE_TXT", "NOTE_TXT", "month_name",
            "CUSTOMER_TXT_normalized", "size_normalized"]
_FLAGS = ["flag_negative_qty", "flag_negative_rate", "flag_amount_mismatch", "flag_amount_outlier",
          "flag_future_date", "flag_invalid_date", "flag_invalid_customer"]
_OUT = ["IDX", "ORDER_DATE_TXT", "CUSTOMER_TXT", "SIZE_TXT", "QTY_TXT", "RATE_TXT", "AMOUNT_TXT", "NOTE_TXT",
        "date_parsed", "year", "quarter", "month", "month_name", "day_of_week", "week_of_year",
        "CUSTOMER_TXT_normalized", "size_normalized"] + _FLAGS + ["has_quality_issues"]


def _sanitized(c: str) -> str:
    if c in _STRINGS:
        return f"{S.strip_control(S.strip_html(c))} AS {c}"
    if c in ("QTY_TXT", "RATE_TXT", "AMOUNT_TXT"):
        return f"round({c}, 2) AS {c}"
    return c


_PREP_ROWS_SQL = "WITH " + _prep_ctes().lstrip() + "\nSELECT " + ", ".join(_sanitized(c) for c in _OUT) + " FROM h"


@register("p_preprocess_rows", _PREP_ROWS_SQL)
def p_preprocess_rows(spark, sf_dir):
    return rounded(_prep(spark, sf_dir).data)


def _issues_sql() -> str:
    parts = [
        ("10", "'Empty Rows'", "'INFO'", "(SELECT count(*) FROM a WHERE {allnull})", "'Removed ' || n || ' completely empty rows'"),
        ("20", "'Data Quality'", "'WARNING'", "(SELECT count(*) FROM a WHERE NOT ({allnull}) AND coalesce(regexp_matches(IDX, '^[A-Z]{{2,}}'), false))",
         "'Found ' || n || ' rows with text in INDEX column'"),
        ("30", "'Duplicates'", "'WARNING'",
         "(SELECT count(*) FROM a WHERE NOT ({allnull}) AND NOT coalesce(regexp_matches(IDX, '^[A-Z]{{2,}}'), false) AND NOT {heads}) - (SELECT count(*) FROM b)",
         "'Found ' || n || ' exact duplicate records'"),
    ]
    allnull = " AND ".join(f"{u} IS NULL" for u in _UP)
    rows = []
    for seq, kind, sev, n, det in parts:
        rows.append(f"SELECT {seq} AS seq, {kind} AS type, {det} AS details, {sev} AS severity, n FROM "
                    f"(SELECT {n.format(allnull=allnull, heads=_HEADS)} AS n)")
    for i, c in enumerate(["QTY_TXT", "RATE_TXT", "AMOUNT_TXT"]):
        rows.append(f"SELECT {50 + i}, 'Numeric Conversion', '{c}: ' || n || ' values couldn''t be converted', "
                    f"'WARNING', n FROM (SELECT count(*) AS n FROM b WHERE {c} IS NOT NULL AND ({S.to_number(c)}) IS NULL)")
    v = [
        (100, "'Negative Values'", "'QTY_TXT: ' || n || ' negative quantities'", "'ERROR'", "count_if(flag_negative_qty)"),
        (101, "'Negative Values'", "'RATE_TXT: ' || n || ' negative rates'", "'ERROR'", "count_if(flag_negative_rate)"),
        (102, "'Business Logic'", "n || ' rows where amount ≠ qty × rate (±1.0)'", "'WARNING'", "count_if(flag_amount_mismatch)"),
        (103, "'Outliers'", "n || ' extreme outliers in AMOUNT_TXT'", "'INFO'", "count_if(flag_amount_outlier)"),
        (104, "'Date Range'", "n || ' future dates found'", "'WARNING'", "count_if(flag_future_date)"),
        (105, "'Date Range'", "n || ' dates older than 10 years'", "'INFO'",
         f"count_if(date_parsed < TIMESTAMP '{AS_OF}' - INTERVAL 120 MONTH)"),
        (106, "'Date Range'", f"n || ' dates beyond year ' || (year(TIMESTAMP '{AS_OF}') + 1)", "'WARNING'",
         "count_if(flag_invalid_date)"),
        (107, "'Data Quality'", "n || ' customer entries are month names'", "'ERROR'", "count_if(flag_invalid_customer)"),
    ]
    for seq, kind, det, sev, n in v:
        rows.append(f"SELECT {seq}, {kind}, {det}, {sev}, n FROM (SELECT {n} AS n FROM h)")
    seq = 200
    for c in _STRINGS:
        for _, pat in T.SQL_PATTERNS:
            rows.append(f"SELECT {seq}, 'Security', '{c}: ' || n || ' potential SQL patterns detected', 'WARNING', n "
                        f"FROM (SELECT count_if({S.sql_pattern(c, pat)}) AS n FROM h)")
            seq += 1
    body = "\nUNION ALL ".join(rows)
    return "WITH " + _prep_ctes().lstrip() + f"\nSELECT seq, type, details, severity FROM ({body}) WHERE n > 0"


@register("p_quality_issues", _issues_sql())
def p_quality_issues(spark, sf_dir):
    return _prep(spark, sf_dir).issues


@register("b7_date_format_stats", "WITH " + _prep_ctes().lstrip() + """
SELECT CAST(idx AS INTEGER) AS idx, CASE idx """ + " ".join(
    f"WHEN {i} THEN {S.lit(f)}" for i, f in enumerate([f for f, _ in CLEAN_DATE_FORMATS] + ["auto_dayfirst"])) + """ END AS format,
  round(s, 2) AS success_rate, CAST(m AS INTEGER) AS distinct_months, CAST(span AS INTEGER) AS span_days FROM st""")
def b7_date_format_stats(spark, sf_dir):
    return rounded(_prep(spark, sf_dir).date_stats)


@register("p_summary", "WITH " + _prep_ctes().lstrip() + """
SELECT count(*) AS total_rows_processed, 25 AS columns, min(date_parsed) AS date_start, max(date_parsed) AS date_end,
  round(sum(AMOUNT_TXT), 2) AS total_sales, round(avg(AMOUNT_TXT), 2) AS avg_transaction,
  round(quantile_cont(AMOUNT_TXT, 0.5), 2) AS median_transaction, round(max(AMOUNT_TXT), 2) AS max_transaction,
  round(min(AMOUNT_TXT), 2) AS min_transaction,
  count(DISTINCT CASE WHEN NOT flag_invalid_customer THEN """ + S.strip_control(S.strip_html("CUSTOMER_TXT")) + """ END) AS unique_customers
FROM h""")
def p_summary(spark, sf_dir):
    s = _prep(spark, sf_dir).summary.drop("missing_values", "validation_flags")
    return rounded(s)


@register("p_missing_values", "WITH " + _prep_ctes().lstrip() + "\n" + "\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(count_if({c} IS NULL) AS BIGINT) AS missing FROM h" for c in _OUT))
def p_missing_values(spark, sf_dir):
    s = _prep(spark, sf_dir).summary
    return s.select(F.explode("missing_values").alias("column_name", "missing")) \
        .withColumn("missing", F.col("missing").cast("bigint"))


@register("b3_empty_columns", f"WITH ds AS ({dirty_sales_sql_for_duckdb()})\n" + "\nUNION ALL ".join(
    f"SELECT '{u}' AS column_name FROM ds HAVING count({c}) = 0" for c, u in zip(_RAW + ["empty_txt"], _UP + ["EMPTY_TXT"])))
def b3_empty_columns(spark, sf_dir):
    df = C.clean_headers(dirty_sales(spark, sf_dir))
    cols = C.empty_columns(df)
    # a one-column frame of the names, derived from the scanned rows' counts
    return df.agg(F.array(*[F.lit(c) for c in cols]).cast("array<string>").alias("a")) \
             .select(F.explode("a").alias("column_name"))


@register("b8_explorer_date_format", f"WITH ds AS ({dirty_sales_sql_for_duckdb()}),\np AS (SELECT " + ", ".join(
    f"{e} AS p{i}" for i, e in enumerate(_date_candidates("order_date_txt", EXPLORE_DATE_FORMATS))) + " FROM ds)\n" +
    "\nUNION ALL ".join(
        f"SELECT {i} AS idx, {S.lit(f)} AS format, round(count(p{i}) / count(*), 2) AS success_rate, "
        f"CAST(count(DISTINCT date_trunc('month', p{i})) AS INTEGER) AS distinct_months, "
        f"CAST(coalesce(datediff('day', min(p{i}), max(p{i})), 0) AS INTEGER) AS span_days, "
        f"{'true' if i == 0 else 'false'} AS chosen FROM p"
        for i, (f, _) in enumerate(EXPLORE_DATE_FORMATS)))
def b8_explorer_date_format(spark, sf_dir):
    ch = detect_date_format(dirty_sales(spark, sf_dir), "order_date_txt")
    return rounded(ch.stats.withColumn("chosen", F.col("format") == F.lit(ch.format)))


@register("b9_time_dimensions_orders", """
SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(quarter(o_orderdate) AS INTEGER) AS quarter,
  CAST(month(o_orderdate) AS INTEGER) AS month, strftime(o_orderdate, '%b-%y') AS month_name,
  CAST(isodow(o_orderdate) - 1 AS INTEGER) AS day_of_week, CAST(week(o_orderdate) AS INTEGER) AS week_of_year
FROM orders""")
def b9_time_dimensions_orders(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    return o.select("o_orderkey", *[e.alias(n) for n, e in time_dimensions(F.col("o_orderdate")).items()])


@register("b4_collapse_whitespace_documents",
          f"SELECT doc_id, {S.collapse_ws('text')} AS text FROM documents")
def b4_collapse_whitespace_documents(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    return d.select("doc_id", T.collapse_ws("text").alias("text"))


@register("b5_null_tokens_conversations", f"""
SELECT CAST(count_if(({S.null_tokens(S.collapse_ws('text'))}) IS NULL) AS BIGINT) AS null_texts,
       CAST(count_if(({S.null_tokens(S.collapse_ws('role'))}) IS NULL) AS BIGINT) AS null_roles FROM conversations""")
def b5_null_tokens_conversations(spark, sf_dir):
    c = C.standardize_nulls(C.trim_strings(load(spark, sf_dir, "conversations").select("text", "role")))
    return c.agg(F.count_if(F.col("text").isNull()).alias("null_texts"),
                 F.count_if(F.col("role").isNull()).alias("null_roles"))


_NAME_SEG = "lower(c_name) || ' ' || lower(c_mktsegment)"


@register("b10_title_case_customers",
          f"SELECT c_custkey, {S.normalize_text(_NAME_SEG)} AS name_normalized FROM customer")
def b10_title_case_customers(spark, sf_dir):
    c = load(spark, sf_dir, "customer")
    return c.select("c_custkey", T.normalize_text(F.concat(F.lower("c_name"), F.lit(" "), F.lower("c_mktsegment")))
                    .alias("name_normalized"))


@register("b11_size_mapping_part", f"SELECT p_partkey, {S.map_size('p_type')} AS size_normalized FROM part")
def b11_size_mapping_part(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    return p.select("p_partkey", T.map_size("p_type").alias("size_normalized"))


@register("b12_first_number_events",
          f"SELECT event_id, round({S.first_number('props')}, 2) AS first_number FROM events")
def b12_first_number_events(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return rounded(e.select("event_id", T.first_number("props").alias("first_number")))


@register("b13_strip_html_pages", f"SELECT page_id, {S.strip_html('html')} AS text FROM pages")
def b13_strip_html_pages(spark, sf_dir):
    p = load(spark, sf_dir, "pages")
    return p.select("page_id", T.strip_html("html").alias("text"))


@register("b14_strip_control_documents", f"""
SELECT doc_id, {S.strip_control('text')} AS text, text <> {S.strip_control('text')} AS changed FROM documents""")
def b14_strip_control_documents(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    s = T.strip_control("text")
    return d.select("doc_id", s.alias("text"), (F.col("text") != s).alias("changed"))


@register("c12_sql_patterns_documents", "\nUNION ALL ".join(
    f"SELECT 'text' AS column_name, '{name}' AS pattern, CAST(count_if({S.sql_pattern('text', pat)}) AS BIGINT) AS matches "
    f"FROM documents"
    for name, pat in T.SQL_PATTERNS))
def c12_sql_patterns_documents(spark, sf_dir):
    return V.sql_pattern_counts(load(spark, sf_dir, "documents"), ["text"])


@register("d1_dedup_documents_by_text", """
SELECT doc_id, lang FROM (
  SELECT doc_id, lang, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1""")
def d1_dedup_documents_by_text(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return deduplicate(d, subset=["text"], order_by=["doc_id"]).select("doc_id", "lang")


@register("d1_exact_dedup_dirty_sales", f"""
WITH ds AS ({dirty_sales_sql_for_duckdb()})
SELECT count(*) AS n_rows FROM (SELECT DISTINCT * FROM ds)""")
def d1_exact_dedup_dirty_sales(spark, sf_dir):
    return deduplicate(dirty_sales(spark, sf_dir)).agg(F.count(F.lit(1)).alias("n_rows"))


@register("d2_duplicate_count_dirty_sales", f"""
WITH ds AS ({dirty_sales_sql_for_duckdb()}), u AS (SELECT count(*) AS n FROM (SELECT DISTINCT * FROM ds))
SELECT count(*) - max(u.n) AS duplicate_rows, count(*) AS total_rows, round((count(*) - max(u.n)) / count(*) * 100, 2) AS duplicate_pct
FROM ds, u""")
def d2_duplicate_count_dirty_sales(spark, sf_dir):
    """Whole rows."""
    return rounded(duplicate_count(dirty_sales(spark, sf_dir)))


@register("d2_duplicate_count_document_texts", """
SELECT CAST(sum(n - 1) AS BIGINT) AS duplicate_rows, CAST(sum(n) AS BIGINT) AS total_rows,
       round(sum(n - 1) / sum(n) * 100, 2) AS duplicate_pct
FROM (SELECT text, lang, count(*) AS n FROM documents GROUP BY text, lang)""")
def d2_duplicate_count_document_texts(spark, sf_dir):
    """The subset form: rows with equal text and language."""
    return rounded(duplicate_count(load(spark, sf_dir, "documents").select("text", "lang")))


@register("e4_outlier_bounds_events", """
WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
SELECT round(q1, 2) AS q1, round(q3, 2) AS q3, round(q1 - 3 * (q3 - q1), 2) AS lower_bound,
       round(q3 + 3 * (q3 - q1), 2) AS upper_bound,
       (SELECT count(*) FROM events WHERE value < q1 - 3 * (q3 - q1) OR value > q3 + 3 * (q3 - q1)) AS outliers
FROM q""")
def e4_outlier_bounds_events(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    q1, q3 = exact_quantiles(e, "value", [0.25, 0.75])
    iqr = q3 - q1
    lo, hi = q1 - 3 * iqr, q3 + 3 * iqr
    return rounded(e.agg(F.lit(q1).alias("q1"), F.lit(q3).alias("q3"), F.lit(lo).alias("lower_bound"),
                         F.lit(hi).alias("upper_bound"),
                         F.count_if((F.col("value") < lo) | (F.col("value") > hi)).alias("outliers")))


@register("c3_header_like_conversations", """
SELECT count(*) AS header_like FROM conversations
WHERE len(list_filter([lower(trim(CAST(conv_id AS VARCHAR))), lower(trim(CAST(turn AS VARCHAR))), lower(trim(role)), lower(trim(text))], lambda v: v LIKE '%heads%')) > 0
  AND len(list_filter([lower(trim(CAST(conv_id AS VARCHAR))), lower(trim(CAST(turn AS VARCHAR))), lower(trim(role)), lower(trim(text))], lambda v: v LIKE '%price%')) > 0""")
def c3_header_like_conversations(spark, sf_dir):
    c = load(spark, sf_dir, "conversations")
    _, heads = C.split_header_like(c)
    return heads.agg(F.count(F.lit(1)).alias("header_like"))


@register("c3_header_rows_dirty_sales", f"""
WITH ds AS ({dirty_sales_sql_for_duckdb()})
SELECT count_if(heads) AS header_rows, count_if(NOT heads) AS kept FROM (
  SELECT coalesce(len(list_filter(v, lambda x: x LIKE '%heads%')) > 0, false) AND coalesce(len(list_filter(v, lambda x: x LIKE '%price%')) > 0, false) AS heads
  FROM (SELECT [{', '.join(f'lower({c})' for c in _RAW)}] AS v FROM ds))""")
def c3_header_rows_dirty_sales(spark, sf_dir):
    kept, heads = C.split_header_like(dirty_sales(spark, sf_dir))
    count = lambda d, n: d.agg(F.count(F.lit(1)).alias(n))
    return count(heads, "header_rows").crossJoin(count(kept, "kept"))      # one row beside one row
