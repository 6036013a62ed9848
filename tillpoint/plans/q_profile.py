"""Registered queries of the profiling / schema-analysis block
over the catalog of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillpoint.functions.text import clean_header_expr, explorer_header_expr, identifier_expr
from tillpoint.operators import compare as J
from tillpoint.operators.profile import column_profile, sample_values
from tillpoint.operators.roles import CLEAN_RULES, EXPLORE_RULES, detect_roles, names_table
from tillpoint.plans.registry import register, rounded
from tillpoint.plans.sqltext import lit
from tillpoint.session import materialize
from tillpoint.sources.tables import TABLES, load

# The schemas of the given tables as Spark reads them (see
# FIXTURES §2); used to write the SQL twins and checked against the data.
SCHEMAS = {
    "region": [("r_regionkey", "int"), ("r_name", "string")],
    "nation": [("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int")],
    "customer": [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"),
                 ("c_mktsegment", "string")],
    "supplier": [("s_suppkey", "bigint"), ("s_name", "string"), ("s_nationkey", "int"), ("s_acctbal", "double")],
    "part": [("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"),
             ("p_size", "int"), ("p_retailprice", "double")],
    "orders": [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
               ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")],
    "lineitem": [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"),
                 ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"),
                 ("l_tax", "double"), ("l_returnflag", "string"), ("l_linestatus", "string"),
                 ("l_shipdate", "timestamp_ntz")],
    "events": [("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"), ("event_type", "string"),
               ("value", "double"), ("props", "string")],
    "documents": [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"),
                  ("n_chars", "bigint")],
    "embeddings": [("vec_id", "bigint"), ("embedding", "array<float>"), ("label", "int")],
    "pages": [("page_id", "bigint"), ("url", "string"), ("html", "string")],
    "benchmark": [("item_id", "bigint"), ("text", "string")],
    "labels": [("doc_id", "bigint"), ("quality", "int"), ("toxic", "int")],
    "conversations": [("conv_id", "bigint"), ("turn", "bigint"), ("role", "string"), ("text", "string")],
}
_NUMERIC = {"int", "bigint", "double", "float"}


def _kind(t: str) -> str:
    return "numeric" if t in _NUMERIC else ("string" if t == "string" else "other")


def catalog(spark, sf_dir):
    """Profile of every given table, unioned into one catalog DataFrame.

    The rows (one per column) are written to the checkpoint folder, so a query that uses
    the catalog twice does not profile twice; nothing is kept between queries."""
    out = None
    for t in TABLES:
        p = column_profile(load(spark, sf_dir, t), t)
        out = p if out is None else out.unionByName(p)
    return materialize(out, "catalog")


def _names(spark, sf_dir):
    """Column names of the given tables, from their schemas."""
    return names_table(spark, {t: load(spark, sf_dir, t).columns for t in TABLES})


def _profile_sql() -> str:
    """Profile of every column; each table is scanned once."""
    parts = []
    for t, cols in SCHEMAS.items():
        one, out = ["count(*) AS n"], []
        for i, (c, ty) in enumerate(cols):
            number = ty in _NUMERIC
            one += [f"count({c}) AS c{i}", f"count(DISTINCT {c}) AS u{i}",
                    f"CAST({f'min({c})' if number else 'NULL'} AS DOUBLE) AS a{i}",
                    f"CAST({f'max({c})' if number else 'NULL'} AS DOUBLE) AS z{i}"]
            out.append(f"{{'column_name': {lit(c)}, 'ordinal': {i + 1}, 'dtype': {lit(ty)}, 'kind': {lit(_kind(ty))}, "
                       f"'null_count': n - c{i}, 'unique_count': u{i}, 'min_num': a{i}, 'max_num': z{i}}}")
        parts.append(f"SELECT {lit(t)} AS table_name, p.column_name, p.ordinal, p.dtype, p.kind, n, p.null_count, p.unique_count, "
                     f"p.min_num, p.max_num FROM (SELECT n, unnest([{', '.join(out)}]) AS p FROM (SELECT {', '.join(one)} FROM {t}))")
    return "\nUNION ALL ".join(parts)


_PROF = f"prof AS MATERIALIZED ({_profile_sql()})"


def _has(*words) -> str:
    return "(" + " OR ".join(f"contains(lower(column_name), {lit(w)})" for w in words) + ")"


_SEMANTIC = f"""CASE WHEN {_has('id', 'index')} THEN CASE WHEN unique_count = n THEN 'unique_identifier' ELSE 'identifier' END
  WHEN {_has('date', 'time', 'month', 'year')} THEN 'temporal'
  WHEN kind = 'numeric' THEN CASE WHEN {_has('price', 'mrp', 'rate', 'amount', 'total', 'tp')} THEN 'monetary'
       WHEN {_has('qty', 'quantity', 'pcs', 'weight')} THEN 'quantity'
       WHEN coalesce(min_num >= 0 AND max_num < 10000, false) THEN 'count' ELSE 'numeric' END
  WHEN kind = 'string' THEN CASE WHEN unique_count / n < 0.05 THEN 'categorical_low'
       WHEN unique_count / n < 0.5 THEN 'categorical_high' ELSE 'text' END
  ELSE 'unknown' END"""

_MEANING = f"""CASE WHEN {_has('sku', 'product', 'style', 'catalog', 'item')} THEN 'product_identifier'
  WHEN {_has('category', 'type', 'class')} THEN 'product_category'
  WHEN {_has('customer', 'client')} THEN 'customer_identifier'
  WHEN {_has('mrp', 'price', 'rate')} THEN 'pricing'
  WHEN {_has('amount', 'total', 'gross')} THEN 'transaction_amount'
  WHEN {_has('weight')} THEN 'logistics_weight'
  WHEN {_has('size')} THEN 'product_size'
  WHEN {_has('amazon', 'flipkart', 'myntra', 'ajio', 'paytm', 'snapdeal')} THEN 'sales_channel_price'
  WHEN {_has('date', 'month', 'year')} THEN 'temporal_dimension'
  ELSE 'general' END"""

_FILETYPE = f"""ft AS (SELECT table_name,
  CASE WHEN max({_has('customer')}::INT) + max({_has('date')}::INT) + max({_has('amount', 'total', 'gross')}::INT)
            + max({_has('quantity', 'pcs')}::INT) >= 3 THEN 'TRANSACTIONAL'
       WHEN max({_has('sku', 'style', 'catalog')}::INT) + max({_has('mrp', 'price')}::INT)
            + max({_has('category', 'type')}::INT) + (sum({_has('amazon', 'flipkart', 'myntra')}::INT) >= 2)::INT >= 3
       THEN 'PRODUCT_CATALOG' ELSE 'UNKNOWN' END AS file_type FROM prof GROUP BY table_name)"""


@register("g9_column_profile_all", f"""WITH {_PROF}
SELECT table_name, column_name, ordinal, dtype, kind, n, null_count, round(null_count / n * 100, 2) AS null_pct,
  unique_count, round(unique_count / n * 100, 2) AS unique_pct, round(min_num, 2) AS min_num,
  round(max_num, 2) AS max_num FROM prof""")
def g9_column_profile_all(spark, sf_dir):
    return rounded(catalog(spark, sf_dir))


@register("g9_column_profile_lineitem", f"""WITH {_PROF}
SELECT column_name, n, null_count, unique_count FROM prof WHERE table_name = 'lineitem'""")
def g9_column_profile_lineitem(spark, sf_dir):
    p = column_profile(load(spark, sf_dir, "lineitem"), "lineitem")
    return p.select("column_name", "n", "null_count", "unique_count")


@register("g10_sample_values_nation", """
SELECT column_name, CAST(rank AS INTEGER) AS rank, value FROM (
  SELECT column_name, value, row_number() OVER (PARTITION BY column_name ORDER BY n_nationkey) AS rank FROM (
    SELECT n_nationkey, 'n_nationkey' AS column_name, CAST(n_nationkey AS VARCHAR) AS value FROM nation
    UNION ALL SELECT n_nationkey, 'n_name', n_name FROM nation
    UNION ALL SELECT n_nationkey, 'n_regionkey', CAST(n_regionkey AS VARCHAR) FROM nation) WHERE value IS NOT NULL)
WHERE rank <= 5""")
def g10_sample_values_nation(spark, sf_dir):
    return sample_values(load(spark, sf_dir, "nation"), 5, order_by=["n_nationkey"]) \
        .select("column_name", "rank", "value")


@register("j3_semantic_types", f"WITH {_PROF}\nSELECT table_name, column_name, {_SEMANTIC} AS inferred_type FROM prof")
def j3_semantic_types(spark, sf_dir):
    return catalog(spark, sf_dir).select("table_name", "column_name", J.semantic_type().alias("inferred_type"))


@register("j4_business_meaning",
          f"WITH {_PROF}\nSELECT table_name, column_name, {_MEANING} AS business_meaning FROM prof")
def j4_business_meaning(spark, sf_dir):
    return _names(spark, sf_dir).select("table_name", "column_name", J.business_meaning().alias("business_meaning"))


@register("j9_sql_types", f"""WITH {_PROF}, s AS (SELECT *, {_SEMANTIC} AS inferred_type FROM prof)
SELECT table_name, column_name, CASE WHEN dtype IN ('bigint', 'int', 'smallint', 'tinyint') THEN 'INTEGER'
  WHEN dtype IN ('double', 'float') THEN CASE WHEN inferred_type = 'monetary' THEN 'DECIMAL(15,2)' ELSE 'DOUBLE' END
  WHEN dtype = 'string' THEN CASE WHEN inferred_type = 'temporal' THEN 'DATE'
       WHEN unique_count / n * 100 > 90 THEN 'TEXT' ELSE 'VARCHAR(255)' END
  ELSE 'VARCHAR(255)' END AS sql_type FROM s""")
def j9_sql_types(spark, sf_dir):
    return J.annotate(catalog(spark, sf_dir)).select("table_name", "column_name", "sql_type")


@register("j5_file_types", f"""WITH {_PROF}, {_FILETYPE}
SELECT table_name, file_type, CASE file_type WHEN 'TRANSACTIONAL' THEN 'Sales Transactions'
  WHEN 'PRODUCT_CATALOG' THEN 'Product Master Data' ELSE 'Unknown' END AS business_domain FROM ft""")
def j5_file_types(spark, sf_dir):
    return J.file_types(_names(spark, sf_dir))


@register("j6_key_entities", f"""WITH {_PROF}
SELECT DISTINCT table_name, entity FROM (
  SELECT table_name, 'Customer' AS entity FROM prof WHERE {_has('customer')}
  UNION ALL SELECT table_name, 'Product' FROM prof WHERE {_has('product', 'style', 'sku')}
  UNION ALL SELECT table_name, 'Time' FROM prof WHERE {_has('date', 'month')}
  UNION ALL SELECT table_name, 'Transaction' FROM prof WHERE {_has('amount', 'total', 'gross')}
  UNION ALL SELECT table_name, 'Sales_Channel' FROM prof WHERE {_has('amazon', 'flipkart', 'myntra')})""")
def j6_key_entities(spark, sf_dir):
    return J.key_entities(_names(spark, sf_dir))


@register("j1_common_columns_documents_labels", f"""WITH {_PROF}
SELECT column_name FROM prof WHERE table_name IN ('documents', 'labels')
GROUP BY column_name HAVING count(DISTINCT table_name) = 2""")
def j1_common_columns_documents_labels(spark, sf_dir):
    cat = _names(spark, sf_dir).where(F.col("table_name").isin("documents", "labels"))
    return J.common_columns(cat)


@register("j2_unique_columns", f"""WITH {_PROF}
SELECT table_name, column_name FROM prof WHERE column_name IN (
  SELECT column_name FROM prof GROUP BY column_name HAVING count(DISTINCT table_name) = 1)""")
def j2_unique_columns(spark, sf_dir):
    return J.unique_columns(_names(spark, sf_dir))


@register("j7_compatibility", f"""WITH {_PROF}, {_FILETYPE}, g AS (
  SELECT count(*) AS files, count(DISTINCT file_type) AS kinds, max((file_type = 'UNKNOWN')::INT) AS has_unknown FROM ft)
SELECT CASE WHEN kinds = 1 THEN 'COMPATIBLE - Same file type'
  WHEN has_unknown = 0 THEN 'INCOMPATIBLE - Different file types (requires separate tables)'
  ELSE 'PARTIAL - Manual inspection required' END AS schema_compatibility,
  CASE WHEN kinds = 1 THEN 'VERTICAL_UNION - Stack all files with same schema'
  ELSE 'SEPARATE_TABLES - Create different tables for different file types, link via foreign keys' END
  AS unification_strategy FROM g WHERE files >= 2""")
def j7_compatibility(spark, sf_dir):
    return J.compatibility(J.file_types(_names(spark, sf_dir)))


@register("j7_recommendations", f"""WITH {_PROF}, {_FILETYPE}
SELECT 7 AS seq, 'Consider partitioning data by date/month for better query performance' AS recommendation
FROM (SELECT count(*) AS files FROM ft) WHERE files > 3
UNION ALL SELECT 8, 'Create aggregated summary tables for faster reporting' FROM (SELECT count(*) AS files FROM ft) WHERE files > 3
UNION ALL SELECT 100, '⚠️  ' || t.table_name || ': Missing date/time column - may limit temporal analysis'
  FROM ft t JOIN prof p ON p.table_name = t.table_name WHERE t.file_type = 'TRANSACTIONAL'
  GROUP BY t.table_name HAVING max({_has('date')}::INT) = 0
UNION ALL SELECT 101, '⚠️  ' || t.table_name || ': Missing customer identifier - limits customer analytics'
  FROM ft t JOIN prof p ON p.table_name = t.table_name WHERE t.file_type = 'TRANSACTIONAL'
  GROUP BY t.table_name HAVING max({_has('customer')}::INT) = 0""")
def j7_recommendations(spark, sf_dir):
    cat = _names(spark, sf_dir)
    return J.recommendations(cat, J.file_types(cat))


@register("j8_union_documents_benchmark", """
SELECT source_file, count(*) AS rows, count(doc_id) AS doc_ids, count(item_id) AS item_ids, count(text) AS texts,
  count(lang) AS langs, count(source) AS sources, count(n_chars) AS sizes, count(loaded_at) AS loaded
FROM (SELECT doc_id, NULL::BIGINT AS item_id, text, lang, source, n_chars, 'documents' AS source_file,
             TIMESTAMP '2026-01-01' AS loaded_at FROM documents
      UNION ALL SELECT NULL, item_id, text, NULL, NULL, NULL, 'benchmark', TIMESTAMP '2026-01-01' FROM benchmark)
GROUP BY source_file""")
def j8_union_documents_benchmark(spark, sf_dir):
    u = J.union_by_type({t: load(spark, sf_dir, t) for t in ("documents", "benchmark")}, loaded_at="2026-01-01")
    return u.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("rows"), F.count("doc_id").alias("doc_ids"), F.count("item_id").alias("item_ids"),
        F.count("text").alias("texts"), F.count("lang").alias("langs"), F.count("source").alias("sources"),
        F.count("n_chars").alias("sizes"), F.count("loaded_at").alias("loaded"))


_NAMES_SQL = f"""names AS (SELECT table_name, CAST(ordinal_position AS INTEGER) AS o, column_name AS c, lower(column_name) AS l
  FROM information_schema.columns WHERE table_name IN ({', '.join(lit(t) for t in TABLES)}))"""
# the role rules once more, in SQL: firsts in order, each without the columns already taken, then lasts
_FIRST_SQL = """
d AS (SELECT table_name, min(o) AS o FROM names WHERE l LIKE '%date%' GROUP BY 1),
m AS (SELECT table_name, min(o) AS o FROM (SELECT table_name, o FROM names WHERE l LIKE '%month%' EXCEPT SELECT * FROM d) GROUP BY 1),
cu AS (SELECT table_name, min(o) AS o FROM (SELECT table_name, o FROM names WHERE l LIKE '%customer%'
       EXCEPT (SELECT * FROM d UNION SELECT * FROM m)) GROUP BY 1),
st AS (SELECT table_name, min(o) AS o FROM (SELECT table_name, o FROM names WHERE l LIKE '%style%'
       EXCEPT (SELECT * FROM d UNION SELECT * FROM m UNION SELECT * FROM cu)) GROUP BY 1),
sk AS (SELECT table_name, min(o) AS o FROM (SELECT table_name, o FROM names WHERE l LIKE '%sku%'
       EXCEPT (SELECT * FROM d UNION SELECT * FROM m UNION SELECT * FROM cu UNION SELECT * FROM st)) GROUP BY 1),
firsts AS (SELECT *, 'date' AS role FROM d UNION ALL SELECT *, 'month' FROM m UNION ALL SELECT *, 'customer' FROM cu
  UNION ALL SELECT *, 'product' FROM st UNION ALL SELECT *, 'sku' FROM sk)"""


def _roles_sql(last: str) -> str:
    return f"""{_NAMES_SQL}, {_FIRST_SQL},
lasts AS (SELECT table_name, max(o) AS o, role FROM (SELECT table_name, o,
    CASE WHEN regexp_matches(l, 'pcs|qty|quantity') THEN 'quantity' WHEN regexp_matches(l, 'rate|price') THEN 'rate'
         WHEN regexp_matches(l, 'amt|amount|total|gross') THEN 'amount' {last} END AS role
    FROM names ANTI JOIN firsts USING (table_name, o)) WHERE role IS NOT NULL GROUP BY table_name, role),
roles AS (SELECT table_name, role, c AS column_name FROM (SELECT * FROM firsts UNION ALL SELECT table_name, o, role FROM lasts)
          JOIN names USING (table_name, o))"""


_EXPLORE_SQL = _roles_sql("WHEN l LIKE '%region%' THEN 'region' WHEN regexp_matches(l, 'category|type') THEN 'category'")
_CLEAN_SQL = _roles_sql("WHEN l LIKE '%size%' THEN 'size'")


@register("j10_column_kinds", f"""WITH {_PROF}, {_EXPLORE_SQL}
SELECT table_name, column_name, CASE WHEN n - null_count < n * 0.1 THEN 'MOSTLY_NULL'
  WHEN {_has('date')} THEN 'DATE'
  WHEN kind = 'numeric' THEN CASE WHEN (table_name, column_name) IN (SELECT (table_name, column_name) FROM roles
       WHERE role IN ('quantity', 'rate', 'amount')) THEN 'METRIC' ELSE 'NUMERIC' END
  WHEN kind = 'string' THEN CASE WHEN unique_count / n < 0.05 THEN 'CATEGORY'
       WHEN unique_count / n > 0.95 THEN 'ID/TEXT' ELSE 'CATEGORY' END
  ELSE 'OTHER' END AS kind FROM prof""")
def j10_column_kinds(spark, sf_dir):
    cat = catalog(spark, sf_dir)
    roles = j11_explore_roles(spark, sf_dir).where(F.col("role").isin("quantity", "rate", "amount"))
    metric = cat.join(roles.select("table_name", "column_name", F.lit(True).alias("is_metric")),
                      ["table_name", "column_name"], "left")
    return metric.select("table_name", "column_name",
                         J.column_kind(F.coalesce(F.col("is_metric"), F.lit(False))).alias("kind"))


@register("j11_clean_roles", f"WITH {_CLEAN_SQL} SELECT * FROM roles")
def j11_clean_roles(spark, sf_dir):
    return detect_roles(_names(spark, sf_dir), CLEAN_RULES)


@register("j11_explore_roles", f"WITH {_EXPLORE_SQL} SELECT * FROM roles")
def j11_explore_roles(spark, sf_dir):
    return detect_roles(_names(spark, sf_dir), EXPLORE_RULES)


@register("a10_ddl_all_tables", f"""WITH {_PROF}, s AS (SELECT *, {_SEMANTIC} AS sem, unique_count / n * 100 AS up FROM prof)
SELECT table_name, 'CREATE TABLE ' || table_name || ' (' || chr(10) || string_agg('  ' || column_name || ' ' ||
  CASE WHEN dtype IN ('int', 'bigint') THEN 'INTEGER'
       WHEN dtype IN ('double', 'float') THEN CASE WHEN sem = 'monetary' THEN 'DECIMAL(15,2)' ELSE 'DOUBLE' END
       WHEN dtype = 'string' THEN CASE WHEN sem = 'temporal' THEN 'DATE' WHEN up > 90 THEN 'TEXT' ELSE 'VARCHAR(255)' END
       ELSE 'VARCHAR(255)' END, ',' || chr(10) ORDER BY ordinal) || chr(10) || ');' AS ddl FROM s GROUP BY table_name""")
def a10_ddl_all_tables(spark, sf_dir):
    from tillpoint.sources.sinks import ddl

    cat = J.annotate(catalog(spark, sf_dir))
    return ddl(cat if "sql_type" in cat.columns else cat.withColumn("sql_type", J.sql_type()))


@register("j12_fact_columns", f"""WITH {_PROF}, w AS (
  SELECT * FROM (VALUES {', '.join(f"('dimension', {lit(w)}, {i})" for i, w in enumerate(
      ['region', 'state', 'store', 'category', 'subcategory', 'product', 'product_line', 'brand', 'channel',
       'segment', 'year', 'quarter', 'month', 'date']))},
    {', '.join(f"('metric', {lit(w)}, {i})" for i, w in enumerate(
      ['sales', 'revenue', 'amount', 'profit', 'margin', 'units', 'quantity']))}) AS t(use, wanted, priority)),
hit AS (SELECT table_name, use, column_name, CAST(priority AS INTEGER) AS priority
        FROM prof JOIN w ON lower(column_name) = wanted)
SELECT * FROM hit
UNION ALL SELECT table_name, 'metric', column_name, CAST(ordinal + 1000 AS INTEGER) FROM prof
WHERE kind = 'numeric' AND table_name NOT IN (SELECT table_name FROM hit WHERE use = 'metric')""")
def j12_fact_columns(spark, sf_dir):
    return J.fact_columns(catalog(spark, sf_dir))


@register("b1_a6_column_name_rules", """
SELECT table_name, CAST(ordinal_position AS INTEGER) AS ordinal, column_name,
  regexp_replace(regexp_replace(upper(trim(column_name)), '\\s+', '_', 'g'), '[^A-Za-z0-9_\\s]', '', 'g') AS clean_header,
  CASE WHEN regexp_matches(s, '^[0-9]') THEN 'c_' || s ELSE s END AS sanitized,
  replace(upper(trim(column_name)), ' ', '_') AS explorer_header
FROM (SELECT *, coalesce(nullif(lower(regexp_replace(trim(regexp_replace(column_name, '[^0-9a-zA-Z]+', '_', 'g'), '_'),
                                                    '_+', '_', 'g')), ''), 'col') AS s
      FROM information_schema.columns
      WHERE table_name IN ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events',
                           'documents', 'embeddings', 'pages', 'benchmark', 'labels', 'conversations'))""")
def b1_a6_column_name_rules(spark, sf_dir):
    """Rules 1-3 applied to every column name of the given tables."""
    n = _names(spark, sf_dir)
    return n.select("*", clean_header_expr("column_name").alias("clean_header"),
                    identifier_expr("column_name").alias("sanitized"), explorer_header_expr("column_name").alias("explorer_header"))
