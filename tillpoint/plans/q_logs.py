"""Registered queries of the conversation / query-log block (I3-I5, L1-L4,
C9, C10, N18, G14, A16).  Query, reply and run logs are derived from the given
``events`` table so that their size grows with it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillpoint.operators import logs as L
from tillpoint.operators import query as Q
from tillpoint.plans.registry import register, rounded
from tillpoint.sources.tables import load


# ---- derived logs (same text in Spark and in the SQL twins) ----------------
def _query_log(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    u = F.col("user_id").cast("string")
    sql = (F.when(F.col("event_type") == "view", F.concat(F.lit("SELECT * FROM events WHERE user_id = "), u))
            .when(F.col("event_type") == "click", F.concat(F.lit("select\nuser_id FROM events WHERE user_id = "), u))
            .when(F.col("event_type") == "error", F.lit("WITH x AS (SELECT 1) DELETE FROM t"))
            .when(F.col("event_type") == "purchase",
                  F.concat(F.lit("  select last_update from t group by 1 order by 1 limit "), u))
            .otherwise(F.concat(F.lit("UPDATE t SET id = "), u)))
    return e.select("event_id", sql.alias("sql"))


_QUERY_LOG_SQL = """(SELECT event_id, CASE event_type
  WHEN 'view' THEN 'SELECT * FROM events WHERE user_id = ' || CAST(user_id AS VARCHAR)
  WHEN 'click' THEN 'select' || chr(10) || 'user_id FROM events WHERE user_id = ' || CAST(user_id AS VARCHAR)
  WHEN 'error' THEN 'WITH x AS (SELECT 1) DELETE FROM t'
  WHEN 'purchase' THEN '  select last_update from t group by 1 order by 1 limit ' || CAST(user_id AS VARCHAR)
  ELSE 'UPDATE t SET id = ' || CAST(user_id AS VARCHAR) END AS sql FROM events)"""


def _reply_log(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    t = (F.when(F.col("event_type") == "view", F.concat(F.lit("Plan: ```json "), F.col("props"), F.lit(" ``` done")))
          .when(F.col("event_type") == "click", F.concat(F.lit("answer "), F.col("props"), F.lit(" and more text")))
          .when(F.col("event_type") == "error", F.concat(F.lit('broken {"k": '), F.col("user_id").cast("string")))
          .when(F.col("event_type") == "purchase", F.concat(F.lit("```json {bad} ``` then "), F.col("props")))
          .otherwise(F.lit("no json here")))
    return e.select("event_id", t.alias("reply"))


_REPLY_LOG_SQL = """(SELECT event_id, CASE event_type
  WHEN 'view' THEN 'Plan: ```json ' || props || ' ``` done'
  WHEN 'click' THEN 'answer ' || props || ' and more text'
  WHEN 'error' THEN 'broken {"k": ' || CAST(user_id AS VARCHAR)
  WHEN 'purchase' THEN '```json {bad} ``` then ' || props
  ELSE 'no json here' END AS reply FROM events)"""


def _plan_log(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    conf = (F.when(F.col("event_type") == "click", F.lit('"0.5"'))
             .when(F.col("event_type") == "error", F.lit('"abc"'))
             .otherwise(F.floor(F.col("value")).cast("string")))
    filters = F.when(F.col("event_type") == "view", F.lit('{"k": 1}')).otherwise(F.lit("[1]"))
    queries = F.when(F.col("event_type") == "purchase", F.lit('["  ", "q1", " q2 "]')) \
        .otherwise(F.concat(F.lit('"q'), F.col("user_id").cast("string"), F.lit('"')))
    reply = F.concat(F.lit('{"sql": " SELECT '), F.col("event_type"), F.lit(' FROM events ", "queries": '), queries,
                     F.lit(', "confidence": '), conf,
                     F.lit(', "reason_tags": ["Top Sales", "'), F.col("event_type"),
                     F.lit('", "top sales", "X#1 !"], "filters": '), filters, F.lit("}"))
    return e.select("event_id", reply.alias("reply"))


_PLAN_LOG_SQL = """(SELECT event_id, '{"sql": " SELECT ' || event_type || ' FROM events ", "queries": '
  || CASE WHEN event_type = 'purchase' THEN '["  ", "q1", " q2 "]' ELSE '"q' || CAST(user_id AS VARCHAR) || '"' END
  || ', "confidence": ' || CASE event_type WHEN 'click' THEN '"0.5"' WHEN 'error' THEN '"abc"'
       ELSE CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END
  || ', "reason_tags": ["Top Sales", "' || event_type || '", "top sales", "X#1 !"], "filters": '
  || CASE WHEN event_type = 'view' THEN '{"k": 1}' ELSE '[1]' END || '}' AS reply FROM events)"""


def _run_log(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    status = (F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "bogus")
               .otherwise("ok"))
    dur = F.floor(F.col("value") * 100) - F.when(F.col("event_type") == "click", 5000).otherwise(0)
    return e.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("index"), status.alias("status"),
                    F.lit(0).cast("bigint").alias("row_count"), dur.alias("duration_ms"))


_RUN_LOG_SQL = """(SELECT user_id AS run_id, event_id AS "index",
  CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'signup' THEN 'bogus' ELSE 'ok' END AS status,
  CAST(floor(value * 100) AS BIGINT) - CASE WHEN event_type = 'click' THEN 5000 ELSE 0 END AS duration_ms FROM events)"""


# ---- conversations ---------------------------------------------------------
@register("i3_rolling_memory", """
SELECT conv_id, turn, role FROM (
  SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations)
WHERE rn <= 5""")
def i3_rolling_memory(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return L.rolling_memory(c, "conv_id", "turn", 5)


@register("i4_carry_forward", """
SELECT conv_id, role, arg_max(text, turn) AS text, max(turn) AS turn FROM conversations
WHERE role IS NOT NULL GROUP BY conv_id, role""")
def i4_carry_forward(spark, sf_dir):
    c = load(spark, sf_dir, "conversations")
    return L.carry_forward(c, "conv_id", "turn", "role", "text")


@register("i5_qa_pairs", """
SELECT q.conv_id, q.turn, q.text AS question, a.text AS answer
FROM (SELECT *, lead(turn) OVER w AS nt, lead(role) OVER w AS nr FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role)) q
JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.nt AND a.role = q.nr
WHERE q.role = 'user' AND q.nr = 'assistant'""")
def i5_qa_pairs(spark, sf_dir):
    c = load(spark, sf_dir, "conversations")
    return L.qa_pairs(c, "conv_id", "turn", "role", "text")


# ---- replies, plans, queries, runs -----------------------------------------
@register("l1_extract_json_events", f"""
SELECT event_id, CASE WHEN json_valid(cand) THEN cand END AS extracted FROM (
  SELECT event_id, CASE WHEN regexp_extract(trim(reply), '(?is)```json\\s*(\\{{.*?\\}})\\s*```', 1) <> ''
                        THEN regexp_extract(trim(reply), '(?is)```json\\s*(\\{{.*?\\}})\\s*```', 1)
                        WHEN regexp_extract(trim(reply), '(?s)(\\{{.*\\}})', 1) <> ''
                        THEN regexp_extract(trim(reply), '(?s)(\\{{.*\\}})', 1) END AS cand
  FROM {_REPLY_LOG_SQL})""")
def l1_extract_json_events(spark, sf_dir):
    return L.extract_json_column(_reply_log(spark, sf_dir), "reply").select("event_id", "extracted")


_TAG = "substr(regexp_replace(replace(lower(trim(x)), ' ', '_'), '[^a-z0-9_-]', '', 'g'), 1, 32)"


@register("l2_normalize_plans", f"""
WITH p AS (SELECT event_id, reply::JSON AS v FROM {_PLAN_LOG_SQL}),
q AS (SELECT event_id, v,
  coalesce(trim(json_extract_string(v, '$.sql')), '') AS sql,
  CASE json_type(v, '$.queries') WHEN 'ARRAY' THEN json_extract_string(v, '$.queries[*]')
       WHEN 'VARCHAR' THEN [json_extract_string(v, '$.queries')] ELSE [] END AS qs,
  CASE json_type(v, '$.assumptions') WHEN 'ARRAY' THEN json_extract_string(v, '$.assumptions[*]')
       WHEN 'VARCHAR' THEN [json_extract_string(v, '$.assumptions')] ELSE [] END AS asm,
  CASE json_type(v, '$.needed_tables') WHEN 'ARRAY' THEN json_extract_string(v, '$.needed_tables[*]')
       WHEN 'VARCHAR' THEN [json_extract_string(v, '$.needed_tables')] ELSE [] END AS tabs,
  json_extract_string(v, '$.reason_tags[*]') AS tags FROM p)
SELECT event_id, sql,
  to_json(list_filter(list_transform(qs, lambda x: trim(x)), lambda x: x <> ''))::VARCHAR AS queries,
  to_json(list_filter(list_transform(asm, lambda x: trim(x)), lambda x: x <> ''))::VARCHAR AS assumptions,
  to_json(list_filter(list_transform(tabs, lambda x: trim(x)), lambda x: x <> ''))::VARCHAR AS needed_tables,
  substr(coalesce(trim(json_extract_string(v, '$.rationale_summary')), ''), 1, 280) AS rationale_summary,
  CASE WHEN json_type(v, '$.filters') = 'OBJECT' THEN CAST(json_extract(v, '$.filters') AS VARCHAR) ELSE '{{}}' END AS filters,
  least(greatest(TRY_CAST(json_extract_string(v, '$.confidence') AS DOUBLE), 0.0), 1.0) AS confidence,
  array_to_string(list_distinct_ordered, ',') AS reason_tags,
  (sql <> '' OR len(list_filter(list_transform(qs, lambda x: trim(x)), lambda x: x <> '')) > 0) AS valid
FROM (SELECT *, (SELECT list(t ORDER BY i) FROM (
        SELECT t, min(i) AS i FROM (SELECT unnest(list_transform(tags, lambda x: {_TAG})) AS t,
                                          generate_subscripts(tags, 1) AS i)
        WHERE t <> '' GROUP BY t ORDER BY i LIMIT 6)) AS list_distinct_ordered FROM q)""")
def l2_normalize_plans(spark, sf_dir):
    p = L.normalize_plans(_plan_log(spark, sf_dir), "reply", "p").select("event_id", "p")
    lists = [F.to_json(f"p.{c}").alias(c) for c in ("queries", "assumptions", "needed_tables")]
    return rounded(p.select("event_id", "p.sql", *lists, "p.filters", "p.rationale_summary", "p.confidence",
                            F.array_join("p.reason_tags", ",").alias("reason_tags"), "p.valid"))


@register("c9_guard_query_log", f"""
SELECT event_id, CASE WHEN lower(trim(sql)) = '' THEN false WHEN starts_with(lower(trim(sql)), 'with ') THEN true
  WHEN NOT starts_with(lower(trim(sql)), 'select ') THEN false
  ELSE NOT ({' OR '.join(f"contains(lower(trim(sql)), '{t}')" for t in Q.FORBIDDEN)}) END AS safe
FROM {_QUERY_LOG_SQL}""")
def c9_guard_query_log(spark, sf_dir):
    q = _query_log(spark, sf_dir)
    return q.select("event_id", Q.is_safe_select("sql").alias("safe"))


@register("l3_query_features", f"""
SELECT event_id, contains(lower(sql), 'group by') AS grouped, contains(lower(sql), 'order by') AS ordered,
  contains(lower(sql), 'limit') AS limited FROM {_QUERY_LOG_SQL}""")
def l3_query_features(spark, sf_dir):
    q = _query_log(spark, sf_dir)
    return q.select("event_id", *[v.alias(k) for k, v in Q.query_features("sql").items()])


_EVENT_COLUMNS = ("event_id", "user_id", "event_type", "value", "props", "ts")
_KEYS_SQL = ("array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} IS NOT NULL THEN '{c}' END" for c in _EVENT_COLUMNS)
             + "], lambda x: x IS NOT NULL)[:5], ', ')")


@register("l3_query_summary", f"""
SELECT event_id, CASE WHEN event_type = 'error' THEN 'read-only analytical query; ' ELSE 'analytical select with columns [' || {_KEYS_SQL} || ']; ' END
  || 'grouped=' || CASE WHEN contains(lower(sql), 'group by') THEN 'True' ELSE 'False' END
  || ', ordered=' || CASE WHEN contains(lower(sql), 'order by') THEN 'True' ELSE 'False' END
  || ', limited=' || CASE WHEN contains(lower(sql), 'limit') THEN 'True' ELSE 'False' END AS summary
FROM {_QUERY_LOG_SQL} JOIN events USING (event_id)""")
def l3_query_summary(spark, sf_dir):
    """The preview of a query is its event as one row; failed ones show no rows."""
    e = load(spark, sf_dir, "events")
    shown = F.when(F.col("event_type") == "error", F.lit(Q.NO_ROWS)).otherwise(
        F.concat(F.lit('{"rows":['), F.to_json(F.struct(*_EVENT_COLUMNS)), F.lit("]}")))
    q = _query_log(spark, sf_dir).select("event_id", "sql").join(e.select("event_id", shown.alias("preview")), "event_id")
    return q.select("event_id", Q.query_summary("sql", "preview").alias("summary"))


@register("l4_augment_errors", f"""
SELECT event_id, CASE WHEN contains(err, 'Could not convert string') OR contains(err, 'Conversion Error')
  THEN err || '{Q.CONVERSION_HINT}' ELSE err END AS error FROM (
  SELECT event_id, CASE WHEN event_type = 'error' THEN 'Conversion Error: Could not convert string ''' || props || ''''
    ELSE 'Binder Error: column ' || event_type END AS err FROM events)""")
def l4_augment_errors(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    err = F.when(F.col("event_type") == "error",
                 F.concat(F.lit("Conversion Error: Could not convert string '"), F.col("props"), F.lit("'"))) \
        .otherwise(F.concat(F.lit("Binder Error: column "), F.col("event_type")))
    return e.select("event_id", Q.augment_error(err).alias("error"))


@register("g14_run_rollup_events", f"""
SELECT run_id, count(*) AS queries_total, CAST(count_if(status = 'ok') AS BIGINT) AS queries_ok,
  CAST(count_if(status <> 'ok') AS BIGINT) AS queries_failed, CAST(sum(greatest(duration_ms, 0)) AS BIGINT) AS total_duration_ms
FROM {_RUN_LOG_SQL} WHERE status IN ('ok', 'error', 'timeout') GROUP BY run_id""")
def g14_run_rollup_events(spark, sf_dir):
    return Q.run_rollup(_run_log(spark, sf_dir), "run_id")


@register("g14_failed_indexes_events", f"""
SELECT run_id, "index" + 1 AS failed_index FROM {_RUN_LOG_SQL} WHERE status IN ('error', 'timeout')""")
def g14_failed_indexes_events(spark, sf_dir):
    return Q.failed_indexes(_run_log(spark, sf_dir), "run_id")


@register("c10_guarded_query_lineitem", """
SELECT * FROM (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_returnflag) LIMIT 2""")
def c10_guarded_query_lineitem(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    ok, df, err = Q.guarded(spark, "SELECT l_returnflag, count(*) AS n FROM {lineitem} GROUP BY 1 "
                                   "ORDER BY n DESC, l_returnflag;", max_rows=2, lineitem=li)
    if not ok:
        raise RuntimeError(err)
    return df


@register("n18_query_batch_lineitem", """
SELECT 0 AS "index", 'ok' AS status, least(count(DISTINCT l_returnflag), 200) AS row_count FROM lineitem
UNION ALL SELECT 1, 'error', 0 UNION ALL SELECT 2, 'error', 0
UNION ALL SELECT 3, 'ok', 1
UNION ALL SELECT 4, CASE WHEN count(*) > count(TRY_CAST(l_returnflag AS BIGINT)) THEN 'error' ELSE 'ok' END,
  CASE WHEN count(*) > count(TRY_CAST(l_returnflag AS BIGINT)) THEN 0 ELSE least(count(*), 200) END FROM lineitem
UNION ALL SELECT 5, 'ok', least(count(*), 200) FROM lineitem WHERE l_quantity > 30""")
def n18_query_batch_lineitem(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    _, log = Q.run_batch(spark, ["SELECT l_returnflag, count(*) AS n FROM {lineitem} GROUP BY 1",
                                 "SELECT no_such_column FROM {lineitem}",
                                 "UPDATE lineitem SET l_tax = 0",
                                 "SELECT sum(l_extendedprice) FROM {lineitem};",
                                 "SELECT CAST(l_returnflag AS BIGINT) AS x FROM {lineitem}",
                                 "SELECT * FROM {lineitem} WHERE l_quantity > 30"], lineitem=li)
    return log.select("index", "status", "row_count")


@register("a16_json_preview_region", """
SELECT to_json({'rows': (SELECT list({'r_regionkey': r_regionkey, 'r_name': r_name} ORDER BY r_regionkey)
                         FROM (SELECT * FROM region ORDER BY r_regionkey LIMIT 50))})::VARCHAR AS preview""")
def a16_json_preview_region(spark, sf_dir):
    r = load(spark, sf_dir, "region").orderBy("r_regionkey")
    return Q.json_preview(r, 50)


@register("a16_batch_preview_region_nation", """
SELECT '{"results":[' || (SELECT to_json({'rows': list({'r_regionkey': r_regionkey, 'r_name': r_name} ORDER BY r_regionkey)})::VARCHAR FROM region)
  || ',{"rows":[]},' || (SELECT to_json({'rows': list({'n_regionkey': n_regionkey, 'nations': nations} ORDER BY n_regionkey)})::VARCHAR
    FROM (SELECT n_regionkey, count(*) AS nations FROM nation GROUP BY 1)) || ']}' AS preview""")
def a16_batch_preview_region_nation(spark, sf_dir):
    """Three results; the second fails when it runs."""
    region, nation = load(spark, sf_dir, "region"), load(spark, sf_dir, "nation")
    return Q.batch_preview(spark, [region.orderBy("r_regionkey"), region.select(F.col("r_name").cast("bigint").alias("n")),
                                   nation.groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("nations")).orderBy("n_regionkey")])
