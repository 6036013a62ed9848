"""The query runner's behaviours (the reference's unit tests, against real Spark)."""

from tillpoint.operators import query as Q


def test_execute_ok_and_error(spark):
    ok, df, err = Q.guarded(spark, "SELECT 1 AS x")
    assert ok and df.collect()[0].x == 1 and err is None
    ok, df, err = Q.guarded(spark, "SELECT no_such_col FROM range(1)")
    assert not ok and df is None and err


def test_non_select_refused_without_running(spark):
    assert Q.guarded(spark, "UPDATE t SET id = 1") == (False, None, "Only SELECT queries are allowed")


def test_row_cap_and_with_select(spark):
    df3 = spark.createDataFrame([(1, 10.5), (2, 20.0), (3, 30.25)], "id int, amount double")
    ok, df, _ = Q.guarded(spark, "SELECT * FROM {t} ORDER BY id", max_rows=2, t=df3)
    assert ok and [r.id for r in df.collect()] == [1, 2]
    ok, df, _ = Q.guarded(spark, "WITH c AS (SELECT 4 AS n) SELECT n FROM c")
    assert ok and df.first().n == 4


def test_known_guard_gaps(spark):
    safe = lambda sql: spark.createDataFrame([(sql,)], "q string").select(Q.is_safe_select("q")).first()[0]
    assert not safe("select\n1")
    assert not safe("select last_update from t")
    assert safe("with x as (select 1) delete from t")


def test_tables_schemas_and_preview(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS mart")
    spark.createDataFrame([(1, 2.0)], "id int, amount double").write.mode("overwrite").saveAsTable("mart.sales")
    tables = [r.qualified for r in Q.list_tables(spark, ["mart"]).collect()]
    assert "mart.sales" in tables
    cols = [(r.column_name, r.data_type) for r in Q.describe_schemas(spark, ("mart",)).collect()
            if r.table_name == "sales"]
    assert cols == [("id", "int"), ("amount", "double")]
    prev = Q.json_preview(spark.createDataFrame([(1,), (2,), (3,)], "a int"), max_rows=2).first().preview
    assert prev == '{"rows":[{"a":1},{"a":2}]}'


def test_batch_and_rollup(spark):
    res, log = Q.run_batch(spark, ["SELECT 1", "SELECT x FROM nowhere", "DROP TABLE t", "SELECT 2"])
    assert sorted(res) == [0, 3]
    r = Q.run_rollup(log).first()
    assert (r.queries_total, r.queries_ok, r.queries_failed) == (4, 2, 2)
    assert sorted(x.failed_index for x in Q.failed_indexes(log).collect()) == [2, 3]


def test_runtime_error_is_logged_and_others_go_on(spark):
    t = spark.createDataFrame([("1",), ("x",)], "a string")
    res, log = Q.run_batch(spark, ["SELECT CAST(a AS INT) AS a FROM {t}", "SELECT a FROM {t} ORDER BY a"], t=t)
    rows = {r["index"]: r for r in log.collect()}
    assert rows[0].status == "error" and rows[0].row_count == 0 and "CAST_INVALID_INPUT" in rows[0].error
    assert rows[1].status == "ok" and rows[1].row_count == 2 and [r.a for r in res[1].collect()] == ["1", "x"]
    assert Q.first_error(log).first().failed is False
    _, bad = Q.run_batch(spark, ["SELECT x FROM nowhere", "DROP TABLE t"])
    assert Q.first_error(bad).first().error == rows_error(bad, 0)


def rows_error(log, i):
    return log.where(f"index = {i}").first().error


#: Years of work that needs neither memory nor disk.
ENDLESS = "SELECT sum(id) AS x FROM range(0, 1000000000000000, 1, 2) WHERE id % 7 = 8"


def test_a_query_that_never_ends_is_cancelled_and_delays_nobody(spark):
    """Two threads: the endless query holds one until its limit, the others use the other."""
    import time

    endless = ENDLESS
    t0 = time.perf_counter()
    res, log = Q.run_batch(spark, [endless, "SELECT 1 AS x", "SELECT x FROM nowhere", "SELECT 2 AS x", "SELECT 3 AS x"], timeout=6, workers=2)
    took = time.perf_counter() - t0
    rows = log.orderBy("index").collect()
    assert [r.status for r in rows] == ["timeout", "ok", "error", "ok", "ok"] and list(res) == [1, 3, 4]
    assert [res[i].first().x for i in res] == [1, 2, 3]
    assert rows[0].error == "Query 1 timed out after 6.0s" and rows[0].row_count == 0
    assert 6000 <= rows[0].duration_ms < 14000 and took < 20
    assert max(r.duration_ms for r in rows[1:]) < 6000
    assert Q.run_rollup(log).first().queries_failed == 2
    time.sleep(0.5)
    assert not spark.sparkContext.statusTracker().getActiveJobsIds()
    assert Q.guarded(spark, "SELECT 1 AS x")[1].first().x == 1          # the session is as before


def test_waiting_is_no_part_of_the_duration_or_the_limit(spark):
    """One thread: queries that wait longer than the limit still run."""
    res, log = Q.run_batch(spark, [ENDLESS, ENDLESS, "SELECT 1 AS x"], timeout=3, workers=1)
    rows = log.orderBy("index").collect()
    assert [r.status for r in rows] == ["timeout", "timeout", "ok"] and list(res) == [2] and rows[2].duration_ms < 3000
    none, empty = Q.run_batch(spark, ["  ", ""], timeout=1)
    assert none == {} and empty.count() == 0
    _, free = Q.run_batch(spark, ["SELECT 1"], timeout=None)
    assert free.first().status == "ok"


def test_a_query_that_is_given_up_leaves_no_job(spark, monkeypatch):
    """It analyses for longer than limit and grace, and only then would start its job."""
    import time

    guarded = Q.guarded

    def slow(spark_, sql, *a, **k):
        if "range(0" in sql:
            spark_.sparkContext._jvm.java.lang.Thread.sleep(3500)
            # the check of the limit comes before the job; let the job start all the same
            ok, df, err = guarded(spark_, sql, *a, **k)
            df.collect()
        return guarded(spark_, sql, *a, **k)

    monkeypatch.setattr(Q, "guarded", slow)
    t0 = time.perf_counter()
    res, log = Q.run_batch(spark, [ENDLESS, "SELECT 1 AS x"], timeout=1, grace=1, workers=1)
    assert [r.status for r in log.orderBy("index").collect()] == ["timeout", "ok"] and time.perf_counter() - t0 < 12
    assert res[1].first().x == 1
    end = time.perf_counter() + 20
    time.sleep(3)
    while spark.sparkContext.statusTracker().getActiveJobsIds() and time.perf_counter() < end:
        time.sleep(0.2)
    assert not spark.sparkContext.statusTracker().getActiveJobsIds()


def test_batch_preview_and_trim(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, s string").orderBy("id")
    bad = spark.createDataFrame([("x",)], "s string").selectExpr("cast(s as int) as i")
    got = Q.batch_preview(spark, [t, bad, None, ValueError("no"), t.limit(0)], max_rows=2).first().preview
    assert got == '{"results":[{"rows":[{"id":1,"s":"a"},{"id":2,"s":"b"}]},{"rows":[]},{"rows":[]},{"rows":[]},{"rows":[]}]}'
    row = '{"id":1,"s":"a"}'
    cut = lambda text, *a: spark.createDataFrame([(text,)], "p string").select(Q.trim_preview("p", *a)).first()[0]
    many = '{"rows":[' + ",".join([row] * 5) + "]}"
    assert cut(many, 2) == '{"rows":[' + row + "," + row + "]}"
    assert cut(many, 40, 2 * (len(row) + 1)) == cut(many, 2) and cut(many, 40, 3) == '{"rows":[]}'
    assert cut('{"results":[' + many + ',{"rows":[]},"odd"]}', 1) == '{"results":[{"rows":[' + row + ']},{"rows":[]},{"rows":[]}]}'
    assert cut("no json") == "no json" and cut(None) is None and cut('{"x":1}') == '{"x":1}'


def test_query_summary_names_the_first_five_columns(spark):
    rows = [("SELECT a FROM t GROUP BY a ORDER BY a LIMIT 3", '{"rows":[{"a":1,"b":2,"c":3,"d":4,"e":5,"f":6}]}'),
            ("select 1", '{"rows":[]}'), ("select 1", "broken"), ("", '{"rows":[{"a":1}]}'), (None, None), ("select 1", '{"rows":[7]}')]
    got = [r[0] for r in spark.createDataFrame(rows, "q string, p string").select(Q.query_summary("q", "p")).collect()]
    plain = "read-only analytical query; grouped=False, ordered=False, limited=False"
    assert got == ["analytical select with columns [a, b, c, d, e]; grouped=True, ordered=True, limited=True", plain, plain,
                   "multi-query KPI and trend summary", "multi-query KPI and trend summary", plain]
