"""Guarded query runner and its run log."""

from __future__ import annotations

import re
import threading
import time
import uuid

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillpoint.functions.text import WS_CLASS

# Statement words refused inside a SELECT (each with its space).
FORBIDDEN = ("insert ", "update ", "delete ", "drop ", "alter ", "create ", "attach ", "copy ", "export ",
             "pragma ", "call ")
# The hint appended to conversion errors.
CONVERSION_HINT = " | Hint: use TRY_CAST(...) and filter out null casts for numeric fields."
# Fixed value: the preview of a result that can't be shown.
NO_ROWS = '{"rows":[]}'


def is_safe_select(sql) -> Column:
    """C9 over a column of query texts: starts with ``select `` and holds none
    of the forbidden words, or starts with ``with `` (then unchecked).  Known
    gaps kept: ``select\\n`` and ``last_update `` are refused, ``with ... delete``
    and ``select 1; truncate t`` pass."""
    s = F.lower(F.regexp_replace(F.col(sql) if isinstance(sql, str) else sql, f"^{WS_CLASS}+|{WS_CLASS}+$", ""))
    bad = None
    for tok in FORBIDDEN:
        bad = s.contains(tok) if bad is None else (bad | s.contains(tok))
    return (F.when(s.isNull() | (s == ""), False).when(s.startswith("with "), True)
             .when(~s.startswith("select "), False).otherwise(~bad))


def guarded(spark: SparkSession, sql: str, max_rows: int = 200, **frames):
    """``(ok, DataFrame | None, error)``.  The text is checked with C9, a
    trailing ``;`` is dropped, and the cap goes into the plan
    (``SELECT * FROM (<sql>) LIMIT n``): Spark's parser refuses DML, DDL and
    several statements, an inner ORDER BY becomes a TakeOrderedAndProject.
    Errors are returned, not raised.  Like C9 this is no sandbox: a SELECT may read
    any path and call any function the session may.  ``frames`` are DataFrames the text names
    as ``{name}`` (``spark.sql`` parameters: no temp view is registered)."""
    if not spark.range(1).select(is_safe_select(F.lit(sql).cast("string"))).first()[0]:
        return False, None, "Only SELECT queries are allowed"
    body = re.sub(r";\s*$", "", sql.strip())
    try:
        df = spark.sql(f"SELECT * FROM (\n{body}\n) LIMIT {int(max_rows)}", **frames)
        return True, df, None
    except Exception as e:  # noqa: BLE001 - report every failure as text
        return False, None, str(e).strip().splitlines()[0] if str(e).strip() else type(e).__name__


def augment_error(error) -> Column:
    """L4 over a column of error texts."""
    e = F.col(error) if isinstance(error, str) else error
    hit = e.contains("Could not convert string") | e.contains("Conversion Error")
    return F.when(hit, F.concat(e, F.lit(CONVERSION_HINT))).otherwise(e)


def query_features(sql) -> dict:
    """L3: grouped / ordered / limited flags of a query text column."""
    s = F.lower(F.col(sql) if isinstance(sql, str) else sql)
    return {"grouped": s.contains("group by"), "ordered": s.contains("order by"), "limited": s.contains("limit")}


def first_columns(preview, most: int = 5) -> Column:
    """L3: names of the first ``most`` columns of a preview's first row, in order; null unless
    the preview is ``{"rows": [{...}, ...]}`` with a row that is an object.  Only the keys are read."""
    rows = F.from_json(F.col(preview) if isinstance(preview, str) else preview, "struct<rows: array<string>>")["rows"]
    return F.slice(F.json_object_keys(F.get(rows, F.lit(0))), 1, most)


def query_summary(sql, preview) -> Column:
    """L3: one line on a query for a reader who must not see its text: the first five
    result columns, where the preview shows a row, and the three flags."""
    text = F.col(sql) if isinstance(sql, str) else sql
    flag = {k: F.when(v, "True").otherwise("False") for k, v in query_features(text).items()}
    flags = F.concat(*(x for k, v in flag.items() for x in (F.lit(f"{k}="), v, F.lit(", "))))
    flags = F.regexp_replace(flags, ", $", "")
    names = first_columns(preview)
    return (F.when(text.isNull() | (text == ""), "multi-query KPI and trend summary")
             .when(names.isNotNull(), F.concat(F.lit("analytical select with columns ["), F.array_join(names, ", "), F.lit("]; "), flags))
             .otherwise(F.concat(F.lit("read-only analytical query; "), flags)))


class _Run:
    """One guarded query of a batch, run in a thread under a job tag of its own."""

    def __init__(self, spark: SparkSession, index: int, sql: str, max_rows: int, frames: dict):
        self.spark, self.index, self.sql, self.max_rows, self.frames = spark, index, sql, max_rows, frames
        self.tag = f"tillpoint-query-{uuid.uuid4().hex}"
        self.started: float | None = None
        self.late, self.ended = threading.Event(), threading.Event()
        self.rows, self.schema, self.error, self.duration = [], None, None, 0.0

    def __call__(self) -> None:
        sc = self.spark.sparkContext
        self.started = time.perf_counter()
        sc.addJobTag(self.tag)
        try:
            ok, df, self.error = guarded(self.spark, self.sql, self.max_rows, **self.frames)
            if ok and not self.late.is_set():
                self.rows, self.schema = df.collect(), df.schema
        except Exception as e:  # noqa: BLE001 - an error of this query only
            self.error = (str(e).strip().splitlines() or [type(e).__name__])[0]
        finally:
            sc.removeJobTag(self.tag)
            self.duration = time.perf_counter() - self.started
            self.ended.set()

    def watch(self, timeout: float) -> None:
        """Cancel the query's jobs once it has run for ``timeout`` seconds; again and again,
        because an adaptive plan starts further jobs."""
        if self.started is None or self.ended.is_set() or time.perf_counter() - self.started < timeout:
            return
        self.late.set()
        self.spark.sparkContext.cancelJobsWithTag(self.tag)

    def give_up(self) -> None:
        """Go on cancelling in the background: a query that is still analysing starts its jobs
        later, and nobody waits for them any more."""
        def reap():
            while not self.ended.wait(0.5):
                self.spark.sparkContext.cancelJobsWithTag(self.tag)
        threading.Thread(target=reap, daemon=True).start()

    def entry(self, timeout: float) -> tuple:
        if self.late.is_set() and self.schema is None:
            took = self.duration if self.ended.is_set() else time.perf_counter() - self.started
            return (self.index, "timeout", 0, int(took * 1000), f"Query {self.index + 1} timed out after {timeout:.1f}s")
        return (self.index, "ok" if self.schema is not None else "error", len(self.rows), int(self.duration * 1000),
                None if self.schema is not None else self.error)


def run_batch(spark: SparkSession, queries, max_rows: int = 200, timeout: float | None = 20.0, workers: int = 4,
              grace: float = 10.0, **frames):
    """Run the guarded queries, ``workers`` at a time; independent failures.  Returns
    ``(results, run_log)``: results ``{index: DataFrame}`` of the queries that ran, in order of
    index, and the log ``(index, status, row_count, duration_ms, error)``.

    Each query runs once, in a thread, under a job tag of its own: its capped rows
    (``max_rows`` at most) are fetched, and the count, the status and the returned result all
    come from them, so a query that fails in any of its columns is an error.  A query that
    runs longer than ``timeout`` seconds is cancelled by its tag and logged as ``timeout``.  Time
    counts from its own start: waiting for a free thread is neither limited nor part of the
    duration, and a slow query holds one thread only.  A thread that has not ended ``grace``
    seconds after its cancellation (it is not in a job, say, but still analysing) is given up:
    its query is a timeout, its place goes to the next one, and jobs that it starts later are
    cancelled too.  Jobs of threads share the
    executors; ``spark.scheduler.mode=FAIR`` keeps a large query from holding up small ones.
    Conversion errors carry the L4 hint."""
    texts = [str(q).strip() for q in queries if str(q).strip()]
    runs = [_Run(spark, i, q, max_rows, frames) for i, q in enumerate(texts)]
    waiting, active = list(reversed(runs)), []
    while waiting or active:
        while waiting and len(active) < max(1, workers):
            active.append(waiting.pop())
            # the caller's local properties (pool, description) hold in the thread too
            threading.Thread(target=inheritable_thread_target(spark)(active[-1]), daemon=True).start()
        active[0].ended.wait(0.05)
        for run in active:
            if timeout is not None:
                run.watch(timeout)
        for run in [r for r in active if r.late.is_set() and not r.ended.is_set() and time.perf_counter() - r.started > timeout + grace]:
            run.give_up()
            active.remove(run)
        active = [r for r in active if not r.ended.is_set()]
    log = [r.entry(timeout or 0.0) for r in runs]
    results = {r.index: spark.createDataFrame(r.rows, r.schema) for r, e in zip(runs, log) if e[1] == "ok"}
    run_log = spark.createDataFrame(log, "index int, status string, row_count bigint, duration_ms bigint, error string")
    return results, run_log.withColumn("error", augment_error("error"))


def first_error(run_log: DataFrame) -> DataFrame:
    """``(failed, error)``: whether every query of the batch failed, and then the
    error of the first one, else null."""
    all_bad = F.min((F.col("status") != "ok").cast("int")) == 1
    return run_log.agg(F.coalesce(all_bad, F.lit(False)).alias("failed"),
                       F.when(all_bad, F.min_by("error", "index")).alias("error"))


def run_rollup(run_log: DataFrame, run: str | None = None) -> DataFrame:
    """G14 per run: queries_total, queries_ok, queries_failed and total_duration_ms
    (negatives clamped to 0).  Records whose status is not ok/error/timeout are skipped
    as invalid.  ``failed_indexes`` gives the failed queries."""
    valid = run_log.where(F.col("status").isin("ok", "error", "timeout"))
    return valid.groupBy(*([run] if run else [])).agg(
        F.count(F.lit(1)).alias("queries_total"), F.count_if(F.col("status") == "ok").alias("queries_ok"),
        F.count_if(F.col("status") != "ok").alias("queries_failed"),
        F.sum(F.greatest(F.col("duration_ms"), F.lit(0))).cast("bigint").alias("total_duration_ms"))


def failed_indexes(run_log: DataFrame, run: str | None = None) -> DataFrame:
    """``(run, failed_index)``, one row per failed query (indexes from 1), as a long
    table, so a run of any size needs no list."""
    failed = run_log.where(F.col("status").isin("error", "timeout"))
    return failed.select(*([run] if run else []), (F.col("index") + 1).alias("failed_index"))


def json_preview(df: DataFrame, max_rows: int = 50) -> DataFrame:
    """One row ``preview`` = ``{"rows": [...]}`` of the first ``max_rows``
    rows (bounded by ``max_rows``, whatever the input size)."""
    head = df.limit(max_rows)
    return head.agg(F.to_json(F.struct(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
                                       .alias("rows"))).alias("preview"))


def trim_preview(preview, max_rows: int = 40, max_bytes: int | None = None) -> Column:
    """Keep the first ``max_rows`` rows of a ``{"rows": [...]}`` preview, and of a
    ``{"results": [preview, ...]}`` one of each part (``{"rows":[]}`` for a part of any other
    form); other texts are returned unchanged.
    With ``max_bytes`` a part also ends before the row that would bring its rows over that size."""
    p = F.col(preview) if isinstance(preview, str) else preview

    def cut(rows):
        rows = F.slice(rows, 1, max_rows)
        if max_bytes is not None:
            # running sizes: a row stays while all up to it, with a comma each, fit
            sizes = F.aggregate(rows, F.struct(F.lit(0).alias("size"), F.lit(0).alias("fit")), lambda s, x: F.struct(
                (s["size"] + F.octet_length(x) + 1).alias("size"),
                (s["fit"] + (s["size"] + F.octet_length(x) + 1 <= max_bytes).cast("int")).alias("fit")))
            rows = F.slice(rows, F.lit(1), sizes["fit"])
        return F.concat(F.lit('{"rows":['), F.array_join(rows, ","), F.lit("]}"))

    rows = F.from_json(p, "struct<rows: array<string>>")["rows"]
    parts = F.from_json(p, "struct<results: array<string>>")["results"]
    one = lambda t: F.coalesce(cut(F.from_json(t, "struct<rows: array<string>>")["rows"]), F.lit(NO_ROWS))
    return (F.when(rows.isNotNull(), cut(rows))
             .when(parts.isNotNull(), F.concat(F.lit('{"results":['), F.array_join(F.transform(parts, one), ","), F.lit("]}")))
             .otherwise(p))


def batch_preview(spark: SparkSession, results, max_rows: int = 50, keep_rows: int = 40, max_bytes: int | None = None) -> DataFrame:
    """A16, batch form: one row ``preview`` = ``{"results": [{"rows": [...]}, ...]}`` over several
    results, in their order.  A part that fails, or is no DataFrame (None, an exception), shows
    ``{"rows":[]}``, and the others go on.  Each part is capped in its own plan (``max_rows``),
    then trimmed to ``keep_rows`` rows and ``max_bytes`` bytes."""
    texts = []
    for part in results:
        try:
            texts.append(json_preview(part, max_rows).select(trim_preview("preview", keep_rows, max_bytes)).first()[0] or NO_ROWS)
        except Exception:  # noqa: BLE001 - the failing part is shown without rows
            texts.append(NO_ROWS)
    return spark.createDataFrame([('{"results":[' + ",".join(texts) + "]}",)], "preview string")


def list_tables(spark: SparkSession, databases=None) -> DataFrame:
    """Base tables as ``schema.table``, sorted; views left out."""
    rows = []
    dbs = databases or [d.name for d in spark.catalog.listDatabases()]
    for db in dbs:
        for t in spark.catalog.listTables(db):
            if t.tableType != "VIEW" and not t.isTemporary:
                rows.append((db, t.name, f"{db}.{t.name}"))
    return spark.createDataFrame(rows, "table_schema string, table_name string, qualified string") \
                .orderBy("table_schema", "table_name")


def describe_schemas(spark: SparkSession, databases=("raw", "mart")) -> DataFrame:
    """``(table_schema, table_name, ordinal, column_name, data_type)`` for
    the tables of the given databases, in column order."""
    rows = []
    existing = {d.name for d in spark.catalog.listDatabases()}
    for db in databases:
        if db not in existing:
            continue
        for t in spark.catalog.listTables(db):
            for i, c in enumerate(spark.catalog.listColumns(f"{db}.{t.name}")):
                rows.append((db, t.name, i + 1, c.name, c.dataType))
    return spark.createDataFrame(rows, "table_schema string, table_name string, ordinal int, column_name string, "
                                       "data_type string").orderBy("table_schema", "table_name", "ordinal")
