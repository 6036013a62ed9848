"""Sinks (A7-A11): raw and mart layers as tables, processed data and the analysis
artefacts as DataFrames written by the executors, on any storage Spark can write."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tillpoint.functions.text import renamed
from tillpoint.sources.csv import sanitize_columns

# Headings of the reports.
ISSUE_TITLE = "DATA QUALITY ISSUES REPORT"
REPORT_TITLE = "# Multi-File Schema Analysis Report"
FILES_HEAD = ("## Files Summary", "| File | Type | Rows | Columns | Domain |", "|------|------|------|---------|--------|")
COMPARE_HEAD, ADVICE_HEAD, COLUMNS_HEAD = "## Schema Comparison", "### Recommendations", "## Detailed Column Analysis"
COLUMN_HEAD = ("| Column | Type | Business Meaning | Nulls % | Unique % |", "|--------|------|------------------|---------|----------|")
PROCESSED = "processed"


def _ensure_db(spark: SparkSession, db: str) -> None:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{db}`")


def _rename(spark: SparkSession, old: str, new: str) -> None:
    spark.sql(f"ALTER TABLE {old} RENAME TO {new}")


def repair_table(spark: SparkSession, database: str, name: str) -> bool:
    """Bring back a table whose swap was cut off between its two renames: the table is
    missing and its last version stands beside it.  Whether that was so."""
    if spark.catalog.tableExists(f"`{database}`.`{name}`"):
        return False
    old = sorted(t.name for t in spark.catalog.listTables(database) if re.fullmatch(re.escape(name.lower()) + "__old_[0-9a-f]{8}", t.name))
    if not old:
        return False
    _rename(spark, f"`{database}`.`{old[-1]}`", f"`{database}`.`{name}`")
    return True


def replace_table(df: DataFrame, database: str, name: str) -> int:
    """Replace ``database.name`` by the rows of ``df`` in one step for readers; the number of rows.

    The rows are written to a table beside it, which then takes its name.  Whatever fails
    before that (a bad row, a lost job, a name that can't be used) leaves the old table as it
    was, and the half-written one is dropped; a swap that fails after the first rename is
    turned back.  A driver that dies between the two renames leaves the old version beside,
    which the next load brings back first.  ``df`` may read the table that it replaces.  The
    count comes from the write itself, not from a second scan."""
    spark = df.sparkSession
    repair_table(spark, database, name)
    mark = uuid.uuid4().hex[:8]
    full, new, old = (f"`{database}`.`{n}`" for n in (name, f"{name}__new_{mark}", f"{name}__old_{mark}"))
    seen = Observation()
    try:
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.saveAsTable(new)
        rows = int(seen.get["n"])
        there = spark.catalog.tableExists(full)
        if there:
            _rename(spark, full, old)
        try:
            _rename(spark, new, full)
        except Exception:
            if there:
                _rename(spark, old, full)
            raise
    except Exception:
        spark.sql(f"DROP TABLE IF EXISTS {new}")
        raise
    if there:
        spark.sql(f"DROP TABLE {old}")
    return rows


def load_raw(spark: SparkSession, frames: dict, database: str = "raw") -> tuple[dict, DataFrame]:
    """One table per file, ``raw.raw_<identifier of the stem>``; files whose stems
    give the same identifier get numbered tables.  Each table is replaced in one step, so a
    file that fails to load leaves its earlier rows.  Returns ``{path: table}`` and a report
    ``(path, table_name, status, error, row_count)`` with a row for every file, failed ones included."""
    _ensure_db(spark, database)
    stems = [str(p).rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0] for p in frames]
    tables = dict(zip(frames, (f"raw_{n}" for n in renamed(stems))))
    rows, done = [], {}
    for path, df in frames.items():
        error, count = df if isinstance(df, Exception) else None, None
        if error is None:
            try:
                count = replace_table(sanitize_columns(df)[0], database, tables[path])
                done[path] = f"{database}.{tables[path]}"
            except Exception as e:  # noqa: BLE001 - reported per file, the others go on
                error = e
        text = None if error is None else (str(error).strip().splitlines() or [type(error).__name__])[0]
        rows.append((str(path), done.get(path), "failed" if error else "loaded", text, count))
    return done, spark.createDataFrame(rows, "path string, table_name string, status string, error string, row_count bigint")


def load_mart(df: DataFrame, table: str = "mart.sales_clean") -> int:
    """Create the database if missing, replace the table in one step, return its row
    count (a name without a database goes to ``mart``)."""
    db, name = table.split(".", 1) if "." in table else ("mart", table)
    _ensure_db(df.sparkSession, db)
    return replace_table(df, db, name)


def processed_basename(base: str | None) -> str:
    """``<base>_processed``, once."""
    stem = (base or "").strip().removesuffix(f"_{PROCESSED}") or f"{PROCESSED}_sales"
    return f"{stem}_{PROCESSED}"


def issue_lines(issues: DataFrame) -> DataFrame:
    """The quality-issue report as one ordered text column ``value``."""
    head = issues.sparkSession.createDataFrame([(-1, 0, ISSUE_TITLE), (-1, 1, "=" * 80), (-1, 2, "")], "seq int, i int, value string")
    each = F.array(F.concat(F.lit("["), "severity", F.lit("] "), "type"), F.concat(F.lit("  "), "details"), F.lit(""))
    body = issues.select(F.col("seq").cast("int").alias("seq"), F.posexplode(each).alias("i", "value"))
    return head.union(body).orderBy("seq", "i").select("value")


def save_processed(prep, output_dir: str, basename: str | None = None, fmt: str = "parquet") -> dict:
    """The data as ``<base>_processed`` (parquet, or csv with a header), the summary
    as JSON lines, and the issue report as text when there are issues."""
    base = f"{output_dir.rstrip('/')}/{processed_basename(basename)}"
    out = {"data": base + ("" if fmt == "parquet" else ".csv"), "summary": base + "_summary.json"}
    prep.data.write.mode("overwrite").format(fmt).option("header", True).save(out["data"])
    roles = F.create_map(*(F.lit(v) for k, c in vars(prep.roles).items() if c for v in (k, c)))
    listed = prep.issues.agg(F.count(F.lit(1)).alias("quality_issues"),
                             F.array_sort(F.collect_list(F.struct("seq", "severity", "type", "details"))).alias("quality_issues_list"))
    (prep.summary.crossJoin(listed)       # one row beside one row
     .withColumns({"date_format": F.lit(prep.date_format), "column_mapping": roles})
     .coalesce(1).write.mode("overwrite").json(out["summary"]))
    if not prep.issues.isEmpty():
        out["issues"] = base + "_quality_issues.txt"
        issue_lines(prep.issues).coalesce(1).write.mode("overwrite").text(out["issues"])
    return out


def ddl(columns: DataFrame) -> DataFrame:
    """A10: ``(table_name, ddl)``, a CREATE TABLE text per table of an annotated column
    catalogue, with the recommended SQL types (J9) in column order."""
    field = F.struct("ordinal", F.concat(F.lit("  "), "column_name", F.lit(" "), "sql_type").alias("text"))
    lines = F.transform(F.array_sort(F.collect_list(field)), lambda f: f["text"])
    body = columns.groupBy("table_name").agg(F.array_join(lines, ",\n").alias("body"))
    return body.select("table_name", F.concat(F.lit("CREATE TABLE "), "table_name", F.lit(" (\n"), "body", F.lit("\n);")).alias("ddl"))


def report_lines(files: DataFrame, columns: DataFrame, compatibility: DataFrame | None = None,
                 recommendations: DataFrame | None = None) -> DataFrame:
    """A10: the schema-analysis report as an ordered text column ``value``: file table,
    compatibility, recommendations, and a column table per file."""
    spark = columns.sparkSession
    order = "section int, name string, ordinal int, i int, value string"
    fixed = [(0, 0, REPORT_TITLE), (0, 1, ""), *((0, 2 + i, t) for i, t in enumerate((FILES_HEAD[0], "", *FILES_HEAD[1:]))),
             (2, 0, ""), (2, 1, COMPARE_HEAD), (2, 2, "")]
    fixed += [(4, 0, ADVICE_HEAD), (4, 1, "")] if recommendations is not None else []
    fixed += [(6, 0, ""), (6, 1, COLUMNS_HEAD), (6, 2, "")]
    parts = [spark.createDataFrame([(s, "", 0, i, t) for s, i, t in fixed], order)]
    row = lambda *cells: F.concat(F.lit("| "), *[x for c in cells for x in (c, F.lit(" | "))][:-1], F.lit(" |"))
    line = lambda df, section, name, ordinal, *texts: df.select(
        F.lit(section).alias("section"), name.alias("name"), ordinal.cast("int").alias("ordinal"),
        F.posexplode(F.array(*texts)).alias("i", "value"))
    none, zero = F.lit(""), F.lit(0)
    parts.append(line(files, 1, F.col("table_name"), zero, row(
        F.col("table_name"), F.col("file_type"), F.format_number("rows", 0), F.col("columns").cast("string"), F.col("business_domain"))))
    if compatibility is not None:
        parts.append(line(compatibility, 3, none, zero, F.concat(F.lit("**Compatibility:** "), "schema_compatibility"), none,
                          F.concat(F.lit("**Unification Strategy:** "), "unification_strategy"), none))
    if recommendations is not None:
        parts.append(line(recommendations, 5, none, F.col("seq"), F.concat(F.lit("- "), "recommendation")))
    parts.append(line(columns.select("table_name").distinct(), 7, F.col("table_name"), zero, none,
                      F.concat(F.lit("### "), "table_name"), none, *map(F.lit, COLUMN_HEAD)))
    share = lambda c: F.concat(F.format_string("%.1f", c), F.lit("%"))
    parts.append(line(columns, 7, F.col("table_name"), F.col("ordinal"), row(
        F.col("column_name"), F.col("inferred_type"), F.col("business_meaning"), share("null_pct"), share("unique_pct"))))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.orderBy("section", "name", "ordinal", "i").select("value")
