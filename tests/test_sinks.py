"""Sinks and small helpers: A3, A4, A7, A9, A10, B15, B16, C7, N17."""

import tempfile

from pyspark.sql import functions as F

from conftest import SMOKE
from tillpoint.operators import clean as C
from tillpoint.operators import compare as J
from tillpoint.operators import kpi
from tillpoint.operators.profile import column_profile
from tillpoint.plans.dirty_sales import dirty_sales
from tillpoint.plans.preprocess import preprocess
from tillpoint.plans.questions import insight_bundle
from tillpoint.sources.csv import count_by_file, head_rows, read_csv_files, with_provenance
from tillpoint.sources.sinks import load_raw, processed_basename, report_lines, save_processed


def test_processed_sink_and_report(spark):
    out = tempfile.mkdtemp(prefix="tillpoint-out-")
    p = preprocess(dirty_sales(spark, SMOKE), as_of="2026-01-01 00:00:00", index_col="IDX")
    paths = save_processed(p, out, "dirty")
    assert processed_basename("dirty") == "dirty_processed" and processed_basename("x_processed") == "x_processed"
    assert spark.read.parquet(paths["data"]).count() == p.data.count()
    summary = spark.read.json(paths["summary"]).first()
    assert summary["quality_issues"] == p.issues.count() == len(summary["quality_issues_list"]) > 0
    assert spark.read.text(paths["issues"]).first().value == "DATA QUALITY ISSUES REPORT"
    cat = column_profile(p.data, "dirty_processed")
    files = J.file_types(cat).join(cat.groupBy("table_name").agg(F.max("n").alias("rows"),
                                                                 F.count(F.lit(1)).alias("columns")), "table_name")
    md = [r.value for r in report_lines(files, J.annotate(cat)).collect()]
    assert md[0].startswith("# ") and any(x.startswith("| dirty_processed | ") for x in md)
    assert md.index("### dirty_processed") > md.index("## Detailed Column Analysis")


def test_csv_raw_layer_and_helpers(spark):
    d = tempfile.mkdtemp(prefix="tillpoint-raw-")
    with open(f"{d}/My File (1).csv", "w", encoding="utf-8") as f:
        f.write("index, Amount ,Unnamed: 2\n1,10,\n2,20,\n3,,\n")
    frames = read_csv_files(spark, [f"{d}/My File (1).csv"])
    tables, report = load_raw(spark, frames, "raw")
    again, both = load_raw(spark, {"/a/x y.csv": df_of(spark), "/b/x-y.csv": df_of(spark), "/b/bad.csv": ValueError("no")}, "raw")
    assert sorted(again.values()) == ["raw.raw_x_y", "raw.raw_x_y_2"]
    assert [(r.path, r.status, r.error) for r in both.where("status = 'failed'").collect()] == [("/b/bad.csv", "failed", "no")]
    assert report.count() == 1
    t = list(tables.values())[0]
    assert t == "raw.raw_my_file_1"
    assert spark.table(t).columns == ["index", "amount", "unnamed_2"]
    df = list(frames.values())[0]
    assert C.drop_index_columns(df.toDF("index", "Amount", "Unnamed: 2")).columns == ["Amount"]
    assert [r.row_count for r in count_by_file(df).collect()] == [3]
    assert [r[0] for r in head_rows(df, 2, ["index"]).collect()] == [1, 2]
    assert with_provenance(df, "2026-01-01").select("source_file").first()[0] == "My File (1).csv"


def test_unique_customers_excludes_flagged(spark):
    df = spark.createDataFrame([("a", False), ("b", True), ("a", False), (None, False)], "c string, f boolean")
    assert kpi.unique_count(df, "c", "f").first()[0] == 1


def test_insight_bundle(spark):
    b = insight_bundle(spark, SMOKE)
    assert set(b) == {"kpis", "top_category", "top_region", "monthly_deltas", "yoy"}
    total = b["kpis"].first()["total"]
    assert abs(sum(r.total for r in b["top_category"].collect()) - total) < 1e-6 * total
    assert b["monthly_deltas"].count() > 1


def df_of(spark):
    return spark.range(2).toDF("id")
