"""Cleaning job on literal rows: cases the derived tables do not contain
(all-null row, negative rate, future and implausible dates)."""

from tillpoint.plans.preprocess import preprocess

ROWS = [
    ("1", "06-05-21", "  alice  ", "2", "10", "20.00", "M"),
    ("1", "06-05-21", "alice", "2", "10", " 20.00 ", "M"),        # exact copy after trimming
    ("3", "07-09-27", "Apr-22", "1", "-5", "-5", "SMALL"),          # future date, negative rate
    ("4", "01-01-30", "bob", "3", "4", "13", "large"),              # implausible year (> as_of + 1)
    (None, None, None, None, None, None, None),                     # all-null row
    ("AVIN", "01-02-21", "x", "1", "1", "1", "S"),                  # junk index
    ("5", "02-03-21", "carol", "n/a", "3", "₹9,999,999.00", "XL"),
]
SCHEMA = "Index string, `Order Date` string, Customer string, Qty string, Rate string, Amount string, Size string"


def test_preprocess_literal_rows(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    p = preprocess(df, as_of="2026-01-01 00:00:00")
    rows = {r.INDEX: r for r in p.data.collect()}
    assert set(rows) == {"1", "3", "4", "5"}
    assert rows["3"].flag_negative_rate and rows["3"].flag_future_date and rows["3"].flag_invalid_customer
    assert rows["4"].flag_invalid_date and rows["4"].date_parsed is None and rows["4"].year is None
    assert rows["1"].CUSTOMER_normalized == "Alice" and rows["1"].size_normalized == "M"
    assert rows["1"].has_quality_issues is False
    kinds = {(r.type, r.details) for r in p.issues.collect()}
    assert ("Empty Rows", "Removed 1 completely empty rows") in kinds
    assert ("Duplicates", "Found 1 exact duplicate records") in kinds
    assert ("Data Quality", "Found 1 rows with text in INDEX column") in kinds
    assert ("Date Range", "1 dates beyond year 2027") in kinds
    s = p.summary.first()
    assert s.total_rows_processed == 4
    flags = [c for c in p.data.columns if c.startswith("flag_")]
    for r in rows.values():
        assert r.has_quality_issues == any(getattr(r, f) for f in flags)


def test_preprocess_is_idempotent_on_clean_text(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    once = preprocess(df, as_of="2026-01-01 00:00:00").data.select("INDEX", "CUSTOMER", "SIZE")
    twice = preprocess(once, as_of="2026-01-01 00:00:00").data.select("INDEX", "CUSTOMER", "SIZE")
    assert sorted(once.collect()) == sorted(twice.collect())


def test_pass_four_runs_in_methods_that_the_jvm_compiles(spark, monkeypatch):
    """HotSpot does not compile a method of more than 8,000 bytes of byte code."""
    import tillpoint.plans.preprocess as P
    from conftest import SMOKE
    from tillpoint.plans.dirty_sales import dirty_sales

    sizes, real = {}, P.materialize
    debug = spark._jvm.java.lang.Class.forName("org.apache.spark.sql.execution.debug.package$").getField("MODULE$").get(None)

    def spy(df, name="stage"):
        parts = debug.codegenStringSeq(df._jdf.queryExecution().executedPlan())
        sizes[name] = [parts.apply(i)._3().maxMethodCodeSize() for i in range(parts.size())]
        return real(df, name)

    monkeypatch.setattr(P, "materialize", spy)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")      # else the plan has no generated code before it runs
    try:
        preprocess(dirty_sales(spark, SMOKE), as_of="2026-01-01", index_col="IDX")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert sizes["preprocessed"] and max(sizes["preprocessed"]) < 8000, sizes


def test_marks_count_each_condition(spark):
    from pyspark.sql import functions as F

    from tillpoint.plans.preprocess import MARKS, marked, tally

    df = spark.range(100).withColumn("x", F.when(F.col("id") < 90, F.col("id")))
    conds = {f"k{i}": F.col("x") % (i + 1) == 0 for i in range(2 * MARKS + 3)}
    for apart in (False, True):
        got, where = marked(df, conds, "_m", apart)
        assert {c for c, _ in where.values()} == {"_m0", "_m1", "_m2"}
        assert tally(got, where) == {f"k{i}": len(range(0, 90, i + 1)) for i in range(2 * MARKS + 3)}
        assert tally(got.limit(0), where) == dict.fromkeys(where, 0)
