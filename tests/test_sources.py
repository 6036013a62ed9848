"""CSV sources and schema analysis on small literal files written per run."""

import tempfile

from tillpoint.operators import compare as J
from tillpoint.operators.profile import column_profile
from tillpoint.sources.csv import discover, file_encodings, read_csv, read_csv_files, sanitize_columns
from tillpoint.sources.sinks import load_mart


def _write(d, name, text, enc="utf-8"):
    with open(f"{d}/{name}", "w", encoding=enc) as f:
        f.write(text)


def test_csv_files(spark):
    d = tempfile.mkdtemp(prefix="tillpoint-csv-")
    _write(d, "sales_a.csv", "Date,Customer Name,SKU Code,Qty,Rate,Gross Amt,Unnamed: 6\n"
                             "06-05-21,Ann,S1,2,10,20,\n07-05-21,Bob,S2,1,5,5,\n")
    _write(d, "sales_b.csv", "Date,Customer Name,SKU Code,Qty,Size,Gross Amt\n06-05-21,José,S1,2,M,20\n",
           enc="latin-1")
    _write(d, "catalog.csv", "SKU,Category,MRP,Amazon MRP,Flipkart MRP\nS1,Kurta,100,90,95\n")
    _write(d, "names.csv", "2021 Sales,a b,a-b,a_b_2,\n1,2,3,4,5\n")
    paths = discover(spark, d)
    assert [p.rsplit("/", 1)[-1] for p in paths] == ["catalog.csv", "names.csv", "sales_a.csv", "sales_b.csv"]
    enc = {p.rsplit("/", 1)[-1]: e for p, e in file_encodings(spark, paths).items()}
    assert enc["sales_b.csv"] == "ISO-8859-1" and enc["sales_a.csv"] == "utf-8"
    assert file_encodings(spark, paths, "ascii")[[p for p in paths if p.endswith("sales_b.csv")][0]] == "ISO-8859-1"
    frames = read_csv_files(spark, paths)
    b = frames[[p for p in paths if p.endswith("sales_b.csv")][0]]
    assert b.first()["Customer Name"] == "José"
    names = frames[[p for p in paths if p.endswith("names.csv")][0]]
    assert sanitize_columns(names)[0].columns == ["c_2021_sales", "a_b", "a_b_2", "a_b_2_2", "c4"] or \
        sanitize_columns(names)[0].columns[:4] == ["c_2021_sales", "a_b", "a_b_2", "a_b_2_2"]
    cat = None
    for p, df in frames.items():
        prof = column_profile(df, p.rsplit("/", 1)[-1])
        cat = prof if cat is None else cat.unionByName(prof)
    types = {r.table_name: r.file_type for r in J.file_types(cat).collect()}
    assert types["sales_a.csv"] == "TRANSACTIONAL" and types["catalog.csv"] == "PRODUCT_CATALOG"
    assert J.compatibility(J.file_types(cat)).first().schema_compatibility.startswith("PARTIAL")


def test_price_comparison_literal(spark):
    rows = [("Heads", "Price (Per Unit)", None), ("Storage", "₹4.00", "Rs 0.15/- Per Day"),
            ("Pick", "15.5", "15.5"), ("Pack", None, None), ("Ship", "3", "7")]
    df = spark.createDataFrame(rows, "item string, a string, b string")
    r = J.compare_prices(df, "item", "a", "b").first()
    assert (r.row_count, r.cheaper_a, r.cheaper_b, r.ties) == (3, 1, 1, 1)


def test_mart_load(spark):
    n = load_mart(spark.range(5).toDF("id"), "sales_clean_test")
    assert n == 5 and spark.table("mart.sales_clean_test").count() == 5


def test_encodings_with_blanks_and_other_letters_in_names(spark):
    d = tempfile.mkdtemp(prefix="tillpoint csv é-")
    _write(d, "b c+d.csv", "Name\nJosé\n", enc="latin-1")
    _write(d, "ü%20.csv", "Name\nJosé\n")
    with open(f"{d}/odd.csv", "wb") as f:
        f.write(b"Name\nx\x81y\n")
    paths = discover(spark, d)
    for given in (paths, [p.replace("file:", "") for p in paths]):
        enc = {p.rsplit("/", 1)[-1]: e for p, e in file_encodings(spark, given).items()}
        assert enc == {"b c+d.csv": "ISO-8859-1", "ü%20.csv": "utf-8", "odd.csv": "ISO-8859-1"}
    enc = {p.rsplit("/", 1)[-1]: e for p, e in file_encodings(spark, paths, "cp1252").items()}
    assert enc == {"b c+d.csv": "windows-1252", "ü%20.csv": "windows-1252", "odd.csv": "ISO-8859-1"}
    frames = read_csv_files(spark, [f"{d}/b c+d.csv"])
    assert [f.first()["Name"] for f in frames.values()] == ["José"]


def test_quoted_line_breaks_are_opt_in(spark):
    d = tempfile.mkdtemp(prefix="tillpoint-csv-")
    _write(d, "m.csv", 'a,b\n1,"x\ny"\n')
    assert [r.b for r in read_csv(spark, f"{d}/m.csv", multi_line=True).collect()] == ["x\ny"]
    assert read_csv(spark, f"{d}/m.csv", schema="a string, b string").count() == 2
