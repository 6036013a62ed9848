"""Column helpers on literal rows: null, tie, malformed and edge inputs."""

import datetime as dt

from pyspark.sql import functions as F

from tillpoint.functions import text as T
from tillpoint.functions.dates import parse_with, time_dimensions


def one(spark, expr, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(expr("v").alias("r")).first()["r"]


def test_title_case_matches_python(spark):
    for s in ["o'neil mary-ann 3rd", "  ÉCOLE  du   nord ", "x", "", "abc123def", "mc donald's"]:
        got = one(spark, T.normalize_text, s)
        assert got == " ".join(s.strip().title().split()) or got == __import__("re").sub(r"\s+", " ", s.strip().title())


def test_to_number_rules(spark):
    cases = {"₹ 1,234.50": 1234.5, "$12": 12.0, "4d": None, "nan": None, "inf": None, "-3": -3.0, "1e3": 1000.0,
             "Rs 0.15/- Per Day": None, " 7 ": 7.0, None: None, ".5": 0.5}
    for s, want in cases.items():
        assert one(spark, T.to_number, s) == want, s


def test_null_tokens_and_whitespace(spark):
    for tok in T.NULL_TOKENS:
        assert one(spark, lambda c: T.null_tokens(T.collapse_ws(c)), tok) is None
    assert one(spark, lambda c: T.null_tokens(T.collapse_ws(c)), "NONE") == "NONE"
    assert one(spark, T.collapse_ws, " a \t\n b  c ") == "a b c"


def test_first_number_and_strippers(spark):
    assert one(spark, T.first_number, "Rs 0.15/- Per Day") == 0.15
    assert one(spark, T.first_number, "no digits") is None
    assert one(spark, T.strip_html, "<b>x</b> <br/>y") == "x y"
    assert one(spark, T.strip_control, "a\tb\nc\x00d\x85e") == "abcde"


def test_size_map(spark):
    for s, want in {"small": "S", " Extra Large ": "XL", "3xl": "XXXL", "ECONOMY": "ECONOMY"}.items():
        assert one(spark, T.map_size, s) == want


def test_two_digit_years_follow_python(spark):
    assert one(spark, lambda c: parse_with(c, "M-d-yy"), "06-05-70") == dt.datetime(1970, 6, 5)
    assert one(spark, lambda c: parse_with(c, "M-d-yy"), "6-5-21") == dt.datetime(2021, 6, 5)
    assert one(spark, lambda c: parse_with(c, "M-d-yy"), "13-05-21") is None
    assert one(spark, lambda c: parse_with(c, "M-d-yyyy"), "06-05-95") is None


def test_time_dimensions_2021_01_03(spark):
    d = spark.createDataFrame([(dt.date(2021, 1, 3),)], "d date")
    r = d.select(*[e.alias(k) for k, e in time_dimensions(F.col("d")).items()]).first().asDict()
    assert r == {"year": 2021, "quarter": 1, "month": 1, "month_name": "Jan-21", "day_of_week": 6,
                 "week_of_year": 53}


def test_sql_patterns(spark):
    df = spark.createDataFrame([("x -- y",), ("DROP table",), ("backdrop",), ("it's",), (None,)], "v string")
    got = [r[0] for r in df.select(T.sql_pattern("v", T.SQL_PATTERNS[0][1])).collect()]
    assert got == [False, True, False, False, False]
    got = [r[0] for r in df.select(T.sql_pattern("v", T.SQL_PATTERNS[1][1])).collect()]
    assert got == [True, False, False, False, False]


def test_identifier_rules(spark):
    assert T.renamed(["2021 Sales", "a b", "a-b", "a_b_2", "", "a b"]) == \
        ["c_2021_sales", "a_b", "a_b_2", "a_b_2_2", "col", "a_b_3"]
    assert T.renamed([" Gross Amt. ", "É b"], T.clean_header_expr) == ["GROSS_AMT", "É_B"]
    assert T.renamed([" a b"], T.explorer_header_expr) == ["A_B"]


def test_text_key_is_an_identity_key(spark):
    long_a, long_b = "x" * 63 + "a", "x" * 63 + "b"
    texts = ["short", "short", long_a, long_a, long_b, "é" * 63, "é" * 64, None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    keys = [r.k for r in df.select(T.text_key("t").alias("k")).collect()]
    assert keys[0] == keys[1] == "short" and keys[2] == keys[3] != keys[4]
    assert len(keys[2]) == 64 and keys[5] == "é" * 63 and len(keys[6]) == 64 and keys[7] is None
    assert len(set(keys[:7])) == 5


def test_dedup_and_duplicate_count_on_long_texts(spark):
    from tillpoint.operators.dedup import deduplicate, duplicate_count
    body = "lorem ipsum " * 50
    rows = [(1, body, "en"), (2, body, "en"), (3, body + ".", "en"), (4, body, "de"), (5, None, "en"), (6, None, "en")]
    df = spark.createDataFrame(rows, "id long, text string, lang string")
    kept = sorted(r.id for r in deduplicate(df, subset=["text"], order_by=["id"]).select("id").collect())
    assert kept == [1, 3, 5]
    d = duplicate_count(df.select("text", "lang")).first()
    assert (d.duplicate_rows, d.total_rows) == (2, 6)


def test_parse_by_value_equals_per_row_parse(spark):
    from tillpoint.functions.dates import AUTO_DAYFIRST_PATTERNS, parse_any
    from tillpoint.operators.dates import parse_by_value
    texts = ["03-15-95", "03-15-95", "12-01-70", "2021-1-3", "junk", None, "7/4/1999", "03-15-95"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, d string")
    expr = parse_any("d", AUTO_DAYFIRST_PATTERNS)
    want = sorted((r.i, r.p) for r in df.withColumn("p", expr).collect())
    got = parse_by_value(df, "d", expr, "p")
    assert got.columns == ["i", "d", "p"]
    assert sorted((r.i, r.p) for r in got.collect()) == want


def test_collated_strings_keep_their_equality(spark):
    from tillpoint.operators.dedup import duplicate_count
    long_a = "A" * 80
    df = spark.createDataFrame([(long_a,), (long_a.lower(),), ("b",)], "t string") \
        .select(F.col("t").cast("string collate UTF8_LCASE").alias("t"))
    d = duplicate_count(df).first()
    assert (d.duplicate_rows, d.total_rows) == (1, 3)  # 'AAA…' and 'aaa…' are equal under UTF8_LCASE


def test_parse_by_value_replaces_an_existing_column(spark):
    from tillpoint.functions.dates import parse_with
    from tillpoint.operators.dates import parse_by_value
    df = spark.createDataFrame([("2021-1-3", 1), ("x", 2)], "d string, p int")
    got = parse_by_value(df, "d", parse_with("d", "yyyy-M-d"), "p")
    assert got.columns == ["d", "p"]
    assert sorted((r.d, str(r.p)) for r in got.collect()) == [("2021-1-3", "2021-01-03 00:00:00"), ("x", "None")]


def test_title_case_marks_only_before_characters_with_case(spark):
    rows = {"customer#000000001": "Customer#000000001", "o'neil 3rd": "O'Neil 3Rd", "a--b 1\u2177": "A--B 1\u2167",
            "\ue000 b": "\ue000 B", "x 12 y": "X 12 Y", "": ""}
    df = spark.createDataFrame([(k,) for k in rows], "t string")
    assert {r.t: r.n for r in df.select("t", T.title_case("t").alias("n")).collect()} == rows


def test_duplicate_count_groups_by_one_short_key(spark):
    from tillpoint.operators.dedup import duplicate_count, row_key

    rows = [("a", "b" * 70, 1), ("a", "b" * 70, 1), ("ab", "b" * 69, 1), ("a", None, 1), ("a", None, 1), (None, "a", 1),
            ("a", "", 1), ("-", "1:a", 1), ("-1:a", "", 1), ("a", "b" * 70, 2), (None, None, None), (None, None, None)]
    df = spark.createDataFrame(rows, "s string, t string, n int")
    d = duplicate_count(df).first()
    assert (d.duplicate_rows, d.total_rows) == (len(rows) - len(set(rows)), len(rows))
    keys = df.select(*row_key(df, df.columns))
    assert [t for _, t in keys.dtypes] == ["int", "binary"]
    assert keys.agg(F.max(F.octet_length("_texts"))).first()[0] == 32


def test_parse_by_value_derives_columns_once_per_text(spark):
    from tillpoint.functions.dates import parse_with
    from tillpoint.operators.dates import parse_by_value
    df = spark.createDataFrame([("2021-1-3", 1), ("x", 2), (None, 3)], "d string, i int")
    got = parse_by_value(df, "d", parse_with("d", "yyyy-M-d"), "p", derived=time_dimensions)
    assert got.columns[:4] == ["d", "i", "p", "year"]
    assert sorted((r.i, r.year, r.month_name) for r in got.collect()) == [(1, 2021, "Jan-21"), (2, None, None), (3, None, None)]


def test_common_texts_are_spared_translate_and_odd_ones_are_not(spark):
    import re

    odd = [*T._WS_CHARS, *T._CONTROL, "​", "⁠", "﻿", "\U0001f600", "₹", "£", "अ", ",", "$", "<", "a", "7"]
    texts = ["", " ", "plain text", "customer#000000001", "o'neil 3rd", "ασ ασ\tα", "a\n", "\na", "₹ 1,234.50 "]
    texts += [f"x{c}{c}y" for c in odd] + [f"{c}{a}z" for c in odd for a in odd[::7]]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    new = {"w": T.collapse_ws("t"), "c": T.strip_control("t"), "n": T.number_text("t")}
    got = {r.t: r for r in df.select("t", *[e.alias(k) for k, e in new.items()]).collect()}
    assert (got[None].w, got[None].c, got[None].n) == (None, None, None)
    white, control = re.compile(f"[ {re.escape(T._WS_CHARS)}]+"), re.compile(f"[{re.escape(T._CONTROL)}]")
    for t in texts:
        assert got[t].w == white.sub(" ", t).strip(" "), repr(t)
        assert got[t].c == control.sub("", t), repr(t)
        assert got[t].n == white.sub("", re.sub(f"[{T.CURRENCY_CHARS}]", "", t)), repr(t)
    plan = df.select(*new.values())._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") == len(re.findall(r"ELSE translate\(", plan)) > 0


def test_normalized_text_equals_title_case_between_strip_and_collapse(spark):
    from pyspark.sql import functions as F

    ends, runs = f"^{T.WS_CLASS}+|{T.WS_CLASS}+$", T.WS_CLASS + "+"
    texts = ["customer#000000001 building", " a  b\tc  d ", "o'neil 3rd", "12 ab", "ab 12", "ab12cd", "αΣ\tΣα", " \tb",
             "İx ǆy", "\x1fA b\x85", "[x] y", "a-b", "", " "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    marked = F.regexp_replace(F.regexp_replace("t", ends, ""), r"(\P{L}(?=[A-Za-z]|\P{ASCII})|\x{E000})", "$1" + T._MARK + " ")
    plain = F.regexp_replace(F.replace(F.initcap(marked), F.lit(T._MARK + " "), F.lit("")), runs, " ")
    for r in df.select("t", T.normalize_text("t").alias("a"), plain.alias("b")).collect():
        assert r.a == r.b, repr(r.t)


def test_header_words_are_found_in_any_case(spark):
    from tillpoint.operators import clean as C

    rows = {("x HeAdS", "Price"): True, ("heads", "prİce"): False, ("headS price", None): True, ("hea", "ds price"): False, ("₹ PRICE", "HEADS"): True}
    df = spark.createDataFrame(list(rows), "a string, b string")
    assert {(r.a, r.b): r.h for r in df.select("a", "b", C.header_like(df).alias("h")).collect()} == rows
    assert "lower(" not in df.select(C.header_like(df))._jdf.queryExecution().optimizedPlan().toString()
