"""Line-first cleaning: rules per line, then a verdict on what is left.

A line is kept when it has a word, ends like a sentence, is not navigation (cells or
crumbs between separators), is not boilerplate, is not mostly symbols, and does not
shout.  A document is rejected when its failing lines hold too much of its text, or by
the base rules on the whole text.  Built-in functions only; each row is judged by itself,
without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII white space, symbol characters, ends of a sentence, boilerplate.
SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
ENDS = ".!?:;\"')]…”’»。！？"
BOILERPLATE = ("cookie policy", "enable javascript", "privacy policy", "terms of service", "terms of use",
               "all rights reserved", "lorem ipsum", "click here", "sign in to", "log in to", "subscribe to our",
               "share this", "skip to content", "read more")
#: Rules: most separators in 100 words, symbols in 100 characters, shouts in 100 words of
#: a line; most characters in 100 that may be lost; fewest words; most repeated words.
MAX_SEPARATORS, MAX_SYMBOLS, MAX_SHOUTS, MAX_LOST, MIN_WORDS, MAX_REPEATED = 20, 10, 30, 50, 50, 50

_SPLIT = r"[ \t\n\x0B\f\r]+"


def _stripped(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE))


def _count(c: Column, chars: str) -> Column:
    """Occurrences of the characters, which all take as many bytes in UTF-8."""
    left = c
    for x in chars:
        left = F.replace(left, F.lit(x))
    return ((F.octet_length(c) - F.octet_length(left)) / len(chars[0].encode())).cast("long")


def good_line(line: Column) -> Column:
    """Whether a line without white space around it passes the punctuation, navigation,
    symbol, shouting and boilerplate rules."""
    words = _count(line, " ") + 1
    return (F.right(line, F.lit(1)).isin(*ENDS)
            & (_count(line, "|") * 100 <= words * MAX_SEPARATORS)
            & (_count(line, SYMBOLS) * 100 <= F.length(line) * MAX_SYMBOLS)
            & (_count(line, "!") * 100 <= words * MAX_SHOUTS)
            & ~F.lower(line).rlike("|".join(BOILERPLATE)))


def _repeated_words(words: Column, bits: Column) -> Column:
    """Words in 3-word windows found twice or more.  A window's hash and place share one
    long, so a plain sort brings equal windows together."""
    windows = F.transform(
        F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))),
        lambda w, i: F.call_function("shiftleft", F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)), bits).bitwiseOR(i.cast("long")))
    return F.sort_array(windows)


def _covered(ordered: Column, bits: Column) -> Column:
    high = lambda k: F.call_function("shiftright", k, bits)
    twice = F.filter(ordered, lambda k, i: (high(k) == high(F.get(ordered, i - 1))) | (high(k) == high(F.get(ordered, i + 1))))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
    places = F.sort_array(F.transform(twice, lambda k: k.bitwiseAND(mask)))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).cast("long").alias("last"))
    return F.aggregate(places, start, lambda acc, p: F.struct(
        (acc["n"] + F.least(F.lit(3).cast("long"), p - acc["last"])).alias("n"), p.alias("last")), lambda acc: acc["n"])


def judge(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, the base counts, ``base_failed``, ``kept`` and
    ``clean_text`` (the good lines, joined by newlines).

    A null or empty text has no words and fails the base rules (too few words).  Ids
    may be null or repeat; extra columns are ignored; empty input gives no rows."""
    body = F.coalesce(F.col("body"), F.lit(""))
    one = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("body")).select("doc_id", body.alias("body"))
    two = one.select(
        "doc_id", "body",
        F.when(_stripped(F.col("body")) == "", F.array().cast("array<string>"))
        .otherwise(F.split(_stripped(F.col("body")), _SPLIT)).alias("words"),
        F.filter(F.split("body", "\n"), lambda s: _stripped(s) != "").alias("lines"))
    three = two.select(
        "*", F.size("words").cast("long").alias("n_words"), F.length(F.bin(F.size("words").cast("long"))).alias("bits"),
        F.transform("lines", _stripped).alias("bare"))
    four = three.select("*", _repeated_words(F.col("words"), F.col("bits")).alias("ordered"),
                        F.filter("bare", good_line).alias("good"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda acc, s: acc + F.length(s))
    five = four.select(
        "doc_id", "n_words", (F.length("body") - _count(F.col("body"), SPACE)).cast("long").alias("word_chars"),
        _count(F.col("body"), SYMBOLS).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _covered(F.col("ordered"), F.col("bits")).alias("n_repeat_words"),
        total(F.col("bare")).alias("line_chars"), total(F.col("good")).alias("good_chars"),
        F.array_join("good", "\n").alias("clean_text"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    lost = 100 * (F.col("line_chars") - F.col("good_chars")) > MAX_LOST * F.col("line_chars")
    return five.select("*", failed.alias("base_failed"), (~failed & ~lost).alias("kept"))


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _sql_count(chars: str) -> str:
    return f"(length(s) - length(translate(s, {_sql_text(chars)}, '')))"


_GOOD = f"""{_sql_text(ENDS)} like '%' || right(s, 1) || '%'
  and {_sql_count("|")} * 100 <= ({_sql_count(" ")} + 1) * {MAX_SEPARATORS}
  and {_sql_count(SYMBOLS)} * 100 <= length(s) * {MAX_SYMBOLS}
  and {_sql_count("!")} * 100 <= ({_sql_count(" ")} + 1) * {MAX_SHOUTS}
  and not regexp_matches(lower(s), '{"|".join(BOILERPLATE)}')"""

SQL = f"""
with d as (select doc_id, coalesce(text, '') as body, row_number() over () as r from documents),
w as (select *, case when trim(body, {_WS}) = '' then []::varchar[]
        else regexp_split_to_array(trim(body, {_WS}), '[ \\t\\n\\x0B\\f\\r]+') end as words,
      list_filter(string_split(body, chr(10)), lambda s: trim(s, {_WS}) <> '') as lines from d),
b as (select *, list_transform(lines, lambda s: trim(s, {_WS})) as bare from w),
g as (select *, list_filter(bare, lambda s: {_GOOD}) as good from b),
x as (select r, unnest(words) as a, generate_subscripts(words, 1) as i from w),
y as (select r, i, a, lead(a) over n as b, lead(a, 2) over n as c from x window n as (partition by r order by i)),
z as (select r, i, count(*) over (partition by r, a, b, c) as n from y where c is not null),
rep as (select r, count(distinct i + j) as n from z, (values (0), (1), (2)) as t(j) where n > 1 group by r),
m as (select doc_id, len(words) as n_words, length(translate(body, {_WS}, '')) as word_chars,
        length(body) - length(translate(body, '{SYMBOLS}', '')) as n_symbols,
        len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(rep.n, 0) as n_repeat_words,
        coalesce(list_sum(list_transform(bare, lambda s: length(s))), 0) as line_chars,
        coalesce(list_sum(list_transform(good, lambda s: length(s))), 0) as good_chars,
        array_to_string(good, chr(10)) as clean_text
      from g left join rep using (r))
select *, (n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEATED} * n_words) as base_failed,
  not (n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEATED} * n_words)
    and 100 * (line_chars - good_chars) <= {MAX_LOST} * line_chars as kept
from m
"""
