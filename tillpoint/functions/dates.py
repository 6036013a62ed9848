"""Date helpers: safe casts, format-driven parsing, time dimensions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The date formats tried by the cleaning job, in the reference's
# order (strftime notation), and their Spark pattern twins.  Day and month take
# one or two digits in both notations when parsing.
CLEAN_DATE_FORMATS = (
    ("%m-%d-%y", "M-d-yy"),
    ("%d-%m-%y", "d-M-yy"),
    ("%Y-%m-%d", "yyyy-M-d"),
    ("%m/%d/%Y", "M/d/yyyy"),
    ("%d/%m/%Y", "d/M/yyyy"),
    ("%m-%d-%Y", "M-d-yyyy"),
    ("%d-%m-%Y", "d-M-yyyy"),
)
# The explorer's five formats (first with success > 90 % wins).
EXPLORE_DATE_FORMATS = CLEAN_DATE_FORMATS[:5]

# pandas' free-form parser has no Spark twin.  "auto" is this documented list
# of (strftime, Spark pattern) pairs, tried in order; "auto_dayfirst" puts the
# day-first patterns before the month-first ones.
_ISO = (
    ("%Y-%m-%d %H:%M:%S", "yyyy-M-d H:m:s"), ("%Y-%m-%dT%H:%M:%S", "yyyy-M-d'T'H:m:s"),
    ("%Y-%m-%d", "yyyy-M-d"), ("%Y/%m/%d", "yyyy/M/d"),
)
_MONTH_FIRST = (("%m/%d/%Y", "M/d/yyyy"), ("%m-%d-%Y", "M-d-yyyy"), ("%m/%d/%y", "M/d/yy"), ("%m-%d-%y", "M-d-yy"))
_DAY_FIRST = (("%d/%m/%Y", "d/M/yyyy"), ("%d-%m-%Y", "d-M-yyyy"), ("%d/%m/%y", "d/M/yy"), ("%d-%m-%y", "d-M-yy"))
_NAMED = (("%d %b %Y", "d MMM yyyy"), ("%b %d %Y", "MMM d yyyy"), ("%d-%b-%Y", "d-MMM-yyyy"))
AUTO_FORMATS = _ISO + _MONTH_FIRST + _NAMED + _DAY_FIRST
AUTO_DAYFIRST_FORMATS = _ISO + _DAY_FIRST + _NAMED + _MONTH_FIRST
AUTO_PATTERNS = tuple(p for _, p in AUTO_FORMATS)
AUTO_DAYFIRST_PATTERNS = tuple(p for _, p in AUTO_DAYFIRST_FORMATS)


def safe_date(c) -> Column:
    """``TRY_CAST(c AS DATE)``: null instead of an error under ANSI mode."""
    col = F.col(c) if isinstance(c, str) else c
    return col.try_cast("date")


def _pattern_regex(pattern: str, year_group: bool = False) -> str:
    """Anchored regex of the text a Spark date pattern can parse; with
    ``year_group`` the text before, the two-digit year and the text after are
    captured as groups 1-3."""
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        j = i
        while j < len(pattern) and pattern[j] == ch:
            j += 1
        run = j - i
        if ch == "'":
            k = pattern.index("'", i + 1)
            out.append(re.escape(pattern[i + 1:k]))
            j = k + 1
        elif ch == "y":
            out.append("[0-9]{4}" if run >= 4 else (")([0-9]{2})(" if year_group else "[0-9]{2}"))
        elif ch == "M" and run >= 3:
            out.append("[A-Za-z]{3,9}")
        elif ch in "MdHms":
            out.append("[0-9]{1,2}")
        else:
            out.append(re.escape(pattern[i:j]))
        i = j
    body = "".join(out)
    return "^(" + body + ")$" if year_group else "^" + body + "$"


def pattern_shape(pattern: str) -> str:
    """Anchored regex of the text a Spark date pattern can parse.  Checked
    before ``try_to_timestamp``: a failed parse costs an exception per row, a
    failed ``rlike`` does not."""
    return _pattern_regex(pattern)


def _precheck(col: Column, pattern: str) -> Column:
    """Cheap tests a text must pass before the shape regex: its length range
    and the separators the pattern contains."""
    lo = hi = 0
    i = 0
    seps = set()
    while i < len(pattern):
        ch = pattern[i]
        j = i
        while j < len(pattern) and pattern[j] == ch:
            j += 1
        run = j - i
        if ch == "'":
            k = pattern.index("'", i + 1)
            lo += k - i - 1
            hi += k - i - 1
            j = k + 1
        elif ch == "y":
            n = 4 if run >= 4 else 2
            lo, hi = lo + n, hi + n
        elif ch == "M" and run >= 3:
            lo, hi = lo + 3, hi + 9
        elif ch in "MdHms":
            lo, hi = lo + 1, hi + 2
        else:
            lo, hi = lo + run, hi + run
            seps.update(pattern[i:j])
        i = j
    n = F.length(col)
    cond = (n >= lo) & (n <= hi)
    for sep in sorted(seps):
        cond = cond & col.contains(sep)
    return cond


def _two_digit_year(pattern: str) -> bool:
    return bool(re.search(r"(?<!y)yy(?!y)", pattern.replace("'", "")))


def parse_with(c, pattern: str) -> Column:
    """Parse a string with one Spark pattern; unparsable -> null (timestamp_ntz).

    Two-digit years follow Python and DuckDB (69-99 -> 1900s, 00-68 -> 2000s;
    Spark's ``yy`` would give 2000-2099): the text is rewritten to a four-digit
    year first, so the parse runs once per row and is never repeated inside a
    conditional."""
    col = (F.col(c) if isinstance(c, str) else c).cast("string")
    if _two_digit_year(pattern):
        rx = _pattern_regex(pattern, year_group=True)
        yy = F.regexp_extract(col, rx, 2)
        century = F.when(yy >= F.lit("69"), F.lit("19")).otherwise(F.lit("20"))
        text = F.regexp_replace(col, F.lit(rx), F.concat(F.lit("$1"), century, F.lit("$2$3")))
        p4 = re.sub(r"(?<!y)yy(?!y)", "yyyy", pattern)
        return F.when(_precheck(col, pattern) & col.rlike(pattern_shape(pattern)),
                      F.try_to_timestamp(text, F.lit(p4))).cast("timestamp_ntz")
    return F.when(_precheck(col, pattern) & col.rlike(pattern_shape(pattern)),
                  F.try_to_timestamp(col, F.lit(pattern))).cast("timestamp_ntz")


def parse_any(c, patterns=AUTO_PATTERNS) -> Column:
    """First pattern of ``patterns`` that parses wins (the "auto" parser)."""
    return F.coalesce(*[parse_with(c, p) for p in patterns])


def time_dimensions(d: Column, prefix: str = "") -> dict[str, Column]:
    """Year, quarter, month, month_name (``%b-%y``), day_of_week (Mon=0),
    week_of_year (ISO)."""
    return {
        f"{prefix}year": F.year(d),
        f"{prefix}quarter": F.quarter(d),
        f"{prefix}month": F.month(d),
        f"{prefix}month_name": F.date_format(d, "MMM-yy"),
        f"{prefix}day_of_week": F.weekday(d),
        f"{prefix}week_of_year": F.weekofyear(d),
    }
