"""DuckDB-dialect SQL snippets that spell out the operators' rules.

Used only to build the ``oracle_sql()`` twins: an independent statement of the
same semantics in another engine (RE2 regexes, ``try_strptime``...).
"""

from __future__ import annotations

from tillpoint.functions import text as T

WS = T.WS_CLASS


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def collapse_ws(x: str) -> str:
    return f"trim(regexp_replace({x}, {lit(WS + '+')}, ' ', 'g'))"


def null_tokens(x: str) -> str:
    toks = ", ".join(lit(t) for t in T.NULL_TOKENS)
    return f"CASE WHEN {x} IN ({toks}) THEN NULL ELSE {x} END"


def to_number(x: str) -> str:
    cleaned = f"regexp_replace(regexp_replace({x}, {lit('[' + T.CURRENCY_CHARS + ']')}, '', 'g'), {lit(WS + '+')}, '', 'g')"
    return (f"CASE WHEN regexp_full_match({cleaned}, {lit('[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?')}) "
            f"THEN TRY_CAST({cleaned} AS DOUBLE) END")


def title_case(x: str) -> str:
    return (f"CASE WHEN {x} IS NOT NULL THEN array_to_string(list_transform(regexp_extract_all({x}, "
            f"'(\\p{{L}}+|\\P{{L}}+)', 1), lambda t: upper(t[1]) || lower(t[2:])), '') END")


def normalize_text(x: str) -> str:
    stripped = f"regexp_replace({x}, {lit('^' + WS + '+|' + WS + '+$')}, '', 'g')"
    return f"regexp_replace({title_case(stripped)}, {lit(WS + '+')}, ' ', 'g')"


def map_size(x: str) -> str:
    u = f"upper(trim({x}))"
    whens = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in T.SIZE_MAP.items())
    return f"coalesce(CASE {u} {whens} END, {u})"


def strip_html(x: str) -> str:
    return f"regexp_replace({x}, {lit(T.HTML_TAG)}, '', 'g')"


def strip_control(x: str) -> str:
    return f"regexp_replace({x}, '[\\x00-\\x1f\\x7f-\\x{{9f}}]', '', 'g')"


def sql_pattern(x: str, pattern: str) -> str:
    # RE2 has no Unicode \b; the test data is ASCII around the keywords
    return f"coalesce(regexp_matches({x}, {lit('(?i)' + pattern)}), false)"


def first_number(x: str) -> str:
    m = f"regexp_extract(CAST({x} AS VARCHAR), '([0-9]+(?:[.][0-9]+)?)', 1)"
    return f"CASE WHEN {m} <> '' THEN TRY_CAST({m} AS DOUBLE) END"


def strptime_guarded(x: str, fmt: str) -> str:
    """``try_strptime`` with the digit-count rules of Python's strptime
    (DuckDB's %Y also reads two digits)."""
    import re
    rx = re.escape(fmt)
    rx = rx.replace("%m", "[0-9]{1,2}").replace("%d", "[0-9]{1,2}").replace("%Y", "[0-9]{4}") \
           .replace("%y", "[0-9]{2}").replace("%H", "[0-9]{1,2}").replace("%M", "[0-9]{1,2}") \
           .replace("%S", "[0-9]{1,2}").replace("%b", "[A-Za-z]{3}")
    rx = rx.replace("\\-", "-").replace("\\ ", " ")
    return f"CASE WHEN regexp_full_match({x}, {lit(rx)}) THEN try_strptime({x}, {lit(fmt)}) END"
