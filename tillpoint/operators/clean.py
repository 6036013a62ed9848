"""Cleaning operators.

Row-local steps are column expressions over all string columns at once; the
only step that must look at the whole table first is B3 (which columns are
empty), done as one ``count(c)`` aggregate for all columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tillpoint.functions import text as T


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def clean_headers(df: DataFrame) -> DataFrame:
    """B1: header rule 1 (strip, upper, spaces -> '_', drop non-word chars);
    names that become equal get ``_2``, ``_3`` (Spark needs unique names)."""
    return df.toDF(*T.renamed(df.columns, T.clean_header_expr))


def drop_unnamed(df: DataFrame, prefix: str = "UNNAMED") -> DataFrame:
    """Drop ``Unnamed: n`` export columns (and ``index`` for B16)."""
    return df.drop(*[c for c in df.columns if c.startswith(prefix)])


def drop_index_columns(df: DataFrame) -> DataFrame:
    """Drop unnamed and ``index`` columns of a comparison table (case-insensitive)."""
    return df.drop(*[c for c in df.columns if c.lower().startswith("unnamed") or c.lower() == "index"])


def trim_strings(df: DataFrame, columns=None) -> DataFrame:
    """B4 on every string column."""
    cols = set(columns if columns is not None else string_columns(df))
    return df.select(*[T.collapse_ws(_q(c)).alias(c) if c in cols else _q(c) for c in df.columns])


def trim_and_standardize(df: DataFrame, columns=None) -> DataFrame:
    """B4 then B5 as two projections: Catalyst keeps them apart (it does not
    inline a regex result that the null test reads twice), so every value is
    scanned by the regex once."""
    return standardize_nulls(trim_strings(df, columns), columns)


def standardize_nulls(df: DataFrame, columns=None) -> DataFrame:
    """B5 on every string column (other types cannot hold the tokens)."""
    cols = set(columns if columns is not None else string_columns(df))
    return df.select(*[T.null_tokens(_q(c)).alias(c) if c in cols else _q(c) for c in df.columns])


def all_null(df: DataFrame) -> Column:
    return reduce(lambda a, b: a & b, [_q(c).isNull() for c in df.columns])


def empty_columns(df: DataFrame) -> list[str]:
    """Names of all-null columns – one aggregate for every column."""
    row = df.agg(*[F.count(_q(c)).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    return [c for i, c in enumerate(df.columns) if row[f"c{i}"] == 0]


def junk_index(col: str) -> Column:
    """C2 predicate: the index text starts with two capital letters (null -> false)."""
    return F.coalesce(_q(col).rlike("^[A-Z]{2,}"), F.lit(False))


def header_like(df: DataFrame) -> Column:
    """C3 predicate: some value contains 'heads' and some value contains
    'price' (case-insensitive).  "Some value contains x" equals "the values
    joined by a separator that cannot occur in x contain x", so this is two
    searches in one string, not a lambda per value; no letter but the ASCII ones
    has one of the words' letters as its lower case.  Only text columns can contain
    the words."""
    cols = string_columns(df)
    if not cols:
        return F.lit(False)
    joined = F.concat_ws("\u0001", *[_q(c) for c in cols])
    return joined.rlike("[Hh][Ee][Aa][Dd][Ss]") & joined.rlike("[Pp][Rr][Ii][Cc][Ee]")


def split_header_like(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to keep, header-like rows)."""
    flag = header_like(df)
    return df.where(~flag), df.where(flag)


def drop_label_headers(df: DataFrame, label: str) -> DataFrame:
    """C4: drop rows whose label mentions Heads or Price (null label kept)."""
    return df.where(~F.coalesce(_q(label).rlike("(?i)Heads|Price"), F.lit(False)))


def drop_rows_without(df: DataFrame, columns) -> DataFrame:
    """Drop rows where every listed column is null."""
    return df.dropna(how="all", subset=list(columns))


def normalize_text_column(df: DataFrame, col: str, suffix: str = "_normalized") -> DataFrame:
    """``<col>_normalized`` in exact Python title case."""
    return df.withColumn(col + suffix, T.normalize_text(_q(col)))


def normalize_size_column(df: DataFrame, col: str, out: str = "size_normalized") -> DataFrame:
    """B11."""
    return df.withColumn(out, T.map_size(_q(col)))


def to_numeric_columns(df: DataFrame, columns) -> DataFrame:
    """B6 for string columns; numeric columns stay as they are."""
    cols = {c for c in columns if c in df.columns and isinstance(df.schema[c].dataType, StringType)}
    # two projections: the cleaned text is computed once and tested, then cast
    df = df.select(*[T.number_text(_q(c)).alias(c) if c in cols else _q(c) for c in df.columns])
    return df.select(*[T.parse_number_text(_q(c)).alias(c) if c in cols else _q(c) for c in df.columns])
