"""De-duplication.

Exact duplicates are removed with a hash aggregate on all columns (map-side
partial aggregation collapses a hot duplicate group before the shuffle).  With a
``subset`` the first row per key by an explicit order is kept through
``row_number() == 1``, which Spark plans as a partial ``WindowGroupLimit`` before
the exchange, so a key holding a third of the rows ships one row per map task.
String keys are compared through ``text_key``: when the text itself is not
selected afterwards, the shuffle carries a digest of a long text, not the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tillpoint.functions.text import text_key


def binary_string(dt) -> bool:
    """A string type compared byte by byte (the default collation): only then is
    ``text_key`` an identity key; a collated string keeps its own equality."""
    return isinstance(dt, StringType) and getattr(dt, "collation", "UTF8_BINARY") == "UTF8_BINARY"


def _key(df: DataFrame, c: str):
    """Grouping key of column ``c``: binary strings through ``text_key`` (long
    texts travel as digests), other types as they are."""
    col = F.col(f"`{c}`")
    return text_key(col) if binary_string(df.schema[c].dataType) else col


def deduplicate(df: DataFrame, subset=None, order_by=None) -> DataFrame:
    """D1, ``keep='first'``.  Nulls compare equal, as in pandas.

    Without ``subset`` duplicates are whole-row copies, so which copy is kept is
    immaterial.  With ``subset``, ``order_by`` (columns) defines "first";
    without it the smallest row by all columns is kept, which is deterministic.
    """
    if not subset:
        return df.dropDuplicates()
    order = list(order_by) if order_by else [c for c in df.columns]
    w = Window.partitionBy(*[_key(df, c) for c in subset]).orderBy(
        *[F.col(f"`{c}`").asc_nulls_first() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def row_key(df: DataFrame, columns) -> list:
    """Grouping keys that are equal exactly when all ``columns`` are: the binary strings
    as one key of at most 32 bytes (their lengths and bytes one after the other, a null as
    ``-``; if longer than 31 bytes its SHA-256), other types as they are.  A row of the
    hash aggregate is then as small however many and however long the texts are."""
    texts = [c for c in columns if binary_string(df.schema[c].dataType)]
    keys = [F.col(f"`{c}`") for c in columns if c not in texts]
    if texts:
        row = F.concat(*[F.coalesce(F.concat(F.octet_length(F.col(f"`{c}`")).cast("string"), F.lit(":"), F.col(f"`{c}`")),
                                    F.lit("-")) for c in texts]).cast("binary")
        keys.append(F.when(F.octet_length(row) <= 31, row).otherwise(F.unhex(F.sha2(row, 256))).alias("_texts"))
    return keys


def duplicate_count(df: DataFrame, subset=None) -> DataFrame:
    """Rows after the first of each identical group, and their % of all rows."""
    g = df.groupBy(*row_key(df, list(subset or df.columns))).agg(F.count(F.lit(1)).alias("_n"))
    return g.agg(F.sum(F.col("_n") - 1).cast("bigint").alias("duplicate_rows"),
                 F.sum("_n").cast("bigint").alias("total_rows")).select(
        "duplicate_rows", "total_rows",
        (F.try_divide(F.col("duplicate_rows"), F.col("total_rows")) * 100).alias("duplicate_pct"))
