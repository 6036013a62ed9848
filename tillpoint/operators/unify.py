"""A data model over many files, one table per file type.

Files are grouped by their J5 type.  In a group, columns are matched by identifier (lower case,
``_`` for blanks), each gets the least type that holds all its files' values, and the
rows are stacked with ``source_file`` and ``loaded_at``.  Schemas are metadata; rows only move
when a table is read or written.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillpoint.operators.compare import file_types

# Table of each file type, and the link between two of them.
TABLE_NAMES = {"TRANSACTIONAL": "sales_transactions", "PRODUCT_CATALOG": "product_catalog", "UNKNOWN": "misc_data"}
OTHER_TABLE = "data_table"
LINK = ("sales_transactions", "product_catalog", "LEFT JOIN", ("SKU", "STYLE", "PRODUCT_ID"), "Link transactions to product details")

#: Decimal digits that the integer types need, narrowest first.
_DIGITS = {T.ByteType(): 3, T.ShortType(): 5, T.IntegerType(): 10, T.LongType(): 19}
_SQL = {"tinyint": "INTEGER", "smallint": "INTEGER", "int": "INTEGER", "bigint": "BIGINT", "float": "DOUBLE", "double": "DOUBLE",
        "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "string": "VARCHAR(255)"}


def least_common(a: T.DataType, b: T.DataType) -> T.DataType:
    """The narrowest type that takes the values of both: integers widen; an integer and a
    decimal, or two decimals, give a decimal with room for both (double where 38 digits don't
    do); any number and a float or double give double; a date and a timestamp a
    timestamp; everything else meets in string.  A column of nulls (void) takes any type."""
    if a == b:
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(b, T.NullType):
        return a
    if a in _DIGITS and b in _DIGITS:
        return max(a, b, key=_DIGITS.get)
    number = lambda t: t in _DIGITS or isinstance(t, (T.DecimalType, T.FloatType, T.DoubleType))
    if number(a) and number(b):
        if isinstance(a, (T.FloatType, T.DoubleType)) or isinstance(b, (T.FloatType, T.DoubleType)):
            return T.DoubleType()
        whole, scale = zip(*((_DIGITS[t], 0) if t in _DIGITS else (t.precision - t.scale, t.scale) for t in (a, b)))
        digits = max(whole) + max(scale)
        return T.DecimalType(digits, max(scale)) if digits <= 38 else T.DoubleType()
    times = (T.DateType, T.TimestampType, T.TimestampNTZType)
    if isinstance(a, times) and isinstance(b, times):
        # a zoned and an unzoned time, too, meet in the zoned one
        return T.TimestampNTZType() if not any(isinstance(t, T.TimestampType) for t in (a, b)) else T.TimestampType()
    return T.StringType()


def identifier(name: str) -> str:
    """Lower case, ``_`` for blanks; a file's own column that is called like one of the two of
    provenance gets ``_own``."""
    name = name.lower().replace(" ", "_")
    return f"{name}_own" if name in ("source_file", "loaded_at") else name


@dataclass
class Model:
    """The model of some files: ``tables`` (name: rows), and as DataFrames ``columns`` ``(table_name,
    file_type, ordinal, column_name, data_type, sql_type, files, conflicting)`` and
    ``relationships`` ``(from_table, to_table, join_type, on_columns, found_columns, description)``."""

    tables: dict[str, DataFrame]
    columns: DataFrame
    relationships: DataFrame


def _stack(frames: list[DataFrame]) -> DataFrame:
    """Union in a balanced tree: with thousands of files the plan stays shallow."""
    while len(frames) > 1:
        frames = [a[0].union(a[1]) if len(a) > 1 else a[0] for a in (frames[i:i + 2] for i in range(0, len(frames), 2))]
    return frames[0]


def _as(name: str, have: T.DataType, want: T.DataType):
    c = F.col(f"`{name}`")
    if isinstance(want, T.StringType) and isinstance(have, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(c)
    return c.cast(want)


def unify(spark: SparkSession, frames: dict[str, DataFrame], loaded_at=None) -> Model:
    """J8 ``by_type`` over ``{file name: rows}``.

    Two columns of one file with the same identifier are one column, the first that is not
    null.  Column order is that of first appearance, files in the given order."""
    names = [(f, c.name, i) for f, df in frames.items() for i, c in enumerate(df.schema.fields)]
    if not names:
        empty = spark.createDataFrame([], "table_name string, file_type string, ordinal int, column_name string, data_type string, "
                                          "sql_type string, files int, conflicting boolean")
        return Model({}, empty, _relationships(spark, {}))
    catalogue = spark.createDataFrame(names, "table_name string, column_name string, ordinal int")
    kind = {r["table_name"]: r["file_type"] for r in file_types(catalogue).collect()}      # one row per file
    stamp = F.current_timestamp() if loaded_at is None else F.lit(loaded_at).cast("timestamp")
    groups: dict[str, list[str]] = {}
    for f in frames:
        groups.setdefault(kind.get(f, "UNKNOWN"), []).append(f)
    tables, rows = {}, []
    for file_type, files in groups.items():
        table = TABLE_NAMES.get(file_type, OTHER_TABLE)
        types: dict[str, T.DataType] = {}
        seen: dict[str, list[str]] = {}
        for f in files:
            for c in frames[f].schema.fields:
                key = identifier(c.name)
                types[key] = least_common(types.get(key, T.NullType()), c.dataType)
                seen.setdefault(key, []).append(c.dataType.simpleString())
        types = {k: T.StringType() if isinstance(t, T.NullType) else t for k, t in types.items()}
        parts = []
        for f in files:
            own: dict[str, list] = {}
            for c in frames[f].schema.fields:
                own.setdefault(identifier(c.name), []).append(_as(c.name, c.dataType, types[identifier(c.name)]))
            cols = [(F.coalesce(*own[k]) if k in own else F.lit(None).cast(t)).alias(k) for k, t in types.items()]
            parts.append(frames[f].select(*cols, F.lit(f).alias("source_file"), stamp.alias("loaded_at")))
        tables[table] = _stack(parts)
        for i, (k, t) in enumerate(types.items()):
            sql = t.simpleString().upper() if isinstance(t, T.DecimalType) else _SQL.get(t.simpleString(), "VARCHAR(255)")
            holders = sum(any(identifier(c) == k for c in frames[f].columns) for f in files)
            rows.append((table, file_type, i + 1, k, t.simpleString(), sql, holders, len(set(seen[k])) > 1))
    columns = spark.createDataFrame(rows, "table_name string, file_type string, ordinal int, column_name string, data_type string, "
                                          "sql_type string, files int, conflicting boolean")
    return Model(tables, columns, _relationships(spark, tables))


def _relationships(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """The link between facts and products, where both are there, with those of its columns
    that both tables hold."""
    source, target, join, on, why = LINK
    rows = []
    if source in tables and target in tables:
        found = [c for c in on if identifier(c) in tables[source].columns and identifier(c) in tables[target].columns]
        rows.append((source, target, join, list(on), found, why))
    return spark.createDataFrame(rows, "from_table string, to_table string, join_type string, on_columns array<string>, "
                                       "found_columns array<string>, description string")


def model_ddl(columns: DataFrame) -> DataFrame:
    """``(table_name, ddl)`` of a model's columns, with the two columns of provenance."""
    field = F.struct("ordinal", F.concat(F.lit("    "), "column_name", F.lit(" "), "sql_type").alias("text"))
    own = F.transform(F.array_sort(F.collect_list(field)), lambda f: f["text"])
    more = F.array(F.lit("    source_file VARCHAR(255)"), F.lit("    loaded_at TIMESTAMP DEFAULT CURRENT_TIMESTAMP"))
    body = columns.groupBy("table_name").agg(F.array_join(F.concat(own, more), ",\n").alias("body"))
    return body.select("table_name", F.concat(F.lit("CREATE TABLE "), "table_name", F.lit(" (\n"), "body", F.lit("\n);")).alias("ddl"))
