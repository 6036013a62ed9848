"""Registry of named queries (``queries()``) and their DuckDB twins (``oracle_sql()``).

Each query takes ``(spark, sf_dir)`` and returns a DataFrame over the whole
given tables.  Double columns are rounded to 2 decimals in both the Spark
result and the SQL text: float sums differ in the last bits with the order of
addition, so unrounded values would not compare.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def rounded(df: DataFrame, digits: int = 2) -> DataFrame:
    """Round every float/double column (same rule as the SQL twins)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            cols.append(F.round(F.col(f"`{f.name}`").cast("double"), digits).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def load_all() -> None:
    """Import every module that registers queries."""
    from tillpoint.plans import q_clean, q_kpi, q_logs, q_model, q_profile, q_sources, q_state, q_text  # noqa: F401
