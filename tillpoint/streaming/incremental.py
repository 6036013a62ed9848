"""M1: the row-local part of the cleaning job on arriving files.

B4, B5, B6, B13, B14 and the flags E1-E3 (E4 with bounds fixed by an earlier
batch run) need no whole-table statistic, so they run per micro-batch.  Files
are read with ``readStream`` and written by the parquet file sink, whose
commit log makes the output exactly-once across restarts; ``availableNow``
processes what is there and stops.  Whole-table steps (B3, the B7 format
choice, D1, E4 bounds) take values fixed by a previous batch run of
``plans.preprocess``.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillpoint.functions import text as T
from tillpoint.operators import clean as C
from tillpoint.operators import validate as V
from tillpoint.session import checkpoint_dir


def clean_rows(df: DataFrame, roles, bounds=None, date_expr=None, as_of=None) -> DataFrame:
    """The row-local steps as one projection chain (usable in batch and stream)."""
    df = C.trim_and_standardize(df)
    numeric = [c for c in (roles.quantity, roles.rate, roles.amount) if c]
    df = C.to_numeric_columns(df, numeric)
    date_col = None
    if date_expr is not None:
        date_col = "date_parsed"
        df = df.withColumn(date_col, date_expr)
    df, _ = V.add_flags(df, roles, bounds, date_col, as_of)
    strings = C.string_columns(df)
    return df.select(*[T.strip_control(T.strip_html(F.col(f"`{c}`"))).alias(c) if c in strings else F.col(f"`{c}`")
                       for c in df.columns])


def start_clean_stream(spark: SparkSession, source_dir: str, schema, sink_dir: str, roles, bounds=None,
                       date_expr=None, as_of=None, source_format: str = "parquet",
                       checkpoint_location: str | None = None):
    """Start the availableNow stream; returns the ``StreamingQuery``."""
    # a stable digest of the sink path (Python's str hash changes per process), so a
    # restarted driver finds the same checkpoint and resumes where the stream stopped
    tag = hashlib.sha256(sink_dir.encode("utf-8")).hexdigest()[:16]
    ckpt = checkpoint_location or f"{checkpoint_dir(spark).rstrip('/')}/tillpoint-stream-{tag}"
    reader = spark.readStream.schema(schema).format(source_format)
    if source_format == "csv":
        reader = reader.option("header", "true")
    stream = reader.load(source_dir)
    out = clean_rows(stream, roles, bounds, date_expr, as_of)
    return (out.writeStream.format("parquet").option("path", sink_dir).option("checkpointLocation", ckpt)
               .outputMode("append").trigger(availableNow=True).start())
