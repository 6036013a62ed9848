"""M1 into the mart: arriving files, cleaned and de-duplicated, in micro-batches that each
count once.

``foreachBatch`` writes a batch's rows to a folder of its own (``data/stream=…/batch=…``) and
then one row to the ledger (``ledger/stream=…/batch=…``).  A batch is in the mart when its
ledger row is: readers take the data of ledger batches only.  A crash before the ledger row
leaves a folder that nobody reads; the restarted stream replays the batch (Structured
Streaming keeps its files and its number) and overwrites the folder.  A crash after it
makes the replayed batch find its ledger row: it runs for its state only, and nothing is written.  ``stream`` is the id that the
checkpoint holds, so a stream with a new checkpoint never meets the numbers of an old one.

D1 runs across batches by state: a row whose key came within the horizon before is dropped.
The watermark stands on the time of arrival, which every batch fixes once and keeps for its
replay: no row is ever late, so none is lost, and keys older than the horizon leave the
state.  A duplicate that arrives later than that is kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tillpoint.session import checkpoint_dir

_LEDGER = "rows bigint, committed_at timestamp, stream string, batch bigint"


def _any(spark: SparkSession, pattern: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p))


def row_key(columns) -> F.Column:
    """Digest of the given columns: equal rows (nulls too) have equal keys, and state and
    shuffle carry 32 bytes however long the texts are."""
    parts = [F.coalesce(F.concat(F.lit("v"), F.sha2(F.col(f"`{c}`").cast("string"), 256)), F.lit("n")) for c in columns]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def deduplicate_stream(stream: DataFrame, keys, horizon: str) -> DataFrame:
    """D1 on a stream: the first arrival of each key; state lasts for ``horizon``."""
    tagged = stream.withColumn("_key", row_key(keys)).withColumn("_arrived", F.current_timestamp())
    return tagged.withWatermark("_arrived", horizon).dropDuplicatesWithinWatermark(["_key"]).drop("_key", "_arrived")


def _commit(spark: SparkSession, path: str, rows: int) -> None:
    """The ledger row of a batch: one file, which the writer's commit renames into place."""
    (spark.range(1).select(F.lit(rows).cast("bigint").alias("rows"), F.current_timestamp().alias("committed_at"))
     .coalesce(1).write.mode("overwrite").parquet(path))


def write_batch(mart: str, stream_id: str, batch: DataFrame, batch_id: int) -> int | None:
    """Write one micro-batch; its number of rows, or None when the ledger has it already."""
    spark = batch.sparkSession
    place = f"stream={stream_id}/batch={batch_id}"
    if _any(spark, f"{mart}/ledger/{place}/part-*"):
        # the state of D1 must pass through the batch all the same
        batch.write.format("noop").mode("overwrite").save()
        return None
    seen = Observation()
    batch.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{mart}/data/{place}")
    rows = int(seen.get["rows"])
    _commit(spark, f"{mart}/ledger/{place}", rows)
    return rows


def start_mart_stream(spark: SparkSession, source: str, schema, mart: str, transform: Callable[[DataFrame], DataFrame] | None = None,
                      keys=None, horizon: str = "7 days", source_format: str = "parquet", checkpoint_location: str | None = None,
                      max_files: int | None = None):
    """Start the availableNow stream from ``source`` (a folder, or a glob) into ``mart``; returns the ``StreamingQuery``.
    ``transform`` holds the row-local steps (``incremental.clean_rows`` for one), ``keys`` the columns of
    D1 (None: all columns; empty: no de-duplication)."""
    mart = mart.rstrip("/")
    tag = hashlib.sha256(mart.encode("utf-8")).hexdigest()[:16]
    ckpt = checkpoint_location or f"{checkpoint_dir(spark).rstrip('/')}/tillpoint-mart-{tag}"
    reader = spark.readStream.schema(schema).format(source_format)
    if source_format == "csv":
        reader = reader.option("header", "true")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    rows = reader.load(source)
    rows = transform(rows) if transform else rows
    if keys is None or len(keys):
        rows = deduplicate_stream(rows, rows.columns if keys is None else keys, horizon)

    def batch(df: DataFrame, batch_id: int) -> None:
        # Structured Streaming sets the id that the checkpoint holds for the jobs of a batch
        write_batch(mart, df.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId"), df, batch_id)

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", ckpt).trigger(availableNow=True).start()


def ledger(spark: SparkSession, mart: str) -> DataFrame:
    """``rows, committed_at, stream, batch`` of the committed batches."""
    path = f"{mart.rstrip('/')}/ledger"
    if not _any(spark, f"{path}/stream=*/batch=*/part-*"):
        return spark.createDataFrame([], _LEDGER)
    return spark.read.schema(_LEDGER).parquet(path)


def read_mart(spark: SparkSession, mart: str, schema: StructType | None = None) -> DataFrame:
    """The rows of all committed batches; with a ``schema`` no file is opened to find it, and a
    mart without a batch is empty."""
    path = f"{mart.rstrip('/')}/data"
    if schema is not None and not _any(spark, path):
        return spark.createDataFrame([], schema)
    reader = spark.read if schema is None else spark.read.schema(
        StructType([*schema.fields, StructField("stream", StringType()), StructField("batch", LongType())]))
    data = reader.parquet(path)
    data = data.withColumn("stream", F.col("stream").cast("string")).withColumn("batch", F.col("batch").cast("bigint"))
    return data.join(ledger(spark, mart).select("stream", "batch"), ["stream", "batch"], "left_semi").drop("stream", "batch")
