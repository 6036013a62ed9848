"""Cutting lineage through the cluster's shared folder."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillpoint.session import checkpoint_dir


#: Most bytes of an Arrow batch in the jobs of ``small_batches`` (one longer row is a batch).
BATCH_BYTES = 2 << 20
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession):
    """The jobs that run inside hand texts to Python in batches of ``BATCH_BYTES``, not of
    10,000 rows: a task holds a batch in the JVM and in its worker, beside what the JVM
    sorts and joins.  The session's own limit holds again afterwards."""
    before = spark.conf.get(_LIMIT, None)
    spark.conf.set(_LIMIT, str(BATCH_BYTES))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_LIMIT)
        else:
            spark.conf.set(_LIMIT, before)


def giving_back(run):
    """``run``, for ``mapInArrow``, that leaves no freed batches with Arrow's memory pool:
    a worker keeps them while it is idle, and a stage without Python needs that memory."""
    def whole(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
    return whole


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder that ``spark.checkpoint.dir`` names."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` as parquet in the shared folder; the frame reread, and its path.

    Lost executors cost only the tasks that were running: what is written stays."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete intermediate folders once all that was read from them is written."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def bitmap(cells: DataFrame, bits: int) -> np.ndarray:
    """Boolean table of ``2**bits`` entries, set where column ``c`` (0 to ``2**bits - 1``)
    has a value.  Its size is fixed: at most ``2**bits / 32`` rows reach the driver,
    whatever the number of rows of ``cells``."""
    got = (cells.select(F.expr("c div 32").alias("w"), F.expr("shiftleft(1L, cast(c % 32 as int))").alias("b"))
           .groupBy("w").agg(F.bit_or("b").alias("b")).toArrow())
    out = np.zeros((1 << bits) // 32, np.uint32)
    out[got.column("w").to_numpy()] = got.column("b").to_numpy().astype(np.uint32)
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)
