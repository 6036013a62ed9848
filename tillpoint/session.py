"""Session helpers.

Library code never creates its own session; callers pass one.  ``local_session``
exists for tests, the bench and examples only.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

LOCAL_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "tillpoint",
                  extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    conf = dict(LOCAL_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", os.environ.get("TILLPOINT_DRIVER_MEMORY", "8g"))
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory of this session.

    Uses the directory already set on the context, else ``spark.checkpoint.dir``
    from the session (runtime conf, then the context's launch conf).  Only a local-mode session (tests) may fall back to a
    fresh temporary directory; on a cluster an unset directory is an error,
    because a machine-local folder does not survive executor loss.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if re.match(r"local(\[|$)", sc.master):     # one process; not local-cluster
        path = tempfile.mkdtemp(prefix="tillpoint-ckpt-")
        sc.setCheckpointDir(path)
        return path
    raise RuntimeError("spark.checkpoint.dir is not set; point it at a shared folder")


def spread(df, busy_fraction: float = 0.25):
    """Give CPU-heavy row-local work ``defaultParallelism`` partitions when the
    input is a handful of files.

    One small file (one row group) is a single scan task however Spark cuts it
    into byte ranges, so fewer files than cores means a repartition.  The
    exception is a few *large* files: Spark splits them by
    ``spark.sql.files.maxPartitionBytes`` into many tasks already, and a
    shuffle would move all of their bytes.  For parquet inputs the split count
    is read from the plan of a plain scan of the same files (a user-given empty
    schema, so no footer job; no exchange, so AQE runs nothing); when it
    reaches ``busy_fraction`` of the cores and is more than four splits per
    file, the files are large and ``df`` is left alone.  Never ask ``df``
    itself for its partition count: a plan with exchanges would run them under
    AQE."""
    spark = df.sparkSession
    target = spark.sparkContext.defaultParallelism
    files = df.inputFiles()
    if not files or len(files) >= target:
        return df
    if all(f.endswith(".parquet") for f in files):
        from pyspark.sql.types import StructType
        splits = spark.read.schema(StructType([])).parquet(*files).rdd.getNumPartitions()
        if splits >= target * busy_fraction and splits > 4 * len(files):
            return df
    return df.repartition(target)


#: Names (with their unique part) of the folders that ``materialize`` wrote.
_WRITTEN: set[str] = set()


def materialize(df, name: str = "stage"):
    """Write ``df`` as parquet under the session's shared checkpoint folder and
    read it back: a lineage cut that survives executor loss and, unlike an
    eager ``checkpoint()``, runs as a Dataset action, so ``observe()`` metrics
    placed anywhere in ``df``'s plan are filled by this one pass."""
    import uuid

    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tillpoint-{name}-{uuid.uuid4().hex}"
    _WRITTEN.add(path.rsplit("/", 1)[1])
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def discard(*frames) -> None:
    """Delete the folders of materialized frames that nothing reads any more; folders that
    ``materialize`` has not written stay, whatever they are called."""
    for df in frames:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if folder.rsplit("/", 1)[1] in _WRITTEN:
                path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
