"""Idempotent ingest by content hash, and the ledger that remembers it.

``IngestStore`` keeps three folders: ``data`` (rows), ``ledger`` (a hash per row) and
``commits`` (one row per ingest), each with a folder per ingest.  An ingest writes them in
this order.  Its commit is one file, renamed into place when written, and only what belongs to a
commit is ever read: a crash at any point before leaves nothing but folders that nobody
reads, and the next ingest adds the rows again.

Writers need no lock.  Two that run at the same time may both add the same content; of
the ledger's rows for one hash the one of the earliest commit counts (then of the least ingest
id), so every content is read once, and the choice never changes later.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


def content_hash(col) -> F.Column:
    return F.sha2(F.col(col) if isinstance(col, str) else col, 256)


def new_items(items: DataFrame, content: str, ledger: DataFrame, ledger_hash: str = "sha256") -> DataFrame:
    """Items whose SHA-256 is not yet in the ledger (left-anti join on the hash:
    both sides shuffle by hash value, so neither needs to fit in memory)."""
    h = items.withColumn("sha256", content_hash(content))
    return h.join(ledger.select(F.col(ledger_hash).alias("sha256")).distinct(), "sha256", "left_anti")


@dataclass
class IngestStore:
    """Content that was ingested into the folder ``path``, each hash once."""

    spark: SparkSession
    path: str

    def _folder(self, name: str) -> str:
        return f"{self.path.rstrip('/')}/{name}"

    def _any(self, pattern: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._folder(pattern))
        return bool(p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p))

    def commits(self) -> DataFrame:
        """``added, committed_at, ingest`` of the ingests that count."""
        schema = "added bigint, committed_at timestamp, ingest string"
        if not self._any("commits/ingest=*/part-*"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self._folder("commits"))

    def ledger(self) -> DataFrame:
        """``sha256, ingest``: every known hash with the ingest whose row counts."""
        schema = "sha256 string, ingest string"
        if not self._any("commits/ingest=*/part-*"):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(self._folder("ledger")).join(self.commits().select("ingest", "committed_at"), "ingest")
        return rows.groupBy("sha256").agg(F.min_by("ingest", F.struct("committed_at", "ingest")).alias("ingest"))

    def items(self) -> DataFrame:
        """The ingested rows, one per content, with ``sha256``."""
        data = self.spark.read.parquet(self._folder("data"))
        return data.withColumn("ingest", F.col("ingest").cast("string")).join(self.ledger(), ["sha256", "ingest"], "left_semi").drop("ingest")

    def ingest(self, items: DataFrame, content: str, order_by: str | None = None) -> int:
        """Add the items whose content is not known yet, the first of each by ``order_by`` (by all
        columns without it); the number of rows added.  Null content is no content.

        The choice of firsts is cut down in each task before rows are shuffled, so content that
        a third of the rows hold sends one row per task."""
        name = uuid.uuid4().hex
        first = F.struct(*([order_by] if order_by else [F.col(f"`{c}`") for c in items.columns]))
        tagged = items.where(F.col(content).isNotNull()).withColumn("sha256", content_hash(content))
        unknown = tagged.join(self.ledger().select("sha256"), "sha256", "left_anti")
        rank = F.row_number().over(Window.partitionBy("sha256").orderBy(first))
        fresh = unknown.withColumn("_place", rank).where("_place = 1").drop("_place")
        seen = Observation()
        fresh.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(self._folder(f"data/ingest={name}"))
        added = int(seen.get["n"])
        if added:
            (self.spark.read.parquet(self._folder(f"data/ingest={name}")).select("sha256")
             .write.parquet(self._folder(f"ledger/ingest={name}")))
            self._commit(name, added)
        return added

    def _commit(self, name: str, added: int) -> None:
        (self.spark.range(1).select(F.lit(added).cast("bigint").alias("added"), F.current_timestamp().alias("committed_at"))
         .coalesce(1).write.parquet(self._folder(f"commits/ingest={name}")))
