"""Registered queries of operators that keep state between runs: the streamed mart (M1)
and the ingest ledger (A15)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tillpoint.functions import text as T
from tillpoint.plans import sqltext as S
from tillpoint.plans.registry import register
from tillpoint.session import checkpoint_dir
from tillpoint.sources.tables import load, table_path


def _fresh(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@register("m1_stream_mart_documents", f"""
SELECT text, count(*) AS n FROM (SELECT DISTINCT {S.strip_control('text')} AS text FROM documents) GROUP BY text""")
def m1_stream_mart_documents(spark, sf_dir):
    """The table's files as a stream: B14 per row, D1 on the cleaned text across batches."""
    from tillpoint.streaming.mart import read_mart, start_mart_stream

    mart = _fresh(spark, "mart")
    schema = load(spark, sf_dir, "documents").schema
    files = table_path(sf_dir, "documents")[:-1] + "[t]"       # a glob: the table may be one file or a folder
    query = start_mart_stream(spark, files, schema, mart, keys=["text"],
                              transform=lambda d: d.withColumn("text", T.strip_control("text")))
    query.awaitTermination()
    return read_mart(spark, mart, schema).groupBy("text").agg(F.count(F.lit(1)).alias("n"))


@register("a15_ingest_remembers", """
WITH d AS (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL),
b AS (SELECT DISTINCT text FROM benchmark WHERE text IS NOT NULL AND text NOT IN (SELECT text FROM d))
SELECT 1 AS step, (SELECT count(*) FROM d) AS added, (SELECT count(*) FROM d) AS known
UNION ALL SELECT 2, 0, (SELECT count(*) FROM d)
UNION ALL SELECT 3, (SELECT count(*) FROM b), (SELECT count(*) FROM d) + (SELECT count(*) FROM b)""")
def a15_ingest_remembers(spark, sf_dir):
    """The documents, the documents again, then the benchmark: what each ingest adds, and what
    the ledger knows after it."""
    from tillpoint.sources.ledger import IngestStore

    store = IngestStore(spark, _fresh(spark, "ingest"))
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    bench = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    rows = []
    for step, items in enumerate((docs, docs, bench), 1):
        added = store.ingest(items, "text", "id")
        rows.append((step, added, store.items().count()))
    return spark.createDataFrame(rows, "step int, added bigint, known bigint")


@register("a15_ingested_documents", """
SELECT min(doc_id) AS doc_id, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL GROUP BY text""")
def a15_ingested_documents(spark, sf_dir):
    """What is read back: the first document of each content."""
    from tillpoint.sources.ledger import IngestStore

    store = IngestStore(spark, _fresh(spark, "ingest"))
    store.ingest(load(spark, sf_dir, "documents").select("doc_id", "text"), "text", "doc_id")
    return store.items().select("doc_id", "sha256")
