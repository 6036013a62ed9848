"""Registered queries of the retrieval block (R1-R3) and the ingest ledger."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tillpoint.operators import retrieval as R
from tillpoint.plans.registry import register, rounded
from tillpoint.sources.ledger import new_items
from tillpoint.sources.tables import load


@register("r1_chunk_documents", """
SELECT doc_id, CAST(k AS INTEGER) AS chunk_no, substring(text, k * 800 + 1, 1000) AS chunk
FROM (SELECT doc_id, text, unnest(range(0, CASE WHEN length(text) <= 1000 THEN 1
                                           ELSE 1 + CAST(ceil((length(text) - 1000) / 800) AS BIGINT) END)) AS k
      FROM documents WHERE length(text) > 0)""")
def r1_chunk_documents(spark, sf_dir):
    return R.chunk_text(load(spark, sf_dir, "documents"), "doc_id", "text", 1000, 200)


@register("r2_top3_neighbours", """
WITH dims AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x
              FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)
              GROUP BY label, i),
c AS (SELECT label, list(x ORDER BY i) AS centroid FROM dims GROUP BY label),
d AS (SELECT c.label AS query_id, e.vec_id,
             sqrt(list_sum(list_transform(range(1, len(e.embedding) + 1),
                  lambda i: (CAST(e.embedding[i] AS DOUBLE) - c.centroid[i]) ** 2))) AS distance
      FROM embeddings e, c)
SELECT query_id, vec_id, round(distance, 2) AS distance, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d) WHERE rank <= 3""")
def r2_top3_neighbours(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings")
    q = R.label_centroids(e, "label", "embedding")
    return rounded(R.nearest(e, "vec_id", "embedding", q, "label", "centroid", 3)
                   .select("query_id", "vec_id", "distance", F.col("rank").cast("int")))


@register("r3_context_for_benchmark", """
WITH m AS (SELECT b.item_id, d.doc_id, d.text FROM benchmark b JOIN documents d ON contains(d.text, b.text)
           WHERE length(b.text) > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS rank FROM m)
SELECT item_id, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS context, count(*) AS n_retrieved
FROM r WHERE rank <= 3 GROUP BY item_id""")
def r3_context_for_benchmark(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    bench = load(spark, sf_dir, "benchmark")
    hits = R.contains_matches(docs, "doc_id", "text", bench, "item_id", "text")
    w = Window.partitionBy("item_id").orderBy("doc_id")
    top = hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= 3)
    top = top.join(docs.select("doc_id", "text"), "doc_id")
    return R.assemble_context(top, "item_id", "rank", "text")


@register("a15_new_documents", """
SELECT doc_id, sha256(text) AS sha256 FROM documents
WHERE sha256(text) NOT IN (SELECT sha256(d.text) FROM labels l JOIN documents d ON l.doc_id = d.doc_id)""")
def a15_new_documents(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    # hash before the join: the shuffle then carries (doc_id, 32-byte hash), not the texts
    hashed = docs.select("doc_id", F.sha2("text", 256).alias("sha256"))
    labelled = hashed.join(load(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select("sha256")
    return new_items(docs.select("doc_id", "text"), "text", labelled).select("doc_id", "sha256")
