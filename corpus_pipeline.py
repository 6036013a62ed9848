"""Corpus pipeline: toxicity, n-gram Jaccard join, substring dedup, benchmark
decontamination, packing.

Each stage takes all that its predecessor kept, as reread Parquet, and its decisions take
effect.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillpoint.llm import decontaminate, jaccard_join, packing, substring_dedup, toxicity
from tillpoint.llm.io import shared_path
from tillpoint.sources.tables import load


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted as toxic go.  Rows without an id and rows that repeat an id
    are judged by their own text."""
    return toxicity.keep_ordinary(docs, load(spark, sf_dir, "labels"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by 5-word shingles (Jaccard 0.75 or more) the one
    with the least id stays.  Rows without an id stay; of rows that repeat an id all stay
    or go together."""
    found = jaccard_join.members(docs)
    gone = found.where("node <> component").select("node").distinct()
    return docs.join(gone, docs["doc_id"] == gone["node"], "left_anti")


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that repeat a document of smaller id are cut out; a
    document of which no word is left goes."""
    return substring_dedup.remove_passages(docs, substring_dedup.repeated_passages(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go.  Rows without an id stay."""
    return decontaminate.remove_contaminated(docs, decontaminate.contaminated(docs, load(spark, sf_dir, "benchmark")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("substring_dedup", drop_passages),
    ("benchmark_decontamination", drop_contaminated),
    ("packing", pack),
]

#: No stage but the join can be said in SQL; the rows are tested against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of ``sf_dir``."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, name)
        stage(spark, docs, sf_dir).select(*(F.col(f"`{c}`") for c in docs.columns)).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
