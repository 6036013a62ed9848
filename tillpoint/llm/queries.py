"""One query per operator over its whole table, with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tillpoint.llm import conversation_trie, hard_negatives, language_id, license_scan, line_quality, lm_maxent, packing, toxicity, warc
from tillpoint.llm.decontaminate import contaminated
from tillpoint.llm.io import shared_path
from tillpoint.llm.jaccard_join import jaccard_components
from tillpoint.llm.substring_dedup import repeated_passages
from tillpoint.llm.token_counts import token_counts
from tillpoint.sources.tables import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(load(spark, sf_dir, "documents"))


@query
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(load(spark, sf_dir, "documents"))


@query
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


@query
def op2_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.judge(load(spark, sf_dir, "documents")).drop("clean_text", "line_chars", "good_chars")


ORACLE["op2_line_quality"] = f"select * exclude (clean_text, line_chars, good_chars) from ({line_quality.SQL})"


@query
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(load(spark, sf_dir, "documents"))


ORACLE["op3_license_scan"] = license_scan.SQL


@query
def op4_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(load(spark, sf_dir, "pages"), shared_path(spark, "warc"))


# DuckDB has SHA-1 as hex; base 32 takes five bits at a time
ORACLE["op4_warc_roundtrip"] = """
with p as (select page_id, coalesce(html, '') as body from pages),
d as (select page_id, octet_length(encode(body)) as payload_bytes, ('0x' || substr(sha1(body), 1, 30))::hugeint as hi,
        ('0x' || substr(sha1(body), 31, 10))::hugeint as lo from p),
b as (select page_id, payload_bytes,
        array_to_string(list_transform(range(24), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((hi >> (115 - 5 * i)::int) & 31)::int + 1, 1)), '')
        || array_to_string(list_transform(range(8), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((lo >> (35 - 5 * i)::int) & 31)::int + 1, 1)), '')
        as payload_digest from d),
f as (select *, min(page_id) over (partition by payload_digest, payload_bytes) as first from b)
select page_id, payload_bytes, payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id <> first then first end as refers_to from f
"""


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


@query
def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_maxent.score(load(spark, sf_dir, "documents"))


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"))


@query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(load(spark, sf_dir, "documents"))


@query
def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_nodes(load(spark, sf_dir, "conversations"))


ORACLE["op11_conversation_trie"] = conversation_trie.SQL


@query
def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.languages(load(spark, sf_dir, "documents"))


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(load(spark, sf_dir, "embeddings"))


ORACLE["op13_hard_negatives"] = hard_negatives.SQL
