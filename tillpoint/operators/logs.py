"""Conversation and reply logs.

The reference keeps these per thread in memory; here they are log tables and
the operators are grouped jobs, so no thread is ever gathered into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rolling_memory(log: DataFrame, thread: str, turn: str, k: int = 5) -> DataFrame:
    """The last ``k`` turns of every thread.  ``row_number() <= k`` is
    planned with a partial WindowGroupLimit before the shuffle, so a thread that
    holds a third of the log ships k rows per map task, not the thread."""
    w = Window.partitionBy(thread).orderBy(F.col(turn).desc())
    return log.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def carry_forward(log: DataFrame, thread: str, turn: str, key: str, value: str) -> DataFrame:
    """I4: per thread and key the value of the latest turn (later filters
    override earlier ones).  The latest turns are numbers, aggregated map-side; the
    texts are only read for them (several rows of that turn: the greatest text)."""
    own = log.where(F.col(key).isNotNull())
    last = own.groupBy(F.col(thread).alias("_t"), F.col(key).alias("_k")).agg(F.max(turn).alias("_n"))
    rows = own.join(last, F.col(thread).eqNullSafe(F.col("_t")) & (F.col(key) == F.col("_k")) & (F.col(turn) == F.col("_n")))
    return rows.groupBy(thread, key, turn).agg(F.max(value).alias(value)).select(thread, key, value, turn)


def qa_pairs(log: DataFrame, thread: str, turn: str, role: str, text: str,
             question_role: str = "user", answer_role: str = "assistant") -> DataFrame:
    """A question turn paired with the answer in the next turn of the same
    thread, whatever numbers are missing in between (rows of one turn in the order of
    role and text).

    The window sees turn numbers and roles only; the texts are joined by thread and turn,
    so a long thread's texts are spread over many tasks."""
    order = Window.partitionBy(thread).orderBy(turn, role)
    turns = log.select(thread, turn, role).distinct()
    pairs = (turns.withColumn("_nt", F.lead(turn).over(order)).withColumn("_nr", F.lead(role).over(order))
             .where((F.col(role) == question_role) & (F.col("_nr") == answer_role))
             .select(F.col(thread).alias("_t"), F.col(turn).alias("_q"), F.col("_nt").alias("_a")))
    q = log.where(F.col(role) == question_role).select(thread, turn, F.col(text).alias("question"))
    a = log.where(F.col(role) == answer_role).select(F.col(thread).alias("_t2"), F.col(turn).alias("_a2"), F.col(text).alias("answer"))
    both = q.join(pairs, (F.col(thread) == F.col("_t")) & (F.col(turn) == F.col("_q")))
    return (both.join(a, (F.col("_t") == F.col("_t2")) & (F.col("_a") == F.col("_a2")))
            .select(thread, turn, "question", "answer"))


def _text_list(v: Column, path: str) -> Column:
    """A list of trimmed, non-empty texts from a JSON value that is an array, a
    scalar (one-element list) or absent (empty list)."""
    arr = F.try_variant_get(v, path, "array<string>")
    one = F.try_variant_get(v, path, "string")
    lst = F.when(arr.isNotNull(), arr).when(one.isNotNull(), F.array(one)).otherwise(F.array().cast("array<string>"))
    return F.filter(F.transform(lst, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))


def normalize_plans(df: DataFrame, reply_col: str, out: str = "plan") -> DataFrame:
    """L2 over a log table: the reply is parsed once in its own projection (a
    variant referenced by every field would otherwise be parsed per field),
    then the fields are read from the parsed value."""
    parsed = df.withColumn("_v", F.try_parse_json(F.col(reply_col)))
    return parsed.withColumn(out, _normalize_variant(F.col("_v"))).drop("_v")


def extract_json_column(df: DataFrame, text_col: str, out: str = "extracted") -> DataFrame:
    """L1: the JSON object in a reply: a fenced ``json`` block (the shortest) first, else
    the span from the first ``{`` to the last ``}``.  Text that is no valid JSON gives
    null; an invalid block does not fall back to the span.  The candidate is computed
    once, in a projection of its own."""
    t = F.trim(F.col(text_col))
    fenced = F.regexp_extract(t, r"(?is)```json\s*(\{.*?\})\s*```", 1)
    greedy = F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    step = df.withColumn("_c", F.when(fenced != "", fenced).when(greedy != "", greedy))
    return step.withColumn(out, F.when(F.try_parse_json(F.col("_c")).isNotNull(), F.col("_c"))).drop("_c")


def _normalize_variant(v: Column) -> Column:
    sql = F.coalesce(F.trim(F.try_variant_get(v, "$.sql", "string")), F.lit(""))
    queries = _text_list(v, "$.queries")
    fv = F.try_variant_get(v, "$.filters", "variant")
    filters = F.when(F.coalesce(F.schema_of_variant(fv).startswith("OBJECT"), F.lit(False)),
                     F.to_json(fv)).otherwise(F.lit("{}"))
    conf = F.try_variant_get(v, "$.confidence", "double")
    tags_raw = _text_list(v, "$.reason_tags")
    tags = F.transform(tags_raw, lambda x: F.substring(
        F.regexp_replace(F.replace(F.lower(x), F.lit(" "), F.lit("_")), "[^a-z0-9_\\-]", ""), 1, 32))
    tags = F.slice(F.array_distinct(F.filter(tags, lambda x: x != "")), 1, 6)
    return F.struct(
        sql.alias("sql"), queries.alias("queries"), _text_list(v, "$.assumptions").alias("assumptions"),
        _text_list(v, "$.needed_tables").alias("needed_tables"), filters.alias("filters"),
        F.substring(F.coalesce(F.trim(F.try_variant_get(v, "$.rationale_summary", "string")), F.lit("")), 1, 280)
        .alias("rationale_summary"),
        F.least(F.greatest(conf, F.lit(0.0)), F.lit(1.0)).alias("confidence"),
        tags.alias("reason_tags"), ((sql != "") | (F.size(queries) > 0)).alias("valid"))
