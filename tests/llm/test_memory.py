"""What a task holds beside its JVM: batches of the texts, and what a worker keeps of them."""

import numpy as np
import pyarrow as pa
import pytest

from tillpoint.llm import io, jaccard_join, substring_dedup, toxicity
from tillpoint.llm.io import BATCH_BYTES, giving_back, small_batches

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_small_batches_hold_for_the_jobs_inside_only(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], ["bytes", "rows"])

    docs = spark.range(0, 900, 1, 1).selectExpr("id", "repeat('word ', 2000) text").mapInArrow(sizes, "bytes long, rows long")
    with small_batches(spark):
        got = docs.collect()
    assert sum(r["rows"] for r in got) == 900 and max(r["bytes"] for r in got) < 1.2 * BATCH_BYTES
    assert [r["rows"] for r in docs.alias("again").collect()] == [900]


def test_the_sessions_own_limit_returns(spark):
    spark.conf.set(LIMIT, "5m")
    try:
        with pytest.raises(ZeroDivisionError), small_batches(spark):
            assert spark.conf.get(LIMIT) == str(BATCH_BYTES)
            1 / 0
        assert spark.conf.get(LIMIT) == "5m"
    finally:
        spark.conf.unset(LIMIT)


def test_every_job_of_the_join_takes_small_batches(spark, monkeypatch):
    seen = []

    def stash(df, name):
        seen.append((name, spark.conf.get(LIMIT)))
        return io.stash(df, name)

    monkeypatch.setattr(jaccard_join, "stash", stash)
    docs = spark.createDataFrame([(i, "a b c d e f g h " + "z " * (i % 2)) for i in range(6)], "doc_id bigint, text string")
    before = spark.conf.get(LIMIT)
    assert jaccard_join.links(docs).count()
    assert {name for name, _ in seen} == {"prefix", "pairs", "involved", "links", "placed"}
    assert {limit for _, limit in seen} == {str(BATCH_BYTES)}
    assert spark.conf.get(LIMIT) == before


def test_every_job_of_substring_dedup_takes_small_batches(spark, monkeypatch):
    seen = []

    def stash(df, name):
        seen.append((name, spark.conf.get(LIMIT)))
        return io.stash(df, name)

    monkeypatch.setattr(substring_dedup, "stash", stash)
    text = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame([(1, text), (2, "x " + text)], "doc_id bigint, text string")
    before = spark.conf.get(LIMIT)
    assert [(r["doc_id"], r["source_id"]) for r in substring_dedup.repeated_passages(docs).collect()] == [(2, 1)]
    assert {name for name, _ in seen} == {"seeds", "seams", "longer", "chains", "passages"}
    assert {limit for _, limit in seen} == {str(BATCH_BYTES)}
    assert spark.conf.get(LIMIT) == before


def test_workers_give_back_after_the_last_batch(monkeypatch):
    done = []

    class Pool:
        def release_unused(self):
            done.append(True)

    monkeypatch.setattr(pa, "default_memory_pool", Pool)
    rows = giving_back(lambda batches: (b + 1 for b in batches))(iter([1, 2]))
    assert next(rows) == 2 and next(rows) == 3 and not done
    assert next(rows, None) is None and done


def test_toxicity_writes_whole_documents_in_parts(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "curve", lambda model, weights, column: np.arange(len(column)) % 3 / 2)
    run = []

    class Docs:
        sparkSession, schema = spark, None

        def mapInArrow(self, f, schema):
            run.append(f)

    monkeypatch.setattr(toxicity, "train", lambda *a: (None, None))
    toxicity.keep_ordinary(Docs(), None)
    n = 3 * toxicity.ROWS + 5
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(["t"] * n)], ["doc_id", "text"])
    got = list(run[0](iter([batch, batch.slice(0, 0)])))
    assert max(b.num_rows for b in got) <= toxicity.ROWS
    assert [i for b in got for i in b.column(0).to_pylist()] == [i for i in range(n) if i % 3 == 0]
