"""The pipeline stage by stage, on a small table with planted cases."""

import numpy as np
from conftest import SMOKE

import corpus_pipeline as P


def test_planted_cases(spark, tmp_path):
    rng = np.random.default_rng(8)
    text = lambda n: " ".join(f"p{x}" for x in rng.integers(0, 10**6, n))
    passage, clean = text(70), [text(90) for _ in range(6)]
    item = text(30)
    near = clean[0].split()
    near[40] = "changed"
    rows = [(1, clean[0]), (2, clean[0]), (3, " ".join(near)), (4, clean[1] + "\n" + passage), (5, clean[2] + "\n" + passage),
            (6, clean[3] + " " + item + " " + clean[4]), (7, clean[5]), (8, None), (9, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint")
    d = str(tmp_path)
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    left = {}
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, d)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        left[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(left["toxicity"]) == set(range(1, 10))
    assert set(left["ngram_jaccard_join"]) == {1, 4, 5, 6, 7, 8, 9}
    assert left["substring_dedup"][5].strip() == clean[2] and left["substring_dedup"][4] == rows[3][1]
    assert set(left["benchmark_decontamination"]) == {1, 4, 5, 7, 8, 9}
    assert P.STAGES[-1][1](spark, docs, d).groupBy().sum("length").first()[0] > 0


def test_run_and_registration(spark):
    import __spark_entry__ as E

    rows = E.queries()["pipeline"](spark, SMOKE).collect()
    assert rows and {r["offset"] for r in rows} >= {0}
    assert P.ORACLE_SQL is None and [n for n, _ in P.STAGES][-1] == "packing"


def test_stages_on_empty_documents(spark, tmp_path):
    d = str(tmp_path)
    for t in ("benchmark", "labels"):
        spark.read.parquet(f"{SMOKE}/{t}.parquet").limit(0).write.parquet(f"{d}/{t}.parquet")
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, d)
    assert docs.collect() == []
