import numpy as np
from conftest import SMOKE

from tillpoint.llm import decontaminate as D


def test_every_thirteen_word_run_is_found(spark):
    docs, bench = (spark.read.parquet(f"{SMOKE}/{t}.parquet") for t in ("documents", "benchmark"))
    runs, expected = {}, set()
    for r in bench.collect():
        w = r["text"].lower().split()
        for a in range(len(w) - 12):
            runs.setdefault(tuple(w[a:a + 13]), set()).add(r["item_id"])
    for r in docs.collect():
        w = r["text"].lower().split()
        for a in range(len(w) - 12):
            expected |= {(r["doc_id"], i) for i in runs.get(tuple(w[a:a + 13]), ())}
    got = {(r["doc_id"], r["item_id"]) for r in D.contaminated(docs, bench).collect()}
    assert expected and expected <= got and len(got) <= len(expected) + 2


def test_substitutions_are_tolerated_and_chance_is_not(spark):
    rng = np.random.default_rng(5)
    item = [f"q{x}" for x in rng.integers(0, 10**6, 40)]
    noise = lambda n: [f"n{x}" for x in rng.integers(0, 10**6, n)]
    changed = [w if i % 8 else "other" for i, w in enumerate(item)]
    rows = [(1, noise(50) + item + noise(50)), (2, noise(9) + changed), (3, noise(80)), (4, noise(30) + item[:8] + noise(30))]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id bigint, text string")
    bench = spark.createDataFrame([(7, " ".join(item).upper()), (8, None), (9, ""), (10, "too short")], "item_id bigint, text string")
    found = D.contaminated(docs, bench)
    got = {r["doc_id"]: r for r in found.collect()}
    assert set(got) == {1, 2}
    assert got[1]["equal_words"] == 40 and got[1]["start_word"] == 50 and got[2]["equal_words"] == 35
    assert {r["doc_id"] for r in D.remove_contaminated(docs, found).collect()} == {3, 4}


def test_odd_rows(spark, odd):
    bench = spark.createDataFrame([(1, "a b c d e f g"), (None, "a b c d e f g")], "item_id bigint, text string")
    got = D.contaminated(odd, bench).collect()
    assert sorted(((r["doc_id"], r["item_id"]) for r in got), key=str) == sorted([(6, 1), (6, None), (None, 1), (None, None)], key=str)
    assert D.contaminated(odd, bench.limit(0)).collect() == []
    assert D.contaminated(odd.limit(0), bench).collect() == []
