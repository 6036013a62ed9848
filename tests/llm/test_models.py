"""Toxicity and language-model scores: held-out accuracy, exact base scores, odd rows."""

import math
import zlib
from collections import Counter

import numpy as np
from conftest import SMOKE
from tests.llm.conftest import ODD, words

from tillpoint.llm import lm_maxent, toxicity


def sample(spark, n=600, seed=4):
    """Documents of made-up words; toxic ones hold one of a few stems with any ending."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "re", "su", "ta", "vo"], 3))
    docs, labels = [], []
    for i in range(n):
        w = [word() for _ in range(rng.integers(20, 80))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                w[rng.integers(len(w))] = rng.choice(["grumz", "blorf"]) + word()
        docs.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = sample(spark)
    rows = toxicity.score(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 600 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert np.mean([r["predicted"] == r["toxic"] for r in held]) > 0.95
    kept = toxicity.keep_ordinary(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in rows if not r["predicted"]}


def test_probabilities_are_kneser_ney(spark):
    """Against a plain version: tokens at the word, distinct words of the class at its stems,
    distinct words of both classes in the shares."""
    rng = np.random.default_rng(2)
    vocabulary = ["".join(rng.choice(list("ab"), rng.integers(1, 13))) for _ in range(60)]
    texts = [([vocabulary[i] for i in rng.integers(0, 60, 40)], int(y)) for y in (0, 1) for _ in range(6)]
    counts = [Counter(w for t, y in texts if y == c for w in t) for c in (1, 0)]
    every = sorted(set(counts[0]) | set(counts[1]))
    stem = lambda w, o: w if o == 0 else w[:toxicity.STEMS[o - 1]]
    D, orders = 0.75, len(toxicity.STEMS) + 1

    def mass(c, o):
        return counts[c] if o == 0 else Counter(stem(w, o) for w in counts[c])

    def p(w, c, o):
        if o == orders:
            return 1.0, len(every) + 1
        n, s = mass(c, o), stem(w, o)
        low, above = p(w, c, o + 1)
        spare = sum(min(v, D) for v in n.values()) / sum(n.values())
        here = len({x for x in every if stem(x, o) == s}) or 1
        return max(n[s] - D, 0) / sum(n.values()) + spare * low * min(here / above, 1), here + 1

    table = __import__("pyarrow").array([" ".join(every + ["abababababab", "q"])])
    sl = next(toxicity.W.slices(table, gaps=toxicity.W.PUNCTUATION))
    keys, of = toxicity._expressions(sl)
    known = next(toxicity.W.slices(__import__("pyarrow").array([" ".join(every)]), gaps=toxicity.W.PUNCTUATION))
    own, place = toxicity._expressions(known)
    n = np.zeros((len(every), 2))
    n[place] = [[counts[0][w], counts[1][w]] for w in every]
    got = toxicity.Model(own, n, D).log_odds(keys)[of]
    want = [math.log(p(w, 0, 0)[0] / p(w, 1, 0)[0]) for w in [*every, "abababababab", "q"]]
    assert np.allclose(got, want)


def test_the_curve_settles_on_classes_that_are_almost_apart():
    """Where full steps overshoot: one column parts the classes but for a few rows."""
    rng = np.random.default_rng(0)
    y = (np.arange(4000) % 4 == 0).astype(float)
    x = np.stack([rng.normal(0, 1, 4000), rng.normal(0, 20, 4000), np.where(y == 1, 17.9, rng.normal(8, 2.5, 4000)), np.ones(4000)], 1)
    x[::401, 2] = 17
    p = toxicity._sigmoid(x @ toxicity.fit_logistic(x, y))
    assert ((p >= 0.5) & (y == 0)).mean() < 0.02 and ((p < 0.5) & (y == 1)).mean() < 0.01


def test_held_out_labels_are_never_read(spark):
    docs, labels = sample(spark, 200)
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 1 - toxic, toxic) as toxic")
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(toxicity.score(docs, labels)) == key(toxicity.score(docs, flipped))


def test_toxicity_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(4, 1), (4, 0), (6, 0), (None, 1), (99, 1), (8, None), (9, 7)], "doc_id bigint, toxic int")
    for some in (labels, labels.limit(0)):
        rows = toxicity.score(odd, some).collect()
        assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
        assert len({r["score"] for r in rows if r["doc_id"] in (1, 2, 3)}) == 1
    assert toxicity.score(odd.limit(0), labels).collect() == []


def brute(rows):
    count, docs = Counter(), 0
    for i, t in rows:
        if i is None or zlib.crc32(str(i).encode()) % 5 != 1:
            count.update(words(t))
            docs += 1
    n, v = sum(count.values()) + docs, len(count) + (docs > 0)
    for i, t in rows:
        w = words(t)
        base = sum(math.log10((c + 0.5) / (n + 0.5 * (v + 1))) for c in [*(count[x] for x in w), docs])
        yield i, len(w) + 1, sum(count[x] > 0 for x in w) + (docs > 0), n, base


def check_base(got, rows):
    order = lambda x: sorted(x, key=lambda r: (str(r[0]), r[1]))
    for g, e in zip(order((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got), order(brute(rows)),
                    strict=True):
        assert g[:4] == e[:4] and math.isclose(g[4], e[4], rel_tol=1e-9), (g, e)


def test_base_scores_and_gain(spark):
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet").select("doc_id", "text")
    got = lm_maxent.score(docs).collect()
    check_base(got, [(r["doc_id"], r["text"]) for r in docs.collect()])
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1) for r in got)
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_rare_words_come_from_the_join(spark, monkeypatch):
    monkeypatch.setattr(lm_maxent, "KNOWN", 100)
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet").select("doc_id", "text").limit(60)
    check_base(lm_maxent.score(docs).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_lm_of_odd_rows(odd):
    got = lm_maxent.score(odd).collect()
    check_base(got, ODD)
    assert all(math.isfinite(r["score"]) and r["score"] <= 0 for r in got)
    assert lm_maxent.score(odd.limit(0)).collect() == []
    only = odd.where("doc_id = 6").selectExpr("4L as doc_id", "text")     # 4 may or may not be held out
    assert lm_maxent.score(only).count() == 1


def test_class_probabilities_sum_to_one(spark):
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet").select("doc_id", "text")
    model, _, _ = lm_maxent.train(docs, "text")
    f = np.random.default_rng(0).integers(0, lm_maxent.FEATURES, (5, 4))
    total = sum(10 ** model.class_log(f, np.full(5, c)) for c in range(lm_maxent.CLASSES))
    assert np.allclose(total, 1, atol=1e-4)


def test_every_place_is_learned_from(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 40, 150)) for _ in range(3)]
    model, _, _ = lm_maxent.train(spark.createDataFrame([(t,) for t in texts], "text string"), "text")
    for sl in lm_maxent.W.slices(lm_maxent.pa.array(texts)):
        assert (model.weights[model.tokens_of(sl)["features"]] != 0).any(-1).all()


def test_run_sums_are_those_of_reduceat():
    rng = np.random.default_rng(3)
    for n, kinds in ((1, 1), (40, 1), (500, 3), (3000, 900)):
        z = rng.normal(size=(n, 7)).astype(np.float32)
        flat = rng.integers(0, kinds, 4 * n).astype(np.uint16)
        order = np.argsort(flat, kind="stable")
        cut = np.flatnonzero(np.concatenate([[True], flat[order][1:] != flat[order][:-1]]))
        got, by = lm_maxent._run_sums(z, order % n, cut)
        assert sorted(by) == list(range(len(cut)))
        assert (got == np.add.reduceat(z[order % n], cut, axis=0)[by]).all()


def test_feature_numbers_fit_16_bits():
    assert lm_maxent.FEATURES <= 1 << 16
