from collections import Counter

from conftest import SMOKE
from tests.llm.conftest import words

from tillpoint.llm import jaccard_join
from tillpoint.llm.components import components


def brute(rows):
    sets, where = {}, {}
    for i, t in rows:
        w = words(t)
        s = {tuple(w[a:a + 5]) for a in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        sets[i] = s
        for x in s:
            where.setdefault(x, []).append(i)
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, s in sets.items():
        for j, both in Counter(e for x in s for e in where[x] if e < i).items():
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: (len(s), top(i)) for i, s in sets.items()}


def test_components_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == brute([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])


def test_near_copies_of_one_text_and_of_each_other(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(base))]
    for i in range(2, 40):                        # some too far from the first, near to others
        w = list(base)
        for e in range(i % 5):
            w[(i * 7 + e * 13) % 60] = f"x{i % 3}{e}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == brute(rows)


def test_odd_rows(odd):
    rows = jaccard_join.jaccard_components(odd).collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows}
    assert [by[i]["n_shingles"] for i in (1, 2, 3, 4, 5, 6, 8, 9)] == [0, 0, 0, 1, 1, 3, 1, 1]
    assert all(by[i]["component_id"] == i for i in by if i is not None)
    assert by[None]["component_id"] is None
    assert jaccard_join.jaccard_components(odd.limit(0)).collect() == []


def test_overlap_bound_is_never_too_small():
    import numpy as np
    rng = np.random.default_rng(1)
    for _ in range(50):
        a = np.unique(rng.integers(0, 2**64, 200, dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.6], rng.integers(0, 2**64, rng.integers(1, 300), dtype=np.uint64)]))
        assert jaccard_join.overlap_bound(jaccard_join._histogram(a), jaccard_join._histogram(b)) >= len(np.intersect1d(a, b))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(20, 60)] + [(100, 100 + i) for i in range(1, 80)] + [(5, 5), (None, 3)]
    got = dict(components(spark.createDataFrame(edges, "u bigint, v bigint")).collect())
    assert got == {i: 20 for i in range(20, 61)} | {i: 100 for i in range(100, 180)}
