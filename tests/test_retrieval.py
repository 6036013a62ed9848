"""Retrieval jobs against brute force on small literal inputs."""

import numpy as np

from tillpoint.operators import retrieval as R


def test_chunks_cover_whole_text(spark):
    texts = [(1, "a" * 1000), (2, "b" * 1001), (3, "".join(chr(65 + i % 26) for i in range(2650))), (4, "")]
    df = spark.createDataFrame(texts, "id long, t string")
    got = {}
    for r in R.chunk_text(df, "id", "t", 100 * 10, 200).collect():
        got.setdefault(r.id, []).append((r.chunk_no, r.chunk))
    assert len(got[1]) == 1 and len(got[2]) == 2 and 4 not in got
    for i, t in texts[:3]:
        chunks = [c for _, c in sorted(got[i])]
        assert all(len(c) <= 1000 for c in chunks)
        assert "".join(c[:800] for c in chunks[:-1]) + chunks[-1] == t


def test_nearest_matches_brute_force(spark):
    rng = np.random.default_rng(7)
    vecs = rng.normal(size=(60, 5)).astype("float32")
    df = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(vecs)], "vid long, e array<float>, lab int")
    q = R.label_centroids(df, "lab", "e")
    got = {(r.query_id, r.rank): r.vid for r in R.nearest(df.repartition(4), "vid", "e", q, "lab", "centroid", 3).collect()}
    for lab in range(3):
        c = vecs[np.arange(60) % 3 == lab].astype("float64").mean(axis=0)
        d = np.sqrt(((vecs.astype("float64") - c) ** 2).sum(axis=1))
        order = np.lexsort((np.arange(60), d))[:3]
        assert [got[(lab, k + 1)] for k in range(3)] == order.tolist()


def test_contains_matches_batches(spark):
    texts = [(1, "the quick brown fox"), (2, "lazy dog"), (3, "brown dog"), (4, None), (5, "ab  cd\nef gh ij kl"), (6, "é"), (7, "")]
    wanted = [(10, "brown"), (11, "dog"), (12, "cat"), (13, ""), (14, "e quick bro"), (15, "cd\nef gh ij k"), (16, "cd ef gh ij k"),
              (17, "o"), (18, " "), (19, "é"), (20, "b  cd\nef"), (21, None)]
    docs = spark.createDataFrame(texts, "d long, t string")
    pats = spark.createDataFrame(wanted, "p long, q string")
    got = sorted((r.p, r.d) for r in R.contains_matches(docs, "d", "t", pats, "p", "q").collect())
    assert got == sorted((p, d) for p, q in wanted for d, t in texts if q and t is not None and q in t)
    assert R.contains_matches(docs, "d", "t", pats.limit(0), "p", "q").collect() == []
    ctx = R.assemble_context(spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "q int, rank int, txt string"),
                             "q", "rank", "txt").first()
    assert ctx.context == "a\n\nb" and ctx.n_retrieved == 2


def test_nearest_exact_ties_and_query_blocks(spark):
    rng = np.random.default_rng(11)
    base = rng.normal(size=(20, 4))
    vecs = np.concatenate([base, base, base[:5]])  # every distance occurs two or three times
    rows = [(int(i), v.tolist()) for i, v in enumerate(vecs)]
    df = spark.createDataFrame(rows, "vid long, e array<double>")
    qs = rng.normal(size=(9, 4))
    q = spark.createDataFrame([(j, v.tolist()) for j, v in enumerate(qs)], "qid int, qv array<double>")
    got = {}
    for r in R.nearest(df.repartition(3), "vid", "e", q, "qid", "qv", 4, max_cells=7).collect():
        got[(r.query_id, r.rank)] = (r.vid, r.distance)
    for j, c in enumerate(qs):
        d = np.sqrt(((vecs - c) ** 2).sum(axis=1))
        order = np.lexsort((np.arange(len(vecs)), d))[:4]
        assert [got[(j, k + 1)][0] for k in range(4)] == order.tolist()
        assert np.allclose([got[(j, k + 1)][1] for k in range(4)], d[order], rtol=0, atol=1e-12)
    # three blocks of queries give the same answer
    again = {(r.query_id, r.rank): (r.vid, r.distance)
             for r in R.nearest(df, "vid", "e", q, "qid", "qv", 4, block_bytes=100).collect()}
    assert again == got


def test_nearest_merges_across_arrow_batches(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 3))
    vecs = np.concatenate([base, base])  # ties across batches
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(vecs)], "vid long, e array<double>")
    qs = rng.normal(size=(6, 3))
    q = spark.createDataFrame([(j, v.tolist()) for j, v in enumerate(qs)], "qid int, qv array<double>")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(r.query_id, r.rank): r.vid for r in R.nearest(df.coalesce(1), "vid", "e", q, "qid", "qv", 5).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    for j, c in enumerate(qs):
        d = np.sqrt(((vecs - c) ** 2).sum(axis=1))
        assert [got[(j, r + 1)] for r in range(5)] == np.lexsort((np.arange(len(vecs)), d))[:5].tolist()
    assert len(got) == 6 * 5
