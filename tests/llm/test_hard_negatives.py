"""Threshold joins against all pairs."""

import math

import numpy as np
import pytest

from tillpoint.llm import hard_negatives as H


def brute(rows, anchors=lambda i: i % 50 == 0, relabel=True):
    sound = []
    for i, v, l in dict.fromkeys((i, None if v is None else tuple(v), l) for i, v, l in rows):
        if None in (i, v, l) or any(x is None or not math.isfinite(x) for x in v):
            continue
        sound.append((i, [math.floor(256 * float(np.float32(x))) for x in v], (l + 1) % 10 if relabel and i % 7 == 0 else l))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for n, (i, v, l) in enumerate(sound):
        if not anchors(i):
            continue
        scores = sorted((-dot(v, w), j, k) for m, (j, w, k) in enumerate(sound) if m != n)
        for s, p, _ in [x for x in scores if x[2] == l][:5]:
            fit = [x for x in scores if x[2] != l and 50 * -s <= 100 * -x[0] <= 95 * -s][:3]
            out += [(i, p, r, j, -s, -t) for r, (t, j, _) in enumerate(fit, 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")


def vectors(n, dims, seed, spread=1.0):
    """Vectors around a few centres, so scores differ much and some rows are copies."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    rows = []
    for i in range(n):
        v = centres[rng.integers(6)] + spread * rng.normal(size=dims)
        v *= rng.choice([0.2, 1, 1, 3]) / np.linalg.norm(v)
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(0, 4)) if i % 3 else 1))
    for i in range(0, n, 11):
        rows[i] = (i, rows[i // 2][1], rows[i][2])
    return rows


def run(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("n, dims, seed, spread", [(700, 16, 1, 0.5), (400, 3, 2, 1.0), (300, 21, 3, 0.1)])
def test_equals_all_pairs(spark, n, dims, seed, spread):
    rows = vectors(n, dims, seed, spread)
    assert run(H.hard_negatives(frame(spark, rows))) == brute(rows)


def test_blocks_of_anchors(spark):
    """Several blocks of anchors, small blocks of the index, every third row an anchor."""
    rows = vectors(200, 9, 5)
    got = run(H.mine(H.whole_vectors(frame(spark, rows)), "id % 3 = 0", anchor_rows=7))
    assert got == brute(rows, lambda i: i % 3 == 0, relabel=False)


def test_threshold_join_finds_all_pairs_and_prunes():
    rng = np.random.default_rng(0)
    x = np.floor(256 * rng.normal(size=(500, 40)) * np.linspace(1, 0.1, 40)).astype(np.int64)
    a = H.Anchors(np.arange(30), np.zeros(30, int), x[:30].astype(float))
    full = x[:30] @ x.T
    for q in (0.5, 0.9, 0.99, 1.0):
        t = np.quantile(full, q, axis=1).astype(np.int64)
        i, j, s = H.threshold_join(a, x.T, H._suffix_norms(x, H.STEP), np.arange(30), t)
        want = np.nonzero(full >= t[:, None])
        assert sorted(zip(i, j)) == sorted(zip(*want)) and (s == full[i, j]).all()
    assert not len(H.threshold_join(a, x.T, H._suffix_norms(x, H.STEP), np.arange(30), np.full(30, 10**9))[0])


def test_thresholds_are_lowered_only_as_far_as_needed(spark, monkeypatch):
    """Open windows go on, filled ones don't; the lowest threshold is the window's end."""
    seen = []
    search = H._search
    monkeypatch.setattr(H, "_search", lambda i, a, w, k, same: seen.append((same, len(w), w.threshold.copy(), w.low)) or search(i, a, w, k, same))
    rows = vectors(900, 12, 7)
    assert run(H.hard_negatives(frame(spark, rows))) == brute(rows)
    for same in (True, False):
        sizes = [n for s, n, _, _ in seen if s == same]
        assert sizes == sorted(sizes, reverse=True) and all((t >= low).all() for s, _, t, low in seen if s == same)
    assert len(seen) <= 6


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (0, [0.9, 0.1], 2), (None, [1.0, 1.0], 1), (1, None, 1), (2, [1.0, None], 1), (3, [nan, 1.0], 1),
            (4, [inf, 1.0], 1), (5, [1.0, 1.0], None), (6, [1.0, 0.4], 1), (8, [0.8, 0.4], 2), (9, [0.8, 0.4], 3), (10, [0.8], 2), (11, [], 3),
            (12, [0.7, 0.4, 5.0], 1), (50, [0.0, 0.0], 1), (100, [-1.0, 0.0], 1), (13, [0.8, 0.4], 2), (14, [0.6, 0.3], 2)]
    df = frame(spark, rows).selectExpr("*", "1 as id", "2 as v", "3 as win", "4 as score", "5 as part")
    assert run(H.hard_negatives(df)) == brute(rows)
    assert run(H.hard_negatives(df.where("label = 1 and vec_id % 7 <> 0"))) == []
    assert run(H.hard_negatives(df.limit(0))) == []
