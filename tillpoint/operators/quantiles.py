"""Exact quantiles without gathering a column into one task.

Spark's exact ``percentile`` keeps a value->count map per group and merges all
maps in one final task: unbounded for a high-cardinality amount column at scale.
``exact_quantiles_many`` finds the values at the needed ranks instead, for any
number of columns at once:

* every target rank has a state ``[lo, hi]`` (closed), the count of values
  below ``lo`` and the count inside;
* one job computes, per state, a ``percentile_approx`` window around the rank
  (a bounded sketch; its rank error is at most count/accuracy), one job counts
  exactly how many values fall below, inside and above each window, and the
  state shrinks to the part that holds the rank – always exact, whatever the
  sketch returned;
* states with at most ``direct_rows`` values are fetched together in one job.

Only per-state numbers and at most ``direct_rows`` values per state reach the
driver.  The projected double columns are persisted for the few passes (8
bytes a value, recomputed from lineage if an executor is lost).  Interpolation
is linear between neighbouring ranks, as pandas ``quantile``, DuckDB
``quantile_cont`` and Spark ``percentile``.  Null and NaN are skipped.
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpoint.session import spread


def _in(i: int, lo, hi):
    v = F.col(f"v{i}")
    cond = v.isNotNull()
    if lo is not None:
        cond = cond & (v >= lo)
    if hi is not None:
        cond = cond & (v <= hi)
    return cond


def value_count(c: str):
    """The count the rank search works from: values that are neither null nor NaN."""
    return F.count(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")))


def exact_quantiles_many(df: DataFrame, columns, probs, accuracy: int = 10_000,
                         direct_rows: int = 50_000, persist: bool = True, counts: dict | None = None) -> dict:
    """``{column: [quantile per prob]}`` (None for a column without values).

    ``counts`` (``{column: value_count}``) may come from an aggregate the
    caller runs anyway; the counting pass is then skipped."""
    cols = list(columns)
    base = df.select(*[F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")).alias(f"v{i}")
                       for i, c in enumerate(cols)])
    if persist:
        base = spread(base).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if counts is not None:
            counts = {f"n{i}": counts[c] for i, c in enumerate(cols)}
        else:
            counts = base.agg(*[F.count(f"v{i}").alias(f"n{i}") for i in range(len(cols))]).first()
        need: dict = {}
        for i in range(len(cols)):
            n = counts[f"n{i}"]
            for p in probs:
                if n:
                    x = p * (n - 1)
                    need[(i, int(math.floor(x)))] = None
                    need[(i, min(int(math.floor(x)) + 1, n - 1))] = None
        # state per (column, rank): lo, hi, values below lo, values in [lo, hi]
        state = {k: (None, None, 0, counts[f"n{k[0]}"]) for k in need}
        found: dict = {}
        while state:
            small = {k: s for k, s in state.items() if s[3] <= direct_rows}
            big = {k: s for k, s in state.items() if s[3] > direct_rows}
            if small:
                _fetch(base, small, found)
            state = _narrow(base, big, accuracy) if big else {}
            for k, (lo, hi, off, cnt) in list(state.items()):
                if lo is not None and lo == hi:
                    found[k] = lo
                    del state[k]
    finally:
        if persist:
            base.unpersist()
    out = {}
    for i, c in enumerate(cols):
        n = counts[f"n{i}"]
        if not n:
            out[c] = [None for _ in probs]
            continue
        res = []
        for p in probs:
            x = p * (n - 1)
            lo = int(math.floor(x))
            hi = min(lo + 1, n - 1)
            frac = x - lo
            a, b = found[(i, lo)], found[(i, hi)]
            res.append(a + (b - a) * frac if frac else a)
        out[c] = res
    return out


def _fetch(base: DataFrame, small: dict, found: dict) -> None:
    """One job: the values of every small state, ranked on the driver."""
    ranges = {}
    for (i, r), (lo, hi, off, cnt) in small.items():
        ranges.setdefault((i, lo, hi), []).append((r, off))
    keys = list(ranges)
    long = base.select(F.explode(F.array(*[
        F.struct(F.lit(j).alias("k"), F.col(f"v{i}").alias("v"), _in(i, lo, hi).alias("keep"))
        for j, (i, lo, hi) in enumerate(keys)])).alias("x")).select("x.*").where("keep")
    by_key: dict = {}
    for row in long.collect():
        by_key.setdefault(row.k, []).append(row.v)
    for j, key in enumerate(keys):
        vals = sorted(by_key.get(j, []))
        for r, off in ranges[key]:
            found[(key[0], r)] = vals[r - off]


def _narrow(base: DataFrame, big: dict, accuracy: int) -> dict:
    """Two jobs: sketch windows around the ranks of each state, then exact counts.

    Ranks that share a column and a state (typically the two neighbours of one
    quantile) share one window."""
    by_state: dict = {}
    for k, st in big.items():
        by_state.setdefault((k[0], st), []).append(k[1])
    groups: dict = {}
    for (i, st), rs in by_state.items():
        # ranks closer than the sketch margin share a window; others get their own
        m = 2 * st[3] / accuracy + 2
        rs = sorted(rs)
        cluster = [rs[0]]
        for r in rs[1:]:
            if r - cluster[-1] > m:
                groups[(i, st, cluster[0])] = cluster
                cluster = [r]
            else:
                cluster.append(r)
        groups[(i, st, cluster[0])] = cluster
    gkeys = list(groups)
    # windows of one column and one state read one sketch (all their bounds in one array)
    sketches: dict = {}
    for j, (i, st, _) in enumerate(gkeys):
        sketches.setdefault((i, st), []).append(j)
    wins = []
    for s, ((i, (lo, hi, off, cnt)), js) in enumerate(sketches.items()):
        m = 2 * cnt / accuracy + 2
        ps = []
        for j in js:
            rs = groups[gkeys[j]]
            ps += [max(0.0, (min(rs) - off - m) / cnt), min(1.0, (max(rs) - off + m) / cnt)]
        wins.append(F.percentile_approx(F.when(_in(i, lo, hi), F.col(f"v{i}")), ps, accuracy).alias(f"s{s}"))
    row = base.agg(*wins).first()
    w = {}
    for s, js in enumerate(sketches.values()):
        for t, j in enumerate(js):
            w[f"w{j}"] = (row[f"s{s}"][2 * t], row[f"s{s}"][2 * t + 1])
    aggs = []
    for j, (i, (lo, hi, _, _), _) in enumerate(gkeys):
        a, b = w[f"w{j}"]
        v = F.col(f"v{i}")
        aggs += [F.count_if(_in(i, lo, hi) & (v < a)).alias(f"b{j}"),
                 F.count_if(_in(i, lo, hi) & (v >= a) & (v <= b)).alias(f"m{j}"),
                 F.count_if(_in(i, lo, hi) & (v == a)).alias(f"e{j}")]
    c = base.agg(*aggs).first()
    nxt = {}
    for j, g in enumerate(gkeys):
        i, (lo, hi, off, cnt), _ = g
        a, b = w[f"w{j}"]
        below, inside, equal = c[f"b{j}"], c[f"m{j}"], c[f"e{j}"]
        for r in groups[g]:
            local = r - off
            if inside == cnt:
                # the window covers the whole state (few distinct values): split at
                # a, which is a value of the state, so the count strictly drops
                nxt[(i, r)] = (a, a, off, equal) if local < equal else \
                    (math.nextafter(a, math.inf), hi, off + equal, cnt - equal)
            elif local < below:
                nxt[(i, r)] = (lo, math.nextafter(a, -math.inf), off, below)
            elif local < below + inside:
                nxt[(i, r)] = (a, b, off + below, inside)
            else:
                nxt[(i, r)] = (math.nextafter(b, math.inf), hi, off + below + inside, cnt - below - inside)
    return nxt


def exact_quantiles(df: DataFrame, column: str, probs, **kw):
    """Exact linear-interpolated quantiles of one column (list, None if empty)."""
    return exact_quantiles_many(df, [column], probs, **kw)[column]
