"""A thread holding a third of all rows: results equal brute force, and the
per-thread top-k is limited before the shuffle."""

import pandas as pd

from tillpoint.operators import logs as L


def _log(spark):
    rows = []
    for conv in range(40):
        n = 400 if conv == 0 else 20  # conv 0 holds 400 of 1180 rows
        for t in range(n):
            rows.append((conv, t, "user" if t % 2 == 0 else "assistant", f"c{conv}t{t}"))
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(8), rows


def test_rolling_memory_and_pairs_on_skew(spark):
    df, rows = _log(spark)
    pdf = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"])
    got = sorted((r.conv_id, r.turn) for r in L.rolling_memory(df, "conv_id", "turn", 5).collect())
    want = sorted((c, t) for c, g in pdf.groupby("conv_id") for t in g.turn.nlargest(5))
    assert got == want
    plan = L.rolling_memory(df, "conv_id", "turn", 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    pairs = L.qa_pairs(df, "conv_id", "turn", "role", "text")
    assert pairs.count() == sum(len(g) // 2 for _, g in pdf.groupby("conv_id"))
    latest = {(r.conv_id, r.role): r.text for r in L.carry_forward(df, "conv_id", "turn", "role", "text").collect()}
    assert latest[(0, "assistant")] == "c0t399" and latest[(0, "user")] == "c0t398"
