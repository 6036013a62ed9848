import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tillpoint.operators.quantiles import exact_quantiles, exact_quantiles_many


@settings(max_examples=8, deadline=None)
@given(st.lists(st.one_of(st.integers(-50, 50).map(float), st.floats(-1e6, 1e6, allow_nan=False)),
                min_size=1, max_size=300))
def test_matches_numpy(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = exact_quantiles(df, "x", [0.0, 0.25, 0.5, 0.75, 1.0], direct_rows=7)
    want = np.quantile(np.array(values), [0.0, 0.25, 0.5, 0.75, 1.0])
    assert np.allclose(got, want, rtol=1e-9, atol=1e-9)


def test_skewed_and_empty(spark):
    vals = [5.0] * 400 + list(map(float, range(200)))
    df = spark.createDataFrame([(v, None) for v in vals], "x double, y double")
    q = exact_quantiles_many(df, ["x", "y"], [0.1, 0.5, 0.9], direct_rows=10)
    assert np.allclose(q["x"], np.quantile(vals, [0.1, 0.5, 0.9]))
    assert q["y"] == [None, None, None]


def test_many_columns_coarse_sketch(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=2000)
    b = np.round(rng.exponential(size=2000) * 10)  # many ties
    c = rng.integers(0, 5, size=2000).astype(float)  # few distinct values
    df = spark.createDataFrame([(float(x), float(y), float(z)) for x, y, z in zip(a, b, c)], "a double, b double, c double")
    probs = [0.01, 0.25, 0.5, 0.51, 0.75, 0.99]
    got = exact_quantiles_many(df, ["a", "b", "c"], probs, accuracy=20, direct_rows=5)
    for name, vals in (("a", a), ("b", b), ("c", c)):
        assert np.allclose(got[name], np.quantile(vals, probs), rtol=1e-12, atol=1e-12)
