"""Plan properties that matter at scale, checked on the registered queries."""

import re

from conftest import SMOKE

from tillpoint.plans import registry


def _q(spark, name):
    registry.load_all()
    return registry.QUERIES[name](spark, SMOKE)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _read_schemas(df) -> list[str]:
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return re.findall(r"ReadSchema: struct<([^>]*)>", df._jdf.queryExecution().explainString(mode))


def test_text_dedup_shuffles_a_digest_not_the_text(spark):
    plan = _plan(_q(spark, "d1_dedup_documents_by_text"))
    assert "sha2(" in plan and "hashpartitioning(text#" not in plan
    lines = plan.splitlines()
    ex = next(i for i, l in enumerate(lines) if "Exchange hashpartitioning" in l)
    # the per-text top-1 runs partially before the shuffle
    assert any("WindowGroupLimit" in l and "Partial" in l for l in lines[ex + 1:])
    # below the exchange, the projection keeps doc_id and lang and the key, not the text
    proj = next(l for l in lines[ex + 1:] if "Project [" in l)
    assert re.sub(r"CASE WHEN .* END AS", "", proj).count("text#") == 0


def test_context_needs_no_python_and_no_cross_join(spark):
    plan = _plan(_q(spark, "r3_context_for_benchmark"))
    assert not re.search("MapInPandas|MapInArrow|Cartesian|NestedLoop", plan)


def test_top_category_reads_only_needed_columns(spark):
    schemas = _read_schemas(_q(spark, "h1_top_category"))
    cols = {c.split(":")[0] for s in schemas for c in s.split(",")}
    assert cols <= {"l_partkey", "l_extendedprice", "p_partkey", "p_type"}, cols


def test_cleaning_counts_are_observed_in_the_result_stage(spark, monkeypatch):
    """Accumulator updates from a re-run map stage may be applied twice, so each
    observation must sit above the shuffle of the stage it is written with."""
    import tillpoint.plans.preprocess as P
    from tillpoint.plans.dirty_sales import dirty_sales

    plans = {}
    real = P.materialize

    def spy(df, name="stage"):
        plans[name] = _plan(df)
        return real(df, name)

    monkeypatch.setattr(P, "materialize", spy)
    P.preprocess(dirty_sales(spark, SMOKE), as_of="2026-01-01", index_col="IDX")
    for name in ("dedup", "preprocessed"):
        lines = plans[name].splitlines()
        metrics = [i for i, l in enumerate(lines) if "CollectMetrics" in l]
        exchanges = [i for i, l in enumerate(lines) if "Exchange" in l and "BroadcastExchange" not in l]
        assert metrics, name
        # the tree prints parents first: every observation is above every shuffle
        assert not exchanges or max(metrics) < min(exchanges), name
