"""Benchmark: run the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]
and print one JSON line.

Each query is timed from building its DataFrame to a full materialization of
its result (``collect`` for small results, a ``noop`` write for large ones).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tillpoint.plans import registry  # noqa: E402
from tillpoint.session import local_session  # noqa: E402

HEADLINE = [
    "h1_top_category", "h1_top_region", "g1_g4_kpi_totals", "h2_monthly_totals", "i1_month_deltas",
    "i2_yoy_growth", "h4_value_counts_orders", "h6_quarterly_recent_year", "g5_numeric_profile",
    "g8_describe_lineitem", "n7_top_customer_purchases", "n13_category_by_channel", "p_preprocess_rows",
    "g9_column_profile_lineitem", "j3_semantic_types", "i3_rolling_memory", "i5_qa_pairs",
    "l1_extract_json_events", "l2_normalize_plans", "r1_chunk_documents", "r2_top3_neighbours",
    "r3_context_for_benchmark", "c12_sql_patterns_documents", "a15_new_documents",
]
LARGE = {"p_preprocess_rows", "r1_chunk_documents", "b4_collapse_whitespace_documents"}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, shuffle_partitions=max(8, cpus * 2), app="tillpoint-bench")
    registry.load_all()
    spark.read.parquet(f"{sf_dir}/region.parquet").count()  # JVM warm-up, not timed
    times = {}
    for name in HEADLINE:
        fn = registry.QUERIES.get(name)
        if fn is None:
            continue
        t0 = time.perf_counter()
        df = fn(spark, sf_dir)
        if name in LARGE:
            df.write.format("noop").mode("overwrite").save()
        else:
            df.collect()
        times[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
