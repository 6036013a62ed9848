"""``spread``: small inputs are repartitioned, large split files are not."""

from conftest import SMOKE

from tillpoint.session import spread
from tillpoint.sources.tables import load


def test_spread_small_file_but_not_split_large_files(spark):
    df = load(spark, SMOKE, "lineitem")
    assert spread(df) is not df  # one small file: repartitioned
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = {k: spark.conf.get(k) for k in keys}
    try:
        for k in keys:
            spark.conf.set(k, "4096")  # the same file now plans as many byte-range splits
        assert spread(df) is df
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    grouped = df.groupBy("l_returnflag").count()
    assert spread(grouped) is not grouped  # decided from the input files, nothing runs
