import tempfile

from tillpoint.operators.roles import roles_of
from tillpoint.plans.dirty_sales import dirty_sales
from tillpoint.operators.clean import clean_headers
from tillpoint.streaming.incremental import clean_rows, start_clean_stream
from conftest import SMOKE


def test_stream_equals_batch(spark):
    src = tempfile.mkdtemp(prefix="tillpoint-src-")
    sink = tempfile.mkdtemp(prefix="tillpoint-sink-")
    ck = tempfile.mkdtemp(prefix="tillpoint-ck-")
    df = clean_headers(dirty_sales(spark, SMOKE)).drop("EMPTY_TXT")
    df.repartition(3).write.mode("overwrite").parquet(src + "/in")
    roles = roles_of(df)
    q = start_clean_stream(spark, src + "/in", df.schema, sink + "/out", roles, bounds=(1000.0, 30000.0),
                           as_of="2026-01-01", checkpoint_location=ck)
    q.awaitTermination(300)
    got = spark.read.parquet(sink + "/out")
    want = clean_rows(spark.read.parquet(src + "/in"), roles, bounds=(1000.0, 30000.0), as_of="2026-01-01")
    assert got.count() == want.count() == df.count()
    assert got.exceptAll(want.select(*got.columns)).count() == 0


def test_stream_restart_resumes_from_default_checkpoint(spark):
    src = tempfile.mkdtemp(prefix="tillpoint-src-")
    sink = tempfile.mkdtemp(prefix="tillpoint-sink-") + "/out"
    df = clean_headers(dirty_sales(spark, SMOKE)).drop("EMPTY_TXT")
    roles = roles_of(df)
    first, second = df.where("QTY_TXT >= '5'"), df.where("NOT (QTY_TXT >= '5') OR QTY_TXT IS NULL")
    for part, mode in ((first, "overwrite"), (second, "append")):
        part.repartition(2).write.mode(mode).parquet(src + "/in")
        q = start_clean_stream(spark, src + "/in", df.schema, sink, roles, bounds=(1000.0, 30000.0),
                               as_of="2026-01-01")
        q.awaitTermination(300)
    got = spark.read.parquet(sink)
    want = clean_rows(df, roles, bounds=(1000.0, 30000.0), as_of="2026-01-01")
    assert got.count() == df.count()  # the second run read only the new files
    assert got.exceptAll(want.select(*got.columns)).count() == 0
