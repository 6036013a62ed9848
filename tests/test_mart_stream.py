"""M1 into the mart: batches count once, whatever is interrupted, and D1 runs across them."""

import pytest

from tillpoint.operators.clean import clean_headers
from tillpoint.operators.roles import roles_of
from tillpoint.plans.dirty_sales import dirty_sales
from tillpoint.streaming import mart as M
from tillpoint.streaming.incremental import clean_rows
from conftest import SMOKE

FILES = 4


@pytest.fixture(scope="module")
def given(spark, tmp_path_factory):
    """Four files; every row also stands in the next file, so most copies lie across batches."""
    df = clean_headers(dirty_sales(spark, SMOKE)).drop("EMPTY_TXT").limit(400).cache()
    src = str(tmp_path_factory.mktemp("src"))
    for i in range(FILES):
        part = df.where(f"pmod(hash(*), {FILES}) IN ({i}, {(i + 1) % FILES})")
        part.coalesce(1).write.mode("append").parquet(src + "/in")
    roles = roles_of(df)
    return src + "/in", df, lambda d: clean_rows(d, roles, bounds=(1000.0, 30000.0), as_of="2026-01-01")


def start(spark, given, mart, ck, **more):
    src, df, steps = given
    return M.start_mart_stream(spark, src, df.schema, mart, transform=steps, checkpoint_location=ck, max_files=1, **more)


def same(spark, given, mart):
    _, df, steps = given
    want = steps(df).dropDuplicates()
    got = M.read_mart(spark, mart)
    assert got.count() == want.count() and got.exceptAll(want.select(*got.columns)).count() == 0


def test_stream_equals_batch(spark, given, tmp_path):
    mart = str(tmp_path / "mart")
    start(spark, given, mart, str(tmp_path / "ck")).awaitTermination()
    same(spark, given, mart)
    led = M.ledger(spark, mart).collect()
    assert sum(r.rows > 0 for r in led) > 1 and sum(r.rows for r in led) == M.read_mart(spark, mart).count()
    start(spark, given, mart, str(tmp_path / "ck")).awaitTermination()      # nothing new
    same(spark, given, mart)


@pytest.mark.parametrize("after", [False, True])
def test_restart_in_mid_batch(spark, given, tmp_path, monkeypatch, after):
    """The driver dies in the second batch, before or after its ledger row; the replay writes once."""
    mart, ck = str(tmp_path / "mart"), str(tmp_path / "ck")
    commit = M._commit

    def dies(spark_, path, rows):
        if path.endswith("/batch=1"):
            if after:
                commit(spark_, path, rows)
            raise RuntimeError("lost")
        commit(spark_, path, rows)

    monkeypatch.setattr(M, "_commit", dies)
    with pytest.raises(Exception, match="lost"):
        start(spark, given, mart, ck).awaitTermination()
    before = M.read_mart(spark, mart).count()
    assert len(M.ledger(spark, mart).collect()) == 1 + after       # what is cut off is not read
    written = []
    write = M.write_batch
    monkeypatch.setattr(M, "_commit", commit)
    monkeypatch.setattr(M, "write_batch", lambda *a: written.append((a[3], write(*a))))
    start(spark, given, mart, ck).awaitTermination()
    assert [b for b, _ in written][:1] == [1] and (written[0][1] is None) == after
    assert M.read_mart(spark, mart).count() > before
    same(spark, given, mart)


def test_new_checkpoint_never_meets_old_batch_numbers(spark, given, tmp_path):
    """A second stream into the same mart: its batch 0 is not the first one's."""
    mart = str(tmp_path / "mart")
    for ck in ("a", "b"):
        start(spark, given, mart, str(tmp_path / ck)).awaitTermination()
    _, df, steps = given
    assert M.read_mart(spark, mart).count() == 2 * steps(df).dropDuplicates().count()
    assert M.ledger(spark, mart).select("stream").distinct().count() == 2


def test_keys_nulls_and_no_deduplication(spark, tmp_path):
    rows = [(1, None), (2, None), (3, ""), (4, "a"), (5, "a")]
    spark.createDataFrame(rows, "id int, t string").coalesce(1).write.parquet(str(tmp_path / "in"))
    for keys, n in ((["t"], 3), ([], 5), (None, 5)):
        mart = str(tmp_path / f"mart{n}{keys is None}")
        M.start_mart_stream(spark, str(tmp_path / "in"), "id int, t string", mart, keys=keys, checkpoint_location=mart + "ck").awaitTermination()
        assert M.read_mart(spark, mart).count() == n
    assert M.ledger(spark, str(tmp_path / "none")).count() == 0
