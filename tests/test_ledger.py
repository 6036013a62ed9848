"""The ingest store remembers, survives crashes and bears two writers."""

import pytest

from tillpoint.sources.ledger import IngestStore


def frame(spark, rows):
    return spark.createDataFrame(rows, "id int, text string")


def read(store):
    return sorted((r.id, r.text) for r in store.items().collect())


def test_second_ingest_adds_nothing(spark, tmp_path):
    store = IngestStore(spark, str(tmp_path / "s"))
    rows = [(3, "a"), (1, "a"), (2, "b"), (4, None), (5, "")]
    assert store.commits().count() == 0 and store.ledger().count() == 0
    assert store.ingest(frame(spark, rows), "text", "id") == 3
    assert read(store) == [(1, "a"), (2, "b"), (5, "")]
    assert store.ingest(frame(spark, rows), "text", "id") == 0 and store.commits().count() == 1
    assert IngestStore(spark, str(tmp_path / "s")).ingest(frame(spark, [(9, "b"), (8, "c")]), "text") == 1     # a new driver
    assert read(store) == [(1, "a"), (2, "b"), (5, ""), (8, "c")]
    assert store.ingest(frame(spark, []), "text") == 0


@pytest.mark.parametrize("lost", ["data", "ledger", "commit"])
def test_crash_at_any_point(spark, tmp_path, monkeypatch, lost):
    """What a cut-off ingest left is never read, and the next one adds the rows again."""
    store = IngestStore(spark, str(tmp_path / "s"))
    store.ingest(frame(spark, [(1, "a")]), "text")

    def dies(*_):
        raise RuntimeError("lost")

    if lost == "commit":
        monkeypatch.setattr(IngestStore, "_commit", dies)
    else:
        folder = IngestStore._folder
        # the folder of this step can't be written
        monkeypatch.setattr(IngestStore, "_folder", lambda self, name: dies() if name.startswith(f"{lost}/ingest=") else folder(self, name))
    with pytest.raises(RuntimeError, match="lost"):
        store.ingest(frame(spark, [(2, "b"), (3, "a")]), "text")
    monkeypatch.undo()
    assert read(store) == [(1, "a")] and store.commits().count() == 1
    assert store.ingest(frame(spark, [(2, "b"), (3, "a")]), "text") == 1
    assert read(store) == [(1, "a"), (2, "b")]


def test_two_writers_at_once(spark, tmp_path, monkeypatch):
    """The second writer starts and ends between the first one's data and its commit."""
    store = IngestStore(spark, str(tmp_path / "s"))
    commit, seen = IngestStore._commit, []

    def slow(self, name, added):
        monkeypatch.setattr(IngestStore, "_commit", commit)
        assert IngestStore(spark, store.path).ingest(frame(spark, [(7, "b"), (8, "c")]), "text") == 2
        seen.append(read(store))
        commit(self, name, added)

    monkeypatch.setattr(IngestStore, "_commit", slow)
    assert store.ingest(frame(spark, [(1, "a"), (2, "b")]), "text") == 2
    assert seen == [[(7, "b"), (8, "c")]]
    assert read(store) == [(1, "a"), (7, "b"), (8, "c")]          # what was visible stays
    assert store.ledger().count() == 3 and store.commits().count() == 2
    assert store.ingest(frame(spark, [(1, "a"), (2, "b"), (8, "c")]), "text") == 0
