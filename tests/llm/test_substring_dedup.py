import numpy as np
from conftest import SMOKE
from tests.llm.conftest import words

from tillpoint.llm import substring_dedup as S


def test_exact_passages_of_fifty_words_are_found(spark):
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    first, expected = {}, set()
    for i in sorted(texts):
        w = words(texts[i])
        for a in range(len(w) - 49):
            if first.setdefault(tuple(w[a:a + 50]), i) < i:
                expected.add(i)
    rows = S.repeated_passages(docs).collect()
    assert expected <= {r["doc_id"] for r in rows}
    for r in rows:      # every passage is one: its words stand in the source, in order
        mine = words(texts[r["doc_id"]].encode()[r["start_byte"]:r["end_byte"]].decode())
        theirs = words(texts[r["source_id"]].encode()[r["source_start"]:r["source_end"]].decode())
        assert r["source_id"] < r["doc_id"] and r["equal_words"] >= 50
        assert len(set(mine) & set(theirs)) > 0.6 * len(set(mine))


def test_fuzzy_passage_and_clean_texts(spark):
    rng = np.random.default_rng(3)
    text = lambda n: [f"t{x}" for x in rng.integers(0, 10**6, n)]
    p = text(80)
    edited = list(p)
    edited[20] = "changed"
    del edited[50]
    edited.insert(65, "added")
    rows = [(1, " ".join(text(100) + p + text(30))), (2, " ".join(text(40) + edited + text(200))), (3, " ".join(text(300)))]
    got = S.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert [(r["doc_id"], r["source_id"]) for r in got] == [(2, 1)]
    assert 70 <= got[0]["equal_words"] <= 80
    left = {r["doc_id"]: r["text"] for r in S.remove_passages(
        spark.createDataFrame(rows, "doc_id bigint, text string"),
        S.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string"))).collect()}
    assert left[1] == rows[0][1] and left[3] == rows[2][1]
    assert 235 <= len(words(left[2])) <= 255


def test_passages_start_and_end_with_whole_words(spark):
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("éüñç漢字aß"), rng.integers(2, 9)))
    long = [word() for _ in range(900)]            # longer than the margins on both sides of a chain
    rows = [(1, " ".join([word() for _ in range(40)] + long)), (2, " ".join([word() for _ in range(7)] + long + [word()])),
            (3, " ".join(long[300:420])), (4, " ".join(long[:350] + long[500:]))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = S.repeated_passages(df)
    texts = dict(rows)
    for r in found.collect():
        for i, a, b in ((r["doc_id"], r["start_byte"], r["end_byte"]), (r["source_id"], r["source_start"], r["source_end"])):
            data = texts[i].encode()
            data[a:b].decode()
            assert (a == 0 or data[a - 1:a] == b" ") and (b == len(data) or data[b:b + 1] == b" ")
    left = {r["doc_id"]: r["text"] for r in S.remove_passages(df, found).collect()}
    assert set(left) == {1, 2} and len(words(left[2])) <= 10


def test_odd_rows(odd):
    found = S.repeated_passages(odd)
    assert {r["doc_id"] for r in found.collect()} <= {9}
    assert S.remove_passages(odd, found).count() == odd.count()
    assert S.repeated_passages(odd.limit(0)).collect() == []


def test_chains_are_ordered_and_use_each_block_once():
    x = np.array([0, 5, 40, 45, 100, 104])
    y = np.array([10, 15, 50, 55, 0, 4])
    found = S.chains(x, y)
    assert [[int(x[i]) for b in c for i in b] for c in found] == [[0, 5, 40, 45], [100, 104]]
    for c in found:
        assert all(y[a[-1]] < y[b[0]] for a, b in zip(c, c[1:]))


def test_winnowing_keeps_one_in_every_window():
    h = np.random.default_rng(0).integers(0, 2**63, 500).astype(np.uint64)
    at = S.winnow(h, 14)
    assert np.diff(np.concatenate([[-1], at, [500]])).max() <= 14
    assert len(S.winnow(np.zeros(100, np.uint64), 14)) == 8


def test_passages_made_of_parts_that_earlier_documents_hold(spark):
    rng = np.random.default_rng(11)
    text = lambda n: [f"t{x}" for x in rng.integers(0, 10**9, n)]
    rows, pairs = [], set()
    for g in range(40):
        a, b, c, i = text(30), text(30), text(30), 10 * g
        rows += [(i, text(40) + a + text(40)), (i + 1, text(40) + b + text(40)), (i + 2, text(20) + c + text(40)),
                 (i + 3, text(25) + a + b + text(25)), (i + 4, text(33) + a + b + text(5)),
                 # each seam has a source of its own; the whole of three parts is held by i + 5 only
                 (i + 5, text(9) + a[10:] + b + c[:20] + text(8)), (i + 6, a[10:] + b + c[:20] + text(30))]
        pairs |= {(i + 4, i + 3), (i + 5, i + 3), (i + 6, i + 5)}
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id bigint, text string")
    got = S.repeated_passages(docs).collect()
    assert pairs <= {(r["doc_id"], r["source_id"]) for r in got}
    assert all(r["equal_words"] >= 60 for r in got if (r["doc_id"], r["source_id"]) in pairs and r["doc_id"] % 10 == 4)
    assert not {r["doc_id"] for r in got} & {i for i, _ in rows if i % 10 < 4}


def test_long_words_and_frequent_edits(spark):
    rng = np.random.default_rng(17)
    text = lambda n, size=1: [f"{'u' * size}{x}" for x in rng.integers(0, 10**9, n)]
    rows, equal = [], {}
    for g, (size, every) in enumerate([(60, 0), (200, 0), (700, 0), (1, 4), (1, 5), (1, 6), (1, 7), (1, 8), (1, 10)] * 4):
        n = 52 if not every else 75
        p = text(n, size)
        edited = [f"e{g}x{i}" if every and i % every == 2 else x for i, x in enumerate(p)]
        rows += [(2 * g, " ".join(text(60) + p + text(60))), (2 * g + 1, " ".join(text(60) + edited + text(60)))]
        equal[2 * g + 1] = sum(a == b for a, b in zip(p, edited))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in S.repeated_passages(docs).collect()}
    assert set(got) == set(equal)
    for i, n in equal.items():
        assert got[i]["source_id"] == i - 1 and n - 4 <= got[i]["equal_words"] <= n


def test_recall_of_edited_passages(spark):
    """66-word passages with one word changed in every 6 to 15: at least nine in ten are found."""
    rng = np.random.default_rng(23)
    text = lambda n: [f"t{x}" for x in rng.integers(0, 10**9, n)]
    rows, kind = [], {}
    for g in range(1000):
        every = (6, 8, 10, 12, 15)[g % 5]
        p = text(66)
        edited = [f"e{g}x{i}" if i % every == every // 2 else x for i, x in enumerate(p)]
        rows += [(2 * g, " ".join(text(40) + p + text(40))), (2 * g + 1, " ".join(text(40) + edited + text(40)))]
        # every 6th word: 55 equal words
        kind[2 * g + 1] = every
    got = {r["doc_id"] for r in S.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    share = {e: np.mean([i in got for i, k in kind.items() if k == e]) for e in (6, 8, 10, 12, 15)}
    assert got <= set(kind) and all(v >= 0.9 for v in share.values()), share
    assert share[8] > 0.97 and share[10] > 0.99


def test_sliding_is_the_extreme_of_every_window():
    rng = np.random.default_rng(5)
    for n, w in ((1, 1), (14, 14), (15, 14), (200, 14), (200, 16), (99, 7), (30, 2)):
        h = rng.integers(0, 1 << 63, n).astype(np.uint64)
        view = np.lib.stride_tricks.sliding_window_view(h, w)
        assert (S.sliding(h, w, np.minimum) == view.min(axis=1)).all()
        assert (S.sliding(h, w, np.maximum) == view.max(axis=1)).all()


def repeats(rng, n):
    """A phrase of two to four words again and again, ``n`` words, one word in 30 changed."""
    phrase = [f"p{x}" for x in rng.integers(0, 10**9, rng.integers(2, 5))]
    return [f"c{rng.integers(0, 10**9)}" if i % 30 == 29 else phrase[i % len(phrase)] for i in range(n)]


def test_a_repeated_pair_of_seeds_is_one_row_of_its_document():
    """a phrase that a document repeats 300 times gave one row for each time."""
    import pyarrow as pa

    n, rows = 300, []
    for doc in range(5):        # the same seed every second word, first seen at word 210 of document 0
        rows += [(7, doc, 20 + 2 * i, 60 + 6 * i, 0, 210, 630) for i in range(n)]
        rows += [(8 + doc, doc, 30 + 2 * n, 90 + 6 * n, 0, 5, 15)]
    columns = [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32()])]
    batch = pa.RecordBatch.from_arrays(columns, ["seed", "id", "word", "byte", "src", "sword", "sbyte"])
    got = [r for b in S._seams(7, 14, 50)([batch]) for r in b.to_pylist()]
    pairs = [r for r in got if r["spans"] is None]
    assert len(pairs) == len({(r["id"], r["seed"]) for r in pairs}) == 10 and len(got) == 15
    for doc in range(5):        # with every place, the first one in the row's own columns
        same = max((r for r in pairs if r["id"] == doc), key=lambda r: len(r["also"] or []))
        assert (same["word"], same["byte"]) == (20, 60)
        assert same["also"] == [v for i in range(1, n - 1) for v in (20 + 2 * i, 60 + 6 * i)]
    assert {r["seed"] for r in pairs if r["also"]} == {same["seed"]}


def test_matches_of_a_group_have_all_places():
    import pyarrow as pa

    def group(also):
        ints = lambda *v: pa.array(v, pa.int32())
        return pa.RecordBatch.from_arrays(
            [ints(0, 1, 2, 3), ints(9, 8, 7, 6), ints(0, 10, 20, 30), ints(90, 80, 70, 60), pa.array(also, pa.list_(pa.int32()))],
            ["word", "sword", "byte", "sbyte", "also"])

    rows = lambda g: sorted(zip(*(v.tolist() for v in S._matches(g))))
    assert rows(group([None] * 4)) == [(0, 9, 0, 90), (1, 8, 10, 80), (2, 7, 20, 70), (3, 6, 30, 60)]
    assert rows(group([[4, 40], None, [5, 50, 6, 60], None]).slice(1)) == [
        (1, 8, 10, 80), (2, 7, 20, 70), (3, 6, 30, 60), (5, 7, 50, 70), (6, 7, 60, 70)]


def test_phrases_repeated_in_many_documents_are_found(spark):
    """The first document holds a phrase too short for a passage; later ones repeat it, with edits."""
    rng = np.random.default_rng(29)
    text = lambda n: [f"t{x}" for x in rng.integers(0, 10**9, n)]
    rows, later = [], set()
    for g in range(20):
        run = repeats(rng, 300)
        rows += [(10 * g, " ".join(text(30) + run[:16] + text(30)))]
        for i in range(1, 6):
            rows.append((10 * g + i, " ".join(text(20 + i) + run[:300 - 20 * i] + text(20))))
            later |= {10 * g + i} if i > 1 else set()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = S.repeated_passages(docs)
    got = found.collect()
    assert {r["doc_id"] for r in got if r["source_id"] % 10 == 1} == later == {r["doc_id"] for r in got}
    left = {r["doc_id"]: len(words(r["text"])) for r in S.remove_passages(docs, found).collect()}
    for i in later:
        assert left[i] <= 40 + i % 10 + 1
