"""Hyperdimensional profiles: against plain vectors, held-out accuracy, odd rows."""

import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from conftest import SMOKE
from tests.llm.conftest import ODD

from tillpoint.llm import language_id as L
from tillpoint.sources.tables import load


def plain(text):
    """Bundled n-gram vector of a text, one n-gram at a time."""
    low = "".join(c.lower()[0] if unicodedata.category(c)[0] in "LM" else " " for c in text)
    seq = " " + "".join(a for a, b in zip(low, " " + low) if a != " " or b != " ").strip(" ") + " "
    out = np.zeros(L.DIM, np.int64)
    vec = lambda c: L.letter_vectors(np.array([ord(c) if c != " " else 0]))[0].astype(np.int64)
    for a, b, c in zip(seq, seq[1:], seq[2:]):
        if b != " ":
            out += np.roll(vec(a), 2) * np.roll(vec(b), 1) * vec(c)
    return out


def test_letter_vectors_are_random_and_fixed():
    v = L.letter_vectors(np.arange(60)).astype(int)
    assert set(np.unique(v)) == {-1, 1} and (L.letter_vectors(np.array([7]))[0] == v[7]).all()
    off = v @ v.T - np.diag([L.DIM] * 60)
    assert abs(off).max() < 6 * np.sqrt(L.DIM)


def test_bundles_equal_plain_sums():
    texts = ["The cat, the hat!", "", "a", "ÉTÉ été 漢字かな", "  x1y2  ", "हिन्दी में", "İstanbul \U0001f600 q"]
    grams = L.Grams([L._points(t.encode()) for t in texts])
    got = grams.bundles(grams.row, len(texts))
    for t, g in zip(texts, got):
        assert (plain(t) == g).all(), t
    assert grams.spoken.tolist() == [True, False, True, True, True, True, True]


def test_many_letters_take_the_sorted_path():
    """More letters than the table of all n-grams has room for."""
    text = "".join(chr(0x4E00 + i) for i in range(400))
    grams = L.Grams([L._points(text.encode())])
    assert (grams.bundles(grams.row, 1)[0] == plain(text)).all()


def test_long_texts_are_counted_whole():
    """Texts that come in several pieces, beside short ones: pieces are cut at white space."""
    rows = ["ab cd", "the end " * 200000, "xy", "of all " * 150000, "z"]
    parts = {}
    for at, texts in L._texts(pa.array(rows)):
        grams = L.Grams(texts)
        for r, g in zip(at, grams.bundles(grams.row, len(texts))):
            parts[r] = parts.get(r, 0) + g.astype(np.int64)
    for r, t in enumerate(rows):
        unit, times = {1: ("the end ", 200000), 3: ("of all ", 150000)}.get(r, (t, 1))
        assert (parts[r] == plain(unit) * times).all()


def test_prediction_is_the_nearest_prototype(spark):
    docs = [(i, t, l) for i, (t, l) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de"), ("le chat et le chien", "fr"),
                                                  ("the house and the end", "en"), ("das haus und der hof", "de"), ("la maison et la fin", "fr")] * 4)]
    got = {r["doc_id"]: r for r in L.languages(spark.createDataFrame(docs, "doc_id bigint, text string, lang string")).collect()}
    held = {i for i, _, _ in docs if zlib.crc32(str(i).encode()) % 4 == 2}
    proto = {}
    for i, t, l in docs:
        if i not in held:
            proto[l] = proto.get(l, 0) + plain(t)
    for i, t, l in docs:
        v = plain(t)
        cos = {k: v @ p / np.linalg.norm(v) / np.linalg.norm(p) for k, p in proto.items()}
        assert got[i]["lang_pred"] == max(cos, key=cos.get) == l and abs(got[i]["score"] - max(0, min(1, max(cos.values())))) < 1e-5
        assert got[i]["held_out"] == (i in held)


def test_held_out_accuracy(spark):
    docs = load(spark, "/root/testdata/sf0.01", "documents")
    rows = L.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 200 and np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.98


def test_held_out_languages_are_never_read(spark):
    docs = load(spark, SMOKE, "documents")
    other = docs.selectExpr("doc_id", "text", "if(crc32(cast(cast(doc_id as string) as binary)) % 4 = 2, 'xx', lang) as lang")
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(L.languages(docs)) == key(L.languages(other))


def test_odd_rows(spark, odd):
    rows = L.languages(odd.drop("lang").selectExpr("*", "if(doc_id % 2 = 0, null, 'q') as lang", "1 as held_out", "2 as score", "3 as lang_pred")).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        assert r["lang_pred"] == ("und" if r["doc_id"] in (1, 2, 3) else "q") and 0 <= r["score"] <= 1
    assert not any(r["held_out"] for r in rows if r["doc_id"] is None)
    none = L.languages(odd.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()
    assert len(none) == len(ODD) and {(r["lang_pred"], r["score"]) for r in none} == {("und", 0.0)}
    assert L.languages(odd.limit(0)).collect() == []
