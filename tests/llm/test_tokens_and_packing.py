"""Token counts and packing: exactly the tokenizers library's ids and counts."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from conftest import SMOKE
from tokenizers import Tokenizer, models, pre_tokenizers

from tillpoint.llm import packing, token_counts

TEXTS = ["", "a", " ", "  ", " a  b ", "é漢字漢字 x", "\n\na", "<unk>", "<s> </s>", "<0x41>", "▁a", "a▁b", "aa▁▁b", "\t", "x" * 50, "😀😀 z",
         "  a  b\n\n c \t d  ", "a   b", "a　\n\nb", "<|endoftext|> x", "don't we'll  I'm", "é́ ² ½ ٣ 漢字", "x\x1c\x1d y",
         "a \n b", "the " * 5000, "x" * 3000]


@pytest.fixture(scope="module")
def bpe():
    t = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    t.encode_special_tokens = True
    return t


def test_ids_equal_the_library(bpe):
    got = packing.token_ids(pa.array([*TEXTS, None]), public_tokenizers.path(packing.VOCABULARY))
    assert [list(g) for g in got] == [bpe.encode(t, add_special_tokens=False).ids for t in [*TEXTS, ""]]


@pytest.mark.parametrize("piece", [1, 2, 7, 100])
def test_long_texts_are_encoded_in_pieces(bpe, monkeypatch, piece):
    """Cut at every allowed place, ids are those of the whole text."""
    monkeypatch.setattr(packing, "PIECE", piece)
    docs = pa.array([t * 3 for t in TEXTS] + ["".join(TEXTS), "a!  \u3000b. \u00a0 c\n d\u2028 e's  'll \r\n\t\tz" * 20])
    got = packing.token_ids(docs, public_tokenizers.path(packing.VOCABULARY))
    assert [list(g) for g in got] == [bpe.encode(t, add_special_tokens=False).ids for t in docs.to_pylist()]


def test_counts_equal_the_library():
    path = public_tokenizers.path(token_counts.VOCABULARY)
    vocabulary = token_counts.read_vocabulary(path)
    unigram = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
    unigram.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(TEXTS))), pa.array(TEXTS)], ["i", "t"])
    got = next(token_counts._rows(path)(iter([batch]))).column(1).to_pylist()
    assert got == [len(unigram.encode(t, add_special_tokens=False).ids) for t in TEXTS]


def test_ties_and_unknown_characters():
    c = token_counts.Counter([("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁", 0.0)])
    assert c.count(["▁ab"]) == [(2, -2.0)]           # equal scores: the piece that begins first stays
    assert c.count(["▁q", "a"]) == [(2, -12.0), (1, -1.0)]


def test_counts_of_odd_rows(spark, odd):
    rows = token_counts.token_counts(odd).collect()
    assert len(rows) == odd.count() and [r["n_tokens"] for r in rows if r["doc_id"] in (1, 2)] == [0, 0]
    assert token_counts.token_counts(odd.limit(0)).collect() == []


def check_pieces(rows, ids, width=packing.WIDTH):
    """Each id in one piece, sequences gapless, all full but one; returns the sequences."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        own = ids[r["doc_id"]]
        piece = np.array(own[r["start"]:r["start"] + r["length"]], "<u4")
        assert r["length"] > 0 and len(piece) == r["length"] and r["doc_tokens"] == len(own)
        assert zlib.crc32(piece.tobytes()) == r["ids_crc32"]
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"], r["doc_id"]))
    for i, own in ids.items():
        at = 0
        for start, n in sorted(pieces[i]):
            assert start == at
            at += n
        assert at == len(own)
    sizes = {}
    for s, parts in sequences.items():
        at = 0
        for offset, n, _ in sorted(parts):
            assert offset == at
            at += n
        sizes[s] = at
    total = sum(map(len, ids.values()))
    assert sorted(sizes) == list(range(-(-total // width))) and sum(n < width for n in sizes.values()) <= 1
    return sequences


def test_packing_of_a_table(spark, bpe):
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet")
    ids = {r["doc_id"]: bpe.encode(r["text"] or "", add_special_tokens=False).ids + [1] for r in docs.collect()}
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    sequences = check_pieces(packing.pack(docs).collect(), ids)
    total = defaultdict(int)
    for i, x in ids.items():
        total[source[i]] += len(x)
    whole = sum(total.values())
    for s in range(len(sequences) - 3):               # every window has the mixture
        have = defaultdict(int)
        for _, n, i in sequences[s]:
            have[source[i]] += n
        assert all(abs(have[q] - packing.WIDTH * t / whole) < 2.5 for q, t in total.items()), s


def test_packing_of_odd_rows(spark, odd, bpe):
    rows = packing.pack(odd.where("doc_id is not null").dropDuplicates(["doc_id"])).collect()
    ids = {r["doc_id"]: bpe.encode(r["text"] or "", add_special_tokens=False).ids + [1]
           for r in odd.where("doc_id is not null").collect()}
    check_pieces(rows, ids)
    assert sum(r["length"] for r in packing.pack(odd).collect()) > sum(r["length"] for r in rows)
    assert packing.pack(odd.limit(0)).collect() == []


@pytest.mark.parametrize("totals,targets", [([5000, 3000, 1], None), ([1], None), ([10, 100000], [0.5, 0.5]), ([7000, 7000, 50], [3, 1, 0]),
                                            ([4096, 4096], [1, 1]), ([2048 * 3], None), ([100] * 300, None), ([0, 9000], [1, 1])])
def test_plan_places_every_token_once(totals, targets):
    width = 2048
    p = packing.plan(totals, targets, width)
    seen = np.zeros((-(-sum(totals) // width), width), int)
    for q, n in enumerate(totals):
        at = 0
        step = 1 + n // 37
        for begin in range(0, n, step):
            for first, length, window, offset in packing.place_tokens(p, q, begin, min(n, begin + step), width):
                assert begin + first == at
                at += length
                seen[window, offset:offset + length] += 1
        assert at == n
    assert seen.ravel()[:sum(totals)].min() == 1 and seen.sum() == sum(totals)


def test_targets_hold_while_the_sources_last():
    p = packing.plan([200000, 100000], [0.25, 0.75], 2048)
    ph = p.phases[0]
    assert ph.count >= 60
    for k in (0, 7, 59):
        a = packing.taken(k + 1, ph.low[0], ph.high[0]) - packing.taken(k, ph.low[0], ph.high[0])
        assert abs(a - 512) <= 1


@pytest.mark.parametrize("totals,targets", [([100] * 5000, None), ([200000] + [40] * 3500, None), ([3 ** i for i in range(12)], None),
                                            ([500] * 3000, [1.0] * 3000), ([90000, 4000, 30, 7], [1, 1e-3, 1e-4, 1e-7])])
def test_small_sources_are_placed_once(totals, targets):
    test_plan_places_every_token_once(totals, targets)


@pytest.mark.parametrize("targets", [None, "equal"])
def test_small_sources_are_mixed(spark, targets):
    sources = 3000
    rows = [(i, "a b c d e f g h i j k l m n o p q r s"[:2 * 19 - 1], f"s{i % sources}") for i in range(3 * sources)]
    rows += [(10**6 + i, "x " * 2000, "hot") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    weights = None if targets is None else {"hot": 1.0} | {f"s{i}": 1 / 3000 for i in range(sources)}
    got = packing.pack(docs, targets=weights).collect()
    windows, total = defaultdict(set), Counter()
    hot = Counter()
    for r in got:
        s = "hot" if r["doc_id"] >= 10**6 else f"s{r['doc_id'] % sources}"
        windows[s].add(r["sequence_id"])
        total[r["sequence_id"]] += r["length"]
        hot[r["sequence_id"]] += r["length"] * (s == "hot")
    n = max(total) + 1
    assert all(total[i] == packing.WIDTH for i in range(n - 1))
    share = sum(hot.values()) / sum(total.values()) if targets is None else 0.5
    for i in range(n // 3):                           # every window is at the target shares
        assert abs(hot[i] - share * packing.WIDTH) < 2.5, i
    for s in windows:
        if s != "hot":                                # from the first windows on to the last ones
            assert min(windows[s]) < n / 8 and len(windows[s]) > 15, s


def test_a_target_of_a_small_source_counts(spark):
    docs = spark.createDataFrame([(i, "a b c d", f"s{i}") for i in range(1100)] + [(2000 + i, "x " * 300, "big") for i in range(50)]
                                 + [(5000, "y y y", "least")], "doc_id bigint, text string, source string")
    got = packing.pack(docs, targets={"big": 0.999, "least": 0.001}).collect()
    assert min(r["sequence_id"] for r in got if r["doc_id"] == 5000) == 0


def test_added_tokens_have_their_ids(spark):
    t = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    e = "<|endoftext|>"
    texts = [*TEXTS, f"a {e} x", e, f"a{e}b", f"x  {e}\n\n y", f" {e}{e} ", f"a\u3000 {e}\u3000b", f"<|end{e}oftext|>", f"don't{e}'ll  "]
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    got = packing.document_ids(pa.array([*texts, None]), public_tokenizers.path(packing.VOCABULARY))
    assert [list(g) for g in got] == [*want, []]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    check_pieces(packing.pack(docs).collect(), {i: [*ids, 1] for i, ids in enumerate(want)})
