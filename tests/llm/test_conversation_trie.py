"""The prefix trie against a plain one over dictionaries."""

import hashlib
import zlib

import numpy as np
import pytest
from conftest import SMOKE
from tests.llm.conftest import words

from tillpoint.llm import conversation_trie as T
from tillpoint.sources.tables import load

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def own_turns(rows):
    """Turns of each conversation in the defined order."""
    out = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            out.setdefault(c, []).append(((turn is not None, turn or 0, digest), (role, text)))
    return {c: [x for _, x in sorted(t)] for c, t in out.items()}


def sequences(rows):
    own = own_turns(rows)
    out = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + t[h:]
    return out


def brute(seqs):
    members = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
    kids = {p: [q for q in members if len(q) == len(p) + 1 and q[:len(p)] == p] for p in members}

    def total(p):
        own = (len(members[p]) - 1) * (len(words(p[-1][1])) if p else 0)
        below = [total(q) for q in kids[p]]
        return sum(x for x, _ in below) or 1, own + sum(y for _, y in below)

    out = []
    for p, who in members.items():
        leaves, saved = total(p)
        ends = ",".join(str(c) for c in sorted(who) if len(seqs[c]) == len(p))
        out.append((min(who), len(p), min(members[p[:-1]]) if p else None, len(who), len(kids[p]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def made(n=150, seed=1):
    """Conversations over few different turns, so many share prefixes or all of their turns."""
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(n):
        if c % 3 == 0:
            turns = [("user", "same first turn"), ("assistant", "same answer"), ("user", "bye")]
        else:
            turns = [(("user", "assistant")[i % 2], " ".join("ab"[rng.integers(2)] * 2 for _ in range(i + 1))) for i in range(rng.integers(0, 7))]
        rows += [(c, i, *t) for i, t in enumerate(turns)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")


def run(df):
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()), key=repr)


def test_rebuilt_conversations(spark):
    rows = made()
    assert run(T.prefix_nodes(frame(spark, rows))) == brute(sequences(rows))


@pytest.mark.parametrize("block, top, parts", [(2, 8, 8), (1, 12, 5), (7, 8, 3), (64, 1000, 1)])
def test_forests_are_merged_across_any_boundaries(spark, block, top, parts):
    """Tiny blocks and rounds: every node is open in many blocks, copies run over several."""
    rows = made(120, seed=block)
    df = T.rebuilt(frame(spark, rows))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert run(T.nodes(df, block, top)) == brute(sequences(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_given_table(spark):
    df = load(spark, SMOKE, "conversations")
    assert run(T.prefix_nodes(df)) == brute(sequences([tuple(r) for r in df.collect()]))


def test_odd_rows(spark):
    """Nulls anywhere, ties, repeated rows, negative ids, a long conversation, clashing columns."""
    rows = [(None, 0, "user", "x"), (1, None, None, None), (1, 0, "user", ""), (1, 0, "user", ""), (1, 0, "", "user"), (2, None, "user", "b"), (2, None, "user", "a"),
            (0, 5, "u", "one two"), (0, -1, "u", None), (-3, 0, "u", "n"), (-20, 0, "u", "m"), (-20, 1, "u", "k"), (40, 0, "u", "w " * 50000),
            *((41, i, "u", "again") for i in range(500)), *((c, i, "u", f"t{i}") for c in (60, 61, 62) for i in range(3))]
    wide = frame(spark, rows).selectExpr("*", "1 as k", "2 as path", "3 as base", "'z' as words", "4 as part")
    assert run(T.prefix_nodes(wide)) == brute(sequences(rows))
    assert run(T.prefix_nodes(wide.limit(0))) == []


def test_turnless_conversation_is_a_member_of_the_root(spark):
    """Without the block's first conversation, a short one can lose all of its turns."""
    c = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 > 1)
    rows = [(c, 0, "u", "lost")]
    got = run(T.prefix_nodes(frame(spark, rows)))
    assert got == brute(sequences(rows)) and len(got) == 1 and got[0][1] == 0
