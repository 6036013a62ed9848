"""Prefix trie of conversations by union-find over the edges between sorted neighbours.

A conversation is a sequence of turns, each known by a digest of role and text.  In sorted
order, neighbours share their longest common prefix (LCP), and every trie node is a run of
neighbours.

**Forest of a block.**  Range partitions hold sorted conversations, taken in blocks of
bounded size.  Edges between neighbours are taken by descending LCP; a union-find structure
knows each component's topmost node.  An edge lifts both components to its depth through
nodes of one child, and their merger is a branching node there.

**Contraction.**  Nodes on the paths of a block's first and last conversation are open:
neighbouring blocks may hold more of them.  All others are closed, and are final but for the name
of an open parent.  A block's open nodes are two paths with counts per depth; everything
closed below them is in these counts.

**Merging across boundaries.**  The paths are sequences in sorted order again, so the same step
merges many blocks' forests, until one block holds the rest (``TOP`` paths at most).  Each round
is written to the shared folder.  Closed nodes then get the names of open parents by a join
on the block and the parent's digest, so no parent's key is hot.

Only digests (16 bytes a turn) are shuffled, not texts.  One conversation's digests are
held by one task, as is one block; copies of a conversation, however many, are dealt over
partitions by id.  Its hash over ids can only be computed in sequence: copies' ids are joined to
pieces per block first, and one task streams the pieces of a node.

* Rows with a null ``conv_id`` take no part; a null role or text is empty.
* Turns of one number are ordered by digest; null turns come first; repeated rows are turns of their own.
* Blocks of 20 ids start at multiples of 20, below zero too.
* An empty table gives no node; other columns are ignored.
* Two turns are equal when 128 bits of their SHA-256 are.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpoint.llm.io import drop, stash

#: Conversations and turns of a block; paths that the last round takes at most.
BLOCK, TURNS, TOP = 1 << 14, 1 << 18, 1 << 12
WORD = r"[^\x20\x09-\x0D]+"
EMPTY = hashlib.sha256(b"").hexdigest()
_NONE = (1 << 63) - 1
_ROOT = bytes(16)
CLOSED, PATH, SLOT, PIECE = range(4)

_FIELDS = [("kind", "int"), ("part", "bigint"), ("side", "int"), ("key", "binary"), ("ref", "binary"),
           *((c, "bigint") for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")),
           ("ends_sha256", "string"), ("piece", "binary"), ("path", "array<binary>"), *((c, "array<bigint>") for c in ("words", "n", "low", "kids", "leaves", "saved"))]
SCHEMA = ", ".join(f"{n} {t}" for n, t in _FIELDS)
_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "string": pa.string(),
          "array<binary>": pa.list_(pa.binary()), "array<bigint>": pa.list_(pa.int64())}
_SCHEMA = pa.schema([(n, _ARROW[t]) for n, t in _FIELDS])


# ------------------------------------------------------------------- sequences

def turn_keys(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, k, w``: each turn's digest and the words of its text."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    return conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)).alias("k"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("w"))


def rebuilt(conversations: DataFrame, block: int = 20, most: int = 4) -> DataFrame:
    """``conv_id, path, words``: the first h turns of the conversation that begins a block of ids,
    then the own turns after the first h; h is the id's CRC-32 modulo ``most``.

    Turns are shuffled once, by block; a block's first conversation is joined there."""
    base = F.col("conv_id") - F.pmod(F.col("conv_id"), F.lit(block))
    own = (turn_keys(conversations).withColumn("base", base).repartition("base").groupBy("base", "conv_id")
           .agg(F.sort_array(F.collect_list(F.struct("turn", "k", "w"))).alias("t")))
    heads = own.where("conv_id = base").select("base", F.slice("t", 1, most - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    both = own.join(heads, "base", "left").withColumn("h", h)
    turns = F.concat(F.slice(F.coalesce("head", F.slice("t", 1, 0)), F.lit(1), F.col("h")),
                     F.slice("t", F.col("h") + 1, F.size("t")))
    return both.select("conv_id", turns.alias("s")).select("conv_id", F.col("s.k").alias("path"), F.col("s.w").alias("words"))


# ------------------------------------------------------------------- one block

class Item:
    """A sequence with what is known of the node at each depth of its path: members, least
    member, closed children, closed leaves and closed savings below.  At first, a sequence
    has its own ``ids`` as members at every depth."""

    __slots__ = ("ids", "path", "stats", "words")

    def __init__(self, path, words, ids=None, stats=None):
        self.path, self.words, self.ids, self.stats = path, words, ids, stats

    def add(self, other: Item) -> None:
        """Take in an equal sequence."""
        n, low, *rest = self.stats
        n2, low2, *rest2 = other.stats
        self.stats = [[a + b for a, b in zip(n, n2)], [min(a, b) for a, b in zip(low, low2)],
                      *([a + b for a, b in zip(x, y)] for x, y in zip(rest, rest2))]


def _lcp(a: list, b: list) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(i for i in range(n) if a[i] != b[i])


def trie(paths: list[list[bytes]]) -> tuple[list[int], list[int]]:
    """Depth and parent of each node over sorted distinct paths; node i is path i's end."""
    lcp = [_lcp(a, b) for a, b in zip(paths, paths[1:])]
    depth, parent = [len(p) for p in paths], [-1] * len(paths)
    boss, top = list(range(len(paths))), list(range(len(paths)))

    def find(x: int) -> int:
        while boss[x] != x:
            boss[x] = x = boss[boss[x]]
        return x

    def lift(node: int, to: int) -> int:
        while depth[node] > to:
            depth.append(depth[node] - 1)
            parent.append(-1)
            parent[node] = node = len(depth) - 1
        return node

    # deepest first, equal depths from the left: so the right component lies below the edge
    for e in sorted(range(len(lcp)), key=lambda i: -lcp[i]):
        a, b = find(e), find(e + 1)
        node = lift(top[a], lcp[e])
        parent[lift(top[b], lcp[e] + 1)] = node
        boss[b], top[a] = a, node
    lift(top[find(0)], 0)
    return depth, parent


def _keys(path: list[bytes]) -> list[bytes]:
    """Digest of the node at each depth."""
    out = [_ROOT]
    for turn in path:
        out.append(hashlib.blake2b(out[-1] + turn, digest_size=16).digest())
    return out


def contract(items: list[Item], part: int, final: bool) -> pa.RecordBatch:
    """Closed nodes of a block, its open paths, the open nodes' digests, and pieces of ids that
    end in an open node.  If ``final``, all nodes are closed."""
    depth, parent = trie([x.path for x in items])
    count = len(depth)
    n, low, kids, leaves, saved, words = [0] * count, [_NONE] * count, [0] * count, [0] * count, [0] * count, [0] * count
    key: list[bytes | None] = [None] * count
    opened = [False] * count
    for i, x in enumerate(items):
        edge = not final and i in (0, len(items) - 1)
        own = _keys(x.path) if edge or x.ids is None else None
        node = i
        while node >= 0:
            d = depth[node]
            if x.ids is None:
                st = x.stats
                n[node] += st[0][d]
                low[node] = min(low[node], st[1][d])
                kids[node] += st[2][d]
                leaves[node] += st[3][d]
                saved[node] += st[4][d]
            else:
                n[node] += len(x.ids)
                low[node] = min(low[node], x.ids[0])
            words[node] = x.words[d - 1] if d else 0
            if own:
                key[node] = own[d]
            opened[node] |= edge
            node = parent[node]
    rows = []
    for v in sorted(range(count), key=lambda i: -depth[i]):
        if opened[v]:
            continue
        leaves[v] += kids[v] == 0
        saved[v] += (n[v] - 1) * words[v]
        if parent[v] >= 0:
            p = parent[v]
            kids[p] += 1
            leaves[p] += leaves[v]
            saved[p] += saved[v]
    for v in range(count):
        p = parent[v]
        if opened[v]:
            rows.append({"kind": SLOT, "part": part, "key": key[v]})
            if v < len(items) and items[v].ids:
                rows.append({"kind": PIECE, "part": part, "key": key[v], "piece": ",".join(map(str, items[v].ids)).encode()})
            continue
        ends = None
        if v < len(items) and items[v].ids:
            ends = hashlib.sha256(",".join(map(str, items[v].ids)).encode()).hexdigest()
        rows.append({"kind": CLOSED, "part": part, "key": key[v], "ref": key[p] if p >= 0 and opened[p] else None,
                     "conv_id": low[v], "depth": depth[v], "parent_conv_id": low[p] if p >= 0 and not opened[p] else None,
                     "n_convs": n[v], "n_children": kids[v], "n_leaves": leaves[v], "saved_tokens": saved[v], "ends_sha256": ends})
    if not final:
        shared = -1
        for side, i in enumerate(dict.fromkeys([0, len(items) - 1])):
            chain, node = [], i
            while node >= 0:
                chain.append(node)
                node = parent[node]
            chain.reverse()
            stats = [[x[v] for v in chain] for x in (n, low, kids, leaves, saved)]
            if side:
                # what both paths share stands on the first
                shared = _lcp(items[0].path, items[i].path)
                for x, none in zip(stats, (0, _NONE, 0, 0, 0)):
                    x[:shared + 1] = [none] * (shared + 1)
            rows.append({"kind": PATH, "part": part, "side": side, "path": items[i].path, "words": items[i].words,
                         **dict(zip(("n", "low", "kids", "leaves", "saved"), stats))})
    return pa.RecordBatch.from_pylist(rows, _SCHEMA)


# ------------------------------------------------------------------- blocks of a partition

def _blocks(sequences, final: bool, block: int):
    """Contracted blocks of a partition's sorted sequences; equal neighbours become one.
    Paths are only cut in blocks of four at least, which leave two, so every round leaves fewer."""
    part = TaskContext.get().partitionId() << 32
    items: list[Item] = []
    rows = turns = 0
    for x in sequences:
        if items and items[-1].path == x.path:
            if x.ids:
                items[-1].ids += x.ids
            else:
                items[-1].add(x)
        else:
            items.append(x)
            turns += len(x.path)
        rows += 1
        if not final and (x.ids or len(items) > 3) and (rows >= block or turns >= TURNS):
            yield contract(items, part, final)
            items, rows, turns, part = [], 0, 0, part + 1
    if items:
        yield contract(items, part, final)


def _lists(column) -> list[list]:
    flat, at = column.flatten().to_pylist(), column.offsets.to_pylist()
    base = at[0]
    return [flat[a - base:b - base] for a, b in zip(at, at[1:])]


def _first(block: int):
    def run(batches):
        def sequences():
            for batch in batches:
                if batch.num_rows:
                    for c, path, words in zip(batch.column("conv_id").to_pylist(), _lists(batch.column("path")), _lists(batch.column("words"))):
                        yield Item(path, words, [c])
        yield from _blocks(sequences(), False, block)
    return run


def _next(final: bool, block: int):
    def run(batches):
        def sequences():
            for batch in batches:
                for r in batch.to_pylist():
                    yield Item(r["path"], r["words"], None, [r[c] for c in ("n", "low", "kids", "leaves", "saved")])
        yield from _blocks(sequences(), final, block)
    return run


def _hashes(batches):
    """SHA-256 of each key's pieces in order, joined by commas."""
    now, sha = None, None
    for batch in batches:
        keys, sums = [], []
        for key, piece in zip(batch.column("key").to_pylist(), batch.column("piece").to_pylist()):
            if key != now:
                if now is not None:
                    keys.append(now)
                    sums.append(sha.hexdigest())
                now, sha = key, hashlib.sha256(piece)
            else:
                sha.update(b"," + piece)
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sums)], ["key", "sha"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([sha.hexdigest()])], ["key", "sha"])


# ------------------------------------------------------------------- the whole

def nodes(sequences: DataFrame, block: int = BLOCK, top: int = TOP) -> DataFrame:
    """Every trie node of ``conv_id, path, words``: ``conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256``.  ``top`` is 8 at least."""
    spark = sequences.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    whole, whole_path = stash(sequences, "conversations")
    ordered = whole.repartitionByRange(parts, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    rounds = [stash(ordered.mapInArrow(_first(block), SCHEMA), "forest")[0]]
    drop(spark, whole_path)
    while True:
        paths = rounds[-1].where(f"kind = {PATH}").select("part", "side", "path", "words", "n", "low", "kids", "leaves", "saved")
        left = paths.count()
        final = left <= top
        dealt = paths.repartition(1) if final else paths.repartitionByRange(-(-left // top), "part")
        rounds.append(stash(dealt.sortWithinPartitions("part", "side").mapInArrow(_next(final, block), SCHEMA), "forest")[0])
        if final:
            break
    tagged = [r.withColumn("level", F.lit(i)) for i, r in enumerate(rounds)]
    pieces = rounds[0].where(f"kind = {PIECE}").select("key", "part", "piece")
    sums = pieces.repartition("key").sortWithinPartitions("key", "part").mapInArrow(_hashes, "key binary, sha string")
    late = reduce(DataFrame.union, tagged[1:]).where(f"kind = {CLOSED}")
    slots = reduce(DataFrame.union, tagged).where(f"kind = {SLOT}").select("level", "part", F.col("key").alias("ref"))
    names = late.select("key", F.col("conv_id").alias("name"))
    named = slots.join(names.withColumnRenamed("key", "ref"), "ref").select("level", "part", "ref", "name")
    columns = ["level", "part", "ref", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    closed = tagged[0].where(f"kind = {CLOSED}").select(columns).union(
        late.join(sums, "key", "left").withColumn("ends_sha256", F.col("sha")).select(columns))
    out = columns[3:]
    far = closed.where("ref is not null").join(named, ["level", "part", "ref"]).withColumn("parent_conv_id", F.col("name"))
    return closed.where("ref is null").select(out).union(far.select(out)).fillna(EMPTY, ["ends_sha256"])


def prefix_nodes(conversations: DataFrame) -> DataFrame:
    """Trie nodes of the rebuilt conversations."""
    return nodes(rebuilt(conversations))


# CRC-32 by bits over the bytes of the decimal id
SQL = r"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
k as (select conv_id, turn, substr(sha256(length(role)::varchar || ':' || role || text), 1, 32) as k,
    len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as w from t),
o as (select conv_id, list(k order by turn nulls first, k) as ks, list(w order by turn nulls first, k) as ws from k group by conv_id),
c as (select *, conv_id - ((conv_id % 20 + 20) % 20) as base, (xor(list_reduce(list_prepend(4294967295::bigint,
      list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint)),
      lambda a, y: list_reduce(list_prepend(xor(a, y), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 4)::bigint as h from o),
r as (select c.conv_id, list_concat(coalesce(b.ks[1:c.h], []), c.ks[c.h + 1:]) as ks, list_concat(coalesce(b.ws[1:c.h], []), c.ws[c.h + 1:]) as ws
  from c left join o b on b.conv_id = c.base),
p as (select conv_id, len(ks) as size, unnest(range(0, len(ks) + 1)) as d, ks, ws from r),
n as (select array_to_string(ks[1:d], '') as path, d as depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(case when d > 0 then ws[d] else 0 end) as w,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where size = d), '')) as ends_sha256 from p group by 1, 2),
g as (select n.*, u.conv_id as parent_conv_id, (select count(*) from n c where c.depth = n.depth + 1 and left(c.path, length(n.path)) = n.path) as n_children
  from n left join n u on u.depth = n.depth - 1 and u.path = left(n.path, length(n.path) - 32))
select g.conv_id, g.depth, g.parent_conv_id, g.n_convs, g.n_children, s.n_leaves, s.saved_tokens, g.ends_sha256 from g join (
  select left(path, 32 * a) as path, a, count(*) filter (where n_children = 0) as n_leaves, sum((n_convs - 1) * w)::bigint as saved_tokens
  from (select *, unnest(range(0, depth + 1)) as a from g) group by 1, 2) s on s.a = g.depth and s.path = g.path
"""
