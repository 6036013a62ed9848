"""Mixture-controlled packing: deficit round-robin over source queues.

Each source is a queue of tokens.  Every window (sequence) takes from each queue its
target share of the window; what rounding leaves a queue short of (or ahead by) in one
window is its deficit and is carried into the next.  With shares fixed, the tokens that
queue ``q`` has given after ``k`` windows are ``floor(k * G[q]) - floor(k * G[q - 1])``,
where ``G`` are the running sums of the shares: the deficits in closed form.  So a piece's
window and its place there follow from the place of its tokens in the queue, and every
task packs its own documents, whatever the number of partitions.

This needs shares of a token at least.  Queues with less form a pool, which is one queue
(the first, so its share may be of any size).  The pool's stream is dealt in the same way
over windows that are wide enough for the greatest of its members and those of half its
size; the others form the next pool.  So every source has its queue, however small.

When a queue can not fill its share of another window, its rest goes to a tail and the
others' shares grow in proportion; the tails fill the last windows.  All windows are full
but the last one, whose length is padded to ``width`` unless it is a power of two.

1. Texts are tokenized once; ids are written with the queue place within their task.
2. Token totals of each task and source give every task's place in its queues.
3. Pieces are cut from the ids and get their window, offset and CRC-32.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache, reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillpoint.llm.io import stash

WIDTH = 2048
END = 1
#: Shares by targets are counted in parts of a token, so that they are exact integers.
PART = 1 << 40
VOCABULARY = "byte_bpe_50k.json"


@lru_cache(maxsize=1)
def _encoder(path: str):
    """The byte-level BPE of the file at ``path``; ids as the tokenizers library gives
    them within a text without added tokens (tested), from the same vocabulary."""
    import json

    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    # byte-level BPE writes each byte as a printable character
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(plain)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if all(c in byte_of for c in t) and t != "<|endoftext|>"}
    return tiktoken.Encoding("pack", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def _added(path: str) -> tuple[re.Pattern, dict[str, int]] | None:
    """The added tokens of the file at ``path``: what finds them, and their ids."""
    import json

    with open(path, encoding="utf-8") as f:
        found = json.load(f).get("added_tokens") or []
    if any(t[flag] for t in found for flag in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens that take in their surroundings are not supported")
    ids = {t["content"]: t["id"] for t in found}
    return (re.compile("|".join(re.escape(c) for c in sorted(ids, key=len, reverse=True))), ids) if ids else None


def document_ids(column: pa.Array, path: str) -> list[np.ndarray]:
    """Token ids of each text as the tokenizers library gives them with
    ``add_special_tokens=False``: an added token in a text has an id of its own."""
    out, added = token_ids(column, path), _added(path)
    if added is None:
        return out
    enc = _encoder(path)
    held = reduce(pc.or_kleene, (pc.match_substring(column, c) for c in added[1]))
    for r in np.flatnonzero(pc.fill_null(held, False).to_numpy(zero_copy_only=False)).tolist():
        text, ids, at = column[r].as_py(), [], 0
        for m in added[0].finditer(text):
            ids += [_encoded(enc, text[at:m.start()]), np.array([added[1][m.group()]], np.uint16)]
            at = m.end()
        out[r] = np.concatenate([*ids, _encoded(enc, text[at:])])
    return out


#: Characters of a long text that are encoded at a time.
PIECE = 1 << 20
#: The splitting pattern ends a token before white space that follows a visible ASCII
#: character, and never looks back: ids on both sides of such a place are independent.
_CUT = re.compile(r"[!-~](?=[ \t-\r])")


def _encoded(enc, text: str) -> np.ndarray:
    out, at = [], 0
    while len(text) - at > PIECE and (m := _CUT.search(text, at + PIECE)):
        out.append(np.array(enc.encode_ordinary(text[at:m.end()]), np.uint16))
        at = m.end()
    out.append(np.array(enc.encode_ordinary(text[at:]), np.uint16))
    return np.concatenate(out) if at else out[0]


def token_ids(column: pa.Array, path: str) -> list[np.ndarray]:
    """Token ids of each text, without an end; added tokens are ordinary text."""
    enc = _encoder(path)
    return [_encoded(enc, text.as_py() or "") for text in column]


def _id_rows(path: str):
    """``doc_id, source, tokens, place, ids``: ids as 16-bit integers; the place counts the
    tokens of the same source before it in this task."""
    end = END.to_bytes(2, "little")

    def run(batches):
        place: dict = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                tokens, places, raw = [], [], []
                for source, ids in zip(part.column(2).to_pylist(), document_ids(part.column(1), path)):
                    at = place.get(source, 0)
                    place[source] = at + len(ids) + 1
                    tokens.append(len(ids) + 1)
                    places.append(at)
                    raw.append(ids.astype("<u2", copy=False).tobytes() + end)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(tokens, pa.int64()), pa.array(places, pa.int64()), pa.array(raw, pa.binary())],
                    ["doc_id", "source", "tokens", "place", "ids"])
    return run


class Phase(NamedTuple):
    """``count`` windows from ``window`` on, filled from several queues: where each one
    stands when it begins, and the running sums of the shares in parts of a token."""

    window: int
    count: int
    begin: dict[int, int]
    low: dict[int, int]
    high: dict[int, int]
    unit: int = PART


class Plan(NamedTuple):
    phases: list[Phase]
    tail_begin: dict[int, int]      # place in its queue where a queue's tail begins
    tail_at: dict[int, int]         # place of that in the tail stream
    tail_window: int
    total: int
    members: frozenset = frozenset()     # queues of the pool, how it is dealt, and its width
    pool: Plan | None = None
    pool_width: int = 0


#: The pool's number among the queues.
POOL = -1


def taken(k: int, low: int, high: int, unit: int = PART) -> int:
    """Tokens that a queue has given after ``k`` windows of a phase.  It never falls if the
    share is of a token at least, or ``low`` is 0."""
    return k * high // unit - k * low // unit


def plan(totals: list[int], targets: list[float] | None = None, width: int = WIDTH) -> Plan:
    """The phases for queues of these lengths; shares in proportion to ``targets``, or to
    the lengths.  Queues with a share of less than a token are dealt as a pool."""
    weights = totals if targets is None else targets
    return _plan(dict(enumerate(totals)), {q: float(w) for q, w in enumerate(weights)}, width)


def _plan(left: dict[int, int], weight: dict[int, float], width: int) -> Plan:
    total, left, weight = sum(left.values()), dict(left), dict(weight)
    active = [q for q in left if left[q] > 0 and weight[q] > 0]
    whole = sum(weight[q] for q in active)
    members = frozenset(q for q in active if weight[q] * width < whole)
    pool, pool_width = None, 0
    if members:
        some = sum(weight[q] for q in members)
        pool_width = int(2 * some / max(weight[q] for q in members)) + 1
        pool = _plan({q: left[q] for q in members}, {q: weight[q] for q in members}, pool_width)
        # the pool comes first
        left = {POOL: pool.total} | {q: n for q, n in left.items() if q not in members}
        weight[POOL] = some
        active = [POOL, *(q for q in active if q not in members)]
    begin = dict.fromkeys(left, 0)
    phases, window = [], 0
    while active:
        whole = sum(weight[q] for q in active)
        low, high, run = {}, {}, 0.0
        for q in active:
            low[q] = round(run / whole * width * PART)
            run += weight[q]
            high[q] = width * PART if q == active[-1] else round(run / whole * width * PART)
        if high[active[0]] == 0:             # less than a token in 2^40 windows
            active = active[1:]
            continue
        # the pool's share may be far below a token, but it gives floor(k * share)
        count = min(((left[q] + 1) * PART - 1) // high[q] if low[q] == 0 else (left[q] + 1) * PART // (high[q] - low[q]) + 1
                    for q in active)
        while count and any(taken(count, low[q], high[q]) > left[q] for q in active):
            count -= 1
        if count:
            phases.append(Phase(window, count, {q: begin[q] for q in active}, low, high))
            for q in active:
                t = taken(count, low[q], high[q])
                begin[q] += t
                left[q] -= t
            window += count
        # whoever can not fill another share leaves
        gone = [q for q in active if left[q] * PART < high[q] - low[q] or not left[q]]
        active = [q for q in active if q not in (gone or active[:1])]
    at, tail_at = 0, {}
    for q in left:
        tail_at[q] = at
        at += left[q]
    return Plan(phases, begin, tail_at, window, total, members, pool, pool_width)


def place_tokens(p: Plan, queue: int, begin: int, end: int, width: int = WIDTH) -> list[tuple[int, int, int, int]]:
    """Pieces of the tokens ``begin:end`` of a queue: ``(first, length, window, offset)``,
    the first counted from ``begin``."""
    if queue in p.members:
        return _through_pool(place_tokens(p.pool, queue, begin, end, p.pool_width), p.pool_width, p, width)
    out = []
    for ph in p.phases:
        if queue not in ph.begin:
            continue
        low, high, base, unit = ph.low[queue], ph.high[queue], ph.begin[queue], ph.unit
        a, b = max(begin, base) - base, min(end, base + taken(ph.count, low, high, unit)) - base
        while a < b:
            # the window that gives token a, at most two windows from where its share would
            k = max(0, a * unit // (high - low) - 2)
            if low == 0:
                k = max(0, -(-(a + 1) * unit // high) - 1)
            while taken(k + 1, low, high, unit) <= a:
                k += 1
            n = min(b, taken(k + 1, low, high, unit)) - a
            front = (k + 1) * low // unit - k * low // unit
            out.append((a + base - begin, n, ph.window + k, front + a - taken(k, low, high, unit)))
            a += n
    base = p.tail_begin[queue]
    a = max(begin, base)
    while a < end:
        at = p.tail_at[queue] + a - base
        n = min(end - a, width - at % width)
        out.append((a - begin, n, p.tail_window + at // width, at % width))
        a += n
    return out


def _through_pool(pieces, pool_width: int, p: Plan, width: int) -> list[tuple[int, int, int, int]]:
    """Pieces placed in a pool's stream, placed where the pool is dealt to."""
    out: list[tuple[int, int, int, int]] = []
    for first, length, window, offset in pieces:
        at = window * pool_width + offset
        out += [(first + f, n, w, o) for f, n, w, o in place_tokens(p, POOL, at, at + length, width)]
    return out


class Level(NamedTuple):
    """Queues dealt in proportion to their lengths, without targets: ``total`` tokens over
    windows of ``width``, the next level's being the first ``pool`` of them."""

    total: int
    width: int
    pool: int


def place_level(levels: list[Level], level: int, low: int, high: int, begin: int, end: int) -> list[tuple[int, int, int, int]]:
    """As ``place_tokens``, for the queue of the tokens ``low:high`` of a level.  Nothing is
    rounded here, so one phase holds all windows."""
    def one(v: Level, q: int, low: int, high: int) -> Plan:
        count = v.total // v.width
        low, high = low * v.width, high * v.width
        gone = taken(count, low, high, v.total)
        return Plan([Phase(0, count, {q: 0}, {q: low}, {q: high}, v.total)], {q: gone},
                    {q: low // v.width - count * low // v.total}, count, v.total)

    pieces = place_tokens(one(levels[level], 0, low, high), 0, begin, end, levels[level].width)
    for i in range(level - 1, -1, -1):
        v = levels[i]
        pieces = _through_pool(pieces, levels[i + 1].width, one(v, POOL, 0, v.pool), v.width)
    return pieces


def _piece_rows(shared, width: int):
    def run(batches):
        p = shared.value
        for batch in batches:
            cols: list[list] = [[] for _ in range(8)]
            for row, (queue, low, high, at, n, raw) in enumerate(zip(*(
                    batch.column(c).to_pylist() for c in ("queue", "low", "high", "at", "tokens", "ids")))):
                ids = np.frombuffer(raw, "<u2").astype("<u4")
                for first, length, window, offset in (place_tokens(p, queue, at, at + n, width) if isinstance(p, Plan)
                                                      else place_level(p, queue, low, high, at, at + n)):
                    for c, v in zip(cols, (row, first, length, zlib.crc32(ids[first:first + length].tobytes()), n, window, offset)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(cols[0], pa.int64())), *(pa.array(c, pa.int64()) for c in cols[1:7])],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
    return run


#: Parts that the table of sources is summed up in, per level.
SUMS = 256


def _levels(sizes: DataFrame, width: int) -> tuple[list[Level], DataFrame]:
    """The levels, and each source's level and place there.  What is collected grows with
    the logarithm of the sizes, not with the number of sources."""
    wide = sizes.agg(F.sum("n")).first()[0] or 0
    # log2 of the length; the longest are dealt directly
    kind = F.when(F.col("n") * width >= wide, F.lit(64)).otherwise(F.length(F.bin("n")))
    sized = sizes.withColumn("kind", kind).withColumn("part", F.pmod(F.xxhash64("source"), F.lit(SUMS)))
    sums = sorted((-r["kind"], r["part"], r["n"], r["most"]) for r in sized.groupBy("kind", "part")
                  .agg(F.sum("n").alias("n"), F.max("n").alias("most")).collect())
    levels, rows, left = [], [], wide
    for k in sorted({r[0] for r in sums} | {-64}):
        own = [r for r in sums if r[0] == k]
        if not levels:
            level_width = width
        else:
            level_width = 2 * left // max(r[3] for r in own) + 1
        at = left - sum(r[2] for r in own)
        levels.append(Level(left, level_width, at))
        left = at
        for _, part, n, _ in own:
            rows.append((-k, part, len(levels) - 1, at))
            at += n
    starts = sizes.sparkSession.createDataFrame(rows, "kind int, part bigint, queue int, front bigint")   # 64 * SUMS rows at most
    before = Window.partitionBy("kind", "part").orderBy("source").rowsBetween(Window.unboundedPreceding, -1)
    placed = (sized.withColumn("inside", F.coalesce(F.sum("n").over(before), F.lit(0))).join(F.broadcast(starts), ["kind", "part"])
              .select(F.col("source").alias("qsource"), "queue", (F.col("front") + F.col("inside")).alias("low"), "n")
              .select("qsource", "queue", "low", (F.col("low") + F.col("n")).alias("high")))
    return levels, placed


def pack(docs: DataFrame, vocabulary: str | None = None, width: int = WIDTH, targets: dict | None = None,
         id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset``.

    ``targets`` gives sources their weights in the mixture (default: their tokens); a
    source without one is packed behind the others.  Null texts are empty: one end token.
    A null source is a source.  Ids may be null or repeat; each row is packed.  Extra
    columns are ignored.  Empty input gives no rows."""
    import public_tokenizers

    spark = docs.sparkSession
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    kind = docs.schema[id].dataType.simpleString()
    own = docs.select(id, F.coalesce(F.col(text), F.lit("")), F.col(source).cast("string") if source in docs.columns else F.lit(None).cast("string"))
    rows, _ = stash(own.mapInArrow(_id_rows(path), f"doc_id {kind}, source string, tokens bigint, place bigint, ids binary")
                    .withColumn("task", F.spark_partition_id()), "ids")
    per_task = rows.groupBy("task", "source").agg(F.sum("tokens").alias("n"))
    sizes = per_task.groupBy("source").agg(F.sum("n").alias("n"))
    if targets is None:
        made, queue = _levels(sizes, width)
    else:
        # as many queues as the caller names, and one for all other sources
        names = sorted((s for s in targets if targets[s] > 0), key=lambda s: (s is None, s or ""))
        named = spark.createDataFrame([(s, i) for i, s in enumerate(names)], "qsource string, queue int")
        have = sizes.join(F.broadcast(named), F.col("source").eqNullSafe(F.col("qsource")))
        lengths = dict.fromkeys(range(len(names)), 0) | {r["queue"]: r["n"] for r in have.select("queue", "n").collect()}
        total = sizes.agg(F.sum("n")).first()[0] or 0
        made = plan([*lengths.values(), total - sum(lengths.values())], [*(float(targets[s]) for s in names), 0.0], width)
        queue = named.withColumn("low", F.lit(0).cast("long")).withColumn("high", F.lit(0).cast("long"))
    other = F.lit(0 if targets is None else len(names))
    known = (per_task.join(queue, F.col("source").eqNullSafe(F.col("qsource")), "left")
             .withColumn("own", F.when(F.col("queue").isNotNull(), F.col("source"))).withColumn("none", F.col("queue").isNull())
             .withColumn("queue", F.coalesce("queue", other)))
    before = Window.partitionBy("queue", "own", "none").orderBy("task", "source").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (known.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
               .select(F.col("task").alias("_task"), F.col("source").alias("_source"), "queue", "low", "high", "base"))
    offsets, _ = stash(offsets, "offsets")
    shared = spark.sparkContext.broadcast(made)
    at = rows.join(offsets, (F.col("task") == F.col("_task")) & F.col("source").eqNullSafe(F.col("_source")))
    return at.select("doc_id", "queue", "low", "high", (F.col("base") + F.col("place")).alias("at"), "tokens", "ids").mapInArrow(
        _piece_rows(shared, width),
        f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
