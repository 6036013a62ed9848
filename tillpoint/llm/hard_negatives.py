"""Hard-negative mining by threshold joins in the manner of L2AP.

For an anchor and one of its positives, hard negatives are the nearest rows of other labels
whose score lies within a window given by the positive's score.  Scores are inner products
of whole-number vectors, so they are exact and ties are true ties.

**Index.**  Rows are sorted by label and norm and packed into blocks of at most ``BLOCK`` rows of
one label, with their values dimension by dimension, those of the most energy over all rows first.  A
block keeps its rows' suffix norms after every ``STEP`` dimensions.

**Join.**  A search has anchors with thresholds and goes through the index once.  In a
block, only the leading dimensions are indexed: the rest is left out as soon as the
product of the largest suffix norms on both sides is below every threshold, because rows
that agree there alone can't reach it.  A block covered whole is skipped.  Partial scores
are accumulated ``STEP`` indexed dimensions at a time; after each step rows and anchors go
of which no partial score plus product of the remaining norms reaches the threshold.  What
is left after the last indexed dimension is verified with the dimensions left out.
Thresholds rise with the k-th best score of a task.

**Lowering.**  A first threshold is the best score among ``TRIAL`` rows of the anchors' own
block, a small part of all rows.  Windows that it doesn't fill are searched again from the k-th
best score there, which is reached by k rows at least, or from the window's lower end.
So every window is filled, or all of it has been searched.

Anchors are searched in blocks of ``ANCHORS``, one broadcast of bounded size each, against
all rows.  Rows per task and search are bounded by anchors times windows times k.

* Rows with a null id, label or vector, or with a null or non-finite component, take no part.
* A row that repeats another in all three columns counts once.  Rows that share only an id
  are rows of their own.
* Vectors of different lengths: missing components count as 0; an empty vector scores 0.
* Fewer positives or negatives than asked for: all that there are.
* Empty tables give empty results; other columns are ignored.
* Scores are exact while the product of two norms is below 2^53 (vectors of unit norm have 2^16).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillpoint.llm.io import drop, shared_path, stash

#: Rows of a block of the index; dimensions that are accumulated between two prunings;
#: anchors that are broadcast at a time.
BLOCK, STEP, ANCHORS = 2048, 8, 8192
#: Anchors of a block from which the first thresholds are taken.
TRIAL = 1024
#: Bytes of anchors' vectors that are broadcast at a time.
ANCHOR_BYTES = 8 << 20
_LOW = -(1 << 62)


def whole_vectors(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256) -> DataFrame:
    """``id, label, v`` with the vectors' components as ``floor(scale * x)``, of the rows that take part."""
    x = F.col(f"`{vector}`")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return rows.where(F.col(f"`{vec_id}`").isNotNull() & F.col(f"`{label}`").isNotNull() & x.isNotNull() & sound).select(
        F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{label}`").cast("int").alias("label"),
        F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v")).distinct()


# ----------------------------------------------------------------------------- index

def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column as a matrix, short ones filled with 0."""
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(size) and (size == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(size), dims), np.int64)
    out[np.arange(dims) < size[:, None]] = flat
    return out


def _suffix_norms(values: np.ndarray, step: int) -> np.ndarray:
    """Norms of what follows the first 0, step, 2 step, ... columns, rounded up; one row per cut."""
    squares = np.cumsum((values.astype(float) ** 2)[:, ::-1], axis=1)[:, ::-1]
    cuts = [squares[:, i] if i < values.shape[1] else np.zeros(len(values)) for i in range(0, values.shape[1] + step, step)]
    return np.sqrt(np.stack(cuts)) * (1 + 1e-12)


def _pack(order: np.ndarray, block: int):
    """Blocks of neighbouring rows of one label."""
    dims = len(order)

    def packed(label, ids, values):
        big = int(np.abs(values).max(initial=0))
        kind = np.int16 if big < 1 << 15 else np.int32 if big < 1 << 31 else np.int64
        return {"label": int(label), "n": len(ids), "ids": ids.tobytes(), "kind": kind.__name__,
                "v": np.ascontiguousarray(values[:, order].T.astype(kind)).tobytes(), "top": float(np.sqrt((values.astype(float) ** 2).sum(axis=1).max()))}

    def rows(batches):
        label, ids, values = None, [], []

        def flush():
            out = packed(label, np.concatenate(ids), np.concatenate(values))
            ids.clear()
            values.clear()
            return pa.RecordBatch.from_pylist([out], SCHEMA)

        for batch in batches:
            got, own = batch.column("label").to_numpy(), batch.column("id").to_numpy()
            m = _matrix(batch.column("v"), dims)
            at = 0
            while at < len(got):
                if ids and (got[at] != label or sum(map(len, ids)) == block):
                    yield flush()
                label = got[at]
                room = block - sum(map(len, ids))
                other = np.flatnonzero(got[at:at + room] != label)
                to = at + (int(other[0]) if len(other) else min(room, len(got) - at))
                ids.append(own[at:to])
                values.append(m[at:to])
                at = to
        if ids:
            yield flush()

    return rows


SCHEMA = pa.schema([("label", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("kind", pa.string()), ("v", pa.binary()), ("top", pa.float64())])


@dataclass
class Index:
    """Blocks in the shared folder, and the order of dimensions."""

    blocks: DataFrame
    order: np.ndarray
    path: str

    def drop(self) -> None:
        drop(self.blocks.sparkSession, self.path)


def build(vectors: DataFrame, block: int = BLOCK) -> Index:
    """Index of ``id, label, v``.  What is collected is one number per dimension."""
    energy = (vectors.select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(F.sum(F.col("x").cast("double") * F.col("x")).alias("e"))
              .orderBy(F.desc("e"), "d").collect())
    order = np.array([r["d"] for r in energy], np.int64)
    order = np.concatenate([order, np.setdiff1d(np.arange(order.max(initial=-1) + 1), order)]).astype(np.int64)
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    rows = vectors.withColumn("norm", norm)
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))    # work per row is high: no coalescing
    sorted_rows = rows.repartitionByRange(parts, "label", F.desc("norm"), "id").sortWithinPartitions("label", F.desc("norm"), "id").select("id", "label", "v")
    blocks, path = stash(sorted_rows.mapInArrow(_pack(order, block), "label int, n int, ids binary, kind string, v binary, top double"), "vectors")
    return Index(blocks, order, path)


# ----------------------------------------------------------------------------- search

@dataclass
class Anchors:
    """Anchors of a block: ids, labels, values in the index's order of dimensions."""

    ids: np.ndarray
    labels: np.ndarray
    values: np.ndarray
    suffix: np.ndarray = field(init=False)

    def __post_init__(self):
        self.suffix = _suffix_norms(self.values, STEP)


@dataclass
class Windows:
    """Windows of a search, sorted by anchor: scores from ``low`` to ``high``, of which the
    ``k`` best are wanted, searched from ``threshold`` on."""

    anchor: np.ndarray
    low: np.ndarray
    high: np.ndarray
    threshold: np.ndarray

    def __len__(self):
        return len(self.anchor)

    def of(self, which: np.ndarray) -> Windows:
        return Windows(*(x[which] for x in (self.anchor, self.low, self.high, self.threshold)))


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first by score (descending) and id."""
    return np.lexsort((ids, -score))[:k]


def threshold_join(a: Anchors, values: np.ndarray, suffix: np.ndarray, at: np.ndarray, threshold: np.ndarray):
    """Pairs ``(place in at, row, score)`` of the anchors ``at`` and the rows of a block whose
    score reaches the anchor's ``threshold``.

    ``values`` holds the block dimension by dimension, ``suffix`` its rows' norms after each step."""
    dims, n = values.shape
    rows, left, threshold = np.arange(n), np.arange(len(at)), threshold.astype(float)
    none = (np.zeros(0, np.int64),) * 3
    if not len(at):
        return none
    qs = a.suffix[:, at]
    # dimensions behind the first cut whose bound is below all thresholds stay out of the index
    covered = qs.max(axis=1) * suffix.max(axis=1) < threshold.min()
    indexed = int(covered.argmax()) if covered.any() else suffix.shape[0] - 1
    if covered[0]:
        return none
    part = np.zeros((len(left), len(rows)))
    for cut in range(1, indexed + 1):
        lo, hi = (cut - 1) * STEP, min(dims, cut * STEP)
        part += a.values[at[left], lo:hi] @ values[lo:hi, rows].astype(float)
        if cut == indexed:
            break
        alive = part + qs[cut][left][:, None] * suffix[cut][rows] >= threshold[left][:, None]
        keep_a, keep_r = alive.any(axis=1), alive.any(axis=0)
        if keep_a.mean() < 0.75 or keep_r.mean() < 0.75:
            part, left, rows = part[np.ix_(keep_a, keep_r)], left[keep_a], rows[keep_r]
            if not len(left) or not len(rows):
                break
    if not len(left) or not len(rows):
        return none
    i, j = np.nonzero(part + qs[indexed][left][:, None] * suffix[indexed][rows] >= threshold[left][:, None])
    score = part[i, j]
    i, j = left[i], rows[j]
    rest = indexed * STEP
    if rest < dims:
        for lo in range(0, len(i), 1 << 16):
            s = slice(lo, lo + (1 << 16))
            score[s] += np.einsum("pd,dp->p", a.values[at[i[s]], rest:], values[rest:, j[s]].astype(float))
    ok = score >= threshold[i]
    return i[ok], j[ok], score[ok].astype(np.int64)


def _searcher(shared, k: int, same: bool):
    """Rows ``window, score, id, label`` of the k best of each window in this task."""

    def rows(batches):
        a, w = shared.value
        first = np.searchsorted(w.anchor, np.arange(len(a.ids)), side="left")
        behind = np.searchsorted(w.anchor, np.arange(len(a.ids)), side="right")
        need = np.where(first < behind, 0, np.iinfo(np.int64).max)     # least threshold of the anchor's windows
        wall = w.threshold.copy()
        for x in np.flatnonzero(first < behind):
            need[x] = wall[first[x]:behind[x]].min()
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for block in batch.to_pylist():
                values = np.frombuffer(block["v"], block["kind"]).reshape(-1, block["n"])
                ids = np.frombuffer(block["ids"], np.int64)
                at = np.flatnonzero((first < behind) & ((a.labels == block["label"]) == same)
                                    & (need <= a.suffix[0] * block["top"] * (1 + 1e-12)))
                if not len(at):
                    continue
                i, j, score = threshold_join(a, values, _suffix_norms(values.T, STEP), at, need[at])
                if same:                                               # an anchor is no positive of its own
                    other = np.ones(len(i), bool)
                    twin = np.flatnonzero(a.ids[at[i]] == ids[j])
                    for t in twin:
                        other[t] = not np.array_equal(a.values[at[i[t]]], values[:, j[t]])
                    i, j, score = i[other], j[other], score[other]
                order = np.argsort(i, kind="stable")
                i, j, score = i[order], j[order], score[order]
                who, starts = np.unique(i, return_index=True)
                for x, lo, hi in zip(who, starts, [*starts[1:], len(i)]):
                    anchor = at[x]
                    s, own = score[lo:hi], ids[j[lo:hi]]
                    for win in range(first[anchor], behind[anchor]):
                        inside = (s >= wall[win]) & (s <= w.high[win])
                        if not inside.any():
                            continue
                        s2, o2 = s[inside], own[inside]
                        if win in held:
                            s2, o2 = np.concatenate([held[win][0], s2]), np.concatenate([held[win][1], o2])
                        top = _best(s2, o2, k)
                        held[win] = s2[top], o2[top]
                        if len(top) == k:
                            wall[win] = max(wall[win], s2[top[-1]])
                    need[anchor] = wall[first[anchor]:behind[anchor]].min()
        for win, (s, own) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), win)), pa.array(s), pa.array(own)], ["win", "score", "id"])

    return rows


def _search(index: Index, a: Anchors, w: Windows, k: int, same: bool) -> DataFrame:
    """``win, score, id, rank`` of the k best rows of each window's label side, from its threshold on."""
    shared = index.blocks.sparkSession.sparkContext.broadcast((a, w))
    found = index.blocks.mapInArrow(_searcher(shared, k, same), "win bigint, score bigint, id bigint")
    rank = F.row_number().over(Window.partitionBy("win").orderBy(F.desc("score"), "id"))
    out = found.withColumn("rank", rank).where(F.col("rank") <= k).toPandas().sort_values(["win", "rank"])
    shared.destroy()
    return out


def _filled(index: Index, a: Anchors, w: Windows, k: int, same: bool):
    """The k best rows of each window of an anchor block, thresholds being lowered until
    the windows are full or searched to their lower ends."""
    import pandas as pd

    inner = a.values @ a.values[:TRIAL].T
    tries = []
    for win in range(len(w)):
        x = w.anchor[win]
        fit = (a.labels[:TRIAL] == a.labels[x]) == same
        fit[x:x + 1] = False
        s = inner[x][fit]
        s = np.sort(s[(s >= w.low[win]) & (s <= w.high[win])])[::-1].astype(np.int64)
        tries.append((s[0] if len(s) else w.low[win], s[k - 1] if len(s) >= k else w.low[win], w.low[win]))
    tries = np.array(tries, np.int64).reshape(-1, 3)
    done, open_ = [], np.arange(len(w))
    for level in range(3):
        if not len(open_):
            break
        now = w.of(open_)
        now.threshold = tries[open_, level]
        found = _search(index, a, now, k, same)
        count = np.bincount(found["win"], minlength=len(open_))
        full = (count >= k) | (now.threshold <= now.low)
        found = found[full[found["win"].to_numpy()]]
        done.append(found.assign(win=open_[found["win"].to_numpy()]))
        open_ = open_[~full]
    return pd.concat(done).sort_values(["win", "rank"], ignore_index=True) if done else None


def mine(vectors: DataFrame, anchors, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
         anchor_rows: int = ANCHORS) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: for the rows of
    ``vectors(id, label, v)`` that satisfy the condition ``anchors``, the first ``positives`` other rows
    of the label, and for each the first ``negatives`` rows of other labels that score from ``low``
    to ``high`` per cent of the positive's score."""
    import pandas as pd

    spark = vectors.sparkSession
    rows, rows_path = stash(vectors, "vectors-whole")
    index = build(rows)
    dims = len(index.order)
    anchor_rows = max(1, min(anchor_rows, ANCHOR_BYTES // (8 * max(1, dims))))
    chosen, chosen_path = stash(rows.where(anchors).withColumn("part", F.xxhash64("id", "label", "v")), "anchors")
    parts = max(1, math.ceil(chosen.count() / anchor_rows * 1.2))
    out = shared_path(spark, "negatives")
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    spark.createDataFrame([], schema).write.parquet(out)
    for part in range(parts):
        got = chosen.where(F.pmod("part", F.lit(parts)) == part).select("id", "label", "v").toArrow().combine_chunks()
        if not got.num_rows:
            continue
        lists = got.column("v").combine_chunks()
        values = _matrix(lists, dims)[:, index.order].astype(float)
        a = Anchors(got.column("id").to_numpy(), got.column("label").to_numpy(), values)
        n = len(a.ids)
        every = np.arange(n)
        near = _filled(index, a, Windows(every, np.full(n, _LOW), np.full(n, -_LOW), np.full(n, _LOW)), positives, same=True)
        if near is None or not len(near):
            continue
        score = near["score"].to_numpy(np.int64)
        lo, hi = -(-low * score // 100), high * score // 100          # ceil and floor of the percentages
        some = np.flatnonzero(lo <= hi)
        if not len(some):
            continue
        w = Windows(near["win"].to_numpy()[some], lo[some], hi[some], lo[some])
        far = _filled(index, a, w, negatives, same=False)
        if far is None or not len(far):
            continue
        of = some[far["win"].to_numpy()]
        table = pd.DataFrame({"anchor_id": a.ids[near["win"].to_numpy()[of]], "positive_id": near["id"].to_numpy()[of], "rank": far["rank"].to_numpy(np.int32),
                              "negative_id": far["id"].to_numpy(), "positive_score": score[of], "negative_score": far["score"].to_numpy()})
        spark.createDataFrame(table, schema).write.mode("append").parquet(out)
    index.drop()
    drop(spark, rows_path, chosen_path)
    return spark.read.schema(schema).parquet(out)


def hard_negatives(rows: DataFrame) -> DataFrame:
    """``mine`` with every id divisible by 50 as an anchor; where the id is divisible by 7, the
    label first becomes the next one of ten."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(whole_vectors(rows.select("vec_id", "embedding", label.alias("label"))), "id % 50 = 0")


SQL = """
with v as (select distinct vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.id as anchor_id, b.id, a.label = b.label as same, list_inner_product(a.v::double[], b.v::double[])::bigint as score
  from v a join v b on a.id <> b.id where a.id % 50 = 0),
p as (select * from (select *, row_number() over (partition by anchor_id order by score desc, id) as place from s where same) where place <= 5),
n as (select p.anchor_id, p.id as positive_id, p.score as positive_score, s.id as negative_id, s.score as negative_score,
    row_number() over (partition by p.anchor_id, p.id order by s.score desc, s.id) as rank
  from p join s on s.anchor_id = p.anchor_id and not s.same and 100 * s.score between 50 * p.score and 95 * p.score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from n where rank <= 3
"""
