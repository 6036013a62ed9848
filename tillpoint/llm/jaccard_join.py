"""N-gram Jaccard join: rare-first prefix filtering with length, positional and
suffix filters, joined on prefix n-grams and verified once per pair.

1. *Order.*  A count sketch of fixed size over the shingles of all documents gives
   each shingle a rarity level.  Every document's distinct shingles are put in the
   order (level, hash): rare ones first, very common ones last.  Any fixed order
   gives a right result, so the sketch's error only costs time.
2. *Prefix.*  Sets of sizes n with Jaccard similarity t share a shingle among the
   first ``n - ceil(t n) + 1`` of both.  Prefix shingles that only one document has
   are dropped by a count and a semi-join on the shingle.
3. *Stars.*  In each group of documents with a common prefix shingle, every document
   is paired with one centre: the one in which the shingle comes first, which is the
   one with the fewest rare shingles of its own, so the text that the others were
   copied from.  One row per row, however large the group.
4. *Filters.*  A pair must pass the length filter, the positional filter (the
   shingles from the first shared one on bound the overlap) and the suffix filter (both
   sets are dealt over the same hash ranges; the sum of the smaller counts bounds the
   overlap).  Then its two texts are compared, once.
5. *Rest.*  The links found so far give labels, equal ones only to connected documents.
   Documents of a group that do not have the centre's label are paired with all others
   of the group with other labels, filtered and verified likewise.  So no link that
   matters is missed, and no pairs are made among documents of one label.

Texts are compared by 64-bit shingle hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpoint.llm import words as W
from tillpoint.llm.components import components, near_labels
from tillpoint.llm.io import bitmap, drop, giving_back, small_batches, stash

SKETCH_BITS = 22
CHUNK = 1 << 14
MASK_BITS = 23


def _sketch_rows(k: int, bits: int):
    def run(batches):
        total, held, size = np.zeros(1 << bits, np.uint32), [], 0

        def add():
            cell, n = np.unique(np.concatenate(held), return_counts=True)
            total[cell] += n.astype(np.uint32)

        for batch in batches:
            for sl in W.slices(batch.column(0)):
                for s in W.doc_shingles(sl, k):
                    held.append((s >> np.uint64(64 - bits)).astype(np.uint32))
                    size += len(s)
                if size > 1 << 20:
                    add()
                    held, size = [], 0
        if held:
            add()
        at = [c for c in range(0, 1 << bits, CHUNK) if total[c:c + CHUNK].any()]
        # more than 65535 in one task is common enough
        rows = [np.minimum(total[c:c + CHUNK], 65535).astype("<u2").tobytes() for c in at]
        for i in range(0, len(at), 32):
            yield pa.RecordBatch.from_arrays(
                [pa.array([c // CHUNK for c in at[i:i + 32]], pa.int32()), pa.array(rows[i:i + 32], pa.binary())],
                ["chunk", "counts"])
    return run


def _levels(batches):
    """Rarity levels of each chunk, from all tasks' counts."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for c, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held[c] = held.get(c, 0) + np.frombuffer(b, "<u2").astype(np.int64)
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(held), pa.int32()),
         pa.array([np.round(4 * np.log2(v + 1.0)).astype(np.uint8).tobytes() for v in held.values()], pa.binary())],
        ["chunk", "levels"])


def rarity(docs: DataFrame, k: int, text: str = "text", bits: int = SKETCH_BITS) -> np.ndarray:
    """Rarity level (four per doubling of the count) of each of ``2**bits`` hash cells.

    The sketch has a fixed size, so what comes to the driver and what is broadcast
    (``2**bits`` bytes) do not grow with the input."""
    part = docs.select(text).mapInArrow(giving_back(_sketch_rows(k, bits)), "chunk int, counts binary")
    out = np.zeros(1 << bits, np.uint8)
    for c, b in part.repartition("chunk").mapInArrow(giving_back(_levels), "chunk int, levels binary").collect():
        out[c * CHUNK:(c + 1) * CHUNK] = np.frombuffer(bytes(b), np.uint8)
    return out


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _prefix_rows(k: int, percent: int, level):
    def run(batches):
        table = level.value
        shift = np.uint64(64 - (len(table) - 1).bit_length())
        for batch in batches:
            for sl in W.slices(batch.column(1)):
                rows, sizes, keys, places = [], [], [], []
                for r, s in enumerate(W.doc_shingles(sl, k)):
                    if len(s):
                        p = prefix_length(len(s), percent)
                        order = np.argsort(table[(s >> shift).astype(np.int64)], kind="stable")[:p]
                        rows.append(np.full(p, sl.lo + r, np.int64))
                        sizes.append(np.full(p, len(s), np.int32))
                        keys.append(s[order])
                        places.append(np.arange(p, dtype=np.int32))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(keys).view(np.int64)),
                         batch.column(0).take(pa.array(np.concatenate(rows))),
                         pa.array(np.concatenate(places)), pa.array(np.concatenate(sizes))],
                        ["shingle", "id", "pos", "n"])
    return run


def _histogram(s: np.ndarray) -> bytes:
    """Counts over 2**b equal hash ranges, two to four shingles each on average."""
    bits = max(0, len(s).bit_length() - 2)
    at = (s >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(s), np.int64)
    counts = np.bincount(at, minlength=1 << bits)
    return b"" if counts.max(initial=0) > 255 else counts.astype(np.uint8).tobytes()


def overlap_bound(a: bytes, b: bytes) -> int:
    """The most shingles that two sets with these histograms can share."""
    if not a or not b:
        return 1 << 62
    x, y = np.frombuffer(a, np.uint8).astype(np.int64), np.frombuffer(b, np.uint8).astype(np.int64)
    n = min(len(x), len(y))
    return int(np.minimum(x.reshape(n, -1).sum(1), y.reshape(n, -1).sum(1)).sum())


def _involved_rows(k: int, mask):
    """Texts and histograms of the documents whose id may be in the mask."""
    def run(batches):
        bitmap = mask.value
        for batch in batches:
            keep = bitmap[batch.column(2).to_numpy(zero_copy_only=False) & ((1 << MASK_BITS) - 1)]
            if not keep.any():
                continue
            batch = batch.filter(pa.array(keep))
            hist, size = [], []
            for sl in W.slices(batch.column(1)):
                for s in W.doc_shingles(sl, k):
                    hist.append(_histogram(s))
                    size.append(len(s))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int32()), pa.array(hist, pa.binary()), batch.column(1)],
                ["id", "n", "hist", "text"])
    return run


def id_mask(ids: DataFrame, bits: int = MASK_BITS) -> np.ndarray:
    """Bitmap, of a fixed size, of the hashes of the ids in column ``id``."""
    return bitmap(ids.select(F.expr(f"xxhash64(id) & {(1 << bits) - 1}").alias("c")), bits)


def _suffix_filter(percent: int):
    def run(batches):
        for b in batches:
            need = [-(-percent * (n + m) // (100 + percent)) for n, m in zip(b.column("nx").to_pylist(), b.column("ny").to_pylist())]
            keep = [overlap_bound(x, y) >= w for x, y, w in zip(b.column("hx").to_pylist(), b.column("hy").to_pylist(), need)]
            yield b.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))
    return run


def _verify(k: int, percent: int):
    def run(batches):
        for b in batches:
            cut = (b.slice(i, 256) for i in range(0, b.num_rows, 256))
            for part in cut:
                left = [s for sl in W.slices(part.column("tx")) for s in W.doc_shingles(sl, k)]
                right = [s for sl in W.slices(part.column("ty")) for s in W.doc_shingles(sl, k)]
                keep = []
                for s, t in zip(left, right):
                    both = len(np.intersect1d(s, t, assume_unique=True))
                    keep.append(both > 0 and 100 * both >= percent * (len(s) + len(t) - both))
                yield part.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))
    return run


def _may_link(percent: int) -> str:
    """Length and positional filter for rows (pos, n) and (cpos, cn) of one shingle.

    The first shingle, in the common order, that two similar sets share leaves enough
    shingles behind it in both.  A shingle that does not is not their first, and another
    row stands for the pair if they are similar."""
    return (f"100 * least(n, cn) >= {percent} * greatest(n, cn) and "
            f"{100 + percent}L * least(n - pos, cn - cpos) >= {percent}L * (n + cn)")


def links(docs: DataFrame, k: int = 5, percent: int = 75, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Edges ``(u, v)``, u < v, of verified pairs: enough of them that two documents
    are connected exactly when a chain of similar pairs connects them.

    Documents without an id are left out; rows that repeat an id count as one
    document with several texts.  Empty input gives no edges."""
    with small_batches(docs.sparkSession):
        return _links(docs, k, percent, id, text)


def _links(docs: DataFrame, k: int, percent: int, id: str, text: str) -> DataFrame:
    spark = docs.sparkSession
    own = docs.where(F.col(id).isNotNull()).select(F.col(id).alias("id"), F.col(text).alias("text"))
    kind = own.schema["id"].dataType.simpleString()
    level = spark.sparkContext.broadcast(rarity(own, k))
    prefixes = lambda: own.mapInArrow(
        giving_back(_prefix_rows(k, percent, level)), f"shingle bigint, id {kind}, pos int, n int")
    shared = prefixes().groupBy("shingle").count().where("count > 1").select("shingle")
    rows, rows_at = stash(prefixes().join(shared.hint("shuffle_hash"), "shingle", "left_semi"), "prefix")

    centre = rows.groupBy("shingle").agg(F.min(F.struct("pos", "id", "n")).alias("c"))
    stars = (rows.join(centre.select("shingle", F.col("c.pos").alias("cpos"), F.col("c.id").alias("cid"),
                                     F.col("c.n").alias("cn")), "shingle")
             .where(f"id <> cid and {_may_link(percent)}"))
    tried, tried_at = stash(_pairs(stars), "pairs")
    found, _ = _checked(own, tried, k, percent, kind)

    label = near_labels(found)       # equal labels are connected; which is all that is needed here
    placed = (rows.join(label, rows["id"] == label["node"], "left")
              .select("shingle", "id", "pos", "n", F.coalesce("component", "id").alias("comp")))
    placed, placed_at = stash(placed, "placed")
    main = (placed.groupBy("shingle").agg(F.min(F.struct("pos", "id", "comp")).alias("c"),
                                          F.min("comp").alias("lo"), F.max("comp").alias("hi"))
            .where("lo <> hi").select("shingle", F.col("c.comp").alias("main")))
    rest = placed.join(main, "shingle")
    out = rest.where("comp <> main").select("shingle", F.col("pos").alias("cpos"), F.col("id").alias("cid"),
                                            F.col("n").alias("cn"), F.col("comp").alias("ccomp"))
    more = (rest.join(out, "shingle")
            .where(f"comp <> ccomp and (comp = main or id < cid) and id <> cid and {_may_link(percent)}"))
    fresh, fresh_at = stash(_pairs(more).join(tried, ["x", "y"], "left_anti"), "pairs")
    also, _ = _checked(own, fresh, k, percent, kind)
    drop(spark, rows_at, tried_at, placed_at, fresh_at)
    return found.union(also)


def _pairs(rows: DataFrame) -> DataFrame:
    return rows.select(F.least("id", "cid").alias("x"), F.greatest("id", "cid").alias("y")).distinct()


def _checked(own: DataFrame, pairs: DataFrame, k: int, percent: int, kind: str) -> tuple[DataFrame, str]:
    """The pairs that pass the suffix filter and the comparison of their texts, written."""
    spark = own.sparkSession
    ids = pairs.select(F.col("x").alias("id")).union(pairs.select("y"))
    mask = spark.sparkContext.broadcast(id_mask(ids))
    involved, involved_at = stash(own.select("id", "text", F.xxhash64("id").alias("h")).mapInArrow(
        giving_back(_involved_rows(k, mask)), f"id {kind}, n int, hist binary, text string"), "involved")
    side = lambda c, *cols: involved.select(F.col("id").alias(c), *(F.col(a).alias(b) for a, b in cols))
    close = (pairs.join(side("x", ("n", "nx"), ("hist", "hx")), "x").join(side("y", ("n", "ny"), ("hist", "hy")), "y")
             .mapInArrow(giving_back(_suffix_filter(percent)), f"x {kind}, y {kind}").distinct())
    equal = (close.join(side("x", ("text", "tx")), "x").join(side("y", ("text", "ty")), "y")
             .mapInArrow(giving_back(_verify(k, percent)), f"x {kind}, y {kind}").distinct()
             .select(F.col("x").alias("u"), F.col("y").alias("v")))
    out = stash(equal, "links")
    drop(spark, involved_at)
    return out


def members(docs: DataFrame, k: int = 5, percent: int = 75, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(node, component)`` of the documents that have a link."""
    return components(links(docs, k, percent, id, text))


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 75, id: str = "doc_id",
                       text: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id``.

    ``component_id`` is the least id reachable over links (Jaccard of the distinct
    ``k``-word shingle sets of at least ``percent`` in 100), its own id included.
    Null and empty texts have 0 shingles and stay alone.  A row without an id keeps a
    null component.  Rows that repeat an id are one document: they share a component.
    Other columns are ignored.  Empty input gives an empty result."""
    label = members(docs, k, percent, id, text)
    kind = docs.schema[id].dataType.simpleString()

    def sizes(batches):
        for b in batches:
            n = [len(s) for sl in W.slices(b.column(1)) for s in W.doc_shingles(sl, k)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["doc_id", "n_shingles"])

    base = docs.select(id, text).mapInArrow(giving_back(sizes), f"doc_id {kind}, n_shingles bigint")
    return (base.join(label, base["doc_id"] == label["node"], "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")))
