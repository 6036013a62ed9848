"""Benchmark decontamination by spaced-seed hashing.

A mask names the word positions that count; the words between them may differ.  Each
text and each benchmark item is hashed under every mask at every word.  Hashes of the
items set bits in a bitmap of fixed size, three bits each, so only documents with a
possible hit leave their task; these hits are joined with the items' hashes.  Around each hit the item is
laid on the document and the words are compared: the document is contaminated when
some ``WINDOW`` words in a row of the item (all of them, in a shorter item) have at
least ``EQUAL`` percent in their places.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpoint.llm import words as W
from tillpoint.llm.io import bitmap, stash

#: Fixed masks of weight 6: word positions that must agree.
MASKS = ((0, 1, 2, 3, 4, 5), (0, 1, 3, 4, 6, 7), (0, 2, 3, 5, 6, 8), (0, 1, 2, 6, 7, 8), (0, 1, 4, 5, 8, 9))
#: The bitmap has ``2**MASK_BITS`` bits; a hash sets the bits that these parts of it number.
MASK_BITS, PARTS = 24, (0, 20, 40)
WINDOW, EQUAL = 13, 80


def seeds(h: np.ndarray, masks=MASKS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each mask its hashes at every place of ``h``; a mask's number is hashed in."""
    with np.errstate(over="ignore"):
        return [W.mix(W.rolling(h, m[-1] + 1, m) + np.uint64(i + 1)) for i, m in enumerate(masks)]


def _hash_rows(masks, mask=None, bits: int = MASK_BITS):
    """``(text's own column, hits, words)`` of each text; with a mask only hits whose bit
    is set, and only texts that have one."""
    def run(batches):
        table = None if mask is None else mask.value
        cell = np.uint64((1 << bits) - 1)
        for batch in batches:
            for sl in W.slices(batch.column(1)):
                h = sl.hashes()
                places, keys = [], []
                for m, s in zip(masks, seeds(h, masks)):
                    at = np.arange(len(s))
                    for part in () if table is None else PARTS:      # all of a hash's bits must be set
                        at = at[table[((s[at] >> np.uint64(part)) & cell).astype(np.int64)]]
                    if len(at):            # a hit's words must lie in one text
                        row = np.searchsorted(sl.first, at, side="right") - 1
                        at = at[at + m[-1] < sl.first[row + 1]]
                        places.append(at)
                        keys.append(s[at])
                at = np.concatenate([*places, np.zeros(0, np.int64)]).astype(np.int64)
                key = np.concatenate([*keys, np.zeros(0, np.uint64)])
                order = np.argsort(at, kind="stable")
                at, key = at[order], key[order]
                cut = np.searchsorted(at, sl.first)
                rows = np.flatnonzero(np.diff(cut))
                if not len(rows):
                    continue
                row_of = np.searchsorted(sl.first, at, side="right") - 1
                hits = pa.StructArray.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array((at - sl.first[row_of]).astype(np.int32))], ["h", "pos"])
                lists = pa.ListArray.from_arrays(pa.array(np.append(cut[rows], cut[-1]).astype(np.int32)), hits)
                words = [h[sl.first[r]:sl.first[r + 1]].tobytes() for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(sl.lo + rows)), lists, pa.array(words, pa.binary())],
                    ["id", "hits", "words"])
    return run


def overlap(doc: np.ndarray, item: np.ndarray, shift: int, window: int, equal: int) -> tuple[int, int, int] | None:
    """``(first place in doc, words of the item that lie on doc, equal words)`` when the
    item laid at ``shift`` agrees well enough somewhere, else None."""
    a, b = max(0, -shift), min(len(item), len(doc) - shift)
    size = min(window, len(item))
    if b - a < size:
        return None
    same = doc[a + shift:b + shift] == item[a:b]
    total = np.concatenate([[0], np.cumsum(same)])
    if 100 * int((total[size:] - total[:-size]).max()) < equal * size:
        return None
    return a + shift, b - a, int(total[-1])


def _verify(window: int, equal: int):
    def run(batches):
        for batch in batches:
            keep, out = [], []
            for i, (d, w, s) in enumerate(zip(*(batch.column(n).to_pylist() for n in ("words", "iwords", "shift")))):
                got = overlap(np.frombuffer(d, np.uint64), np.frombuffer(w, np.uint64), s, window, equal)
                if got:
                    keep.append(i)
                    out.append((*got, len(w) // 8))
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(keep, pa.int64())), batch.column("item").take(pa.array(keep, pa.int64())),
                 *(pa.array([int(v) for v in c], pa.int32()) for c in cols)],
                ["doc_id", "item_id", "start_word", "overlap_words", "equal_words", "item_words"])
    return run


def contaminated(docs: DataFrame, bench: DataFrame, masks=MASKS, window: int = WINDOW, equal: int = EQUAL,
                 id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and benchmark item that the document holds a passage of:
    the overlap with the most equal words (then the first), in words.

    Words are compared in lower case (of all scripts).  Null and empty texts on either side and
    items shorter than the shortest mask (six words) match nothing.  Ids may be null or
    repeat: each row is compared, and rows of equal ids give one result.  Extra columns
    are ignored.  Either table may be empty."""
    spark = docs.sparkSession
    kind, item_kind = docs.schema[id].dataType.simpleString(), bench.schema[item].dataType.simpleString()
    fields = "hits array<struct<h: bigint, pos: int>>, words binary"
    items, _ = stash(bench.select(F.col(item).alias("id"), F.lower(item_text).alias("text"))
                     .mapInArrow(_hash_rows(masks), f"id {item_kind}, {fields}")
                     .withColumn("item_row", F.monotonically_increasing_id()), "items")
    item_seeds = items.select("item_row", F.explode("hits").alias("s")).select("item_row", "s.h", F.col("s.pos").alias("ipos"))
    cells = F.array(*(F.shiftrightunsigned("h", p).bitwiseAND(F.lit((1 << MASK_BITS) - 1)) for p in PARTS))
    table = spark.sparkContext.broadcast(bitmap(item_seeds.select(F.explode(cells).alias("c")), MASK_BITS))
    found, _ = stash(docs.select(F.col(id).alias("id"), F.lower(text).alias("text"))
                     .mapInArrow(_hash_rows(masks, table), f"id {kind}, {fields}")
                     .withColumn("doc_row", F.monotonically_increasing_id()), "hits")
    hits = found.select("doc_row", F.explode("hits").alias("s")).select("doc_row", "s.h", "s.pos")
    laid = (hits.join(item_seeds, "h").select("doc_row", "item_row", (F.col("pos") - F.col("ipos")).alias("shift"))
            .distinct())
    both = (laid.join(found.select("doc_row", "id", "words"), "doc_row")
            .join(items.select("item_row", F.col("id").alias("item"), F.col("words").alias("iwords")), "item_row"))
    rows = both.mapInArrow(
        _verify(window, equal),
        f"doc_id {kind}, item_id {item_kind}, start_word int, overlap_words int, equal_words int, item_words int")
    best = F.min(F.struct((-F.col("equal_words")).alias("worst"), "start_word", "overlap_words", "equal_words", "item_words"))
    return (rows.groupBy("doc_id", "item_id").agg(best.alias("b"))
            .select("doc_id", "item_id", "b.start_word", "b.overlap_words", "b.equal_words", "b.item_words"))


def remove_contaminated(docs: DataFrame, found: DataFrame, id: str = "doc_id") -> DataFrame:
    """``docs`` without those named in ``found``; documents without an id stay."""
    return docs.join(found.select(F.col("doc_id").alias("_gone")).distinct(), docs[id] == F.col("_gone"), "left_anti")
