"""Toxicity by class-conditional Kneser-Ney models.

Two models are counted, one on toxic and one on ordinary labelled documents.  A word's
probability is interpolated, with absolute discounting, over its orders: the whole word,
then its stems of 9, 7, 6, 5 and 4 bytes, then one for all.  The highest order counts tokens;
every lower order has continuation counts, as Kneser-Ney smoothing does: a stem counts the
distinct words of the class that begin with it, not their tokens, so a frequent word lends its
stem no more than a rare one.  What a class has not seen often
enough at an order is left to the order below, and how a lower order is shared out among
the higher one's expressions follows from the distinct words of both classes together.  So a
rare expression is as toxic as its stem, and one that is rare in all orders has the same
probability in both classes.  A document's score is the difference of its two
log-likelihoods, normalised by its length and by its root, and its most telling word, through
a logistic curve.

The models are fitted on a bounded sample: at most ``max_rows`` labelled documents of
each class and fold, those with the least hash of the id, so what reaches the driver and
what is broadcast does not grow with the input.  Every document is scored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpoint.llm import words as W
from tillpoint.llm.io import giving_back

#: Rows that are written at a time of a batch of whole documents.
ROWS = 512
#: Bound of the training sample, per class and fold.
MAX_ROWS = 4000
#: Bytes of a word's stems, longest first.
STEMS = (9, 7, 6, 5, 4)
DISCOUNT = 3.0
#: The remainder of crc32(id) by 5 that is held out; of the rest, one in so many ids is
#: kept from the counts to fit the curve on.
FOLDS, HELD_OUT, CALIBRATE = 5, 0, 6
_U = np.uint64
_ORDERS = ["word", *(f"stem{n}" for n in STEMS)]


def _expressions(sl: W.Slice) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of the slice's distinct words and of their stems, and each word's place
    among the distinct ones."""
    h = sl.hashes()
    word, at, of = np.unique(h, return_index=True, return_inverse=True)
    start, end = sl.start[at], sl.end[at]
    return [word, *(sl.hashes(start=start, end=np.minimum(start + n, end)) for n in STEMS)], of


def _count_rows(batches):
    """Counts by class of each distinct word, with its stems."""
    for batch in batches:
        toxic = batch.column(1).to_numpy(zero_copy_only=False)
        for sl in W.slices(batch.column(0), gaps=W.PUNCTUATION):
            if not len(sl.start):
                continue
            keys, of = _expressions(sl)
            bad = np.repeat(toxic[sl.lo:sl.hi], sl.counts()).astype(float)
            n = np.bincount(of, minlength=len(keys[0]))
            hit = np.bincount(of, weights=bad, minlength=len(keys[0])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(pa.array(k.view(np.int64)) for k in keys), pa.array(hit), pa.array(n - hit)],
                                             [*_ORDERS, "toxic", "ordinary"])


class Model:
    """Per order, sorted hashes with both classes' probabilities."""

    def __init__(self, keys: list[np.ndarray], counts: np.ndarray, discount: float = DISCOUNT):
        self.tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.spare = []
        # continuation counts: a stem counts the distinct words that it has in a class
        kinds = (counts > 0).astype(float)
        for order, k in enumerate(keys):     # from the word to its shortest stem
            weight = kinds if order else counts
            total = weight.sum(0)
            key, of = np.unique(k, return_inverse=True)
            n = np.stack([np.bincount(of, weights=weight[:, c], minlength=len(key)) for c in (0, 1)], 1)
            self.spare.append(np.where(total > 0, np.minimum(n, discount).sum(0) / np.maximum(total, 1.0), 1.0))
            self.tables.append((key, np.maximum(n - discount, 0) / np.maximum(total, 1.0), np.bincount(of, minlength=len(key)).astype(float)))
        self.all = float(len(counts))

    @staticmethod
    def _find(table: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(table, x), max(len(table) - 1, 0))
        return at, (table[at] == x) if len(table) else np.zeros(len(x), bool)

    def log_odds(self, keys: list[np.ndarray]) -> np.ndarray:
        """log P(word, toxic) - log P(word, ordinary) of words given with their stems."""
        if not self.all:
            return np.zeros(len(keys[0]))
        above = np.full(len(keys[0]), self.all + 1)
        p = np.ones((len(keys[0]), 2))
        for (table, own, n), spare, k in list(zip(self.tables, self.spare, keys))[::-1]:
            at, known = self._find(table, k)
            here = np.where(known, n[at], 1.0)
            # shared: the expression's part of the order below, over both classes
            p = np.where(known[:, None], own[at], 0.0) + spare * p * np.minimum(here / above, 1.0)[:, None]
            above = here + 1
        return np.log(p[:, 0]) - np.log(p[:, 1])


def features(model: Model, column: pa.Array) -> np.ndarray:
    """Per text: mean log-odds of its words, their sum over the root of its length, the
    highest, and 1.  Without words the first three are 0."""
    out = np.zeros((len(column), 4))
    out[:, 3] = 1
    for sl in W.slices(column, gaps=W.PUNCTUATION):
        if not len(sl.start):
            continue
        keys, of = _expressions(sl)
        odds = model.log_odds(keys)[of]
        n = sl.counts()
        rows = np.flatnonzero(n)
        total = np.add.reduceat(odds, sl.first[rows])
        out[sl.lo + rows, 0] = total / n[rows]
        out[sl.lo + rows, 1] = total / np.sqrt(n[rows])
        out[sl.lo + rows, 2] = np.maximum.reduceat(odds, sl.first[rows])
    return out


def _sigmoid(m: np.ndarray) -> np.ndarray:
    return np.exp(-np.logaddexp(0, -m))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 200) -> np.ndarray:
    """Weights of a logistic curve by Newton's method on scaled columns.  A step is halved
    until it lowers the penalised loss: on classes that are almost apart a full step
    overshoots, and the method would never settle."""
    scale = np.maximum(x.std(0), 1e-9)
    scale[-1] = 1.0
    z, w = x / scale, np.zeros(x.shape[1])

    def loss(w):
        m = z @ w
        return (np.logaddexp(0, m) - y * m).sum() + ridge / 2 * w @ w

    now = loss(w)
    for _ in range(rounds):
        p = _sigmoid(z @ w)
        grad = z.T @ (y - p) - ridge * w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), grad)
        size = 1.0
        while size > 1e-10 and loss(w + size * step) > now - 1e-4 * size * (grad @ step):
            size /= 2
        if size <= 1e-10 or grad @ step < 1e-9:
            break
        w += size * step
        now = loss(w)
    return w / scale


def curve(model: Model, weights: np.ndarray, column: pa.Array) -> np.ndarray:
    """Scores of texts, between 0 and 1."""
    return _sigmoid(features(model, column) @ weights)


def _crc(c):
    return F.crc32(c.cast("string").cast("binary"))


def _held_out(c):
    return F.coalesce(_crc(c) % FOLDS == HELD_OUT, F.lit(False))


def _sample(labels: DataFrame, id: str, label: str, calibrate: bool, max_rows: int) -> DataFrame:
    """At most ``max_rows`` ids of each class outside the held-out fold, those of least hash."""
    one = labels.where(F.col(id).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(id).alias("_id")).agg(F.max(label).alias("_y"))
    part = F.floor(_crc(F.col("_id")) / FOLDS) % CALIBRATE == 0
    folded = one.where(~_held_out(F.col("_id")) & (part if calibrate else ~part)).withColumn("_h", F.xxhash64("_id"))
    return folded.where("_y = 1").orderBy("_h", "_id").limit(max_rows).union(
        folded.where("_y = 0").orderBy("_h", "_id").limit(max_rows)).select("_id", "_y")


def train(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic",
          max_rows: int = MAX_ROWS) -> tuple[Model, np.ndarray]:
    """The models and the logistic weights, from labelled rows outside the held-out fold.

    A document with several labels counts as toxic when one says so; labels other than
    0 and 1, null ids and labels without a document are left out.  Without documents of
    both classes the score is near the share of toxic ones (a quarter when none is labelled)."""
    def of(calibrate):
        chosen = F.broadcast(_sample(labels, id, label, calibrate, max_rows))   # 2 * max_rows ids at most
        return docs.select(id, text).join(chosen, F.col(id) == F.col("_id")).select(text, F.col("_y").cast("int").alias("y"))

    grams = (of(False)
             .mapInArrow(giving_back(_count_rows), ", ".join(f"{c} bigint" for c in [*_ORDERS, "toxic", "ordinary"]))
             .groupBy(*_ORDERS).agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")).toArrow())
    model = Model([grams.column(c).to_numpy().view(_U) for c in _ORDERS],
                  np.stack([grams.column(c).to_numpy() for c in ("toxic", "ordinary")], 1))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches):
        for b in batches:
            x = features(shared.value, b.column(0))
            yield pa.RecordBatch.from_arrays([*(pa.array(x[:, i]) for i in range(3)), b.column(1)], ["a", "b", "c", "y"])

    seen = of(True).mapInArrow(giving_back(rows), "a double, b double, c double, y int").toArrow()
    y = seen.column("y").to_numpy().astype(float)
    x = np.stack([*(seen.column(c).to_numpy() for c in "abc"), np.ones(len(y))], 1)
    if 0 < y.sum() < len(y):
        return model, fit_logistic(x, y)
    share = (y.sum() + 0.5) / (len(y) + 2)
    return model, np.array([1.0, 0.0, 0.0, np.log(share / (1 - share))])


def score(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic",
          max_rows: int = MAX_ROWS) -> DataFrame:
    """One row per input row: ``doc_id, held_out, score`` (0 to 1) and ``predicted``.

    Null and empty texts get the curve's value at even odds.  Rows without an id are
    scored, with ``held_out`` false.  Ids may repeat; columns other than id and text are
    never read.  Empty input gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id, text, label, max_rows))
    kind = docs.schema[id].dataType.simpleString()

    def rows(batches):
        for b in batches:
            s = curve(*shared.value, b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(s), pa.array((s >= 0.5).astype(np.int32))],
                                             ["doc_id", "held_out", "score", "predicted"])

    return (docs.select(id, text, _held_out(F.col(id)).alias("_out"))
            .mapInArrow(giving_back(rows), f"doc_id {kind}, held_out boolean, score double, predicted int"))


def keep_ordinary(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic",
                  max_rows: int = MAX_ROWS) -> DataFrame:
    """``docs``, with all its columns, without the rows whose text scores 0.5 or more."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id, text, label, max_rows))

    def rows(batches):
        for b in batches:
            keep = pa.array(curve(*shared.value, b.column(text)) < 0.5, pa.bool_())
            for i in range(0, b.num_rows, ROWS):       # no second copy of the whole batch
                yield b.slice(i, ROWS).filter(keep.slice(i, ROWS))

    return docs.mapInArrow(giving_back(rows), docs.schema)
