"""Language-model scores of a hashed maximum-entropy model.

A token's probability is that of its class, given the tokens before it, times its own
within the class.  The most frequent words and the end of a text are classes of their
own; all other words fall into ``BUCKETS`` classes by their first two bytes.  The class
is a softmax over hashed features of the history: the last word, the one before it
(skipping one), the one before that (skipping two) and the last two together.  A word
within a bucket has its smoothed share of the bucket's training tokens.

*Counts* of all training tokens are one distributed aggregation.  *Training* is
distributed: each learner takes the weights, updates them by gradient steps over its
partition's documents, and sends back its change; the changes are averaged and the next
round starts.  Every training document is used in one round, at all its places.
*Scoring* runs over whole texts in numpy blocks.
Counts of the ``KNOWN`` most frequent words are broadcast (a bound, whatever the corpus);
the other words' counts come from a join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpoint.llm import words as W
from tillpoint.llm.io import stash

FOLDS, HELD_OUT = 5, 1
SINGLES, BUCKETS = 64, 32
CLASSES = SINGLES + BUCKETS
#: Rows of the weight table; words that are told apart in a history; words whose count is broadcast.
FEATURES, HISTORY, KNOWN = 1 << 13, 1 << 11, 1 << 18
ROUNDS, BATCH, RATE = 2, 4096, 0.3
BLOCK = 8192
CHUNK = 256
#: Rows of a run that are added with those of other runs; numpy adds up to 8 in a row one by one.
SHORT_RUN = 8
_U = np.uint64
_START = HISTORY + BUCKETS
_END_WORD = _U(0xE4D0F7E87)     # stands for the end of a text


def _bucket(sl: W.Slice) -> np.ndarray:
    """Class by the first two bytes of each word (A-Z in lower case)."""
    if not len(sl.start):
        return np.zeros(0, np.int64)
    a = W.LOWER[sl.data[sl.start]].astype(np.int64)
    b = W.LOWER[sl.data[np.minimum(sl.start + 1, sl.end - 1)]].astype(np.int64)
    return (a * 37 + b * 11) % BUCKETS


def _counted(hashes: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    word, at, n = np.unique(hashes, return_index=True, return_counts=True)
    return word, buckets[at], n


def _count_rows(batches):
    """Counts of each word, combined in the task before they are sent."""
    held: list[tuple] = []

    def merge():
        word, bucket, n = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(word, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], word[order][1:] != word[order][:-1]]))
        return word[order][first], bucket[order][first], np.add.reduceat(n[order], first)

    def batch_of(word, bucket, n):
        return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(bucket.astype(np.int32)),
                                           pa.array(n.astype(np.int64))], ["word", "bucket", "n"])

    docs = 0
    for batch in batches:
        docs += batch.num_rows
        for sl in W.slices(batch.column(0)):
            if len(sl.start):
                held.append(_counted(sl.hashes(), _bucket(sl)))
            if sum(len(h[0]) for h in held) > 1 << 20:
                held = [merge()]
                if len(held[0][0]) > 1 << 19:       # bounded memory, whatever the task's input
                    yield batch_of(*held[0])
                    held = []
    if held:
        yield batch_of(*merge())
    if docs:
        yield batch_of(np.array([_END_WORD]), np.array([-1]), np.array([docs]))


class Model:
    """What every scoring task needs; of a bounded size."""

    def __init__(self, word, bucket, n, tokens: int, types: int, bucket_n, bucket_types, end_n: int):
        order = np.argsort(-n, kind="stable")
        word, bucket, n = word[order], bucket[order], n[order]
        self.tokens, self.types, self.end_n = tokens, types, end_n
        rank = np.arange(len(word))
        cls = np.where(rank < SINGLES - 1, rank, SINGLES + bucket)
        past = np.where(rank < HISTORY, rank, HISTORY + bucket)
        by = np.argsort(word)
        self.word, self.n = word[by], n[by]
        self.cls, self.past = cls[by].astype(np.int64), past[by].astype(np.int64)
        single = rank < SINGLES - 1
        # tokens and types of each bucket without its words that are classes of their own
        self.bucket_n = bucket_n - np.bincount(bucket[single], weights=n[single], minlength=BUCKETS)
        self.bucket_types = bucket_types - np.bincount(bucket[single], minlength=BUCKETS)
        self.bucket_log = np.log10(self.bucket_n + 0.5 * (self.bucket_types + 1))
        start = np.full(CLASSES, 0.5)
        start[:min(SINGLES - 1, len(n))] += n[:SINGLES - 1]
        start[SINGLES - 1] += end_n
        start[SINGLES:] += self.bucket_n
        self.bias = np.log(start / start.sum()).astype(np.float32)
        self.base_log = np.log10(tokens + 0.5 * (types + 1))
        self.weights = np.zeros((FEATURES, CLASSES), np.float32)

    def tokens_of(self, sl: W.Slice) -> dict[str, np.ndarray]:
        """The slice's tokens, each text's end included: class, features, count (-1: not
        among the known words) and the first token of each row."""
        h, bucket = sl.hashes(), _bucket(sl)
        at = np.minimum(np.searchsorted(self.word, h), max(len(self.word) - 1, 0))
        known = (self.word[at] == h) if len(self.word) else np.zeros(len(h), bool)
        at = np.where(known, at, 0)
        pick = lambda a, other: np.where(known, a[at], other) if len(self.word) else other
        rows = sl.hi - sl.lo
        total = len(h) + rows
        first = sl.first + np.arange(rows + 1)
        is_word = np.ones(total, bool)
        is_word[first[1:] - 1] = False
        out = {"first": first, "is_word": is_word, "word": h}
        cls = np.full(total, SINGLES - 1)
        cls[is_word] = pick(self.cls, SINGLES + bucket)
        count = np.full(total, self.end_n)
        count[is_word] = pick(self.n, -1)
        past = np.full(total, _START)
        past[is_word] = pick(self.past, HISTORY + bucket)
        place = np.arange(total) - np.repeat(first[:-1], np.diff(first))
        before = []
        for back in (1, 2, 3):
            p = np.full(total, _START)
            p[back:] = past[:-back]
            p[place < back] = _START
            before.append(p.astype(_U))
        a, b, c = before
        with np.errstate(over="ignore"):
            keys = (a * _U(8) + _U(1), b * _U(8) + _U(2), c * _U(8) + _U(3), ((a << _U(20)) + b) * _U(8) + _U(4))
        out["features"] = np.stack([(W.mix(k) & _U(FEATURES - 1)).astype(np.int32) for k in keys], 1)
        return out | {"cls": cls, "count": count}

    def class_log(self, features: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """log10 P(class | history), block by block."""
        out = np.empty(len(cls))
        for lo in range(0, len(cls), BLOCK):
            f = features[lo:lo + BLOCK]
            z = np.take(self.weights, f[:, 0], axis=0)
            for j in range(1, f.shape[1]):
                z += np.take(self.weights, f[:, j], axis=0)
            z += self.bias
            own = z[np.arange(len(f)), cls[lo:lo + BLOCK]].astype(float)
            top = z.max(1)
            z -= top[:, None]
            np.exp(z, out=z)
            out[lo:lo + BLOCK] = own - top - np.log(z.sum(1, dtype=float))
        return out / np.log(10)


def _run_sums(z: np.ndarray, rows: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of ``z[rows]`` over the runs that begin at ``cut``, long runs first, and the
    runs' numbers in that order.

    The same sums, to the bit, as by ``np.add.reduceat``, which adds each run's later rows
    to its first; but the k-th rows of all short runs at once and each long run by itself."""
    size = np.diff(np.append(cut, len(rows)))
    by = np.argsort(-size, kind="stable")
    size, start = size[by], cut[by]
    out = np.take(z, rows[start], axis=0)
    long, two = (int(np.count_nonzero(size > k)) for k in (SHORT_RUN, 1))
    for i in range(long):
        out[i] += np.ascontiguousarray(np.take(z, rows[start[i] + 1:start[i] + size[i]], axis=0).T).sum(1)
    if two > long:
        later = np.take(z, rows[start[long:two] + 1], axis=0)
        for k in range(2, SHORT_RUN):
            more = int(np.count_nonzero(size > k))
            later[:max(more - long, 0)] += np.take(z, rows[start[long:more] + k], axis=0)
        out[long:two] += later
    return out, by


def _learn(model):
    """Gradient steps over a partition's documents; the change of the weights, by chunk."""
    def run(batches):
        m = model.value
        weights, seen = m.weights.copy(), np.full(FEATURES, 1e-3, np.float32)
        held: list[tuple] = []
        steps = 0

        def step(features, cls):
            z = np.take(weights, features[:, 0], axis=0)
            for j in range(1, features.shape[1]):
                z += np.take(weights, features[:, j], axis=0)
            z += m.bias
            z -= z.max(1)[:, None]
            np.exp(z, out=z)
            z /= z.sum(1)[:, None]
            z[np.arange(len(cls)), cls] -= 1
            flat = features.T.ravel().astype(np.uint16)      # numbers of 16 bits are sorted by radix
            order = np.argsort(flat, kind="stable")
            cut = np.flatnonzero(np.concatenate([[True], flat[order][1:] != flat[order][:-1]]))
            grad, by = _run_sums(z, order % len(cls), cut)
            row = flat[order][cut][by]
            seen[row] += (grad * grad).sum(1)
            weights[row] -= (RATE / np.sqrt(seen[row]))[:, None] * grad

        for batch in batches:
            for sl in W.slices(batch.column(0)):
                t = m.tokens_of(sl)
                held.append((t["features"], t["cls"]))
                steps += 1
                if sum(len(c) for _, c in held) >= BATCH:
                    features, cls = (np.concatenate(x) for x in zip(*held))
                    for lo in range(0, len(cls), BATCH):
                        step(features[lo:lo + BATCH], cls[lo:lo + BATCH])
                    held = []
        if held:
            step(*(np.concatenate(x) for x in zip(*held)))
        if steps:
            change = weights - m.weights
            at = [c for c in range(0, FEATURES, CHUNK) if change[c:c + CHUNK].any()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(at, pa.int32()), pa.array([change[c:c + CHUNK].tobytes() for c in at], pa.binary())], ["chunk", "change"])
    return run


def _average(batches):
    """Mean change of each chunk over the learners that changed its rows."""
    total: dict[int, np.ndarray] = {}
    learners: dict[int, np.ndarray] = {}
    for b in batches:
        for c, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x = np.frombuffer(raw, np.float32).reshape(CHUNK, CLASSES)
            total[c] = total.get(c, 0) + x
            learners[c] = learners.get(c, 0) + (x != 0).any(1)
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(total), pa.int32()),
         pa.array([(total[c] / np.maximum(learners[c], 1)[:, None]).astype(np.float32).tobytes() for c in total], pa.binary())],
        ["chunk", "change"])


def train(docs: DataFrame, text: str) -> tuple[Model, DataFrame, str]:
    """The model of the given documents, all words' counts, and where these are kept."""
    spark = docs.sparkSession
    counts, counts_at = stash(
        docs.select(text).mapInArrow(_count_rows, "word bigint, bucket int, n bigint")
        .groupBy("word").agg(F.sum("n").alias("n"), F.max("bucket").alias("bucket")), "counts")
    words = counts.where("bucket >= 0")
    size = F.floor(F.log2("n") * 16)
    per = words.groupBy(size.alias("size"), "bucket").agg(F.count("*").alias("types"), F.sum("n").alias("n")).collect()
    end_n = sum(r["n"] for r in counts.where("bucket < 0").collect())
    least, kept = 0, 0
    for s in sorted({r["size"] for r in per}, reverse=True):     # as many sizes as fit in KNOWN words
        kept += sum(r["types"] for r in per if r["size"] == s)
        if kept > KNOWN:
            least = s + 1
            break
    bucket_n, bucket_types = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in per:
        bucket_n[r["bucket"]] += r["n"]
        bucket_types[r["bucket"]] += r["types"]
    top = words.where(size >= least).select("word", "bucket", "n").toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    model = Model(top.column("word").to_numpy().view(_U), top.column("bucket").to_numpy().astype(np.int64), top.column("n").to_numpy(),
                  int(bucket_n.sum()) + end_n, int(bucket_types.sum()) + (end_n > 0), bucket_n, bucket_types, end_n)
    learners = 2 * spark.sparkContext.defaultParallelism
    for r in range(ROUNDS):
        shared = spark.sparkContext.broadcast(model)
        part = docs.where(F.pmod(F.xxhash64(text), F.lit(ROUNDS)) == r).select(text).coalesce(learners)
        change = (part.mapInArrow(_learn(shared), "chunk int, change binary")
                  .repartition("chunk").mapInArrow(_average, "chunk int, change binary"))
        for c, raw in change.toLocalIterator():
            model.weights[c:c + CHUNK] += np.frombuffer(bytes(raw), np.float32).reshape(CHUNK, CLASSES)
    return model, counts, counts_at


def _score_rows(model):
    def run(batches):
        m = model.value
        for batch in batches:
            n_tokens, n_known, base, score, rare = ([] for _ in range(5))
            for sl in W.slices(batch.column(1)):
                t = m.tokens_of(sl)
                first, cls, count = t["first"], t["cls"], t["count"]
                known = count >= 0
                one = np.log10(np.maximum(count, 0) + 0.5)
                p = m.class_log(t["features"], cls)
                bucket = cls >= SINGLES
                p[bucket] -= m.bucket_log[cls[bucket] - SINGLES]
                p[bucket & known] += one[bucket & known]
                rows = first[:-1]
                n_tokens.append(np.diff(first))
                n_known.append(np.add.reduceat((count > 0).astype(np.int64), rows))
                base.append(np.add.reduceat(np.where(known, one, 0.0) - m.base_log, rows))
                score.append(np.add.reduceat(p, rows))
                left = np.flatnonzero(~known)
                word_no = np.cumsum(t["is_word"]) - 1
                cut = np.searchsorted(left, first)
                hashes = t["word"][word_no[left]].view(np.int64)
                rare += [hashes[a:b] for a, b in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), *(pa.array(np.concatenate(x)) for x in (n_tokens, n_known, base, score)),
                 pa.array(rare, pa.list_(pa.int64()))],
                ["doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rare"])
    return run


def score(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score`` (add-half unigram, log10) and ``score`` (the model's log10 probability).

    A null or empty text has one token, its end.  Rows without an id are trained on.
    Ids may repeat: each row is scored.  Other columns are ignored.  Without training
    documents all classes are alike.  Empty input gives no rows."""
    spark = docs.sparkSession
    kind = docs.schema[id].dataType.simpleString()
    out = F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))
    own = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), out.alias("held_out"))
    model, counts, _ = train(own.where("not held_out"), "text")
    shared = spark.sparkContext.broadcast(model)
    fields = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base double, score double, rare array<bigint>"
    rows, _ = stash(own.select("id", "text", "held_out").mapInArrow(_score_rows(shared), fields)
                    .withColumn("row", F.monotonically_increasing_id()), "scores")
    rare = rows.select("row", F.explode("rare").alias("word"))
    # words without a count are in no training text; half a token each, added without a join
    got = (rare.join(counts.where("bucket >= 0").select("word", "n"), "word")
           .groupBy("row").agg(F.count("*").alias("found"), F.sum(F.log10(F.col("n") + 0.5)).alias("more")))
    done = rows.select("*", F.size("rare").alias("n_rare")).drop("rare").join(got, "row", "left")
    more = F.coalesce("more", F.lit(0.0)) + (F.col("n_rare") - F.coalesce("found", F.lit(0))) * F.log10(F.lit(0.5))
    return done.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("found", F.lit(0))).alias("n_known"),
                       F.lit(model.tokens).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"),
                       (F.col("score") + more).alias("score"))
