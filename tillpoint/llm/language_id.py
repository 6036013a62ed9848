"""Language identification by hyperdimensional profiles.

Every letter has a random vector of ``DIM`` entries of +1 and -1, drawn from its code
point by a hash, so all tasks know it.  An n-gram of letters is the product (binding) of its letters'
vectors, each rotated (permuted) by its distance from the n-gram's end; a text is the sum
(bundle) of its n-grams' vectors.  A language's prototype is the sum over its training
documents.  A document gets the language whose prototype makes the least angle with it.

Letters are lower-cased code points of the Unicode classes L and M; all else parts words,
and a run of it counts as one blank, which is a letter too.  N-grams with a blank in the
middle are left out: they tell of neighbouring words, not of a language's spelling.

Sums are whole numbers, so results depend neither on the order of rows nor on partitions.
What is collected is one vector per language, whatever the number of documents.

* A null text, and one without a letter (class L), gives ``und`` and score 0.
* Without any training document all languages are ``und``, with score 0.
* A null ``doc_id`` is never held out; repeated rows are learned from and returned each.
* Languages that tie go to the first by name.
* Empty tables give empty results; other columns of the table are ignored.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpoint.llm import words as W

#: Entries of a vector, letters of an n-gram.
DIM, N = 2048, 3
#: The remainder of crc32(id) by 4 that is held out.
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
#: Entries of a prototype that travel in one row.
CHUNK = 64
#: Cells of the table of n-grams by documents that a task holds at a time.
CELLS = 1 << 21
#: Bytes of a text that are counted at a time.
PIECE = 1 << 19


@lru_cache(1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its lower-case letter (0 where it is none), and whether it is of class L."""
    low = np.zeros(sys.maxunicode + 1, np.uint32)
    true = np.zeros(sys.maxunicode + 1, bool)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LM":
            low[c] = ord(chr(c).lower()[0])
            true[c] = kind == "L"
    return low, true


def letter_vectors(letters: np.ndarray, dim: int = DIM) -> np.ndarray:
    """Random vectors of +1 and -1, one row per letter: bits of splitmix64 over (letter, block)."""
    with np.errstate(over="ignore"):
        seeds = W.mix(letters.astype(np.uint64) + np.uint64(0x1D872B41))[:, None] + np.arange(1, dim // 64 + 1, dtype=np.uint64) * np.uint64(W._BASE)
    bits = np.unpackbits(W.mix(seeds).view(np.uint8).reshape(len(letters), -1), axis=1)
    return (bits.astype(np.int8) << 1) - 1


def ngram_vectors(grams: np.ndarray, letters: np.ndarray, dim: int = DIM) -> np.ndarray:
    """Bound vectors of n-grams given as rows of places in ``letters``."""
    own = letter_vectors(letters, dim)
    out = own[grams[:, -1]]
    for back in range(1, grams.shape[1]):
        out = out * np.roll(own, back, axis=1)[grams[:, -1 - back]]
    return out


class Grams:
    """N-grams of some texts: ``grams`` (distinct, as rows of places in ``letters``), and
    for each occurrence its text ``row`` and its n-gram ``which``; ``spoken`` says which
    texts have a letter."""

    def __init__(self, texts: list[np.ndarray], n: int = N):
        low, true = _letters()
        size = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        points = np.concatenate([*texts, np.zeros(0, np.uint32)])
        row = np.repeat(np.arange(len(texts)), size)
        self.spoken = np.bincount(row[true[points]], minlength=len(texts)) > 0
        # a blank before each text, one behind the last; runs of blanks become one
        at = np.arange(len(points)) + row + 1
        seq = np.zeros(len(points) + len(texts) + 1, np.uint32)
        owner = np.zeros(len(seq), np.int64)
        seq[at], owner[at] = low[points], row
        keep = seq > 0
        keep[1:] |= seq[:-1] > 0
        keep[:1] = True
        seq, owner = seq[keep], owner[keep]
        seen = np.zeros(sys.maxunicode + 1, bool)
        seen[seq] = True
        self.letters = np.flatnonzero(seen)
        place = np.zeros(sys.maxunicode + 1, np.int64)
        place[self.letters] = np.arange(len(self.letters))
        code = place[seq]
        m = max(0, len(seq) - n + 1)
        ok = np.ones(m, bool)
        for i in range(1, n - 1):
            ok &= seq[i:i + m] > 0
        key = np.zeros(m, np.int64)
        for i in range(n):
            key = key * len(self.letters) + code[i:i + m]
        # n >= 3: an n-gram with letters in its middle belongs to the text of its second letter
        key, self.row = key[ok], owner[1:1 + m][ok]
        cells = len(self.letters) ** n
        if cells <= 1 << 22:
            there = np.flatnonzero(np.bincount(key, minlength=cells))
            back = np.zeros(cells, np.int64)
            back[there] = np.arange(len(there))
            self.which = back[key]
        else:
            there, self.which = np.unique(key, return_inverse=True)
        self.grams = np.stack([there // len(self.letters) ** i % len(self.letters) for i in range(n - 1, -1, -1)], axis=1)

    def bundles(self, rows: np.ndarray, count: int, dim: int = DIM) -> np.ndarray:
        """Sums of n-gram vectors of each of ``count`` groups, ``rows`` giving an occurrence's
        group.  Sums are exact: a group has fewer than 2^24 n-grams."""
        out = np.zeros((count, dim), np.float32)
        k = len(self.grams)
        if not k:
            return out
        vectors = ngram_vectors(self.grams, self.letters, dim).astype(np.float32)
        order = np.argsort(rows, kind="stable") if np.any(rows[1:] < rows[:-1]) else None
        r, w = (rows, self.which) if order is None else (rows[order], self.which[order])
        step = max(1, CELLS // k)
        for lo in range(0, count, step):
            hi = min(count, lo + step)
            a, b = np.searchsorted(r, [lo, hi])
            table = np.bincount((r[a:b] - lo) * k + w[a:b], minlength=(hi - lo) * k).reshape(hi - lo, k)
            used = table.any(axis=0)
            out[lo:hi] = table[:, used].astype(np.float32) @ vectors[used]
        return out


def _points(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)


def _texts(column: pa.Array) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """``(rows, code points)`` of some texts at a time, about ``PIECE`` bytes.  A longer text
    comes in pieces cut behind white space, or, where there is none, anywhere between code points."""
    data, offsets = W.text_buffers(column)
    rows, texts, held = [], [], 0
    for r in range(len(column)):
        lo, end = int(offsets[r]), int(offsets[r + 1])
        while True:
            hi = min(end, lo + PIECE)
            if hi < end:
                gaps = np.flatnonzero(W._SPACE[data[lo:hi]])
                if len(gaps):
                    hi = lo + int(gaps[-1]) + 1
                else:
                    while data[hi] & 0xC0 == 0x80 and hi > lo + PIECE - 4:
                        hi -= 1
            rows.append(r)
            texts.append(_points(data[lo:hi].tobytes()))
            held += hi - lo
            lo = hi
            if held >= PIECE:
                yield np.array(rows), texts
                rows, texts, held = [], [], 0
            if lo >= end:
                break
    if rows:
        yield np.array(rows), texts


def _train_rows(batches):
    """Each language's sum of n-gram vectors in this task, in chunks."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        names, of = np.unique(np.array(batch.column(1).to_pylist(), dtype=object).astype(str), return_inverse=True)
        for rows, texts in _texts(batch.column(0)):
            grams = Grams(texts)
            got = grams.bundles(of[rows][grams.row], len(names))
            for i in np.unique(of[rows]):
                sums[names[i]] = sums.get(names[i], 0) + got[i].astype(np.int64)
    for name, total in sums.items():
        chunks = total.reshape(-1, CHUNK)
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * len(chunks)), pa.array(np.arange(len(chunks)), pa.int32()), pa.array(list(chunks), pa.list_(pa.int64()))],
            ["lang", "chunk", "v"])


def prototypes(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages, in order of name, and their prototypes as rows of length one.

    Tasks sum their documents; the sums of tasks are added by Spark in chunks of ``CHUNK``
    entries.  One row per language and chunk reaches the driver."""
    parts = docs.where(F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").isNotNull()).select(F.col(f"`{text}`"), F.col(f"`{lang}`")).mapInArrow(
        _train_rows, "lang string, chunk int, v array<bigint>")
    total = parts.groupBy("lang", "chunk").agg(*(F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(CHUNK)))
    got = total.orderBy("lang", "chunk").toPandas()
    names = sorted(got["lang"].unique())
    sums = got.drop(columns=["lang", "chunk"]).to_numpy(float).reshape(len(names), DIM)
    norm = np.sqrt((sums ** 2).sum(axis=1))
    names, sums, norm = [n for n, x in zip(names, norm) if x], sums[norm > 0], norm[norm > 0]
    return names, (sums / norm[:, None]).astype(np.float32)


def _predictor(names: list[str], spokes: np.ndarray, width: int):
    schema = None

    def rows(batches):
        nonlocal schema
        for batch in batches:
            n = batch.num_rows
            sums, spoken = {}, np.zeros(n, bool)
            best, score = np.full(n, -1), np.zeros(n)

            def settle(at, bundles):
                if not len(at) or not names:
                    return
                length = np.sqrt((bundles.astype(float) ** 2).sum(axis=1))
                cos = bundles.astype(float) @ spokes.T / np.maximum(length, 1)[:, None]
                best[at] = cos.argmax(axis=1)
                score[at] = np.clip(cos.max(axis=1), 0, 1)

            for at, texts in _texts(batch.column(width)):
                grams = Grams(texts)
                spoken[at[grams.spoken]] = True
                at, of = np.unique(at, return_inverse=True)
                got = grams.bundles(of[grams.row], len(at))
                for r in [r for r in sums if r < at[0]]:
                    settle(np.array([r]), sums.pop(r)[None])
                # the first may go on from the lot before, the last may go on in the next
                for i in {0, len(at) - 1}:
                    sums[at[i]] = sums.get(at[i], 0) + got[i].astype(np.float64)
                settle(at[1:-1], got[1:-1])
            for r, total in sums.items():
                settle(np.array([r]), total[None])
            best[~spoken], score[~spoken] = -1, 0
            lang = [names[b] if b >= 0 else UNKNOWN for b in best]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(width)), pa.array(lang, pa.string()), pa.array(score)],
                [*batch.schema.names[:width], "lang_pred", "score"])

    return rows


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and, for each row, ``lang_pred`` and ``score`` (the cosine, 0 where it is negative)."""
    kept = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(_predictor(*model, len(keep)), f"{fields}, lang_pred string, score double")


def languages(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document, with prototypes from the
    documents that aren't held out."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    tagged = docs.select("doc_id", F.coalesce(fold == HELD_OUT, F.lit(False)).alias("held_out"), "text", "lang")
    return predict(tagged, prototypes(tagged.where(~F.col("held_out"))), ["doc_id", "held_out"])
