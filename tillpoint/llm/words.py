"""Words and shingles of whole texts as numpy arrays, straight from Arrow buffers.

A word is a maximal run of bytes other than the ASCII white space characters
(space, tab, LF, VT, FF, CR), which in UTF-8 is the same as ``[^\\x20\\x09-\\x0D]+``
on code points.  Hashes are 64-bit; two different words or shingles are taken as
equal only when their 64-bit hashes collide.

Every function works on one slice of an Arrow batch at a time, so a task needs
memory for ``SLICE_BYTES`` of text (or for its longest single text), not for the
batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: White space and ASCII punctuation: words as runs of letters, digits and non-ASCII bytes.
PUNCTUATION = _SPACE.copy()
PUNCTUATION[[b for b in range(128) if not chr(b).isalnum()]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64 (public domain): every input bit reaches every output bit."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_TABLE = mix(np.arange(1, 257, dtype=_U) * _U(_BASE))
_TABLE_LOWER = _TABLE[LOWER]
_COEF = mix(np.arange(1001, 1065, dtype=_U) * _U(_BASE)) | _U(1)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, _U), np.ones(1, _U))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n (kept, grown by doubling)."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        inverse = pow(_BASE, -1, 1 << 64)
        with np.errstate(over="ignore"):
            _powers = tuple(np.cumprod(np.concatenate([np.ones(1, _U), np.full(size - 1, b, _U)]))
                            for b in (_BASE, inverse))
    return _powers


class Slice:
    """Words of the rows ``lo:hi`` of a batch.

    ``start``/``end`` are byte positions in ``data``; words of row ``lo + r`` are
    ``first[r]:first[r + 1]``; ``offsets[r]`` is where the row's text begins."""

    __slots__ = ("_runs", "data", "end", "first", "hi", "lo", "offsets", "start")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lo: int, hi: int, gaps: np.ndarray = _SPACE):
        self.lo, self.hi, self._runs = lo, hi, {}
        base = int(offsets[lo])
        self.offsets = (offsets[lo:hi + 1] - base).astype(np.int64)
        self.data = data[base:int(offsets[hi])]
        ink = ~gaps[self.data]
        n = len(ink)
        if n:
            opens = ink.copy()
            opens[1:] &= ~ink[:-1]
            cuts = self.offsets[:-1]
            cuts = cuts[cuts < n]
            opens[cuts] = ink[cuts]          # a text's first byte may open a word
            closes = ink.copy()
            closes[:-1] &= ~ink[1:] | opens[1:]
            self.start = np.flatnonzero(opens)
            self.end = np.flatnonzero(closes) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.first = np.searchsorted(self.start, self.offsets)

    def hashes(self, lower: bool = True, start: np.ndarray | None = None,
               end: np.ndarray | None = None) -> np.ndarray:
        """64-bit hash of each word (or of the given byte ranges)."""
        start = self.start if start is None else start
        end = self.end if end is None else end
        n = len(self.data)
        up, down = _power_tables(n + 1)
        with np.errstate(over="ignore"):
            run = self._runs.get(lower)
            if run is None:
                run = self._runs[lower] = np.zeros(n + 1, _U)
                np.cumsum((_TABLE_LOWER if lower else _TABLE)[self.data] * up[:n], out=run[1:])
            h = (run[end] - run[start]) * down[start]
            return mix(h + (end - start).astype(_U) * _COEF[63])

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null counts as an empty text."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    if offs is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    return (np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)), offsets


def slices(column: pa.Array, limit: int = SLICE_BYTES, gaps: np.ndarray = _SPACE) -> Iterator[Slice]:
    """The batch's texts in row order, cut between rows after about ``limit`` bytes.
    ``gaps`` says which bytes part words."""
    data, offsets = text_buffers(column)
    lo, rows = 0, len(column)
    while lo < rows:
        hi = int(np.searchsorted(offsets, int(offsets[lo]) + limit, side="right")) - 1
        hi = min(rows, max(hi, lo + 1))
        yield Slice(data, offsets, lo, hi, gaps)
        lo = hi


def rolling(hashes: np.ndarray, k: int, offsets: tuple[int, ...] | None = None) -> np.ndarray:
    """Hash of the words at ``i + offsets`` (default: ``k`` words in a row) for every
    ``i`` that leaves room for ``k`` words; rows are not kept apart here."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    with np.errstate(over="ignore"):
        out = np.zeros(n, _U)
        for j, o in enumerate(range(k) if offsets is None else offsets):
            out += hashes[o:o + n] * _COEF[j]
        return mix(out)


def whole(hashes: np.ndarray) -> np.ndarray:
    """One hash for the whole (short) word sequence, as an array of one."""
    with np.errstate(over="ignore"):
        return mix(np.array([(hashes * _COEF[:len(hashes)]).sum(dtype=_U) + _COEF[40 + len(hashes)]], _U))


def doc_shingles(sl: Slice, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct ``k``-word shingle hashes of each row; with fewer words the
    whole sequence is one shingle; without words the set is empty."""
    h = sl.hashes()
    rolled = rolling(h, k)
    for r in range(sl.hi - sl.lo):
        a, b = sl.first[r], sl.first[r + 1]
        if b - a >= k:
            yield np.unique(rolled[a:b - k + 1])
        elif b > a:
            yield whole(h[a:b])
        else:
            yield rolled[:0]
