"""Substring dedup by collinear chaining: passages that repeat, also with edits,
across documents.

1. *Seeds.*  A shingle is ``k`` words with one word left open in their middle, which fits
   between words changed at any regular distance of four or more.  Of every ``w``
   consecutive shingles the one with the least hash is kept (winnowing); with ``w = 1``
   that is every shingle.
2. *Matches.*  Each seed is joined with its first occurrence (the least document id).
   That is one match a row, however many documents share the seed: the first document
   with a passage keeps it, the later ones repeat it.
   *Rest.*  A passage whose parts stand in several earlier documents gives its seeds to
   those.  Where neighbouring seeds go to different places, two further keys are joined
   with their first occurrence: every window of ``min_words`` words there (so no exact
   run is missed) and the pair of the two seeds (for edited passages).
3. *Chains.*  The matches of a document with one source are merged into blocks of one
   diagonal; a Fenwick tree over the source position finds the best-scoring ordered
   chains under a linear gap cost.
4. *Alignment.*  Chains of one document and source that lie close together share a row.  The two
   byte ranges are cut out of the texts, and the chains, best first, are aligned
   word by word between the chain's points and extended at both ends as long as the
   score does not drop by ``DROP``; where a range ends before that, a wider one is cut
   out.  The best-scoring parts with at least ``min_words`` equal words are the repeated
   passages.  A chain that lies within a passage found before adds none: a document that
   repeats a line a thousand times costs one alignment of the run, not a thousand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpoint.llm import words as W
from tillpoint.llm.io import drop, giving_back, small_batches, stash

K, WINDOW, MIN_WORDS = 6, 14, 50
#: One in so many shingles is a seed by its own hash.
SHARE = 4
#: Of a run of equal shingles (one word again and again) one in so many is a seed.
SAME = 14
#: Bytes of text beside a chain that are cut out first, and the factor by which they grow
#: while an extension reaches the cut.
MARGIN, WIDER = 512, 16
#: Bytes of a document and of its source that chains of one row may take up.
SPAN, SOURCE_SPAN = 1 << 18, 1 << 15
#: Words that an extension compares at a time.
STRETCH = 128
#: Words between matches of one diagonal that still belong to one block.
BLOCK_GAP = WINDOW
#: Per word skipped on either side; small, as edits leave gaps between the seeds.
GAP_COST = 0.05
MISMATCH, DROP = 2, 12


def sliding(h: np.ndarray, w: int, of) -> np.ndarray:
    """``of`` (np.minimum or np.maximum) every ``w`` values in a row, by windows that double."""
    size = 1
    while 2 * size <= w:
        h, size = of(h[:-size], h[size:]), 2 * size
    return of(h[:size - w], h[w - size:]) if size < w else h


def winnow(h: np.ndarray, w: int, share: int = 0) -> np.ndarray:
    """Places of the hashes that are least in one of the windows of ``w`` around them, and of
    one hash value in ``share``."""
    n = len(h)
    if not n:
        return np.zeros(0, np.int64)
    if n <= w:
        chosen = h == h.min()
    else:
        least = sliding(h, w, np.minimum)
        padded = np.concatenate([np.zeros(w - 1, h.dtype), least, np.zeros(w - 1, h.dtype)])
        chosen = sliding(padded, w, np.maximum) == h
    if share:
        chosen |= h % np.uint64(share) == 0
    # of a run of equal hashes (one word again and again) a few places will do
    same = np.concatenate([[False], h[1:] == h[:-1]])
    if same.any():
        place = np.arange(n)
        run = np.maximum.accumulate(np.where(same, 0, place))
        chosen &= ~same | ((place - run) % max(w, SAME) == 0)
    return np.flatnonzero(chosen)


def shingles(h: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of ``k`` words in every ``k + 1``, the middle one left open."""
    return W.rolling(h, k + 1, tuple(i for i in range(k + 1) if i != k // 2))


def _seed_rows(k: int, w: int):
    def run(batches):
        for batch in batches:
            for sl in W.slices(batch.column(1)):
                rolled = shingles(sl.hashes(), k)
                rows, words = [], []
                for r in range(sl.hi - sl.lo):
                    a, b = int(sl.first[r]), int(sl.first[r + 1])
                    if b - a > k:
                        at = winnow(rolled[a:b - k], w, SHARE) + a
                        words.append(at)
                        rows.append(np.full(len(at), r))
                if not rows:
                    continue
                row, at = np.concatenate(rows), np.concatenate(words)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rolled[at].view(np.int64)), batch.column(0).take(pa.array(sl.lo + row)),
                     pa.array((at - sl.first[row]).astype(np.int32)),
                     pa.array((sl.start[at] - sl.offsets[row]).astype(np.int32))],
                    ["seed", "id", "word", "byte"])
    return run


class Fenwick:
    """Prefix maxima with the index of the best entry."""

    def __init__(self, n: int):
        self.best = [(-1e18, -1)] * (n + 1)

    def put(self, i: int, value: float, what: int) -> None:
        i += 1
        while i < len(self.best):
            if value > self.best[i][0]:
                self.best[i] = (value, what)
            i += i & -i

    def get(self, i: int) -> tuple[float, int]:
        """The best of the entries at places below ``i``."""
        out = (-1e18, -1)
        while i > 0:
            if self.best[i][0] > out[0]:
                out = self.best[i]
            i -= i & -i
        return out


def blocks(x: np.ndarray, y: np.ndarray, gap: int = BLOCK_GAP) -> list[np.ndarray]:
    """Indexes of the matches of one diagonal that lie close together, by first match."""
    order = np.lexsort((x, x - y))
    d, s = (x - y)[order], x[order]
    cut = np.flatnonzero((d[1:] != d[:-1]) | (s[1:] - s[:-1] > gap)) + 1
    return sorted(np.split(order, cut), key=lambda b: (x[b[0]], y[b[0]]))


def chains(x: np.ndarray, y: np.ndarray, k: int = K) -> list[list[np.ndarray]]:
    """Ordered chains of blocks, each block in one chain, best chains first.

    A chain's score is the words its blocks cover less ``GAP_COST`` for every word
    skipped on either side; a block joins a chain only if that raises its score."""
    found = blocks(x, y)
    if len(found) == 1:
        return [found]
    x0, x1 = [int(x[b[0]]) for b in found], [int(x[b[-1]]) + k for b in found]
    y0, y1 = [int(y[b[0]]) for b in found], [int(y[b[-1]]) + k for b in found]
    ends = sorted(set(y1))
    place = {v: i for i, v in enumerate(ends)}
    tree, score, before = Fenwick(len(ends)), [0.0] * len(found), [-1] * len(found)
    closing, c = sorted(range(len(found)), key=lambda i: x1[i]), 0
    for i in range(len(found)):
        while c < len(closing) and x1[closing[c]] <= x0[i]:
            p = closing[c]
            tree.put(place[y1[p]], score[p] + GAP_COST * (x1[p] + y1[p]), p)
            c += 1
        score[i] = float(x1[i] - x0[i])
        value, p = tree.get(int(np.searchsorted(ends, y0[i], side="right")))
        gain = value - GAP_COST * (x0[i] + y0[i])
        if p >= 0 and gain > 0:
            score[i] += gain
            before[i] = p
    used, out = set(), []
    for i in sorted(range(len(found)), key=lambda i: -score[i]):
        chain = []
        while i >= 0 and i not in used:
            used.add(i)
            chain.append(found[i])
            i = before[i]
        if chain:
            out.append(chain[::-1])
    return out


def _groups(batches, least: int, keys: tuple[str, ...] = ("id", "src")) -> Iterator[pa.RecordBatch]:
    """Rows of one (id, src) after the other, from batches sorted by them (or by other
    ``keys``); only groups of at least ``least`` rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held:
            batch = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()[0]
        n = batch.num_rows
        new = np.zeros(n, bool)
        for name in keys:
            col = batch.column(name)
            new[1:] |= pc.not_equal(col.slice(1), col.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        cut = [0, *np.flatnonzero(new).tolist()]
        for a, b in zip(cut, cut[1:]):
            if b - a >= least:
                yield batch.slice(a, b - a)
        held = [batch.slice(cut[-1])]
    yield from (g for g in held if g.num_rows >= least)


def _seams(k: int, w: int, min_words: int):
    """Per document, from its shared seeds in order: the pairs of neighbouring seeds that
    go to different sources or diagonals (key in ``seed``), and in one row the ranges of
    places where a window of ``min_words`` words holds such a pair (``spans``).

    A pair is one row, however often the document repeats it (one phrase again and again):
    its first place, and word and byte of each later one in turn in ``also``.

    Seeds of an exact run lie at most ``w`` places apart, the first within ``w`` places of
    its start and the last within ``w`` of its last shingle; other places are left out."""
    def run(batches):
        for g in _groups(batches, 2, ("id",)):
            seed, at, byte, to = (g.column(n).to_numpy() for n in ("seed", "word", "byte", "sword"))
            at, src = at.astype(np.int64), g.column("src")
            n = len(at)
            other = pc.not_equal(src.slice(1), src.slice(0, n - 1)).to_numpy(zero_copy_only=False) | (np.diff(at - to) != 0)
            near = np.diff(at) <= w
            pair = np.flatnonzero(other & (np.diff(at) <= min_words))
            if not len(pair):
                continue
            cut = np.flatnonzero(~near) + 1
            run_of = np.searchsorted(cut, np.arange(n), side="right")
            opens, closes = np.concatenate([[0], cut])[run_of], np.concatenate([cut, [n]])[run_of] - 1
            seam = np.flatnonzero(other & near)
            lo = np.maximum(np.maximum(at[seam + 1] - (min_words - k), at[opens[seam]] - (w - 1)), 0)
            hi = np.minimum(at[seam], at[closes[seam]] - (min_words - k - (w - 1)))
            spans: list[int] = []
            for a, b in sorted(zip(lo.tolist(), (hi + 1).tolist())):
                if a < b and spans and a <= spans[-1]:
                    spans[-1] = max(spans[-1], b)
                elif a < b:
                    spans += [a, b]
            keys = W.mix(seed.view(np.uint64)[pair] * np.uint64(3) + W.mix(seed.view(np.uint64)[pair + 1])).view(np.int64)
            order = np.lexsort((byte[pair], at[pair], keys))
            keys, pair = keys[order], pair[order]
            opened = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            places = np.stack([at[pair], byte[pair]], axis=1)
            also = [places[a + 1:b].ravel() if b - a > 1 else None for a, b in zip(opened, [*opened[1:], len(pair)])]
            one = lambda m: g.column("id").take(pa.array(np.zeros(m, np.int64)))
            size = len(opened) + bool(spans)
            none = [None] * (size - len(opened))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[opened].tolist() + none, pa.int64()), one(size),
                 *(pa.array(v.tolist() + none, pa.int32()) for v in places[opened].T),
                 pa.array(also + none, pa.list_(pa.int32())),
                 pa.array([None] * len(opened) + [spans] * len(none), pa.list_(pa.int32()))],
                ["seed", "id", "word", "byte", "also", "spans"])
    return run


def _window_rows(min_words: int):
    """The windows of ``min_words`` words that begin in the spans, as seeds are written."""
    def run(batches):
        for batch in batches:
            spans = batch.column("spans").to_pylist()
            for sl in W.slices(batch.column("text")):
                h = sl.hashes()
                rows, words, keys = [], [], []
                for r in range(sl.hi - sl.lo):
                    a, b = int(sl.first[r]), int(sl.first[r + 1])
                    own = spans[sl.lo + r]
                    for lo, hi in zip(own[::2], own[1::2]):
                        lo, hi = a + lo, min(a + hi, b - min_words + 1)
                        if lo < hi:
                            keys.append(_long_hash(h[lo:hi + min_words - 1], min_words))
                            words.append(np.arange(lo, hi))
                            rows.append(np.full(hi - lo, r))
                if rows:
                    row, at = np.concatenate(rows), np.concatenate(words)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(keys).view(np.int64)), batch.column("id").take(pa.array(sl.lo + row)),
                         pa.array((at - sl.first[row]).astype(np.int32)),
                         pa.array((sl.start[at] - sl.offsets[row]).astype(np.int32))],
                        ["seed", "id", "word", "byte"])
    return run


def _long_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` words in a row, whatever ``n``."""
    with np.errstate(over="ignore"):
        out = np.zeros(len(h) - n + 1, np.uint64)
        for j in range(n):
            out = out * _FACTOR + h[j:j + len(out)]
        return W.mix(out)


_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _clusters(found: list[tuple[np.ndarray, np.ndarray]]) -> list[list[int]]:
    """Chains that lie close together in the document, within the spans that a row may have;
    in each cluster the best chain first."""
    order = sorted(range(len(found)), key=lambda c: found[c][0][0])
    out: list[list[int]] = []
    lo = hi = slo = shi = 0
    for c in order:
        at, sat = found[c]
        a, b, sa, sb = int(at[0]), int(at[-1]), int(sat[0]), int(sat[-1])
        if out and a - hi <= 4 * MARGIN and max(hi, b) - lo <= SPAN and max(shi, sb) - min(slo, sa) <= SOURCE_SPAN:
            out[-1].append(c)
            hi, slo, shi = max(hi, b), min(slo, sa), max(shi, sb)
        else:
            out.append([c])
            lo, hi, slo, shi = a, b, sa, sb
    return [sorted(c) for c in out]


def _matches(g: pa.RecordBatch) -> list[np.ndarray]:
    """Words and bytes (document's and source's of each) of the matches of a group, those
    at the places in ``also`` with the others."""
    x, y, bx, by = (g.column(n).to_numpy().astype(np.int64) for n in ("word", "sword", "byte", "sbyte"))
    also = g.column("also")
    if also.null_count == len(also):
        return [x, y, bx, by]
    of = pc.list_parent_indices(also).to_numpy()[::2]
    places = pc.list_flatten(also).to_numpy().astype(np.int64).reshape(-1, 2)
    return [np.concatenate(v) for v in ((x, places[:, 0]), (y, y[of]), (bx, places[:, 1]), (by, by[of]))]


def _chain_rows(k: int):
    """Clusters of chains of each (id, src), with the points of each chain; ``k`` is the words
    that a match spans."""
    def run(batches):
        names = ("id", "src", "lo", "hi", "slo", "shi", "at", "sat", "sizes")
        keep: dict[str, list] = {n: [] for n in names}

        def flush():
            return pa.RecordBatch.from_arrays(
                [pa.concat_arrays(keep["id"]), pa.concat_arrays(keep["src"]),
                 *(pa.array(keep[n], pa.int32()) for n in ("lo", "hi", "slo", "shi")),
                 *(pa.array(keep[n], pa.list_(pa.int32())) for n in ("at", "sat", "sizes"))], list(keep))

        for g in _groups(batches, 1):
            x, y, bx, by = _matches(g)
            found = []
            for chain in chains(x, y, k):
                points = np.concatenate([b[[0, -1]] if len(b) > 1 else b for b in chain])
                found.append((bx[points], by[points]))
            for cluster in _clusters(found):
                at, sat = (np.concatenate([found[c][side] for c in cluster]) for side in (0, 1))
                keep["id"].append(g.column("id").slice(0, 1))
                keep["src"].append(g.column("src").slice(0, 1))
                for name, v in (("lo", max(0, at.min() - MARGIN)), ("hi", at.max() + MARGIN), ("slo", max(0, sat.min() - MARGIN)),
                                ("shi", sat.max() + MARGIN), ("at", at), ("sat", sat), ("sizes", [len(found[c][0]) for c in cluster])):
                    keep[name].append(v)
            if len(keep["id"]) >= 4096:
                yield flush()
                keep = {n: [] for n in keep}
        if keep["id"]:
            yield flush()
    return run


def _extension(h: np.ndarray, s: np.ndarray, i: int, j: int, left: bool) -> tuple[int, bool]:
    """Words to go on for beyond a point, up to the best score before it drops by ``DROP``;
    and whether it drops before one of the texts ends."""
    n = min(i, j) if left else min(len(h) - i, len(s) - j)
    done = score = best = peak = 0
    while done < n:
        m = min(STRETCH, n - done)
        if left:
            equal = (h[i - done - m:i - done] == s[j - done - m:j - done])[::-1]
        else:
            equal = h[i + done:i + done + m] == s[j + done:j + done + m]
        run = score + np.cumsum(np.where(equal, 1, -MISMATCH))
        low = np.flatnonzero(run < np.maximum(np.maximum.accumulate(run), peak) - DROP)
        ahead = run[:low[0]] if len(low) else run
        if len(ahead) and ahead.max() > peak:
            best, peak = done + int(ahead.argmax()) + 1, int(ahead.max())
        if len(low):
            return best, True
        done, score = done + m, int(run[-1])
    return best, False


def _run(equal: np.ndarray) -> int:
    """Length of the run of True at the start."""
    return len(equal) if equal.all() else int(equal.argmin())


def align(h: np.ndarray, s: np.ndarray, points: list[tuple[int, int]], left: int, right: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of equal words ``(places in h, places in s)`` along a chain of points, and so many
    words beyond its ends."""
    i, j = points[0]
    eq = np.flatnonzero(h[i - left:i] == s[j - left:j])
    at, to = [i - left + eq], [j - left + eq]
    for i2, j2 in points[1:]:
        if i2 < i or j2 < j:
            continue
        if i2 - i == j2 - j:
            eq = np.flatnonzero(h[i:i2] == s[j:j2])
            at.append(i + eq)
            to.append(j + eq)
        else:                      # words put in or left out between the points
            n = min(i2 - i, j2 - j)
            a = _run(h[i:i + n] == s[j:j + n])
            b = min(n - a, _run((h[i2 - n:i2] == s[j2 - n:j2])[::-1]))
            at += [np.arange(i, i + a), np.arange(i2 - b, i2)]
            to += [np.arange(j, j + a), np.arange(j2 - b, j2)]
        i, j = i2, j2
    eq = np.flatnonzero(h[i:i + right] == s[j:j + right])
    return np.concatenate([*at, i + eq]), np.concatenate([*to, j + eq])


def parts(at: np.ndarray, to: np.ndarray, min_words: int) -> list[tuple[int, int]]:
    """Ranges ``a:b`` of the aligned words with the best scores (1 a word, less
    ``MISMATCH`` for each unequal word between two of them) and ``min_words`` words."""
    out, todo = [], [(0, len(at))]
    skipped = np.maximum(np.diff(at), np.diff(to)) - 1
    while todo:
        a, b = todo.pop()
        if b - a < min_words:
            continue
        gain = np.ones(b - a)
        gain[1:] -= MISMATCH * skipped[a:b - 1]
        total = np.concatenate([[0.0], np.cumsum(gain)])
        # starting at word m does not pay for the gap before it
        entry = total[:-1].copy()
        entry[1:] -= MISMATCH * skipped[a:b - 1]
        least = np.minimum.accumulate(entry)
        end = int((total[1:] - least).argmax())
        start = int(entry[:end + 1].argmin())
        if end + 1 - start >= min_words:
            out.append((a + start, a + end + 1))
            todo += [(a, a + start), (a + end + 1, b)]
        elif start > 0 or end + 1 < b - a:
            todo += [(a, a + start), (a + end + 1, b)]
    return sorted(out)


def _passage_rows(min_words: int):
    def run(batches):
        for big in batches:
            for lo in range(0, big.num_rows, 256):
                yield from _passages(big.slice(lo, 256), min_words)
    return run


def _aligned(h: np.ndarray, s: np.ndarray, all_points: list[list[tuple[int, int]]], cut: list[bool], min_words: int):
    """Passages ``(place in h, place in s, last in h, last in s, equal words)`` of a row's
    chains; None if an extension ends only where a range does, and the text goes on there
    (``cut``: left and right of h, then of s)."""
    hl, hr, sl, sr = cut
    out: list[tuple[int, int, int, int, int]] = []
    for points in all_points:
        (i, j), (i2, j2) = points[0], points[-1]
        if any(p[0] <= i and i2 <= p[2] for p in out):
            continue
        # align() leaves out points that fall behind; its last one counts
        for a, b in points[1:]:
            if a >= i and b >= j:
                i, j = a, b
        last, (i, j) = (i, j), points[0]
        left, dropped = _extension(h, s, i, j, True)
        if not dropped and not (i <= j and not hl or j <= i and not sl):
            return None
        right, dropped = _extension(h, s, *last, False)
        if not dropped and not (len(h) - last[0] <= len(s) - last[1] and not hr or len(s) - last[1] <= len(h) - last[0] and not sr):
            return None
        x, y = align(h, s, points, left, right)
        out += [(int(x[a]), int(y[a]), int(x[b - 1]), int(y[b - 1]), b - a) for a, b in parts(x, y, min_words)]
    return out


def _passages(batch: pa.RecordBatch, min_words: int):
    """Passages; rows with a chain whose extension reaches a cut come back with null passages
    and wider ranges."""
    mine = [(sl, r) for sl in W.slices(batch.column("part")) for r in range(sl.hi - sl.lo)]
    theirs = [(sl, r) for sl in W.slices(batch.column("spart")) for r in range(sl.hi - sl.lo)]
    hashed: dict[int, np.ndarray] = {}
    rows, out, wide, open_rows = [], [], [], []
    meta = [batch.column(n).to_pylist() for n in ("lo", "hi", "slo", "shi", "at", "sat", "sizes")]
    for row, ((ml, mr), (tl, tr), lo, hi, slo, shi, at, sat, sizes) in enumerate(zip(mine, theirs, *meta)):
        side, cut = [], []
        for sl, r, base, until, points in ((ml, mr, lo, hi, at), (tl, tr, slo, shi, sat)):
            if id(sl) not in hashed:
                hashed[id(sl)] = sl.hashes()
            a, b = sl.first[r], sl.first[r + 1]
            size = int(sl.offsets[r + 1] - sl.offsets[r])
            cut += [base > 0, size == until - base]
            # a word that touches a cut may be part of a longer one
            if b > a and base > 0 and sl.start[a] == sl.offsets[r]:
                a += 1
            if b > a and size == until - base and sl.end[b - 1] == sl.offsets[r + 1]:
                b -= 1
            start = sl.start[a:b] - sl.offsets[r]
            side.append((hashed[id(sl)][a:b], start, sl.end[a:b] - sl.offsets[r],
                         np.searchsorted(start, np.array(points) - base)))
        (h, hs, he, p), (s, ss, se, q) = side
        found = None
        # a word that begins at a point always ends, if only at the end of the text
        if len(h) and len(s) and p.max() < len(h) and q.max() < len(s):
            pairs, ends = list(zip(p.tolist(), q.tolist())), np.cumsum(sizes).tolist()
            found = _aligned(h, s, [pairs[b - n:b] for b, n in zip(ends, sizes)], cut, min_words)
        if found is None:
            open_rows.append(row)
            first, end, sfirst, send = min(at), max(at), min(sat), max(sat)
            more = WIDER * max(MARGIN, first - lo, hi - end)
            wide.append((max(0, first - more), end + more, max(0, sfirst - more), send + more))
            continue
        for i, j, i2, j2, equal in found:
            rows.append(row)
            out.append((lo + hs[i], lo + he[i2], slo + ss[j], slo + se[j2], equal, i2 - i + 1))
    if rows or open_rows:
        n, m = len(rows), len(open_rows)
        both = pa.array(rows + open_rows, pa.int64())
        cols = list(zip(*out)) or [()] * len(PASSAGE)
        wider = list(zip(*wide)) or [()] * 4
        yield pa.RecordBatch.from_arrays(
            [batch.column("id").take(both), batch.column("src").take(both),
             *(pa.array([int(v) for v in c] + [None] * m, pa.int32()) for c in cols),
             *(pa.array([None] * n + [int(v) for v in c], pa.int32()) for c in wider),
             *(pa.array([None] * n + [c[r] for r in open_rows], pa.list_(pa.int32())) for c in meta[4:])],
            ["id", "src", *PASSAGE, "lo", "hi", "slo", "shi", "at", "sat", "sizes"])


PASSAGE = ("start_byte", "end_byte", "source_start", "source_end", "equal_words", "n_words")


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, k: int = K, window: int = WINDOW,
                      id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per passage of a document that repeats a passage of a document with a
    smaller id: both ids, both byte ranges, and how many of its words are equal.

    Words are compared with A-Z in lower case.  Null and empty texts and texts of fewer
    than ``min_words`` words repeat nothing.  Rows without an id are left out; rows that
    repeat an id are one document (nothing repeats within a document) and each of its
    texts is compared.  Extra columns are ignored.  Empty input gives no rows."""
    with small_batches(docs.sparkSession):
        return _repeated(docs, min_words, k, window, id, text)


def _repeated(docs: DataFrame, min_words: int, k: int, window: int, id: str, text: str) -> DataFrame:
    own = docs.where(F.col(id).isNotNull()).select(F.col(id).alias("id"), F.col(text).alias("text"))
    kind = own.schema["id"].dataType.simpleString()
    seeds = lambda: own.mapInArrow(giving_back(_seed_rows(k, window)), f"seed bigint, id {kind}, word int, byte int")
    first = (seeds().groupBy("seed").agg(F.min("id").alias("src"), F.max("id").alias("last"))
             .where("src <> last").select("seed", "src"))
    shared, shared_at = stash(seeds().join(first.hint("shuffle_hash"), "seed"), "seeds")
    origin = lambda of: (of.where("id = src").groupBy("seed").agg(F.min(F.struct("word", "byte")).alias("o"))
                         .select("seed", F.col("o.word").alias("sword"), F.col("o.byte").alias("sbyte")))
    columns = ["id", "src", "word", "sword", "byte", "sbyte"]
    placed = shared.join(origin(shared), "seed")
    seams, seams_at = stash(placed.repartition("id").sortWithinPartitions("id", "word").mapInArrow(
        giving_back(_seams(k + 1, max(window, SAME), min_words)), f"seed bigint, id {kind}, word int, byte int, also array<int>, spans array<int>"), "seams")
    spans = seams.where("spans is not null").select("id", "spans")
    longer = (seams.where("spans is null").drop("spans")
              .unionByName(spans.join(own, "id").select("id", "text", "spans").mapInArrow(
                  giving_back(_window_rows(min_words)), f"seed bigint, id {kind}, word int, byte int"), allowMissingColumns=True))
    longer, longer_at = stash(longer, "longer")
    least = (longer.groupBy("seed").agg(F.min("id").alias("src"), F.max("id").alias("last"))
             .where("src <> last").select("seed", "src"))
    rest = longer.join(least.hint("shuffle_hash"), "seed")
    matches = (placed.where("id <> src").select(*columns)
               .unionByName(rest.join(origin(rest), "seed").where("id <> src").select(*columns, "also"), allowMissingColumns=True)
               .repartition("id").sortWithinPartitions("id", "src", "word", "sword"))
    chain = "lo int, hi int, slo int, shi int, at array<int>, sat array<int>, sizes array<int>"
    found, _ = stash(matches.mapInArrow(giving_back(_chain_rows(k + 1)), f"id {kind}, src {kind}, {chain}"), "chains")
    drop(docs.sparkSession, shared_at, seams_at, longer_at)

    bytes_of = lambda lo, hi: F.expr(f"cast(substring(cast(text as binary), {lo} + 1, {hi} - {lo}) as string)")
    names = [c.split()[0] for c in chain.split(", ")]
    passages = None
    while True:
        sources = found.join(own.withColumnRenamed("id", "src"), "src").withColumn("spart", bytes_of("slo", "shi")).drop("text")
        both = sources.join(own, "id").withColumn("part", bytes_of("lo", "hi")).drop("text")
        made, _ = stash(both.mapInArrow(
            giving_back(_passage_rows(min_words)),
            f"id {kind}, src {kind}, " + ", ".join(f"{c} int" for c in PASSAGE) + f", {chain}"), "passages")
        new = made.where("start_byte is not null").select(F.col("id").alias("doc_id"), F.col("src").alias("source_id"), *PASSAGE)
        passages = new if passages is None else passages.unionByName(new)
        found = made.where("start_byte is null").select("id", "src", *names)
        # ranges grow until they hold the texts, so the rounds end
        if found.isEmpty():
            return passages


def _cut(batches):
    """Texts without the byte ranges of ``cuts``; null when no word is left."""
    for batch in batches:
        texts, cuts = batch.column("text").to_pylist(), batch.column("cuts").to_pylist()
        out = []
        for t, ranges in zip(texts, cuts):
            data, kept, at = (t or "").encode(), [], 0
            for c in sorted(ranges, key=lambda c: (c["a"], c["b"])):
                if c["a"] > at:
                    kept.append(data[at:c["a"]])
                at = max(at, c["b"])
            kept.append(data[at:])
            text = b"".join(kept).decode()
            out.append(text if text.strip(" \t\n\v\f\r") else None)
        yield batch.drop_columns(["text", "cuts"]).append_column("text", pa.array(out, pa.string()))


def remove_passages(docs: DataFrame, passages: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the repeated passages; a document of which no word is left goes.

    Only documents with a passage reach Python.  Documents without an id stay as they
    are.  Of rows that repeat an id each loses the ranges found for that id."""
    ranges = (passages.groupBy(F.col("doc_id").alias("_of"))
              .agg(F.collect_set(F.struct(F.col("start_byte").alias("a"), F.col("end_byte").alias("b"))).alias("cuts")))
    joined = docs.join(ranges, docs[id] == ranges["_of"], "left")
    clean = joined.where("cuts is null").select(*docs.columns)
    other = [c for c in docs.columns if c not in (text, "n_chars")]
    cut = (joined.where("cuts is not null").select(*other, F.col(text).alias("text"), "cuts")
           .mapInArrow(giving_back(_cut), ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in other) + ", text string")
           .where("text is not null").withColumnRenamed("text", text))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return clean.unionByName(cut.select(*docs.columns))
