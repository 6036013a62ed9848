"""Token counts by count-only Viterbi over a unigram vocabulary.

The pieces and scores of a vocabulary file are read as a unigram model with byte
fallback.  An Aho-Corasick automaton lists the vocabulary's pieces that end at each
character; dynamic programming keeps the best score and the number of pieces up to
there, with the tokenizer's rule for ties: of equal scores the piece that begins first
stays.  A character that no piece of one character covers costs the least score less ten and counts as
its bytes.  No piece list is built.

Texts are cut at blanks (U+0020), which no piece crosses: each part with the mark U+2581
before it is one unit; there is none before a blank that begins a text.  A unit has the same count wherever it stands, so a task counts
each distinct one of a slice once.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpoint.llm import words as W

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_COST = 10.0
_BLANK = np.zeros(256, bool)
_BLANK[0x20] = True


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a SentencePiece model file, in the order of their ids."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]


class Counter:
    """Viterbi counts over one vocabulary."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_COST
        pieces = {p for p, _ in vocabulary}
        self.bytes = all(f"<0x{b:02X}>" in pieces for b in range(256))

    def count(self, units: list[str]) -> list[tuple[int, float]]:
        """Number of tokens and best score of each unit (none holds a blank), in one pass
        over all of them: the automaton reports the pieces by their ends and, of those,
        the longest first, so the one that begins first comes first."""
        text = " ".join(units)
        n = len(text)
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        unknown, in_bytes = self.unknown, self.bytes

        def close(end: int, top: float | None, pieces: int, single: bool) -> None:
            if text[end - 1] != " ":
                if not single:
                    value = best[end - 1] + unknown
                    if top is None or value > top:
                        top = value
                        pieces = count[end - 1] + (len(text[end - 1].encode()) if in_bytes else 1)
                best[end], count[end] = top, pieces

        now, top, pieces, single = 0, None, 0, True
        for last, (size, score) in self.automaton.iter(text):
            end = last + 1
            if end != now:
                if now:
                    if single:
                        best[now], count[now] = top, pieces
                    else:
                        close(now, top, pieces, False)
                for skipped in range(now + 1, end):
                    close(skipped, None, 0, False)
                now, top, pieces, single = end, best[end - size] + score, count[end - size] + 1, size == 1
            else:
                value = best[end - size] + score
                if value > top:
                    top, pieces = value, count[end - size] + 1
                if size == 1:
                    single = True
        if now:
            close(now, top, pieces, single)
        for skipped in range(now + 1, n + 1):
            close(skipped, None, 0, False)
        out, at = [], -1
        for u in units:
            at += len(u) + 1
            out.append((count[at], best[at]))
        return out


@lru_cache(maxsize=2)
def _counter(path: str) -> Counter:
    return Counter(read_vocabulary(path))


#: Units whose counts are kept between slices.
KEPT = 1 << 18


def _counts(c: Counter, keys: list[int], units: list[bytes], kept: dict[int, tuple[int, float]]) -> list[tuple[int, float]]:
    """Counts of the units; those that were met before are looked up."""
    new = [i for i, k in enumerate(keys) if k not in kept]
    if len(kept) + len(new) > KEPT:
        kept.clear()
        new = range(len(keys))
    texts = [units[i].decode() for i in new]
    got = c.count([t if t.startswith(MARK) else MARK + t for t in texts])
    kept.update((keys[i], g) for i, g in zip(new, got))
    return [kept[k] for k in keys]


def _rows(path: str):
    def run(batches):
        c, kept = _counter(path), {}
        for batch in batches:
            tokens, scores = [], []
            for sl in W.slices(batch.column(1), gaps=_BLANK):
                start, end, first = _units(sl)
                if not len(start):
                    tokens.append(np.zeros(sl.hi - sl.lo, np.int64))
                    scores.append(np.zeros(sl.hi - sl.lo))
                    continue
                key, at, of = np.unique(sl.hashes(lower=False, start=start, end=end), return_index=True, return_inverse=True)
                data = sl.data.tobytes()
                got = _counts(c, key.tolist(), [data[a:b] for a, b in zip(start[at].tolist(), end[at].tolist())], kept)
                n, s = np.array([g[0] for g in got], np.int64), np.array([g[1] for g in got])
                total, value = np.concatenate([[0], np.cumsum(n[of])]), np.concatenate([[0.0], np.cumsum(s[of])])
                tokens.append(total[first[1:]] - total[first[:-1]])
                scores.append(value[first[1:]] - value[first[:-1]])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.concatenate([*tokens, np.zeros(0, np.int64)])),
                 pa.array(np.concatenate([*scores, np.zeros(0)]))], ["doc_id", "n_tokens", "score"])
    return run


def _units(sl: W.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges of each text's parts between blanks, empty ones included but for one
    at the text's start."""
    blank = np.flatnonzero(_BLANK[sl.data])
    row = np.searchsorted(sl.offsets, blank, side="right") - 1
    filled = np.flatnonzero(np.diff(sl.offsets))
    start = np.concatenate([sl.offsets[filled], blank + 1])
    end = np.concatenate([blank, sl.offsets[filled + 1]])
    rows = np.concatenate([filled, row])
    order = np.lexsort((start, rows))
    start, end, rows = start[order], end[np.lexsort((end, np.concatenate([row, filled])))], rows[order]
    keep = (end > start) | (start > sl.offsets[rows])       # a leading blank has its own mark
    return start[keep], end[keep], np.searchsorted(rows[keep], np.arange(sl.hi - sl.lo + 1))


def token_counts(docs: DataFrame, vocabulary: str | None = None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_tokens`` and the best segmentation's ``score``.

    Null and empty texts have 0 tokens.  Ids may be null or repeat; extra columns are
    ignored; empty input gives no rows."""
    import public_tokenizers

    path = vocabulary or public_tokenizers.path(VOCABULARY)
    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id), F.coalesce(F.col(text), F.lit(""))).mapInArrow(
        _rows(path), f"doc_id {kind}, n_tokens bigint, score double")
