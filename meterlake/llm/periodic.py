"""Runs of words that repeat with a period, caught block by block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlake.llm.words import _BASE, _INVERSE, U64, Words, mix, pieces, powers

#: Comparisons that are held in memory at once.
AT_ONCE = 1 << 21


class Catchers:
    """Finds all runs in some texts, whose words are given by their hashes.

    A catcher watches one completed block of 2**k words for a second copy of it that begins a period later. Blocks lie at
    multiples of their size, so every stretch of 2**(k + 1) - 1 words holds one: a square of period p has a stretch of p words
    that come again p words on, and is caught by the block of the largest power of two that such a stretch must hold. Of all
    catchers of one size the comparisons are made at once. Catches of neighbouring blocks with one period are squares of one
    run; the ends of a run are found by halving steps over hashes of 2**(k - 1), ..., 2, 1 words.
    """

    def __init__(self, words: np.ndarray, first: np.ndarray, least: int) -> None:
        self.words, self.first, self.least = words, first, least
        self.total = np.zeros(len(words) + 1, U64)
        np.cumsum(words * powers(_BASE, len(words)), out=self.total[1:])
        self.back = powers(_INVERSE, len(words) + 1)

    def hashes(self, at: np.ndarray, size: int) -> np.ndarray:
        return (self.total[at + size] - self.total[at]) * self.back[at]

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, smallest period) of each maximal run, by start, then period."""
        longest = int(np.diff(self.first).max(initial=0)) // 2
        found = [self._caught(size, low, high) for size, low, high in self._levels(longest)]
        start, end, period = (np.concatenate([np.empty(0, np.int64), *c]) for c in zip(*found)) if found else (np.empty(0, np.int64),) * 3
        order = np.lexsort((period, end, start))
        start, end, period = start[order], end[order], period[order]
        new = np.r_[True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])][: len(start)]
        start, end, period = start[new], end[new], period[new]
        order = np.lexsort((period, start))
        return start[order], end[order], period[order]

    def _levels(self, longest: int) -> Iterator[tuple[int, int, int]]:
        """(block size, least period, greatest period): all periods up to the longest, each with the largest block that works."""
        low = 1
        while low <= longest:
            size = self._size(low)
            high = low
            while high < longest and high < low + 2 * size and self._size(high + 1) == size:
                high += 1
            yield size, low, high
            low = high + 1

    def _size(self, period: int) -> int:
        return 1 << (((max(self.least - period, period) + 1) // 2).bit_length() - 1)

    def _caught(self, size: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.arange(0, len(self.words), size)
        text = np.searchsorted(self.first, at, "right") - 1
        end = self.first[text + 1]
        fit = (at + size + low <= end) & (end - self.first[text] >= 2 * low)
        at, end = at[fit], end[fit]
        blocks, shifts, wide = [], [], np.arange(low, high + 1)
        everywhere = self.hashes(np.arange(len(self.words) - size + 1), size) if len(at) else None
        for i in range(0, len(at), step := max(1, AT_ONCE // len(wide))):
            there = at[i : i + step, None] + wide
            inside = there + size <= end[i : i + step, None]
            b, s = np.nonzero(inside & (everywhere[np.where(inside, there, 0)] == everywhere[at[i : i + step]][:, None]))
            blocks.append(b + i)
            shifts.append(wide[s])
        if not blocks:
            return (np.empty(0, np.int64),) * 3
        b, p = np.concatenate(blocks), np.concatenate(shifts)
        order = np.lexsort((b, p))
        b, p = b[order], p[order]
        a, e = at[b], end[b]
        new = np.r_[True, (p[1:] != p[:-1]) | (a[1:] != a[:-1] + size) | (e[1:] != e[:-1])][: len(a)]
        last = np.r_[new[1:], True][: len(a)]
        p, e, start, stop = p[new], e[new], a[new], a[last] + size
        begin = self.first[np.searchsorted(self.first, start, "right") - 1]
        step = size
        while step > 1:
            step //= 2
            left = np.maximum(start - step, 0)
            start = np.where((start - step >= begin) & (self.hashes(left, step) == self.hashes(left + p, step)), start - step, start)
            right = np.minimum(stop, e - p - step)
            fits = stop + p + step <= e
            right = np.where(fits, right, 0)
            stop = np.where(fits & (self.hashes(right, step) == self.hashes(np.where(fits, right + p, 0), step)), stop + step, stop)
        stop = stop + p
        long = stop - start >= np.maximum(self.least, 2 * p)
        return start[long], stop[long], p[long]


def runs_of(words: list[bytes], least: int = 12) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of one text. Words are numbered, so none are taken for each other."""
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], U64)
    for attempt in range(64):
        start, end, period = Catchers(mix(ids + U64(1 + (attempt << 40))), np.array([0, len(ids)]), least).runs()
        found = [(s, e - s, p) for s, e, p in zip(start.tolist(), end.tolist(), period.tolist())]
        if _true(words, found):
            return found
    raise ArithmeticError("hashes of different passages agree for 64 numberings of the words")


def _true(words: list[bytes], runs: list[tuple[int, int, int]]) -> bool:
    return all(words[s : s + n - p] == words[s + p : s + n] for s, n, p in runs)


def find_runs(docs: DataFrame, least: int = 12, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for each row of docs.

    Words are what stands between ASCII white space, numbered from 0. A run is a stretch of words with smallest period p,
    of at least `least` and at least 2 * p words, which no neighbouring word extends. runs: (start, length, period), by start,
    then period. collapsed: the words joined by a space, without those that some run contains after its first p words.

    Each text is judged on its own, in the task that reads it, and nothing is shuffled; memory is in proportion to the longest
    text. Found runs are confirmed on the words. Null and empty texts have no words and no runs. Repeated rows give repeated
    rows. Columns of docs other than the two named are not looked at.
    """
    docs = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    run = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    arrow = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
    fields = [docs.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(run)), T.StructField("collapsed", T.StringType())]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                sizes, runs, kept = _judged(batch.column("text"), least)
                columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(runs, arrow), pa.array(kept, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    return docs.mapInArrow(judged, T.StructType(fields))


def _judged(column: pa.Array, least: int) -> tuple[list, list, list]:
    words = Words(column)
    start, end, period = Catchers(words.hashes(), words.first, least).runs()
    of = np.searchsorted(words.first, start, "right") - 1
    edges = np.searchsorted(of, np.arange(len(column) + 1))
    sizes, runs, kept = np.diff(words.first).tolist(), [], []
    for i, text in enumerate(column):
        own = (text.as_py() or "").encode().split()
        a, b, zero = edges[i], edges[i + 1], words.first[i]
        found = [(s, n, p) for s, n, p in zip((start[a:b] - zero).tolist(), (end[a:b] - start[a:b]).tolist(), period[a:b].tolist())]
        if not _true(own, found):
            found = runs_of(own, least)
        if found:
            dropped = np.zeros(len(own) + 1, np.int64)
            np.add.at(dropped, [s + p for s, _, p in found], 1)
            np.add.at(dropped, [s + n for s, n, _ in found], -1)
            own = [own[k] for k in np.flatnonzero(np.cumsum(dropped[:-1]) == 0).tolist()]
        runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])
        kept.append(b" ".join(own).decode())
    return sizes, runs, kept
