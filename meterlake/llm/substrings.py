"""Substring dedup: words in passages that occur more than once, found by seeds and extension."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlake.llm.hasharrays import BLOB_SCHEMA, Counter, SortedHashes, bucket_bits, bucket_of, merged_blobs, save
from meterlake.llm.shared import mounted, new_folder
from meterlake.llm.words import _BASE, U64, Words, mix, pieces, powers, window_hashes

_INVERSE = pow(_BASE, -1, 1 << 64)


class Seeds:
    """Winnowed anchors of all texts of a slice, and for each the windows that chose it.

    Among the grams of a window the least hash is its anchor (the leftmost of equal ones), so equal windows have equal
    anchors at equal offsets. Windows in a row with one anchor make up its extent: the anchor extended both ways as far
    as its windows reach. first, count: those windows; anchor: the gram's hash; extent: a hash of all words of the extent
    and the anchor's place there.
    """

    def __init__(self, column: pa.Array, length: int, gram: int) -> None:
        self.words = Words(column)
        h = self.words.hashes()
        grams = window_hashes(h, gram)
        per = length - gram + 1
        starts = np.arange(max(0, len(h) - length + 1))
        ends = self.words.first[1:]
        self.text_of = np.searchsorted(ends, starts, "right")
        starts = starts[starts + length <= ends[self.text_of]] if len(starts) else starts
        place = starts + np.array([], np.int64) if not len(starts) else starts + _leftmost_least(grams, per)[starts]
        new = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(place) else np.empty(0, np.int64)
        self.first, at = starts[new], place[new]
        self.count = np.diff(np.r_[new, len(place)])
        self.anchor = grams[at]
        total = np.zeros(len(h) + 1, U64)
        np.cumsum(h * powers(_BASE, len(h)), out=total[1:])
        whole = (total[self.first + self.count + length - 1] - total[self.first]) * powers(_INVERSE, len(h) + 1)[self.first]
        self.extent = mix(whole ^ mix((at - self.first).astype(U64) << U64(32) | self.count.astype(U64)))
        self.hashes, self.length = h, length

    def windows(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All windows of the chosen extents: their first words, hashes and anchors."""
        count = self.count[chosen]
        offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        first = np.repeat(self.first[chosen], count) + offset
        total = np.zeros(len(self.hashes) + 1, U64)
        np.cumsum(self.hashes * powers(_BASE, len(self.hashes)), out=total[1:])
        h = mix((total[first + self.length] - total[first]) * powers(_INVERSE, len(self.hashes) + 1)[first])
        return first, h, np.repeat(self.anchor[chosen], count)


def _leftmost_least(h: np.ndarray, width: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(h, width).argmin(axis=1)


def _counted(docs: DataFrame, text: str, bits: int, rows, keys: int) -> DataFrame:
    """Blobs of what rows(slice) gives, whose first column is the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(keys, most=2)
        for whole in batches:
            for batch in pieces(whole, text):
                columns = rows(batch.column(text))
                if len(columns[0]) and counter.add([*columns, np.ones(len(columns[0]), np.uint8)]):
                    yield from counter.flush(bits)
        yield from counter.flush(bits)

    return docs.select(text).mapInArrow(run, BLOB_SCHEMA)


def _reduced(blobs: DataFrame, write) -> int:
    """Runs write(bucket, columns) on the merged rows of each bucket."""

    def reduce(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        write(key[0].as_py(), merged_blobs(table, 2, most=2))
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32())})

    return blobs.groupBy("bucket").applyInArrow(reduce, "bucket int").count()


def mark_repeats(docs: DataFrame, length: int = 35, gram: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, spans) for each row of docs.

    Words are what stands between ASCII white space. A word is removed if a window of `length` words over it occurs anywhere
    else, in the same text or another; spans are the maximal removed runs as [first word, end). Windows are judged on the
    input. kept_sha256 is that of the kept words, joined by a space.

    Three passes over the texts, none of which shuffles them. Seeds: anchors with their extents are joined by anchor; an
    extent found twice settles all its windows at once, which is the case inside long repeats and whole copies. Extension:
    where an anchor has different extents (the ends of repeats), its windows are compared one by one. Both joins count in
    map tasks first, so a passage that most documents have is one entry of each task. Last, texts are marked by the two
    sets of hashes, which are memory-mapped from the shared folder.

    Nulls and empty texts have no words and nothing removed; a text shorter than a window keeps all. Repeated rows repeat
    each other. Columns of docs other than the two named are not looked at.
    """
    docs = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    folder, bits = mounted(new_folder(docs.sparkSession, "repeats")), bucket_bits(docs)

    def seeds(column: pa.Array) -> list[np.ndarray]:
        s = Seeds(column, length, gram)
        return [s.anchor, s.extent]

    def write_seeds(bucket: int, rows: list[np.ndarray]) -> None:
        anchor, extent, n = rows
        save(folder, f"same-{bucket}", np.sort(extent[n > 1]))
        different = anchor[1:][anchor[1:] == anchor[:-1]]
        save(folder, f"mixed-{bucket}", np.unique(different))

    def ends(column: pa.Array) -> list[np.ndarray]:
        s = Seeds(column, length, gram)
        _, mixed = SortedHashes.places(_opened(folder, "mixed", bits), s.anchor)
        _, h, anchor = s.windows(np.flatnonzero(mixed))
        return [anchor, h]

    def write_windows(bucket: int, rows: list[np.ndarray]) -> None:
        save(folder, f"window-{bucket}", np.unique(rows[1][rows[2] > 1]))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                yield _marked(batch, length, gram, folder, bits)

    _reduced(_counted(docs, "text", bits, seeds, 2), write_seeds)
    _reduced(_counted(docs, "text", bits, ends, 2), write_windows)
    span = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType())]))
    fields = [docs.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("spans", span)]
    return docs.mapInArrow(mark, T.StructType(fields))


_open: dict[tuple[str, str], SortedHashes] = {}


def _opened(folder: str, name: str, bits: int) -> SortedHashes:
    """Kept by a Python worker for as long as it works on the same folder."""
    if (folder, name) not in _open:
        for key in [k for k in _open if k[0] != folder]:
            del _open[key]
        _open[folder, name] = SortedHashes(folder, name, bits)
    return _open[folder, name]


def _marked(batch: pa.RecordBatch, length: int, gram: int, folder: str, bits: int) -> pa.RecordBatch:
    s = Seeds(batch.column("text"), length, gram)
    of = bucket_of(s.anchor, bits)
    _, same = _opened(folder, "same", bits).places(s.extent, of)
    _, mixed = _opened(folder, "mixed", bits).places(s.anchor)
    settled, _, _ = s.windows(np.flatnonzero(same))
    first, h, anchor = s.windows(np.flatnonzero(mixed & ~same))
    _, found = _opened(folder, "window", bits).places(h, bucket_of(anchor, bits))
    repeats = np.r_[settled, first[found]]
    change = np.zeros(len(s.hashes) + 1, np.int64)
    np.add.at(change, repeats, 1)
    np.add.at(change, repeats + length, -1)
    removed = np.cumsum(change[:-1]) > 0
    data = memoryview(s.words.data.tobytes())
    rows = {"n_words": [], "n_removed": [], "kept_sha256": [], "spans": []}
    edges = s.words.first
    starts, stops = s.words.starts, s.words.ends
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        gone = removed[a:b]
        n = int(gone.sum())
        words = bytes(data[int(starts[a]) : int(stops[b - 1])]).split() if b > a else []
        step = np.diff(np.r_[0, gone.astype(np.int8), 0]) if n else np.empty(0)
        rows["n_words"].append(b - a)
        rows["n_removed"].append(n)
        rows["kept_sha256"].append(hashlib.sha256(b" ".join(compress(words, ~gone) if n else words)).hexdigest())
        rows["spans"].append([{"first": int(x), "end": int(y)} for x, y in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1))])
    span = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
    types = {"n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(), "spans": span}
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(rows[k], t) for k, t in types.items())], ["doc_id", *types])
