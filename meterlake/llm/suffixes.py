"""Substring dedup on bytes: suffixes dealt by leading bytes, sorted in their bucket, equal neighbours marked."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlake.llm.hasharrays import SortedHashes, bucket_of, load, merged, save
from meterlake.llm.shared import mounted, new_folder, staged
from meterlake.llm.words import _BASE, _INVERSE, _VALUES, U64, mix, pieces, powers, text_bytes

#: Bytes of many texts, and window starts of one longer text, that are looked at in one go, and the most that the latter can be.
PIECE_BYTES, PART_BYTES, PART_MOST = 256 << 10, 4 << 20, 4 << 20
#: From so many units under one gram on, its windows are dealt out one by one. Changes the work, never the result.
CROWDED = 10_000
#: Hashes of a file, units of a shuffle partition, and units sorted at once.
FILE_ROWS, PARTITION_UNITS, SORTED_UNITS = 1 << 20, 40_000, 20_000


class Units:
    """The windows of some texts, gathered into units, which are what is dealt out.

    A window is `length` bytes. The gram of least hash within it (the leftmost of equal ones) is its gram, so equal windows
    have equal grams at equal places. Windows in a row that share one gram there are a unit: `count` windows from byte `first`
    on, with the gram at byte `place`. Every window is in one unit.
    """

    def __init__(self, data: np.ndarray, first: np.ndarray, length: int, gram: int) -> None:
        self.data, self.length, self.gram, n = data, length, gram, len(data)
        self.total = np.zeros(n + 1, U64)
        np.cumsum(_VALUES[data] * powers(_BASE, n), out=self.total[1:])
        self.back = powers(_INVERSE, n + 1)
        starts = max(0, n - length + 1)
        end_of = np.repeat(first[1:], np.diff(first))
        start = np.flatnonzero(np.arange(length, length + starts) <= end_of[:starts])
        grams = mix((self.total[gram:] - self.total[:-gram]) * self.back[: n - gram + 1]) if starts else np.empty(0, U64)
        place = _leftmost_least(grams, length - gram + 1)[start] if starts else start
        new = np.flatnonzero(np.r_[True, place[1:] != place[:-1]][: len(place)])
        self.first, self.place = start[new], place[new]
        self.count = np.diff(np.r_[new, len(place)])
        # The least of many hashes are small; mixed again, they spread over all files.
        self.anchor = mix(~grams[self.place])
        whole = (self.total[self.first + self.count + length - 1] - self.total[self.first]) * self.back[self.first]
        self.unit = mix(whole ^ mix((self.place - self.first).astype(U64) << U64(32) | self.count.astype(U64)))

    def windows(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First bytes and hashes of all windows of the chosen units."""
        count = self.count[chosen]
        start = np.repeat(self.first[chosen], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return start, mix(~((self.total[start + self.length] - self.total[start]) * self.back[start]))


def _leftmost_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The place of the least of keys[i : i + width] for each i, by minima over 1, 2, 4, ... keys.

    The place stands in the low bits of a key, so the leftmost of keys that agree in the others counts as the least.
    """
    low, size = U64((2 * PART_MOST) - 1), 1
    keys = keys & ~low | np.arange(len(keys), dtype=U64)
    while size < width:
        step = min(size, width - size)
        keys = np.minimum(keys[:-step], keys[step:])
        size += step
    return (keys & low).astype(np.int64)


def _parts(column: pa.Array, length: int, part: int = PART_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place of its first byte, bytes, text boundaries) of all texts, or of overlapping parts of one long text.

    Parts overlap by a window less a byte, so that every window lies in one part.
    """
    data, first = text_bytes(column)
    if len(data) <= 2 * part:
        yield 0, data, first
    else:
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            for i in range(a, b, part):
                end = min(b, i + part + length - 1)
                yield i, data[i:end], np.array([0, end - i])


@dataclass
class Repeats:
    """Files of sorted hashes in the shared folder, as far as they are written."""

    folder: str
    length: int
    gram: int
    bits: dict[str, int]
    part: int

    def units(self, column: pa.Array) -> Iterator[tuple[int, Units]]:
        for at, data, first in _parts(column, self.length, self.part):
            yield at, Units(data, first, self.length, self.gram)

    def has(self, name: str, hashes: np.ndarray) -> np.ndarray:
        return self._sorted(name).places(hashes)[1] if name in self.bits else np.zeros(len(hashes), bool)

    def masks(self, hashes: np.ndarray) -> np.ndarray:
        """A row for each hash: a bit for each of its windows that occurs again."""
        out = np.zeros((len(hashes), -(-(self.length - self.gram + 1) // 64)), U64)
        if "result" not in self.bits:
            return out
        place, found = self._sorted("result").places(hashes)
        at = np.flatnonzero(found)
        of = bucket_of(hashes[at], self.bits["result"])
        order = np.argsort(of, kind="stable")
        at, of = at[order], of[order]
        edges = np.flatnonzero(np.r_[True, of[1:] != of[:-1], True]) if len(of) else np.array([0])
        for a, b in zip(edges[:-1], edges[1:]):
            out[at[a:b]] = load(self.folder, f"mask-{of[a]}")[place[at[a:b]]]
        return out

    def _sorted(self, name: str) -> SortedHashes:
        """Kept by a Python worker for as long as it works on the same folder."""
        key = (self.folder, name)
        if key not in _open:
            for other in [k for k in _open if k[0] != self.folder]:
                del _open[other]
            _open[key] = SortedHashes(self.folder, name, self.bits[name])
        return _open[key]

    def write(self, name: str, rows: DataFrame) -> None:
        """Writes rows (hash, mask if there are any) to files by the leading bits of the hash."""
        n = rows.count()
        if not n:
            return
        bits, folder = max(5, (n // FILE_ROWS).bit_length()), self.folder

        def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            bucket, hashes = key[0].as_py(), table.column("hash").to_numpy().view(U64)
            order = np.argsort(hashes)
            if "mask" in table.column_names:
                masks = np.frombuffer(b"".join(table.column("mask").to_pylist()), U64).reshape(len(hashes), -1)
                save(folder, f"mask-{bucket}", masks[order])
            save(folder, f"{name}-{bucket}", hashes[order])
            return pa.table({"bucket": pa.array([bucket], pa.int32())})

        bucket = F.shiftrightunsigned("hash", 64 - bits).cast("int").alias("bucket")
        rows.select(bucket, "*").groupBy("bucket").applyInArrow(run, "bucket int").count()
        self.bits[name] = bits


_open: dict[tuple[str, str], SortedHashes] = {}


def _counts(docs: DataFrame, rows, names: list[str], keys: int = 1) -> DataFrame:
    """Sums of what rows(column) gives as (key, numbers), first within each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for whole in batches:
            for batch in pieces(whole, "text", PIECE_BYTES):
                for columns in rows(batch.column("text")):
                    held.append(merged([columns], keys))
                    n += len(held[-1][0])
                    if n > 4_000_000:
                        yield from out(held)
                        held, n = [], 0
        yield from out(held)

    def out(held: list) -> Iterator[pa.RecordBatch]:
        table = merged(held, keys) if held else [np.empty(0, U64)] * len(names)
        for i in range(0, len(table[0]), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 100_000].view(np.int64)) for c in table], names)

    schema = ", ".join(f"{c} long" for c in names)
    return docs.mapInArrow(run, schema).groupBy(names[0]).agg(*[F.sum(c).alias(c) for c in names[1:]])


def _grams_seen(docs: DataFrame, own: Repeats) -> DataFrame:
    """(hash, n, units): how often each gram is that of a unit, and in how many different units of a task, over all tasks."""

    def rows(column: pa.Array) -> Iterator[list[np.ndarray]]:
        for _, u in own.units(column):
            anchor, _, n = merged([[u.anchor, u.unit, np.ones(len(u.unit), np.int64)]], 2)
            yield [anchor, n, np.ones(len(n), np.int64)]

    return _counts(docs, rows, ["hash", "n", "units"])


def _windows_seen(docs: DataFrame, own: Repeats) -> DataFrame:
    """(hash, n) of all windows of crowded grams."""

    def rows(column: pa.Array) -> Iterator[list[np.ndarray]]:
        for _, u in own.units(column):
            _, h = u.windows(np.flatnonzero(own.has("crowded", u.anchor)))
            yield [h, np.ones(len(h), np.int64)]

    return _counts(docs, rows, ["hash", "n"])


_UNIT = "lead binary, shift int, hash long, body binary, n int"


def _units(docs: DataFrame, own: Repeats) -> DataFrame:
    """Units that can hold a repeat: equal ones of a task as one row, n of them (2 for any more).

    lead: the suffix from the gram on, as far as the gram; shift: the place of the gram in the body. Windows of crowded grams
    are units of their own: the lead is the whole window, and there is no shift.
    """
    length, gram = own.length, own.gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        size = 0
        for whole in batches:
            for batch in pieces(whole, "text", PIECE_BYTES):
                for _, u in own.units(batch.column("text")):
                    data = memoryview(u.data.tobytes())
                    one_by_one = own.has("crowded", u.anchor)
                    chosen = np.flatnonzero(own.has("seen", u.anchor) & ~one_by_one)
                    for f, c, p, h in zip(u.first[chosen].tolist(), u.count[chosen].tolist(), u.place[chosen].tolist(), u.unit[chosen].view(np.int64).tolist()):
                        key = (bytes(data[f : f + c - 1 + length]), p - f)
                        size += 0 if key in held else c + length
                        held.setdefault(key, [bytes(data[p : p + gram]), h, 0])[2] += 1
                    start, h = u.windows(np.flatnonzero(one_by_one))
                    again = own.has("again", h)
                    for s, x in zip(start[again].tolist(), h[again].view(np.int64).tolist()):
                        body = bytes(data[s : s + length])
                        size += 0 if (body, None) in held else length
                        held.setdefault((body, None), [body, x, 0])[2] += 1
                if size > 64 << 20:
                    yield from out(held)
                    held, size = {}, 0
        yield from out(held)

    def out(held: dict[tuple, list]) -> Iterator[pa.RecordBatch]:
        keys = list(held)
        for i in range(0, len(keys), 5_000):
            part = [(k, held[k]) for k in keys[i : i + 5_000]]
            columns = [
                pa.array([v[0] for _, v in part], pa.binary()),
                pa.array([k[1] for k, _ in part], pa.int32()),
                pa.array([v[1] for _, v in part], pa.int64()),
                pa.array([k[0] for k, _ in part], pa.binary()),
                pa.array([min(2, v[2]) for _, v in part], pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["lead", "shift", "hash", "body", "n"])

    return docs.mapInArrow(run, _UNIT)


def sort_equal(data: np.ndarray, start: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """For windows data[start : start + length], sorted by multikey quicksort within groups: whether another one is equal.

    A key is eight bytes. Only windows that still have an equal neighbour are sorted by the next key.
    """
    words = np.ndarray((max(0, len(data) - 7),), ">u8", np.ascontiguousarray(data), strides=(1,))
    left = np.arange(len(start))
    depths = [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])] if length >= 8 else []
    for depth in [None, *depths]:
        key = words[start[left] + depth].astype(U64) if depth is not None else None
        order = np.lexsort((key, group)) if key is not None else np.argsort(group, kind="stable")
        left, group = left[order], group[order]
        edge = group[1:] != group[:-1]
        if key is not None:
            key = key[order]
            edge |= key[1:] != key[:-1]
        new = np.r_[True, edge][: len(left)]
        alone = new & np.r_[new[1:], True][: len(left)]
        group, left = np.cumsum(new)[~alone], left[~alone]
    equal = np.zeros(len(start), bool)
    equal[left] = True
    return equal


def _settled(rows: dict[tuple, list], length: int, gram: int) -> tuple[list[int], list[bytes]]:
    """Hashes and masks of the units of some leads, those of a lead together, that hold a window which occurs again."""
    bodies, shifts, leads, n = [k[0] for k in rows], [k[1] for k in rows], [v[0] for v in rows.values()], np.array([v[2] for v in rows.values()])
    numbers: dict[bytes, int] = {}
    lead = np.array([numbers.setdefault(x, len(numbers)) for x in leads])
    size = np.array([len(b) for b in bodies])
    first, count = np.cumsum(size) - size, size - length + 1
    unit = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(unit)) - np.repeat(np.cumsum(count) - count, count)
    shift = np.array([length if s is None else s for s in shifts])[unit] - nth
    sharing = (np.bincount(lead)[lead] > 1)[unit]
    at = np.flatnonzero(sharing)
    again = np.repeat(n > 1, count)
    group = lead[unit[at]] * (2 * length) + shift[at] + length
    again[at] |= sort_equal(np.frombuffer(b"".join(bodies) + bytes(8), np.uint8), (first[unit] + nth)[at], group, length)
    masks = np.zeros((len(size), -(-(length - gram + 1) // 64) * 64), bool)
    masks[unit[again], nth[again]] = True
    some = masks.any(axis=1)
    packed = np.packbits(masks[some], axis=1, bitorder="little")
    hashes = [v[1] for v in rows.values()]
    return [hashes[i] for i in np.flatnonzero(some).tolist()], [m.tobytes() for m in packed]


def _sorted_units(units: DataFrame, own: Repeats, partitions: int) -> DataFrame:
    """(hash, mask) of units with repeated windows.

    Splitters are sampled leads. A lead lies in one partition, so windows on two sides of a boundary differ in their leads and
    need no comparison. Leads arrive in order and are settled some at a time, so memory doesn't grow with the partition.
    """
    length, gram = own.length, own.gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        last = None
        for batch in batches:
            for lead, shift, h, body, n in zip(*(batch.column(c).to_pylist() for c in ("lead", "shift", "hash", "body", "n"))):
                if lead != last and len(held) >= SORTED_UNITS:
                    yield out(held)
                    held = {}
                last = lead
                held.setdefault((body, shift), [lead, h, 0])[2] += n
        if held:
            yield out(held)

    def out(held: dict[tuple, list]) -> pa.RecordBatch:
        hashes, masks = _settled(held, length, gram)
        return pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(masks, pa.binary())], ["hash", "mask"])

    dealt = units.repartitionByRange(partitions, "lead").sortWithinPartitions("lead")
    return dealt.mapInArrow(run, "hash long, mask binary")


def remove_repeats(docs: DataFrame, length: int = 200, gram: int = 64, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, spans, kept) for each row of docs.

    Texts are UTF-8 bytes. A byte goes if a string of `length` bytes over it also starts anywhere else, in the same text
    (overlapping or not) or another; strings don't reach from one text into the next and are judged on the input. spans: the
    maximal removed runs as [first byte, end). kept: the other bytes.

    A suffix is a position, and of it only `length` bytes matter. Suffixes in a row that share a gram are one unit and travel
    as one string. Grams that occur once in all texts have no repeat and stay where they are (hashes are counted, so none is
    missed). The other units are range-partitioned by the suffix that begins at their gram, with sampled splitters; each
    partition sorts all suffixes of its units by multikey quicksort on their bytes and marks equal neighbours. Equal units are
    one row of each task, and where one gram has very many different units, its suffixes are dealt out one by one, so no
    partition holds what grows with the corpus. Results are looked up by a 64-bit hash of the unit.

    Null and empty texts, and those shorter than `length`, keep all bytes. Repeated rows repeat each other. Columns of docs
    other than the two named are not looked at. The shared folder must be mounted, as tasks map files there.
    """
    if not 1 <= gram <= length or not 8 <= length <= PART_MOST:
        raise ValueError(f"a gram of {gram} bytes must lie in a string of {length}, of 8 to {PART_MOST}")
    docs = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    own = Repeats(mounted(new_folder(docs.sparkSession, "suffixes")), length, gram, {}, PART_BYTES)
    texts = docs.select("text")
    grams = staged(_grams_seen(texts, own).where("n > 1"), "grams")
    own.write("seen", grams.select("hash"))
    own.write("crowded", grams.where(F.col("units") > CROWDED).select("hash"))
    if "crowded" in own.bits:
        own.write("again", _windows_seen(texts, own).where("n > 1").select("hash"))
    if "seen" in own.bits:
        expected = grams.agg(F.sum(F.least("units", F.lit(CROWDED)))).first()[0]
        units = staged(_units(texts, own), "units")
        own.write("result", staged(_sorted_units(units, own, max(1, expected // PARTITION_UNITS)), "results"))
    span = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType())]))
    fields = [docs.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("spans", span), T.StructField("kept", T.BinaryType())]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text", PIECE_BYTES):
                yield _marked(batch, own)

    return docs.mapInArrow(mark, T.StructType(fields))


def _marked(batch: pa.RecordBatch, own: Repeats) -> pa.RecordBatch:
    data, first = text_bytes(batch.column("text"))
    change = np.zeros(len(data) + 1, np.int32)
    for at, u in own.units(batch.column("text")):
        one_by_one = own.has("crowded", u.anchor)
        units = np.flatnonzero(own.has("seen", u.anchor) & ~one_by_one)
        masks = own.masks(u.unit[units])
        row, nth = np.nonzero(np.unpackbits(masks.view(np.uint8).reshape(len(units), masks.shape[1] * 8), axis=1, bitorder="little"))
        start, h = u.windows(np.flatnonzero(one_by_one))
        again = own.has("result", h)
        repeats = np.r_[u.first[units[row]] + nth, start[again]] + at
        np.add.at(change, repeats, 1)
        np.add.at(change, repeats + own.length, -1)
    removed = np.cumsum(change[:-1], dtype=np.int32) > 0
    text = memoryview(data.tobytes())
    spans, kept = [], []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        gone = removed[a:b]
        if gone.any():
            step = np.diff(np.r_[0, gone.astype(np.int8), 0])
            spans.append([{"first": int(x), "end": int(y)} for x, y in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1))])
            kept.append(data[a:b][~gone].tobytes())
        else:
            spans.append([])
            kept.append(bytes(text[a:b]))
    span = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
    columns = [batch.column("doc_id"), pa.array(np.diff(first)), pa.array(spans, span), pa.array(kept, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "spans", "kept"])
