"""Sorted arrays of 64-bit hashes: counted by Spark tasks, stored in the shared folder, memory-mapped by readers.

Map tasks send each bucket (the top bits of a hash) packed sorted arrays of what they have counted, so a key with most of
the rows is one entry of each task. Reducers merge the arrays of one bucket and write files, atomically and under the same
name each time: a task that runs again writes the same.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from meterlake.llm.words import U64

BLOB_SCHEMA = "bucket int, blob binary"


def bucket_bits(docs: DataFrame) -> int:
    """Bits for about four buckets an input partition: a bucket is a bounded share of what a task reads."""
    return min(20, max(3, (4 * docs.rdd.getNumPartitions() - 1).bit_length()))


def bucket_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> U64(64 - bits)).astype(np.int64)


def _squeeze(a: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T) if len(a) else a
    return zstandard.compress(planes.tobytes(), 1)


def _expand(b: bytes, dtype: np.dtype, n: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(b), np.uint8)
    return np.ascontiguousarray(planes.reshape(dtype.itemsize, n).T).reshape(-1).view(dtype) if n else np.empty(0, dtype)


def pack(columns: list[np.ndarray]) -> bytes:
    """Arrays of one length; the first, sorted, is sent as differences."""
    first = columns[0].copy()
    first[1:] -= columns[0][:-1]
    return b"".join(len(x).to_bytes(8, "little") + x for x in (len(first).to_bytes(8, "little"), *(c.dtype.str.encode().ljust(4) + _squeeze(c) for c in (first, *columns[1:]))))


def unpack(blob: bytes) -> list[np.ndarray]:
    parts, at = [], 0
    while at < len(blob):
        n = int.from_bytes(blob[at : at + 8], "little")
        parts.append(blob[at + 8 : at + 8 + n])
        at += 8 + n
    n = int.from_bytes(parts[0], "little")
    columns = [_expand(p[4:], np.dtype(p[:4].decode().strip()), n) for p in parts[1:]]
    columns[0] = np.cumsum(columns[0], dtype=columns[0].dtype)
    return columns


def merged(columns: list[list[np.ndarray]], keys: int, most: int | None = None) -> list[np.ndarray]:
    """Rows of several tables as one: sorted by the first `keys` columns, the others summed (up to `most`)."""
    table = [np.concatenate(c) for c in zip(*columns)]
    order = np.argsort(table[0], kind="stable") if keys == 1 else np.lexsort(table[:keys][::-1])
    table = [c[order] for c in table]
    if not len(order):
        return table
    new = np.zeros(len(order), bool)
    new[0] = True
    for k in table[:keys]:
        new[1:] |= k[1:] != k[:-1]
    at = np.flatnonzero(new)
    sums = [np.add.reduceat(c, at, dtype=np.int64) for c in table[keys:]]
    return [k[at] for k in table[:keys]] + [np.minimum(s, most).astype(np.uint8) if most else s for s in sums]


class Counter:
    """Gathers rows of (keys..., counts...) in a task and gives them out as packed blobs for each bucket."""

    def __init__(self, keys: int, most: int | None = None, rows: int = 3_000_000) -> None:
        self.keys, self.most, self.rows, self.held, self.n = keys, most, rows, [], 0

    def add(self, columns: list[np.ndarray]) -> bool:
        """True if it is time to flush."""
        self.held.append(merged([columns], self.keys, self.most))
        self.n += len(self.held[-1][0])
        if self.n > self.rows:
            self.held = [merged(self.held, self.keys, self.most)]
            if len(self.held[0][0]) > self.rows // 2:
                return True
            self.n = len(self.held[0][0])
        return False

    def flush(self, bits: int, bucket=None) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        table = merged(self.held, self.keys, self.most)
        self.held, self.n = [], 0
        of = bucket(table) if bucket else bucket_of(table[0], bits)
        order = np.argsort(of, kind="stable")
        of, table = of[order], [c[order] for c in table]
        edges = np.flatnonzero(np.r_[True, of[1:] != of[:-1], True]) if len(of) else np.array([0])
        for a, b in zip(edges[:-1], edges[1:]):
            yield pa.RecordBatch.from_arrays([pa.array([int(of[a])], pa.int32()), pa.array([pack([c[a:b] for c in table])], pa.binary())], ["bucket", "blob"])


def merged_blobs(table: pa.Table, keys: int, most: int | None = None) -> list[np.ndarray]:
    return merged([unpack(b.as_py()) for b in table.column("blob")], keys, most)


def save(folder: str, name: str, array: np.ndarray) -> None:
    os.makedirs(folder, exist_ok=True)
    own = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with open(own, "wb") as f:
        np.save(f, array)
    os.replace(own, f"{folder}/{name}.npy")


def load(folder: str, name: str, dtype: type = np.uint64) -> np.ndarray:
    """Memory-mapped; empty if no reducer had rows for it."""
    path = f"{folder}/{name}.npy"
    return np.load(path, mmap_mode="r") if os.path.exists(path) else np.empty(0, dtype)


class SortedHashes:
    """Files `name-bucket` of sorted hashes."""

    def __init__(self, folder: str, name: str, bits: int) -> None:
        self.folder, self.name, self.bits, self.arrays = folder, name, bits, {}

    def array(self, bucket: int) -> np.ndarray:
        if bucket not in self.arrays:
            self.arrays[bucket] = load(self.folder, f"{self.name}-{bucket}")
        return self.arrays[bucket]

    def places(self, hashes: np.ndarray, buckets: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each hash its place in the file of its bucket and whether it is there."""
        of = bucket_of(hashes, self.bits) if buckets is None else buckets
        order = np.lexsort((hashes, of))
        place, found = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        sorted_of = of[order]
        edges = np.flatnonzero(np.r_[True, sorted_of[1:] != sorted_of[:-1], True]) if len(of) else np.array([0])
        for a, b in zip(edges[:-1], edges[1:]):
            own, at = self.array(int(sorted_of[a])), order[a:b]
            if len(own):
                p = np.searchsorted(own, hashes[at])
                inside = p < len(own)
                p[~inside] = 0
                place[at], found[at] = p, inside & (own[p] == hashes[at])
        return place, found
