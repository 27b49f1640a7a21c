"""Benchmark decontamination: Wu-Manber search for the word windows of benchmark items in documents."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlake.llm.shared import fresh

#: Items of about so many bytes of text are searched for, and broadcast, in one pass.
BLOCK_BYTES = 16 << 20

#: A-Z to lower case; ASCII other than letters and digits to blanks; all else as it is.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def folded_words(text: str | None) -> list[bytes]:
    return text.encode().translate(FOLD).split() if text else []


class WuManber:
    """All patterns of one length, in words. A block is the last two words looked at (one if patterns are of one word).

    shift: how far the search may go on after a block, for blocks that patterns have; others allow the whole length.
    ends: for a block that ends patterns, the patterns by their first block, each with its items.
    """

    def __init__(self, patterns: dict[tuple[bytes, ...], set[str]]) -> None:
        self.length = len(next(iter(patterns)))
        self.block = min(2, self.length)
        self.most = self.length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.ends: dict[tuple[bytes, ...], dict[tuple[bytes, ...], list[tuple[list[bytes], frozenset[str]]]]] = defaultdict(dict)
        for pattern, items in patterns.items():
            for end in range(self.block, self.length + 1):
                b = pattern[end - self.block : end]
                self.shift[b] = min(self.shift.get(b, self.most), self.length - end)
            self.ends[pattern[-self.block :]].setdefault(pattern[: self.block], []).append((list(pattern), frozenset(items)))
        self.ends = dict(self.ends)

    def search(self, words: list[bytes], hit: bytearray, items: set[str]) -> None:
        length, block, most, shift, n, done = self.length, self.block, self.most, self.shift, len(words), 0
        end = length
        while end <= n:
            b = tuple(words[end - block : end])
            step = shift.get(b, most)
            if step:
                end += step
                continue
            start = end - length
            for pattern, of in self.ends[b].get(tuple(words[start : start + block]), ()):
                if words[start:end] == pattern:
                    items |= of
                    low = max(start, done)
                    hit[low:end] = b"\1" * (end - low)
                    done = end
            end += 1


def machines(rows: list[tuple[str | None, str | None]], window: int) -> list[WuManber]:
    by_length: dict[int, dict[tuple[bytes, ...], set[str]]] = defaultdict(lambda: defaultdict(set))
    for item, text in rows:
        words = folded_words(text)
        if not words:
            continue
        width = min(window, len(words))
        for i in range(len(words) - width + 1):
            by_length[width][tuple(words[i : i + width])].add(item or "")
    return [WuManber(p) for _, p in sorted(by_length.items())]


def find_benchmark(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 13,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """All columns of docs, and n_words, n_hit, items (sorted ids as strings), contaminated.

    A document word inside any occurrence of a window of an item is hit. An item of fewer words than a window is one
    window; one without words has none. contaminated: at least one word in twenty is hit.

    Documents are not shuffled. Items are split by hash into blocks of about `block_bytes`; each block is broadcast and
    searched for in a pass over the documents, and passes are chained in one stage. Nulls: a null text has no words; items
    with a null id share the id "". Rows of one item_id are one item. An empty benchmark hits nothing. Columns of docs that
    have one of the new names are replaced.
    """
    spark = docs.sparkSession
    added = {"n_words": T.LongType(), "n_hit": T.LongType(), "items": T.ArrayType(T.StringType()), "contaminated": T.BooleanType()}
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in added or c == text])
    items = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("item"), F.col(f"`{item_text}`").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    out, mask = docs, fresh(docs, "__hit_mask")
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).collect()
        shared = spark.sparkContext.broadcast(machines([(r.item, r.text) for r in part], window))
        begun, last = k > 0, k == blocks - 1
        fields = [f for f in docs.schema.fields if f.name.lower() not in added]
        extra = [T.StructField(n, t) for n, t in added.items()] if last else [T.StructField(mask, T.BinaryType()), T.StructField("items", added["items"])]
        out = out.mapInArrow(_pass(shared, text, mask, [f.name for f in fields], begun, last), T.StructType(fields + extra))
    return out


def _pass(shared, text: str, mask: str, keep: list[str], begun: bool, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        for batch in batches:
            n_words, n_hit, hits, lists = [], [], [], []
            for i, value in enumerate(batch.column(text)):
                words = folded_words(value.as_py())
                hit, items = bytearray(len(words)), set()
                if begun:
                    hit = bytearray(np.unpackbits(np.frombuffer(batch.column(mask)[i].as_py(), np.uint8), count=len(words)).tobytes())
                    items = set(batch.column("items")[i].as_py())
                for m in found:
                    own = bytearray(len(words))
                    m.search(words, own, items)
                    if any(own):
                        hit = bytearray((np.frombuffer(hit, np.uint8) | np.frombuffer(own, np.uint8)).tobytes())
                n_words.append(len(words))
                n_hit.append(sum(hit))
                lists.append(sorted(items, key=str.encode))
                if not last:
                    hits.append(np.packbits(np.frombuffer(hit, np.uint8)).tobytes())
            columns = [batch.column(n) for n in keep]
            if last:
                columns += [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(lists, pa.list_(pa.string()))]
                columns += [pa.array([h > 0 and 20 * h >= n for n, h in zip(n_words, n_hit)], pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, [*keep, "n_words", "n_hit", "items", "contaminated"])
            else:
                yield pa.RecordBatch.from_arrays([*columns, pa.array(hits, pa.binary()), pa.array(lists, pa.list_(pa.string()))], [*keep, mask, "items"])

    return run
