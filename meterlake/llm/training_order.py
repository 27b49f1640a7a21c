"""Token ids in training order: fixed-stride shards in which a keyed permutation gives every sequence its slot."""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlake.llm.shared import fresh, mounted, new_folder, staged
from meterlake.llm.words import U64, mix, pieces

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the tokenizer's public vocabulary splits text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SEQUENCE_TOKENS, SHARD_SEQUENCES, SEED = 512, 8_192, 2024
#: A piece of a text that is tokenised at once; pieces end before a blank, where the splitting pattern ends too.
PIECE_CHARACTERS = 1 << 20
#: Text of a staged blob of tokens, tokens that are dealt to shards at once, and the level at which both are compressed.
BLOB_BYTES, DEALT_TOKENS, LEVEL = 1 << 19, 2 << 20, 6


@lru_cache(maxsize=2)
def tokenizer(path: str) -> tiktoken.Encoding:
    """Read from a path that every worker has (the vocabulary is installed, not part of the input)."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


class Permutation:
    """A keyed bijection of 0 ... n - 1: a balanced Feistel network on the next even number of bits, walked until it is below n."""

    def __init__(self, n: int, seed: int, rounds: int = 6) -> None:
        self.n = n
        self.half = U64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
        self.mask = (U64(1) << self.half) - U64(1)
        self.keys = mix(np.arange(1, rounds + 1, dtype=U64) + mix(np.array([seed], U64)))

    def _through(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for k in self.keys:
            left, right = right, left ^ (mix(right ^ k) & self.mask)
        return (left << self.half) | right

    def _back(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for k in self.keys[::-1]:
            left, right = right ^ (mix(left ^ k) & self.mask), left
        return (left << self.half) | right

    def _walk(self, x: np.ndarray, step) -> np.ndarray:
        y = step(np.asarray(x, U64))
        while (out := y >= self.n).any():
            y[out] = step(y[out])
        return y.astype(np.int64)

    def slot(self, sequence: np.ndarray) -> np.ndarray:
        return self._walk(sequence, self._through)

    def sequence(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, self._back)


def _ids(encoding: tiktoken.Encoding, text: str) -> list[np.ndarray]:
    """Ids of a text, of one piece after another."""
    out, at = [], 0
    while at < len(text):
        end = at + PIECE_CHARACTERS
        while end < len(text) and not (text[end] == " " and text[end - 1].isalnum() and text[end + 1 : end + 2].isalpha()):
            end += 1
        ids = encoding.encode_ordinary(text[at:end])
        out.append(np.fromiter(ids, "<u2", len(ids)))
        at = end
    return out


def _tokenised(docs: DataFrame, text: str, tokens: str, path: str) -> DataFrame:
    """docs without its text, with its number of tokens (an end of each text included), its input partition, and its place there.

    The first row of some documents in a row has the tokens of all of them (zstd of 16-bit ids).
    """
    keep = [f for f in docs.schema.fields if f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, at, part = tokenizer(path), 0, TaskContext.get().partitionId()
        if encoding.n_vocab >= 1 << 16:
            raise ValueError("ids do not fit 16 bits")
        end = np.array([encoding.n_vocab], "<u2")
        for whole in batches:
            for batch in pieces(whole, text, BLOB_BYTES):
                each = [[*_ids(encoding, t.as_py() or ""), end] for t in batch.column(text)]
                counts = np.array([sum(map(len, x)) for x in each], np.int64)
                blob = zstandard.compress(np.concatenate([a for x in each for a in x]).tobytes(), LEVEL)
                begins = at + np.cumsum(counts) - counts
                at += int(counts.sum())
                columns = [batch.column(f.name) for f in keep]
                own = [pa.array([blob] + [None] * (len(counts) - 1), pa.binary()), pa.array(counts), pa.array(begins), pa.array(np.full(len(counts), part, np.int32))]
                yield pa.RecordBatch.from_arrays([*columns, *own], [*(f.name for f in keep), tokens, f"{tokens}_n", f"{tokens}_at", f"{tokens}_part"])

    more = [(tokens, T.BinaryType()), (f"{tokens}_n", T.LongType()), (f"{tokens}_at", T.LongType()), (f"{tokens}_part", T.IntegerType())]
    return docs.mapInArrow(run, T.StructType([*keep, *(T.StructField(n, t) for n, t in more)]))


def materialise(docs: DataFrame, text: str = "text", folder: str | None = None, length: int = SEQUENCE_TOKENS, per_shard: int = SHARD_SEQUENCES, seed: int = SEED, path: str = TOKENIZER) -> tuple[DataFrame, DataFrame, str]:
    """Writes shards; gives (documents, shards, folder).

    Texts are tokenised in the order of the input's partitions, each followed by an end id (the first id beyond the
    vocabulary), into one stream that is cut into sequences of `length` ids; the last is padded with end ids. A keyed Feistel
    permutation with cycle-walking gives each sequence its slot. Shard k has slots k * per_shard and on, one after another,
    as little-endian 16-bit ids: the place of a slot in the files follows from its number, so a reader reads in training order
    from any slot on.

    documents: the columns of docs but for its text, and n_tokens, first_token (place in the stream), slots (of the
    sequences with its tokens, in stream order), shards. shards: shard, path, first_slot, n_sequences, sha256.

    Tokens are staged once; what follows is the same each time. Only token counts of input partitions come to the driver.
    Pieces of the stream go to the shard's range of slots, compressed; a group is one shard, whose size is fixed. Files are
    written under a name of their own and renamed. A null text is empty and has only its end. Without rows nothing is written.
    Repeated rows are written each time. Columns of docs that have one of the new names are replaced.
    """
    spark = docs.sparkSession
    added = ("n_tokens", "first_token", "slots", "shards")
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in added or c == text])
    name = fresh(docs, "__tokens")
    rows = staged(_tokenised(docs, text, name, path), "tokens")
    sizes = {r["part"]: r["n"] for r in rows.groupBy(F.col(f"{name}_part").alias("part")).agg(F.sum(f"{name}_n").alias("n")).collect()}
    base, total = np.zeros(max(sizes, default=0) + 1, np.int64), 0
    for part in sorted(sizes):
        base[part], total = total, total + sizes[part]
    order = Permutation(max(1, -(-total // length)), seed)
    url = folder or new_folder(spark, "shards")
    target = mounted(url)
    end = tokenizer(path).n_vocab

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What some of the stream has for each shard: slot, place and length of each piece, and their ids together."""
        places, ids, held = [], [], 0

        def dealt() -> pa.RecordBatch:
            rows, all_ids = np.concatenate(places), [x for part in ids for x in part]
            shard = rows[:, 0] // per_shard
            by_shard = np.argsort(shard, kind="stable")
            edges = np.flatnonzero(np.diff(shard[by_shard], prepend=-1, append=-1))
            groups = [by_shard[a:b] for a, b in zip(edges[:-1], edges[1:])]
            where = pa.array([rows[g].astype("<i8").tobytes() for g in groups], pa.binary())
            packed = pa.array([zstandard.compress(np.concatenate([all_ids[k] for k in g]).tobytes(), LEVEL) for g in groups], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([int(shard[g[0]]) for g in groups], pa.int64()), where, packed], ["shard", "places", "ids"])

        for batch in batches:
            for blob, at, part in zip(batch.column(name), batch.column(f"{name}_at"), batch.column(f"{name}_part")):
                tokens = np.frombuffer(zstandard.decompress(blob.as_py()), "<u2")
                first = base[part.as_py()] + at.as_py()
                sequences = np.arange(first // length, (first + len(tokens) - 1) // length + 1)
                begins = np.maximum(sequences * length, first) - first
                ends = np.minimum((sequences + 1) * length - first, len(tokens))
                places.append(np.stack([order.slot(sequences), first + begins - sequences * length, ends - begins], axis=1))
                ids.append([tokens[a:b] for a, b in zip(begins.tolist(), ends.tolist())])
                held += len(tokens)
                if held >= DEALT_TOKENS:
                    yield dealt()
                    places, ids, held = [], [], 0
        if held:
            yield dealt()

    def write(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        first = shard * per_shard
        n = min(per_shard, order.n - first)
        out = np.full((n, length), end, "<u2")
        for places, ids in zip(table.column("places"), table.column("ids")):
            tokens, at = np.frombuffer(zstandard.decompress(ids.as_py()), "<u2"), 0
            for slot, place, count in np.frombuffer(places.as_py(), "<i8").reshape(-1, 3).tolist():
                out[slot - first, place : place + count] = tokens[at : at + count]
                at += count
        data = out.tobytes()
        os.makedirs(target, exist_ok=True)
        file = f"{target}/shard-{shard:08d}.bin"
        own = f"{target}/.shard-{shard:08d}-{uuid.uuid4().hex}"
        with open(own, "wb") as f:
            f.write(data)
        os.replace(own, file)
        return pa.table({"shard": pa.array([shard], pa.int64()), "path": [file], "first_slot": pa.array([first], pa.int64()), "n_sequences": pa.array([n], pa.int64()), "sha256": [hashlib.sha256(data).hexdigest()]})

    cuts = rows.where(F.col(name).isNotNull()).select(name, f"{name}_at", f"{name}_part").mapInArrow(cut, "shard long, places binary, ids binary")
    shards = staged(cuts.groupBy("shard").applyInArrow(write, "shard long, path string, first_slot long, n_sequences long, sha256 string"), "index")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = base[batch.column(f"{name}_part").to_numpy()] + batch.column(f"{name}_at").to_numpy()
            n = batch.column(f"{name}_n").to_numpy()
            slots = [order.slot(np.arange(a // length, (a + k - 1) // length + 1)).tolist() for a, k in zip(first, n)]
            new = [pa.array(n), pa.array(first), pa.array(slots, pa.list_(pa.int64())), pa.array([sorted({x // per_shard for x in s}) for s in slots], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *new], [*(f.name for f in kept), *added])

    kept = [f for f in docs.schema.fields if f.name != text]
    types = [T.LongType(), T.LongType(), T.ArrayType(T.LongType()), T.ArrayType(T.LongType())]
    documents = rows.drop(name).mapInArrow(placed, T.StructType([*kept, *(T.StructField(n, t) for n, t in zip(added, types))]))
    return documents, shards, url


def read_slots(folder: str, first: int, n: int, length: int = SEQUENCE_TOKENS, per_shard: int = SHARD_SEQUENCES) -> np.ndarray:
    """n sequences in training order from slot `first` on, each by one sequential read of its shard."""
    out = []
    while n > 0:
        shard, at = divmod(first, per_shard)
        file = f"{mounted(folder)}/shard-{shard:08d}.bin"
        have = os.path.getsize(file) // (2 * length) - at
        part = np.fromfile(file, "<u2", min(n, have) * length, offset=2 * at * length).reshape(-1, length)
        if not len(part):
            break
        out.append(part)
        first, n = first + len(part), n - len(part)
    return np.concatenate(out) if out else np.empty((0, length), "<u2")
