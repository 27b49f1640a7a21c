"""An interpolated modified Kneser-Ney bigram model, counted in Spark and read as memory-mapped sorted hash arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlake.llm.hasharrays import BLOB_SCHEMA, Counter, SortedHashes, bucket_bits, bucket_of, load, merged_blobs, pack, save
from meterlake.llm.shared import mounted, new_folder
from meterlake.llm.words import U64, Words, mix, pieces

#: The hash of the end of a text, which is a token like others.
END = mix(np.array([0x656E64], U64))
#: Word ids of a block share a file of statistics; no more than MOST_BLOCKS files.
BLOCK_IDS, MOST_BLOCKS = 1 << 16, 4_096


@dataclass
class Model:
    folder: str
    bits: int
    offsets: np.ndarray  # of each bucket's first word id, and the number of words last
    tokens: int
    block: int
    pairs: np.ndarray  # distinct bigrams that occur once, twice, three and four times, and all of them
    discounts: np.ndarray  # of bigrams that occur once, twice and more often
    word_discounts: np.ndarray  # of words that follow one, two and more different words
    rest: float  # what words alone leave to the uniform distribution

    @property
    def words(self) -> int:
        return int(self.offsets[-1])


class Tokens:
    """Tokens of a slice in a row: words of a text, then an end. word: hashes; text: number of the text."""

    def __init__(self, column: pa.Array) -> None:
        words = Words(column, lower=True)
        n, texts = len(words.starts), len(column)
        self.n_texts = texts
        self.starts = words.first[:-1] + np.arange(texts)
        of = np.searchsorted(words.first[1:], np.arange(n), "right")
        self.hashes = np.full(n + texts, END[0], U64)
        self.hashes[np.arange(n) + of] = words.hashes()
        self.text = np.repeat(np.arange(texts), np.diff(np.r_[self.starts, n + texts]))


def _ids(hashes: np.ndarray, files: SortedHashes, offsets: np.ndarray) -> np.ndarray:
    """Word ids, -1 for unknown words."""
    distinct, back = np.unique(hashes, return_inverse=True)
    place, found = files.places(distinct)
    return np.where(found, offsets[bucket_of(distinct, files.bits)] + place, -1)[back]


def _pairs(ids: np.ndarray, starts: np.ndarray, begin: int) -> np.ndarray:
    """For each token the id before it (begin at a text's first) and its own, in one number; ids are below 2**32 - 1."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[starts] = begin
    return (before.astype(U64) << U64(32)) | (ids.astype(U64) & U64(0xFFFFFFFF))


def _discounts(n: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts from the numbers of things counted once to four times; fixed ones where these are 0."""
    if min(n[:4]) == 0:
        return np.array([0.5, 1.0, 1.5])
    y = n[0] / (n[0] + 2 * n[1])
    return np.clip([k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3)], 0.01, [1, 2, 3])


def _discount(c: np.ndarray, discounts: np.ndarray) -> np.ndarray:
    return np.r_[0.0, discounts][np.minimum(c, 3)]


def fit(docs: DataFrame, text: str = "text") -> Model:
    """Counts all texts of docs (white-space words, A-Z in lower case, and one end each; null is an empty text).

    Two passes: words, then pairs by word id. Map tasks send each bucket of hashes packed arrays of distinct words or pairs
    with counts; a very common word is one entry of each. What a context and a word need (how often, with how many
    different words) is added up by blocks of ids from all buckets.
    """
    docs = docs.select(F.col(f"`{text}`").alias("text"))
    url, bits = new_folder(docs.sparkSession, "ngrams"), bucket_bits(docs)
    folder = mounted(url)

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(1)
        for whole in batches:
            for batch in pieces(whole, "text"):
                h = Tokens(batch.column("text")).hashes
                if counter.add([h, np.ones(len(h), np.int64)]):
                    yield from counter.flush(bits)
        yield from counter.flush(bits)

    def store_words(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        h, n = merged_blobs(table, 1)
        save(folder, f"word-{key[0].as_py()}", h)
        save(folder, f"count-{key[0].as_py()}", n)
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "words": pa.array([len(h)]), "tokens": pa.array([int(n.sum())])})

    stored = docs.mapInArrow(count_words, BLOB_SCHEMA).groupBy("bucket").applyInArrow(store_words, "bucket int, words long, tokens long").collect()
    sizes = np.zeros((1 << bits) + 1, np.int64)
    for r in stored:
        sizes[r.bucket + 1] = r.words
    offsets = np.cumsum(sizes)
    words = int(offsets[-1])
    if words >= 1 << 32 - 1:
        raise ValueError("more distinct words than 32-bit ids")
    block = max(BLOCK_IDS, -(-(words + 1) // MOST_BLOCKS))

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, files = Counter(1), SortedHashes(folder, "word", bits)
        spread = lambda t: bucket_of(mix(t[0]), bits)
        for whole in batches:
            for batch in pieces(whole, "text"):
                t = Tokens(batch.column("text"))
                pairs = _pairs(_ids(t.hashes, files, offsets), t.starts, words)
                if counter.add([pairs, np.ones(len(pairs), np.int64)]):
                    yield from counter.flush(bits, spread)
        yield from counter.flush(bits, spread)

    def store_pairs(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        pairs, n = merged_blobs(table, 1)
        hashed = mix(pairs)
        order = np.argsort(hashed)
        save(folder, f"pair-{key[0].as_py()}", hashed[order])
        save(folder, f"pcount-{key[0].as_py()}", n[order].astype(np.uint32 if n.max(initial=0) < 1 << 32 else np.uint64))
        context, word, n = (pairs >> U64(32)).astype(np.int64), (pairs & U64(0xFFFFFFFF)).astype(np.int64), n.astype(np.int64)
        at = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
        sums = [np.add.reduceat(x, at) for x in (n, (n == 1).astype(np.int64), (n == 2).astype(np.int64), (n > 2).astype(np.int64))]
        after, different = np.unique(word, return_counts=True)
        buckets, blobs = [], []
        for kind, table_ in ((0, [context[at], *sums]), (1, [after, different.astype(np.int64)])):
            of = table_[0] // block
            edges = np.flatnonzero(np.r_[True, of[1:] != of[:-1], True])
            for a, b in zip(edges[:-1], edges[1:]):
                buckets.append(int(2 * of[a] + kind))
                blobs.append(pack([c[a:b] for c in table_]))
        return pa.table({"bucket": pa.array(buckets, pa.int32()), "blob": pa.array(blobs, pa.binary())})

    def store_stats(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        which, kind = divmod(key[0].as_py(), 2)
        ids, *sums = merged_blobs(table, 1)
        dense = np.zeros((block, len(sums)), np.int64)
        dense[ids - which * block] = np.stack(sums, axis=1)
        save(folder, f"{('context', 'after')[kind]}-{which}", dense)
        if kind:  # how many words follow one, two, three, four different words, and more than two; all
            n = sums[0]
            totals = [int((n == k).sum()) for k in (1, 2, 3, 4)] + [int((n > 2).sum()), int(n.sum())]
        else:  # pairs counted 1, 2, and more often
            totals = [int(x.sum()) for x in sums[1:]] + [0, 0, 0]
        return pa.table({"kind": pa.array([kind], pa.int32()), "totals": pa.array([totals], pa.list_(pa.int64()))})

    paired = docs.mapInArrow(count_pairs, BLOB_SCHEMA).groupBy("bucket").applyInArrow(store_pairs, BLOB_SCHEMA)
    stats = paired.groupBy("bucket").applyInArrow(store_stats, "kind int, totals array<long>").collect()
    after = np.sum([r.totals for r in stats if r.kind] or [[0] * 6], axis=0)
    pairs = _pair_counts(docs, folder, bits)
    word_discounts = _discounts(after)
    left = word_discounts @ np.array([after[0], after[1], after[4]])
    return Model(folder, bits, offsets, sum(r.tokens for r in stored), block, pairs, _discounts(pairs), word_discounts, float(left / after[5]) if after[5] else 1.0)


def _pair_counts(docs: DataFrame, folder: str, bits: int) -> np.ndarray:
    """How many distinct pairs occur once, twice, three and four times, and how many there are; one small row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.column("id"):
                n = load(folder, f"pcount-{b.as_py()}", np.uint32)
                yield pa.RecordBatch.from_arrays([pa.array([int((n == k).sum())]) for k in (1, 2, 3, 4)] + [pa.array([len(n)])], ["a", "b", "c", "d", "n"])

    spark = docs.sparkSession
    found = spark.range(1 << bits).mapInArrow(run, "a long, b long, c long, d long, n long").groupBy().sum().first()
    return np.array([x or 0 for x in found], np.int64)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of docs, and n_tokens, n_known, train_tokens, base_score, score (log10 probability), perplexity.

    score: the sum over tokens of log10 P(token | token before). P discounts each pair's count and gives what is left of the
    context to P(token), made from the number of different words before a token, discounted likewise, with the rest
    spread evenly over all words and one unknown word. After an unknown context P is P(token). base_score: add-one
    unigrams. Null and empty texts are one end. With nothing to train on every probability is 1. Columns of docs that
    have one of the new names are replaced.
    """
    added = {"n_tokens": T.LongType(), "n_known": T.LongType(), "train_tokens": T.LongType(), "base_score": T.DoubleType(), "score": T.DoubleType(), "perplexity": T.DoubleType()}
    own = [f for f in docs.schema.fields if f.name.lower() not in added or f.name == text]
    docs = docs.select(*[F.col(f"`{f.name}`") for f in own])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(model)
        for whole in batches:
            for batch in pieces(whole, text):
                t = Tokens(batch.column(text))
                n = np.bincount(t.text, minlength=t.n_texts)
                known, base, log_p = reader.tokens(t)
                sums = [np.bincount(t.text, x, t.n_texts) for x in (known, base, log_p)]
                new = [pa.array(n), pa.array(sums[0].astype(np.int64)), pa.array(np.full(len(n), model.tokens)), pa.array(sums[1]), pa.array(sums[2]), pa.array(10.0 ** np.minimum(-sums[2] / n, 300.0))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *added])

    return docs.mapInArrow(run, T.StructType([*own, *(T.StructField(k, v) for k, v in added.items())]))


class _Reader:
    def __init__(self, model: Model) -> None:
        self.m = model
        self.words, self.pairs = (SortedHashes(model.folder, name, model.bits) for name in ("word", "pair"))
        self.files: dict[str, np.ndarray] = {}

    def _file(self, name: str, dtype: type = np.int64) -> np.ndarray:
        if name not in self.files:
            self.files[name] = load(self.m.folder, name, dtype)
        return self.files[name]

    def _by(self, name: str, of: np.ndarray, place: np.ndarray, width: int | None = None) -> np.ndarray:
        """Entries `place` of the files name-of; `of` in any order."""
        out = np.zeros(len(of) if width is None else (len(of), width), np.int64)
        order = np.argsort(of, kind="stable")
        edges = np.flatnonzero(np.r_[True, of[order][1:] != of[order][:-1], True]) if len(of) else np.array([0])
        for a, b in zip(edges[:-1], edges[1:]):
            at, values = order[a:b], self._file(f"{name}-{int(of[order[a]])}")
            if len(values):
                out[at] = values[place[at]]
        return out

    def tokens(self, t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        m = self.m
        distinct, back = np.unique(t.hashes, return_inverse=True)
        place, found = self.words.places(distinct)
        of = bucket_of(distinct, m.bits)
        ids = np.where(found, m.offsets[of] + place, -1)
        count = np.where(found, self._by("count", of, place), 0)
        base = np.log10((count + 1) / (m.tokens + m.words + 1))
        after = np.where(found, self._by("after", np.maximum(ids, 0) // m.block, np.maximum(ids, 0) % m.block, 1)[:, 0], 0)
        types = max(int(m.pairs[4]), 1)
        alone = np.maximum(after - _discount(after, m.word_discounts), 0) / types + m.rest / (m.words + 1)
        known_pairs = _pairs(ids[back], t.starts, m.words)
        both, pair_back = np.unique(known_pairs, return_inverse=True)
        context, word = (both >> U64(32)).astype(np.int64), (both & U64(0xFFFFFFFF)).astype(np.int64)
        hashed = mix(both)
        at, there = self.pairs.places(hashed)
        n = np.where(there, self._by("pcount", bucket_of(hashed, m.bits), at), 0)
        seen = context <= m.words
        stats = self._by("context", np.where(seen, context, 0) // m.block, np.where(seen, context, 0) % m.block, 4)
        total = np.where(seen, stats[:, 0], 0)
        left = stats[:, 1:] @ m.discounts / np.maximum(total, 1)
        order = np.argsort(ids, kind="stable")
        unknown = m.rest / (m.words + 1)
        p_word = np.full(len(both), unknown)
        in_vocabulary = word < m.words
        p_word[in_vocabulary] = alone[order][np.searchsorted(ids[order], word[in_vocabulary])]
        p = np.where(total > 0, np.maximum(n - _discount(n, m.discounts), 0) / np.maximum(total, 1) + left * p_word, p_word)
        return found[back].astype(float), base[back], np.log10(p)[pair_back]


def token_scores(docs: DataFrame, modulus: int = 7, held_out: int = 2) -> DataFrame:
    """Scores of documents (doc_id, text) by a model of those whose crc32(doc_id as text) mod `modulus` is not `held_out`."""
    out = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus) == held_out
    marked = docs.select("doc_id", "text", out.alias("held_out"))
    return score(marked, fit(marked.where(~F.col("held_out")))).drop("text")
