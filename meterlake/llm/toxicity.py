"""Toxicity by the nearest labelled examples: exact TF-IDF cosine of all words over an inverted index with block maxima."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlake.llm.hasharrays import load, save
from meterlake.llm.labelled import examples
from meterlake.llm.shared import mounted, new_folder, staged
from meterlake.llm.words import Words, pieces

#: Labelled rows to learn from, at most; all their words are indexed.
MOST_EXAMPLES = 16_384
#: Examples of a block, texts searched at once, and blocks that are searched before the first bound is known.
BLOCK, TEXTS, FIRST_BLOCKS = 1024, 64, 1
#: Bytes of text that are looked at together, so that the arrays of their words stay small.
PIECE_BYTES = 1 << 19
#: Words of more than one in so many examples are common; blocks are of examples with the same common words.
COMMON = 8
#: Words of more than one in so many examples of a block are columns of the block's matrix instead of postings.
DENSE = 8
#: Texts from this score on are toxic.
THRESHOLD = 0.7
NEIGHBOURS, GRAM, LEAST_EXAMPLES = 15, 5, 3
#: A mark must be tied to toxic examples by this chi-squared value, and be so many times as likely in them as in clean ones.
CHI2, LIFT = 25.0, 2.0
#: Rounding of 32-bit sums that bounds must allow for.
CLOSE = 1e-5
_OTHER = re.compile(r"[\W_]+")


def normal(text: str | None) -> str:
    """Lower case, with one blank before, between and after words."""
    # Most words stand between blanks; only what holds other signs is searched for them.
    parts = [t if t.isalnum() else _OTHER.sub(" ", t).strip() for t in (text or "").lower().split()]
    return f" {' '.join(filter(None, parts))} " if any(parts) else " "


def pieces_of(line: str) -> set[str]:
    """What can be a mark: words, with their blanks, their pieces of five characters and their longer beginnings, blanks included."""
    out = set()
    for word in set(line.split()):
        padded = f" {word} "
        out.add(padded)
        out.update(padded[i : i + GRAM] for i in range(len(padded) - GRAM + 1))
        out.update(padded[:i] for i in range(GRAM + 1, min(GRAM + 5, len(padded))))
    return out


def counted_words(lines: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, count) of the different words of each text, by text and hash."""
    words = Words(lines)
    h = words.hashes()
    text = np.repeat(np.arange(len(lines)), np.diff(words.first))
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        h[a:b].sort()
    new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (text[1:] != text[:-1])][: len(h)])
    return text[new], h[new], np.diff(np.r_[new, len(h)])


@dataclass
class Index:
    """Where the arrays of the examples lie, and what is learned besides.

    Arrays, by word: words (hashes, sorted), idf, entries (a word's entries lie from there to the next). An entry is a word in
    a block: entry_block, entry_most (the largest weight there), entry_posted and entry_size (where its postings lie, and how
    many), entry_column (of words that are frequent there and have no postings: block times width of the matrix plus column;
    -1 else). postings: example and weight, 32 bits each. matrix: block by example by column, of which a block uses its own
    number (columns). By example: ids, labels, rank (place by id).
    """

    folder: str
    n: int
    marks: list[str]
    mark_idf: np.ndarray
    prior: float
    unmatched: float  # share of toxic among examples without marks, for texts that share no word with any example
    curve: tuple[float, ...] = (1.0, 0.0, 0.0, 0.0)  # of the log-odds of votes, the strength of marks, 1, and no marks

    def __getattr__(self, name: str) -> np.ndarray:
        if name.startswith("_"):
            raise AttributeError(name)
        array = np.asarray(load(self.folder, name))
        self.__dict__[name] = array
        return array

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in self.__dataclass_fields__}

    def strengths(self, lines: list[str]) -> np.ndarray:
        """How strongly each text is marked: the length of the TF-IDF vector of its marks."""
        if not self.marks:
            return np.zeros(len(lines))
        if "_found" not in self.__dict__:
            self._found = ahocorasick.Automaton()
            for i, t in enumerate(self.marks):
                self._found.add_word(t, i)
            self._found.make_automaton()
        out = np.zeros(len(lines))
        for k, line in enumerate(lines):
            counts = Counter(i for _, i in self._found.iter(line))
            if counts:
                out[k] = np.linalg.norm((1 + np.log(np.fromiter(counts.values(), float))) * self.mark_idf[list(counts)])
        return out

    def vectors(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, word, weight): (1 + log count) * idf of the words that examples have, each text scaled to length 1."""
        if not self.n:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        text, h, count = counted_words(pa.array(lines, pa.string()))
        word = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        known = self.words[word] == h
        text, word, count = text[known], word[known], count[known]
        weight = (1 + np.log(count)) * self.idf[word]
        square = np.bincount(text, weight * weight, len(lines))
        return text, word, weight / np.sqrt(square[text])

    def nearest(self, lines: list[str], k: int, but: list[str] | None = None) -> list[list[tuple[float, int]]]:
        """For each text the k examples of the largest cosine above 0 (of equal ones those that come first by id), and their cosines.

        A block can't hold a larger cosine than the sum of its largest weights. The blocks of the largest sums are searched
        first; then all those whose sum reaches the k-th best cosine found there, and no others. What may be among the best is
        computed again from the whole vectors with 64 bits, in an order that doesn't depend on the other texts.
        """
        text, word, weight = self.vectors(lines)
        edges = np.searchsorted(text, np.arange(len(lines) + 1))
        full = np.flatnonzero(np.diff(edges))
        if not len(full):
            return [[] for _ in lines]
        blocks = len(self.columns)
        own, most = {}, np.zeros((len(full), blocks))
        # One text at a time, so that the arrays stay in the processor's cache.
        for i, q in enumerate(full.tolist()):
            start = self.entries[word[edges[q] : edges[q + 1]]]
            size = self.entries[word[edges[q] : edges[q + 1]] + 1] - start
            entry = _ranges(start, size)
            block, part, column = self.entry_block[entry], np.repeat(weight[edges[q] : edges[q + 1]], size), self.entry_column[entry]
            most[i] = np.bincount(block, part * self.entry_most[entry], blocks)
            often = np.flatnonzero(column >= 0)
            own[i] = (entry, block, part, column[often], part[often])
        out: list[list[tuple[float, int]]] = [[] for _ in lines]
        # Texts of one language are searched together, as they look at the same blocks.
        alike = np.argsort(most.argmax(axis=1), kind="stable")
        for i in range(0, len(alike), TEXTS):
            some = alike[i : i + TEXTS]
            found = self._nearest([own.pop(j) for j in some.tolist()], most[some], k, but and [but[q] for q in full[some].tolist()])
            for q, near in zip(full[some].tolist(), found):
                out[q] = near
        return out

    def _nearest(self, own: list[tuple[np.ndarray, ...]], most: np.ndarray, k: int, but: list[str] | None) -> list[list[tuple[float, int]]]:
        """own: for each text the entries of its words, their blocks and weights; the columns of the frequent ones and their weights."""
        n, blocks = most.shape
        _, block, width = self.matrix.shape
        rank = min(self.n, k + (but is not None))
        some = min(blocks, max(FIRST_BLOCKS, -(-rank // block)))
        columns = self.columns.tolist()
        queries = np.zeros((n, blocks * width), np.float32)
        for q, (_, _, _, column, part) in enumerate(own):
            queries[q, column] = part
        queries = queries.reshape(n, blocks, width)
        first = np.argpartition(-most, some - 1, axis=1)[:, :some]
        wanted = np.zeros((n, blocks), bool)
        np.put_along_axis(wanted, first, True, axis=1)
        sums, cosines = np.zeros((n, blocks * block)), np.zeros((n, blocks, block), np.float32)

        def search(wanted: np.ndarray) -> None:
            """Adds up the cosines of these blocks: postings for each text, the matrix for all texts."""
            for q, (entry, of_block, part, _, _) in enumerate(own):
                here = np.flatnonzero(wanted[q][of_block])
                start = self.entry_posted[entry[here]]
                size = self.entry_size[entry[here]]
                posting = self.postings[_ranges(start, size)]
                weights = np.repeat(part[here], size)
                weights *= posting.view(np.float32)[1::2]
                sums[q] += np.bincount(posting.view(np.int32)[::2], weights, blocks * block)
            for b in np.flatnonzero(wanted.any(axis=0)).tolist():
                rows = np.flatnonzero(wanted[:, b])
                cosines[rows, b] = sums[rows, b * block : (b + 1) * block] + queries[rows, b, : columns[b]] @ self.matrix[b][:, : columns[b]].T

        search(wanted)
        known = np.take_along_axis(cosines, first[:, :, None], axis=1).reshape(n, some * block)
        least = np.partition(known, known.shape[1] - rank, axis=1)[:, known.shape[1] - rank]
        search((most >= least[:, None] - CLOSE) & (most > 0) & ~wanted)
        cosines = cosines.reshape(n, blocks * block)
        out = []
        for q in range(n):
            at = np.flatnonzero(cosines[q] >= max(least[q] - CLOSE, 1e-12))
            if len(at) > rank:
                there = cosines[q, at]
                at = at[there >= np.partition(there, len(there) - rank)[len(there) - rank] - CLOSE]
            whole = np.zeros(blocks * width)
            whole[own[q][3]] = own[q][4]
            exact = sums[q, at] + (self.matrix[at // block, at % block] * whole.reshape(blocks, width)[at // block]).sum(axis=1)
            best = np.lexsort((self.rank[at], -exact))
            if but is not None:
                best = best[self.ids[at[best]] != but[q]]
            out.append([(float(exact[i]), int(at[i])) for i in best[:k]])
        return out

    def vote(self, near: list[tuple[float, int]]) -> float:
        """The share of toxic neighbours weighted by nearness, which a copy outweighs all others by, drawn a little to the prior."""
        weights = [c * c / (1.01 - min(c, 1.0)) for c, _ in near]
        return (sum(x * float(self.labels[i]) for x, (_, i) in zip(weights, near)) + 0.02 * self.prior) / (sum(weights) + 0.02)

    def score(self, near: list[tuple[float, int]], strength: float) -> float:
        if not near:
            return self.unmatched
        return float(1 / (1 + np.exp(-(_facts(self.vote(near), strength) @ np.array(self.curve)))))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after the other."""
    out = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    out += np.arange(len(out))
    return out


def _facts(vote: float, strength: float) -> np.ndarray:
    p = min(max(vote, 1e-3), 1 - 1e-3)
    return np.array([np.log(p / (1 - p)), np.log1p(strength), 1.0, float(strength == 0)])


def _sketch(line: str) -> int:
    """The least hash of five words in a row; near copies mostly share it."""
    words = line.split()
    return min(zlib.crc32(" ".join(words[i : i + 5]).encode()) for i in range(max(1, len(words) - 4)))


def _with_lines(rows: DataFrame) -> DataFrame:
    """Examples with their normalised text, one for each such text and label, and their weight as evidence for marks.

    Examples of one sketch and label have a weight of 1 between them, so that near copies of one text don't make its words
    look like marks. Only ids, labels and hashes are shuffled.
    """

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [normal(t.as_py()) for t in batch.column("text")]
            columns = [batch.column("doc_id"), batch.column("label"), pa.array(each, pa.string()), pa.array([_sketch(x) for x in each], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "label", "line", "sketch"])

    schema = T.StructType([rows.schema["doc_id"], rows.schema["label"], T.StructField("line", T.StringType()), T.StructField("sketch", T.LongType())])
    known = staged(rows.select("doc_id", "text", "label").mapInArrow(lines, schema), "lines")
    toxic = (F.col("label") > 0).alias("toxic")
    first = known.groupBy(F.md5("line").alias("digest"), toxic, "sketch").agg(F.min("doc_id").alias("doc_id"))
    weights = first.groupBy("sketch", "toxic").agg((1 / F.count(F.lit(1))).alias("weight"))
    apart = (F.pmod(F.xxhash64("sketch"), F.lit(4)) == 0).alias("apart")
    kept = first.join(weights, ["sketch", "toxic"]).select("doc_id", "toxic", "weight", apart)
    return known.join(F.broadcast(kept), (known.doc_id == kept.doc_id) & (toxic == kept.toxic)).select(known.doc_id, kept.toxic, "line", "weight", "apart")


def _marks(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """Pieces that mark toxic examples, and their idf. All that pass the test are marks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: tuple[dict, dict] = ({}, {})
        for batch in batches:
            for line, toxic, weight in zip(batch.column("line"), batch.column("toxic"), batch.column("weight")):
                of, weight = have[toxic.as_py()], weight.as_py()
                for piece in pieces_of(line.as_py()):
                    of[piece] = of.get(piece, 0.0) + weight
        names = list(have[0].keys() | have[1].keys())
        for i in range(0, len(names), 50_000):
            part = names[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array([h.get(t, 0.0) for t in part], pa.float64()) for h in have)], ["term", "clean", "toxic"])

    total = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.sum("weight").alias("n")).collect()}
    clean, toxic = total.get(False, 0.0), total.get(True, 0.0)
    # Sums of weights come in any order; rounded, they don't depend on it.
    a, b = (F.round(F.sum(c), 6).alias(c) for c in ("toxic", "clean"))
    counted = rows.select("line", "toxic", "weight").mapInArrow(count, "term string, clean double, toxic double").groupBy("term").agg(a, b)
    a, b, c, d = F.col("toxic"), F.col("clean"), F.lit(toxic) - F.col("toxic"), F.lit(clean) - F.col("clean")
    chi2 = F.lit(clean + toxic) * F.pow(a * d - b * c, F.lit(2)) / ((a + b) * (c + d) * F.lit(max(toxic, 1.0)) * F.lit(max(clean, 1.0)) + 1e-9)
    fit = (a >= LEAST_EXAMPLES) & (chi2 >= CHI2) & (a * F.lit(clean) >= LIFT * b * F.lit(toxic))
    chosen = counted.where(fit).orderBy("term").collect()
    return [r.term for r in chosen], np.array([np.log((clean + toxic + 1) / (r.clean + r.toxic + 1)) + 1 for r in chosen])


def _write_index(folder: str, rows: pa.Table, size_of_block: int) -> None:
    """Writes the arrays of the index for examples (doc_id, toxic, hashes, counts), which are at most MOST_EXAMPLES."""
    n = rows.num_rows
    ids = rows.column("doc_id").to_pylist()
    labels = np.array(rows.column("toxic").to_pylist(), float)
    by_id = np.array(sorted(range(n), key=lambda i: ids[i]), np.int64)
    flat = [rows.column(c).combine_chunks() for c in ("hashes", "counts")]
    size = np.diff(flat[0].offsets.to_numpy())
    words, word = np.unique(flat[0].flatten().to_numpy().view(np.uint64), return_inverse=True)
    word = word.astype(np.int32)
    have = np.bincount(word, minlength=len(words))
    # A word that all examples have tells next to nothing, but a text of such words alone has neighbours too.
    idf = np.log((n + 1) / (have + 0.5))
    example = np.repeat(np.arange(n, dtype=np.int32), size)
    weight = (1 + np.log(flat[1].flatten().to_numpy())) * idf[word]
    weight /= np.sqrt(np.bincount(example, weight * weight, n))[example]
    del flat
    often = np.flatnonzero(have * COMMON > n)
    common = np.full(len(words), -1, np.int32)
    common[often] = np.arange(len(often))
    table = np.zeros((n, len(often)), np.float32)
    dense = common[word] >= 0
    table[example[dense], common[word[dense]]] = weight[dense]
    order = _alike(table, by_id, size_of_block)
    del table, dense
    place = np.empty(n, np.int32)
    place[order] = np.arange(n)
    example = place[example]
    # Words come first, then blocks, which lie one after the other: one number orders both.
    by = np.argsort(word.astype(np.int64) * n + example)
    word, example, weight = word[by], example[by], weight[by]
    del by
    block = example // size_of_block
    new = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (block[1:] != block[:-1])])
    entry_block, entry_word = block[new], word[new]
    number = np.diff(np.r_[new, len(word)])
    frequent = number > max(1, size_of_block // DENSE)
    blocks = -(-n // size_of_block)
    columns = np.bincount(entry_block[frequent], minlength=blocks)
    matrix = np.zeros((blocks, size_of_block, int(columns.max())), np.float32)
    column = np.full(len(new), -1, np.int32)
    for b in range(blocks):
        column[frequent & (entry_block == b)] = np.arange(columns[b]) + b * matrix.shape[2]
    dense = np.repeat(frequent, number)
    matrix[block[dense], example[dense] % size_of_block, np.repeat(column, number)[dense] % max(1, matrix.shape[2])] = weight[dense]
    save(folder, "matrix", matrix)
    del matrix
    rank = np.empty(n, np.int64)
    rank[by_id] = np.arange(n)
    arrays = {
        "words": words,
        "idf": idf,
        "entries": np.searchsorted(entry_word, np.arange(len(words) + 1)),
        "entry_block": entry_block,
        "entry_most": np.maximum.reduceat(weight, new),
        "entry_posted": np.cumsum(np.where(frequent, 0, number)) - np.where(frequent, 0, number),
        "entry_size": np.where(frequent, 0, number),
        "entry_column": column,
        "columns": columns,
        "postings": np.stack([example[~dense], weight[~dense].astype(np.float32).view(np.int32)], axis=1).view(np.int64).ravel(),
        "ids": np.array([str(ids[i]) for i in order]),
        "labels": labels[order],
        "rank": rank[order],
    }
    for name, array in arrays.items():
        save(folder, name, array)


def _alike(table: np.ndarray, order: np.ndarray, block: int) -> np.ndarray:
    """Examples in an order that brings those with the same common words together, so that a block's largest weights say much.

    A part is halved along its main direction until it fits a block.
    """
    if len(order) <= block or not table.shape[1]:
        return order
    part = table[order] - table[order].mean(axis=0)
    direction = np.ones(part.shape[1], np.float32) + np.arange(part.shape[1], dtype=np.float32) / part.shape[1]
    for _ in range(12):
        direction = part.T @ (part @ direction)
        length = np.linalg.norm(direction)
        if not length:
            return order
        direction /= length
    blocks = -(-len(order) // block)
    along = order[np.argsort(part @ direction, kind="stable")]
    cut = blocks // 2 * block
    return np.concatenate([_alike(table, along[:cut], block), _alike(table, along[cut:], block)])


def fit(rows: DataFrame, block: int = BLOCK) -> Index:
    """Learns from rows (doc_id, text, label), of which there must be a bounded number (see labelled.examples).

    An example is a vector of its words, weighted by (1 + log count) * idf, of length 1. Tasks make the vectors, one task
    orders the bounded number of them and writes the index to the shared folder, where all workers map it. Marks are words
    and pieces of words that toxic examples have much more often. Scores are calibrated by a logistic curve on votes and the
    strength of marks. A quarter of the examples, from which no marks are chosen, serves for that; each is voted on by all
    others.
    """
    spark = rows.sparkSession
    rows = staged(_with_lines(rows), "examples")
    marks, idf = _marks(rows.where("NOT apart"))
    n = rows.count()
    folder = mounted(new_folder(spark, "toxic-index"))
    if n:
        key = rows.schema["doc_id"].dataType.simpleString()

        def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (piece for whole in batches for piece in pieces(whole, "line", PIECE_BYTES)):
                text, h, count = counted_words(batch.column("line"))
                edges = pa.array(np.searchsorted(text, np.arange(batch.num_rows + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(edges, pa.array(x)) for x in (h.view(np.int64), count.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), *lists], ["doc_id", "toxic", "hashes", "counts"])

        def write(table: pa.Table) -> pa.Table:
            _write_index(folder, table, block)
            return pa.table({"n": pa.array([table.num_rows], pa.int64())})

        seen = rows.select("doc_id", "toxic", "line").mapInArrow(vectors, f"doc_id {key}, toxic boolean, hashes array<long>, counts array<int>")
        seen.groupBy().applyInArrow(write, "n long").collect()
    sums = rows.agg(F.avg(F.col("toxic").cast("double")).alias("prior")).first()
    prior = sums.prior or 0.0
    index = Index(folder, n, marks, idf, prior, prior)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "line", PIECE_BYTES):
                lines = batch.column("line").to_pylist()
                near = index.nearest(lines, NEIGHBOURS, [str(i) for i in batch.column("doc_id").to_pylist()])
                votes = pa.array([index.vote(x) if x else None for x in near], pa.float64())
                yield pa.RecordBatch.from_arrays([batch.column("toxic"), votes, pa.array(index.strengths(lines))], ["toxic", "vote", "strength"])

    facts = rows.where("apart").select("doc_id", "toxic", "line").mapInArrow(judged, "toxic boolean, vote double, strength double").collect()
    bare = [r.toxic for r in facts if not r.strength]
    index.unmatched = (sum(bare) + prior) / (len(bare) + 1)
    facts = sorted((r.vote, r.strength, r.toxic) for r in facts if r.vote is not None)
    index.curve = _calibrated(np.array([_facts(v, s) for v, s, _ in facts]).reshape(-1, 4), np.array([t for _, _, t in facts], float))
    return index


def _calibrated(x: np.ndarray, truth: np.ndarray) -> tuple[float, ...]:
    """A logistic curve over the columns of x, held near the identity of the first: the least loss, by Newton steps.

    A step is halved until the loss falls. On facts that nearly part toxic from clean, whole steps swing to and fro.
    """
    start = np.array([1.0, 0.0, 0.0, 0.0])

    def loss(b: np.ndarray) -> float:
        z = x @ b
        return float((np.logaddexp(0, z) - truth * z).sum() + 0.05 * ((b - start) ** 2).sum())

    b, least = start, loss(start)
    for _ in range(200 if len(x) else 0):
        q = 1 / (1 + np.exp(-np.clip(x @ b, -500, 500)))
        slope = x.T @ (truth - q) - 0.1 * (b - start)
        step = np.linalg.solve(x.T @ (x * (q * (1 - q))[:, None]) + 0.1 * np.eye(4), slope)
        gain, size = float(slope @ step), 1.0
        while size > 1e-9 and loss(b + size * step) > least - 1e-4 * size * gain:
            size /= 2
        if gain < 1e-18 or size <= 1e-9:
            break
        b = b + size * step
        least = loss(b)
    return tuple(b.tolist())


def score(docs: DataFrame, index: Index, text: str = "text") -> DataFrame:
    """All columns of docs, and score (0 to 1) and evidence: the nearest three examples with cosine and label.

    Null and empty texts have no words, so no neighbours; their score is the share of toxic ones among examples without
    marks. Nothing learned gives 0. Columns of docs that have one of the new names are replaced.
    """
    own = [f for f in docs.schema.fields if f.name.lower() not in ("score", "evidence") or f.name == text]
    docs = docs.select(*[F.col(f"`{f.name}`") for f in own])
    evidence = T.ArrayType(T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("cosine", T.DoubleType()), T.StructField("toxic", T.IntegerType())]))
    arrow = pa.list_(pa.struct([("doc_id", pa.string()), ("cosine", pa.float64()), ("toxic", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, text, PIECE_BYTES):
                lines = [normal(t.as_py()) for t in batch.column(text)]
                near = index.nearest(lines, NEIGHBOURS)
                scores = [index.score(x, s) for x, s in zip(near, index.strengths(lines))]
                why = [[{"doc_id": str(index.ids[i]), "cosine": c, "toxic": int(index.labels[i])} for c, i in x[:3]] for x in near]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array(why, arrow)], [*batch.schema.names, "score", "evidence"])

    return docs.mapInArrow(run, T.StructType([*own, T.StructField("score", T.DoubleType()), T.StructField("evidence", evidence)]))


def learn(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1) -> Index:
    return fit(examples(docs, labels, "toxic", MOST_EXAMPLES, modulus, held_out))
