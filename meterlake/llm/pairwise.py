"""Text quality by Bradley-Terry ranking: scores whose differences explain which of two documents is preferred."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlake.llm.labelled import examples

#: Labelled documents to learn from, at most; all pairs of a preferred and another one count.
MOST_EXAMPLES = 16_384
#: Preferred documents that are compared with all others in one piece of work, and pairs in memory at once.
PART_ROWS, PAIRS_AT_ONCE = 1_024, 1 << 20
_SYMBOLS, _MARKS = b"#*$%&|<>", b".,;:!?\"'()-"
_CAPITALS, _SMALL, _DIGITS = bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)), b"0123456789"
NAMES = (
    "log_words", "word_bytes", "word_spread", "capitals", "digits", "symbols", "exclamations", "marks", "other_ascii", "beyond_ascii",
    "line_ends", "distinct_words", "top_word", "distinct_pairs", "distinct_fours", "short_words", "long_words", "packed", "packed_twice", "repeated_lines", "empty",
)


def features(text: str | None) -> list[float]:
    """Numbers that describe the form of a text, each from 0 to about 1 or a logarithm; none uses its label, language or id."""
    data = (text or "").encode()
    words = data.split()
    if not words:
        return [0.0] * (len(NAMES) - 1) + [1.0]
    n, size, inside = len(words), len(data), sum(map(len, words))
    count = lambda chars: (size - len(data.translate(None, chars))) / inside
    lengths = np.fromiter(map(len, words), float, n)
    lines = [x for x in data.split(b"\n") if x.strip()]
    pairs, fours = max(n - 1, 1), max(n - 3, 1)
    packed = zlib.compress(data, 1)
    capitals, small, digits, symbols, marks = (count(c) for c in (_CAPITALS, _SMALL, _DIGITS, _SYMBOLS, _MARKS))
    beyond = count(bytes(range(0x80, 0x100)))
    return [
        float(np.log(n)), float(lengths.mean()) / 10, float(lengths.std()) / 10, capitals, digits, symbols, count(b"!"), marks, max(0.0, 1 - capitals - small - digits - symbols - marks - beyond), beyond,
        len(lines) / n, len(set(words)) / n, max(Counter(words).values()) / n, len(set(zip(words, words[1:]))) / pairs, len(set(zip(words, words[1:], words[2:], words[3:]))) / fours,
        float((lengths <= 2).mean()), float((lengths >= 15).mean()), len(packed) / size, float(np.log(size / len(packed))), 1 - len(set(lines)) / len(lines), 0.0,
    ]


@dataclass
class Ranking:
    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float
    scale: float

    def merit(self, x: np.ndarray) -> np.ndarray:
        return _expanded(x, self.centre, self.spread) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((self.merit(x) - self.threshold) / self.scale, -40, 40)))


def _expanded(x: np.ndarray, centre: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Standardised, within six spreads, and the squares."""
    z = np.clip((x - centre) / spread, -6, 6)
    return np.concatenate([z, z * z / 6], axis=1)


def fit(rows: DataFrame) -> Ranking:
    """Learns from rows (doc_id, text, label), of which there must be a bounded number; label 1 is preferred to 0.

    Every document of label 1 is paired with every one of label 0. Weights minimise the mean logistic loss on the feature
    differences of all these pairs, with a ridge, by Newton steps whose sums over pairs are made by Spark tasks, each for some
    of the preferred documents against all others. The threshold is the quantile of merit that parts
    the examples as their labels do: a share of them equal to that of label 0 lies below. With one label only, everything
    has the score of that label's share.
    """
    key = rows.schema["doc_id"].dataType.simpleString()

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([features(t.as_py()) for t in batch.column("text")], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), x], ["doc_id", "label", "x"])

    seen = sorted(rows.mapInArrow(describe, f"doc_id {key}, label int, x array<double>").collect(), key=lambda r: r.doc_id)
    x = np.array([r.x for r in seen], float).reshape(-1, len(NAMES))
    y = np.array([r.label > 0 for r in seen], bool)
    centre, spread = (x.mean(axis=0), x.std(axis=0)) if len(x) else (np.zeros(len(NAMES)), np.ones(len(NAMES)))
    spread[spread < 1e-9] = 1.0
    good, bad = np.flatnonzero(y), np.flatnonzero(~y)
    if not len(good) or not len(bad):
        share = float(y.mean()) if len(y) else 0.5
        p = min(max(share, 0.01), 0.99)
        return Ranking(centre, spread, np.zeros(2 * len(NAMES)), -float(np.log(p / (1 - p))), 1.0)
    z = _expanded(x, centre, spread)
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((z[good], z[~y]))
    parts = -(-len(good) // PART_ROWS)
    pairs, w = len(good) * len(bad), np.zeros(z.shape[1])
    for _ in range(40):
        gradient, hessian = _sums(spark, shared, parts, w)
        gradient, hessian = gradient / pairs - 1e-3 * w, hessian / pairs + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w = w + step * min(1.0, 2.0 / max(np.linalg.norm(step), 1e-12))
        if np.abs(step).max() < 1e-7:
            break
    merit = z @ w
    ordered = np.sort(merit)
    cut = len(bad)
    threshold = (ordered[cut - 1] + ordered[min(cut, len(ordered) - 1)]) / 2
    return Ranking(centre, spread, w, float(threshold), 1.0)


def pair_sums(good: np.ndarray, bad: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The gradient and the negative Hessian of the log-likelihood, summed over all pairs (good, bad), by products of matrices."""
    gradient, hessian, far = np.zeros(len(w)), np.zeros((len(w), len(w))), bad @ w
    for i in range(0, len(good), step := max(1, PAIRS_AT_ONCE // max(1, len(bad)))):
        part = good[i : i + step]
        p = 1 / (1 + np.exp(-np.clip((part @ w)[:, None] - far, -40, 40)))
        gradient += (1 - p).sum(axis=1) @ part - (1 - p).sum(axis=0) @ bad
        p *= 1 - p
        mixed = part.T @ (p @ bad)
        hessian += part.T @ (part * p.sum(axis=1)[:, None]) + bad.T @ (bad * p.sum(axis=0)[:, None]) - mixed - mixed.T
    return gradient, hessian


def _sums(spark: SparkSession, shared, parts: int, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, bad = shared.value
        for batch in batches:
            for part in batch.column("id").to_pylist():
                gradient, hessian = pair_sums(good[part * PART_ROWS : (part + 1) * PART_ROWS], bad, w)
                yield pa.RecordBatch.from_pylist([{"part": part, "sums": [*gradient.tolist(), *hessian.ravel().tolist()]}])

    rows = spark.range(0, parts, 1, parts).mapInArrow(run, "part long, sums array<double>").collect()
    # Always in the same order, so that reruns agree to the last bit.
    total = np.sum([r.sums for r in sorted(rows, key=lambda r: r.part)], axis=0)
    return total[: len(w)], total[len(w) :].reshape(len(w), len(w))


def score(docs: DataFrame, ranking: Ranking, text: str = "text") -> DataFrame:
    """All columns of docs, and merit and score; score is at least 0.5 from the threshold on.

    Null and empty texts are described alike, by a feature of their own. Columns of docs that have one of the new names
    are replaced.
    """
    own = [f for f in docs.schema.fields if f.name.lower() not in ("merit", "score") or f.name == text]
    docs = docs.select(*[F.col(f"`{f.name}`") for f in own])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column(text)], float).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ranking.merit(x)), pa.array(ranking.score(x))], [*batch.schema.names, "merit", "score"])

    return docs.mapInArrow(run, T.StructType([*own, T.StructField("merit", T.DoubleType()), T.StructField("score", T.DoubleType())]))


def learn(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1) -> Ranking:
    return fit(examples(docs, labels, "quality", MOST_EXAMPLES, modulus, held_out))
