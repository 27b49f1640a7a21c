"""Parts of the toxicity score on what larger tables bring: facts that nearly part, languages of their own, batches of much text."""

import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql.classic.dataframe import DataFrame

from meterlake.llm import toxicity


@pytest.mark.parametrize("seed", range(5))
def test_curve_is_the_least_loss_where_facts_nearly_part(seed):
    """Four thousand facts as in a large table: one in ten toxic, strongly marked, with neighbours of either kind."""
    rng = np.random.default_rng(seed)
    truth = (rng.random(4000) < 0.1).astype(float)
    odds = np.where(truth > 0, rng.normal(-0.3, 1.8, 4000), rng.normal(-2.8, 1.4, 4000))
    clean = np.where(rng.random(4000) < 0.76, 0.0, 2.5 + rng.exponential(3, 4000))
    strength = np.where(truth > 0, np.maximum(12, rng.lognormal(3.65, 0.55, 4000)), clean)
    vote = 1 / (1 + np.exp(-odds))
    x = np.array([toxicity._facts(v, s) for v, s in zip(vote, strength)])
    curve = np.array(toxicity._calibrated(x, truth))
    score = 1 / (1 + np.exp(-x @ curve))
    slope = x.T @ (truth - score) - 0.1 * (curve - np.array([1.0, 0, 0, 0]))
    assert np.abs(slope).max() < 1e-6
    assert (score[truth == 0] < toxicity.THRESHOLD).mean() > 0.99
    assert (score[truth == 1] >= toxicity.THRESHOLD).mean() > 0.9


def test_curve_without_facts():
    assert toxicity._calibrated(np.empty((0, 4)), np.empty(0)) == (1.0, 0.0, 0.0, 0.0)


def test_normal_text_is_that_of_one_pattern():
    rng = random.Random(3)
    signs = [*"aAzé ß_-.,!\t\n0٣²Ⅷ́  \x1c\x85'İ語"]
    for text in ["", " ", "_", "a", "_a", "...", *("".join(rng.choices(signs, k=rng.randint(0, 30))) for _ in range(3000))]:
        assert toxicity.normal(text) == re.sub(r"[\W_]+", " ", f" {text.lower()} "), ascii(text)
    assert toxicity.normal(None) == " "


def test_words_frequent_in_one_block_only_have_no_postings(spark, tmp_path):
    """Examples of four languages with words of their own: none is in half of the examples, nearly all are in half of a block."""
    rng = np.random.default_rng(4)
    words = [[f"{c}{i}" for i in range(30)] for c in "wxyz"]
    lines = [toxicity.normal(" ".join(rng.choice(words[i % 4], 40))) for i in range(256)]
    text, h, count = toxicity.counted_words(pa.array(lines))
    edges = pa.array(np.searchsorted(text, np.arange(257)), pa.int32())
    lists = [pa.ListArray.from_arrays(edges, pa.array(x)) for x in (h.view(np.int64), count.astype(np.int32))]
    toxicity._write_index(str(tmp_path), pa.table([pa.array(range(256)), pa.array([False] * 256), *lists], ["doc_id", "toxic", "hashes", "counts"]), 64)
    index = toxicity.Index(str(tmp_path), 256, [], np.empty(0), 0.0, 0.0)
    assert len(index.postings) < 0.1 * len(h)
    vectors = np.zeros((256, len(index.words)))
    text, word, weight = index.vectors(lines)
    vectors[text, word] = weight
    place = {i: int(k) for k, i in enumerate(index.ids)}
    for i, near in enumerate(index.nearest(lines, 15)):
        cosines = vectors @ vectors[i]
        assert [c for c, _ in near] == pytest.approx(sorted(cosines, reverse=True)[:15], abs=1e-6)
        assert near[0][1] == place[str(i)]


def test_memory_of_a_task_does_not_follow_the_text_of_a_batch(spark, monkeypatch):
    """Words of examples are counted piece by piece, however much text Spark puts into a batch."""
    sizes = []
    count = toxicity.counted_words
    monkeypatch.setattr(toxicity, "counted_words", lambda lines: sizes.append(pc.sum(pc.binary_length(lines)).as_py()) or count(lines))
    runs, whole = [], DataFrame.mapInArrow
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, f, schema: runs.append(f) or whole(self, f, schema))
    rows = [(i, f"{'abcdefghij'[i % 10]}{i} some words " * 4000, i % 2) for i in range(30)]
    toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, label int"))
    vectors = next(f for f in runs if f.__name__ == "vectors")
    lines = pa.array([toxicity.normal(t) for _, t, _ in rows])
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _, _ in rows]), pa.array([y > 0 for _, _, y in rows]), lines], ["doc_id", "toxic", "line"])
    sizes.clear()
    assert sum(b.num_rows for b in vectors(iter([batch]))) == 30
    assert len(sizes) > 1 and max(sizes) <= toxicity.PIECE_BYTES < pc.sum(pc.binary_length(lines)).as_py()
