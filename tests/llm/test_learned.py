"""Toxicity and quality: exact neighbours, held-out accuracy, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterlake.llm import pairwise, toxicity
from meterlake.llm.labelled import examples, fold

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{FOLDER}/labels.parquet")


def held_out(scored, labels, label, threshold):
    rows = scored.where(fold(F.col("doc_id"), 3) == 1).join(labels, "doc_id").select("score", label).collect()
    right = sum((r.score >= threshold) == bool(r[label]) for r in rows)
    caught = [r.score >= threshold for r in rows if r[label]]
    clean = [r.score >= threshold for r in rows if not r[label]]
    return right / len(rows), np.mean(caught), np.mean(clean)


def test_quality_of_held_out(tables):
    docs, labels = tables
    right, good, bad = held_out(pairwise.score(docs, pairwise.learn(docs, labels)), labels, "quality", 0.5)
    assert right >= 0.97 and good >= 0.97 and bad <= 0.1


def test_toxicity_of_held_out(tables):
    docs, labels = tables
    right, caught, clean = held_out(toxicity.score(docs, toxicity.learn(docs, labels)), labels, "toxic", toxicity.THRESHOLD)
    assert right >= 0.93 and caught >= 0.65 and clean <= 0.02


@pytest.mark.parametrize("module,label", [(toxicity, "toxic"), (pairwise, "quality")])
def test_odd_rows(spark, module, label):
    docs = spark.createDataFrame(
        [(1, "you stupid clown", "x"), (2, "a calm line", "x"), (2, "a calm line", "x"), (None, "lost", None), (3, None, "x"), (4, "", "x"), (5, "word " * 60_000, "x"), (6, "stupid clown you", "y")],
        "doc_id long, text string, score string",
    )
    labels = spark.createDataFrame([(1, 1, "a"), (2, 0, "a"), (2, 0, "b"), (3, None, "a"), (6, 1, "c"), (None, 1, "d"), (99, 1, "e")], f"doc_id long, {label} int, text string")
    rows = examples(docs, labels, label, 100)
    assert sorted((r.doc_id, r.label) for r in rows.collect()) == [(1, 1), (2, 0), (6, 1)]
    scored = module.score(docs, module.fit(rows))
    assert scored.count() == 8 and scored.where("score between 0 and 1").count() == 8
    same = [r.score for r in scored.where("doc_id in (3, 4)").collect()]
    assert same[0] == same[1]
    for empty in (rows.limit(0), rows.where("label = 1")):
        assert module.score(docs, module.fit(empty)).where("score between 0 and 1").count() == 8
    assert module.score(docs.limit(0), module.fit(rows)).count() == 0
    assert examples(docs.limit(0), labels.limit(0), label, 5).count() == 0


@pytest.mark.parametrize("module,label", [(toxicity, "toxic"), (pairwise, "quality")])
def test_clashing_columns(spark, module, label):
    rows = [(1, "you stupid clown", "a"), (2, "a calm line", "b"), (3, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    docs = docs.selectExpr("doc_id", "text", "score", "score as evidence", "score as merit", "score as weight", "score as line", "score as `_`")
    labels = spark.createDataFrame([(1, 1, "x"), (2, 0, "y")], f"doc_id long, {label} int, text string")
    scored = module.score(docs, module.learn(docs, labels, 2, 5)).collect()
    assert len(scored) == 3 and all(0 <= r.score <= 1 and r["line"] == r["_"] for r in scored)


def test_sample_is_bounded(tables):
    docs, labels = tables
    rows = examples(docs, labels, "toxic", 50, 3, 1)
    assert rows.count() == 50 and rows.where(fold(F.col("doc_id"), 3) == 1).count() == 0


def test_ranking_is_that_of_all_pairs(spark):
    """The loss over all pairs laid side by side is convex; its slope must vanish at the weights."""
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice(["a", "bb", "Ccc,", "dddd", "#", "7"], rng.integers(1, 30), p=p)), y) for i, (y, p) in enumerate([(1, [0.3, 0.3, 0.1, 0.2, 0.05, 0.05]), (0, [0.2, 0.2, 0.1, 0.1, 0.2, 0.2])] * 40)]
    got = pairwise.fit(spark.createDataFrame(rows, "doc_id long, text string, label int"))
    x = np.array([pairwise.features(t) for _, t, _ in rows])
    y = np.array([y for *_, y in rows], bool)
    spread = x.std(axis=0)
    spread[spread < 1e-9] = 1
    z = np.clip((x - x.mean(axis=0)) / spread, -6, 6)
    z = np.concatenate([z, z * z / 6], axis=1)
    d = np.array([a - b for a in z[y] for b in z[~y]])
    slope = d.T @ (1 / (1 + np.exp(d @ got.weights))) / len(d) - 1e-3 * got.weights
    assert np.abs(slope).max() < 1e-8
    merit = np.sort(z @ got.weights)
    assert got.threshold == pytest.approx((merit[39] + merit[40]) / 2)
    assert got.merit(x) == pytest.approx(z @ got.weights)
