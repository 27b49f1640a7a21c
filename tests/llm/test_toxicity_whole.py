"""Toxicity for any share of toxic labels, and over all words of texts and examples."""

import random

import pytest

from meterlake.llm import toxicity

MARKS = ["idiot", "scum", "moron", "clown"]


def texts(rng, n, share):
    """Rows (doc_id, text, label): random words, with two marks in toxic ones."""
    words = ["".join(rng.choice("abdeghlmnorstu") for _ in range(rng.randint(3, 7))) for _ in range(400)]
    rows = []
    for i in range(n):
        toxic = int(i < share * n)
        line = [rng.choice(words) for _ in range(40)] + toxic * rng.sample(MARKS, 2)
        rng.shuffle(line)
        rows.append((i, " ".join(line), toxic))
    return rows


def scores(spark, index, lines):
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    return {r.doc_id: r for r in toxicity.score(docs, index).collect()}


@pytest.mark.parametrize("share", [0.3, 0.5, 0.8])
def test_any_share_of_toxic_labels(spark, share):
    rows = texts(random.Random(5), 600, share)
    known, other = [r for r in rows if r[0] % 3], [r for r in rows if r[0] % 3 == 0]
    index = toxicity.fit(spark.createDataFrame(known, "doc_id long, text string, label int"))
    got = scores(spark, index, [r[1] for r in other])
    right = [(got[i].score >= toxicity.THRESHOLD) == bool(r[2]) for i, r in enumerate(other)]
    assert sum(right) >= 0.95 * len(right)


def test_words_that_are_no_marks_count(spark):
    rng = random.Random(6)
    rows = texts(rng, 600, 0.1)
    rare = " ".join(f"zq{i}x" for i in range(30))
    index = toxicity.fit(spark.createDataFrame([*rows, (1000, rare, 1)], "doc_id long, text string, label int"))
    got = scores(spark, index, [rare, rows[-1][1], "unseen"])
    assert got[0].evidence[0].doc_id == "1000" and got[0].evidence[0].cosine == pytest.approx(1) and got[0].score >= toxicity.THRESHOLD
    assert got[1].evidence[0].doc_id == str(rows[-1][0]) and got[1].evidence[0].cosine == pytest.approx(1) and got[1].score < 0.1
    assert not got[2].evidence
