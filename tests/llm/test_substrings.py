"""Removed passages against a plain count of all windows."""

import hashlib
import random
import re
from collections import Counter

import pytest

from meterlake.llm.substrings import mark_repeats


def plain(texts, length):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone |= set(range(i, i + length))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def check(spark, rows, length, gram):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_words string")
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in mark_repeats(docs, length, gram).collect()), key=str)
    want = [(i, *w) for (i, _), w in zip(rows, plain([t for _, t in rows], length))]
    assert got == sorted(want, key=str)
    return got


@pytest.mark.parametrize("length,gram", [(8, 3), (8, 8), (5, 1)])
def test_planted_passages(spark, length, gram):
    rng = random.Random(length * gram)
    text = lambda n, v: [str(rng.randint(0, v)) for _ in range(n)]
    passages = [text(rng.randint(length - 2, 3 * length), 900) for _ in range(8)]
    rows = []
    for i in range(60):
        words = text(rng.randint(0, 60), 900)
        for p in rng.sample(passages, 2):
            at = rng.randint(0, len(words))
            words[at:at] = p[rng.randint(0, 2) :]
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(words)))
    rows += [(100 + i, "a b " * n) for i, n in enumerate((1, 2, 3, 4, 5, 300))]  # many equal grams, in one text too
    rows += rows[:5] + [(None, rows[7][1]), (200, None), (201, ""), (202, " \n"), (203, "éè 中 " * 30), (204, " ".join(text(30_000, 50_000)))]
    got = check(spark, rows, length, gram)
    assert sum(r[2] for r in got) > 300


def test_whole_sample_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(spark, [(r.doc_id, r.text) for r in docs.collect()], 35, 10)


def test_spans_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "p q a b c d r"), (2, "a b c d"), (3, "a b c x")], "doc_id long, text string")
    spans = {r.doc_id: [tuple(s) for s in r.spans] for r in mark_repeats(docs, 4, 2).collect()}
    assert spans == {1: [(2, 6)], 2: [(0, 4)], 3: []}
    assert mark_repeats(docs.limit(0), 4, 2).count() == 0
