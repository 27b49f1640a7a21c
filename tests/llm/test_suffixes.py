"""Repeated strings of bytes beside a plain count of all strings, and odd rows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from meterlake.llm import suffixes
from meterlake.llm.queries import op13_suffix_array_dedup


def plain(texts, length):
    """(bytes, removed runs, kept) of each text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.flatnonzero(np.diff(np.r_[False, gone].astype(int)))
        out.append((len(d), [tuple(x) for x in edges.reshape(-1, 2).tolist()], d[: len(d)] if not gone.any() else bytes(np.frombuffer(d, np.uint8)[~gone[:-1]])))
    return out


def some_texts(rng, n=150, length=40):
    letters = "abcdé"
    passages = ["".join(rng.choice(letters) for _ in range(rng.randint(length // 2, 4 * length))) for _ in range(8)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.1 and texts:
            t = rng.choice(texts)
            i = rng.randrange(len(t) + 1)
            texts.append(t[:i] + rng.choice(["", "X", "yz"]) + t[i + 1 :])
        elif kind < 0.15:
            texts.append(rng.choice(["a", "ab", "abc"]) * rng.randrange(length))
        else:
            texts.append("".join(rng.choice([rng.choice(passages), "".join(rng.choice(letters) for _ in range(rng.randrange(60)))]) for _ in range(rng.randrange(5))))
    return texts


def removed(spark, texts, **how):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = {r.doc_id: (r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in suffixes.remove_repeats(docs, **how).collect()}
    return [rows[i] for i in range(len(texts))]


@pytest.mark.parametrize("length,gram,crowded", [(40, 16, 10_000), (40, 16, 1), (13, 5, 3), (70, 1, 10_000), (40, 40, 10_000)])
def test_all_strings(spark, monkeypatch, length, gram, crowded):
    monkeypatch.setattr(suffixes, "CROWDED", crowded)
    monkeypatch.setattr(suffixes, "SORTED_UNITS", 50)
    monkeypatch.setattr(suffixes, "PARTITION_UNITS", 100)
    texts = some_texts(random.Random(length + gram), length=length)
    want = plain(texts, length)
    assert removed(spark, texts, length=length, gram=gram) == want
    assert sum(len(w[1]) for w in want) > 20


def test_one_passage_everywhere(spark, monkeypatch):
    """A line that all texts have, shorter than a string, with other text around it."""
    monkeypatch.setattr(suffixes, "CROWDED", 20)
    rng = random.Random(2)
    line = "the same line of forty bytes everywhere."
    around = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(30, 80)))
    texts = [around() + line + around() for _ in range(300)] + ["x" + line + "y" * 30, "x" + line + "y" * 30]
    assert removed(spark, texts, length=60, gram=20) == plain(texts, 60)


def test_parts_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "PART_BYTES", 100)
    rng = random.Random(6)
    part = "".join(rng.choice("abcdefgh") for _ in range(900))
    texts = [part + "Z" + part[100:700], part[50:350] + "é", "q" * 700]
    assert removed(spark, texts, length=64, gram=20) == plain(texts, 64)


def test_sort_equal():
    rng = np.random.default_rng(5)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    for length in (8, 9, 12, 16, 23):
        start = rng.integers(0, 3000 - length, 500)
        group = rng.integers(0, 3, 500)
        counts = Counter((g, data[s : s + length].tobytes()) for s, g in zip(start, group))
        want = [counts[g, data[s : s + length].tobytes()] > 1 for s, g in zip(start, group)]
        assert suffixes.sort_equal(np.r_[data, np.zeros(8, np.uint8)], start, group, length).tolist() == want
    assert suffixes.sort_equal(data, np.empty(0, np.int64), np.empty(0, np.int64), 16).tolist() == []


def test_odd_rows(spark):
    line = "0123456789" * 3
    rows = [(1, line, 1), (1, line, 1), (None, line + "!", 2), (2, None, 3), (3, "", 4), (4, "short", 5), (4, "short", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hash long").selectExpr("doc_id", "text", "hash", "hash as lead", "hash as kept", "hash as `_`")
    got = sorted(((r.doc_id or 0, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in suffixes.remove_repeats(docs, 25, 9).collect()))
    assert got == sorted([(1, 30, [(0, 30)], b"")] * 2 + [(0, 31, [(0, 30)], b"!"), (2, 0, [], b""), (3, 0, [], b""), (4, 5, [], b"short"), (4, 5, [], b"short")])
    assert suffixes.remove_repeats(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        suffixes.remove_repeats(docs, 20, 21)


def test_query(spark, tmp_path):
    rng = random.Random(9)
    passages = ["".join(rng.choice("abcdefgh é") for _ in range(rng.randint(150, 500))) for _ in range(5)]
    texts = ["".join(rng.choice([rng.choice(passages), "".join(rng.choice("abc") for _ in range(rng.randrange(300)))]) for _ in range(rng.randrange(4))) for _ in range(60)] + [None, "", "z" * 450]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, op13_suffix_array_dedup(spark, str(tmp_path)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()))
    assert got == [(i, n, sum(b - a for a, b in s), len(s), hashlib.sha256(k).hexdigest()) for i, (n, s, k) in enumerate(plain(texts, 200))]
