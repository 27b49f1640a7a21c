"""Periodic runs beside a plain search of all starts and periods, and odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from meterlake.llm import periodic
from meterlake.llm.queries import op12_periodic_runs
from meterlake.llm.words import mix


def plain(words, least=12):
    found = {}
    for p in range(1, len(words) // 2 + 1):
        start = 0
        for i in range(len(words) - p + 1):
            if i == len(words) - p or words[i] != words[i + p]:
                if i + p - start >= max(least, 2 * p):
                    found.setdefault((start, i + p), p)
                start = i + 1
    return sorted((s, e - s, p) for (s, e), p in found.items())


def some_words(rng):
    kind = rng.randrange(4)
    if kind == 0:
        return [rng.choice("ab") for _ in range(rng.randrange(90))]
    if kind == 1:
        part = [rng.choice("abc") for _ in range(rng.randint(1, 30))]
        return ([rng.choice("xyz") for _ in range(rng.randrange(9))] + part * rng.randint(1, 8) + part[: rng.randrange(len(part))] + [rng.choice("xyz") for _ in range(rng.randrange(9))]) * rng.randint(1, 3)
    if kind == 2:
        a, b = ["a"], ["a", "b"]
        for _ in range(rng.randint(1, 9)):
            a, b = b, b + a
        return b
    return [rng.choice("abcdefgh") for _ in range(rng.randrange(200))]


@pytest.mark.parametrize("least", [2, 5, 12, 31])
def test_all_runs(least):
    rng = random.Random(least)
    for _ in range(150):
        words = some_words(rng)
        assert periodic.runs_of([w.encode() for w in words], least) == plain(words, least), words


def test_texts_side_by_side(spark):
    rng = random.Random(4)
    texts = [" ".join(some_words(rng)) for _ in range(120)]
    rows = periodic.find_runs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        words = texts[r.doc_id].split()
        runs = plain(words)
        assert [tuple(x) for x in r.runs] == runs and r.n_words == len(words)
        gone = {i for s, n, p in runs for i in range(s + p, s + n)}
        assert r.collapsed == " ".join(w for i, w in enumerate(words) if i not in gone)


def test_long_texts():
    words = [b"a"] * 300_000
    assert periodic.runs_of(words) == [(0, 300_000, 1)]
    part = [str(i).encode() for i in range(70_000)]
    assert periodic.runs_of([b"x", *part, *part, *part[:5], b"y"]) == [(1, 140_005, 70_000)]


def test_agreeing_hashes_are_found_out(monkeypatch):
    calls = []

    def weak(x):
        calls.append(1)
        return mix(x % np.uint64(2)) if len(calls) == 1 else mix(x)

    monkeypatch.setattr(periodic, "mix", weak)
    assert periodic.runs_of([str(i).encode() for i in range(40)]) == [] and len(calls) == 2


def test_odd_rows(spark):
    line = "one two three " * 6
    rows = [(1, line, 1), (1, line, 1), (None, line, 2), (2, None, 3), (3, "", 4), (4, " \t\n", 5), (5, "é é " * 12, 6), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs long").selectExpr("doc_id", "text", "runs", "runs as n_words", "runs as collapsed", "runs as `_`")
    got = sorted(((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.find_runs(docs).collect()), key=str)
    three = [(0, 18, 3)]
    assert got == sorted([(1, 18, three, "one two three")] * 2 + [(0, 18, three, "one two three"), (2, 0, [], ""), (3, 0, [], ""), (4, 0, [], ""), (5, 12, [(0, 12, 1)], "é é"), (0, 0, [], "")], key=str)
    assert periodic.find_runs(docs.limit(0)).count() == 0


def test_query(spark, tmp_path):
    rng = random.Random(8)
    texts = [" ".join(some_words(rng)) if i % 3 else " ".join(rng.choice("abcdefghij") + rng.choice("xyz") for _ in range(rng.randrange(120))) for i in range(300)]
    rows = [*enumerate(texts), (7, "  a\tb\nc  " * 9), (None, "a b " * 9), (400, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if doc_id is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = plain(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        gone = {i for s, k, p in runs for i in range(s + p, s + k)}
        milli = 1000 * best[1] // best[2] if runs else None
        want.append((doc_id, len(runs), *best, milli, sha("".join(f"{s},{k},{p}\n" for s, k, p in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone))))
    got = op12_periodic_runs(spark, str(tmp_path)).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert sum(w[1] for w in want) > 100
