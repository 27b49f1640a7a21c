"""Spelling variants beside a plain comparison of all words, and odd rows."""

import random
import re
import zlib

import pytest

from meterlake.llm import spelling
from meterlake.llm.queries import op11_spelling_variants


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def plain(counts, ratio=10):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= ratio * counts[w] else None
    rows = []
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, counts[w], len(near[w]), form[w] and counts[form[w]]))
    return sorted(rows)


@pytest.mark.parametrize("least", [1, 4, 7])
def test_all_pairs(spark, least):
    rng = random.Random(least)
    counts = {}
    for _ in range(900):
        w = "".join(rng.choice("abé" if least < 7 else "ab") for _ in range(rng.randint(least, least + 4)))
        counts[w] = int(2 * 10 ** (rng.random() * 4))
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = sorted(map(tuple, spelling.group_variants(words).collect()))
    assert got == plain(counts)
    assert sum(r[4] for r in got) > 500 and any(r[2] != r[1] for r in got if r[1])


def test_chains_and_ties(spark):
    counts = {"aaaaaaaa": 1, "baaaaaaa": 10, "bbaaaaaa": 100, "bbbaaaaa": 1000, "bbbbaaaa": 10_000, "bbbbbaaa": 100_000, "xyzxyzxy": 2, "xyzxyzxa": 20, "xyzxyzxb": 20}
    got = spelling.group_variants(spark.createDataFrame(list(counts.items()), "word string, n long"))
    assert sorted(map(tuple, got.collect())) == plain(counts)
    assert {r.word: r.root for r in got.collect()}["aaaaaaaa"] == "bbbbbaaa"


def corpus(rng):
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(5, 11))) for _ in range(60)]
    rows = []
    for i in range(250):
        line = [rng.choice(words[: rng.choice([3, 10, 60])]) for _ in range(rng.randrange(80))]
        rows.append((i, rng.choice([" ", "-", "1", "\n"]).join(w.upper() if rng.random() < 0.1 else w for w in line)))
    return rows


def test_query(spark, tmp_path):
    rows = [*corpus(random.Random(3)), (5, "ABCDEFGH abcdefgh ×÷àÿÀÞ7 " + "q" * 50_000), (5, "q" * 50_000), (None, "wordless wordless"), (9, None), (10, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    counts = {}
    for doc_id, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] = counts.get(w, 0) + 1
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    got = op11_spelling_variants(spark, str(tmp_path)).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted(map(tuple, got)) == plain(counts)
    assert sum(1 for r in got if r.form) >= 30


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD_WORDS", 2)
    docs = spark.createDataFrame([(1, "letters letters Letters", "a"), (1, "letters", "a"), (None, "lettres", None), (2, None, "b"), (3, "", "b")], "doc_id long, text string, word string")
    docs = docs.selectExpr("doc_id", "text", "word", "word as n", "word as form", "word as `key`")
    assert sorted(map(tuple, spelling.count_words(docs, 7, 1).collect())) == [("letters", 4), ("lettres", 1)]
    assert spelling.count_words(docs.limit(0)).count() == 0
    assert spelling.group_variants(spelling.count_words(docs.limit(0))).count() == 0
    assert list(map(tuple, spelling.group_variants(spelling.count_words(docs)).collect())) == [("letters", None, "letters", 4, 0, None)]
