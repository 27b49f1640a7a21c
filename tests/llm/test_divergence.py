"""Counts against Python; verdicts on clean and junk texts; odd rows. The sample tables are compared with DuckDB in test_queries."""

import random
import re
from collections import Counter

from meterlake.llm.divergence import judge


def plain(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    again = {j for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(again)


def check(spark, rows):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, n_words string")
    got = judge(docs).collect()
    have = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=str)
    assert have == sorted(((i, *plain(t)) for i, t, _ in rows), key=str)
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.kept and r.base_failed) and 0 <= r.char_distance <= 1 and 0 <= r.word_distance <= 1
    return got


def test_counts_and_verdicts(spark):
    rng = random.Random(2)
    vocabulary = ["the", "of", "and", "to", "in"] * 8 + [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(12)]
    prose = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ",", ".\n"]) for _ in range(n))
    rows = [(i, prose(rng.randint(60, 400)), "en") for i in range(150)]
    rows += [(1_000 + i, "#*$% " .join(prose(80).split()), "en") for i in range(5)] + [(2_000 + i, prose(90).upper() + "!" * 200, "en") for i in range(5)]
    rows += [(3_000 + i, "one two three four five six seven eight nine\n" * n, "en") for i, n in enumerate((1, 2, 3, 40))]
    rows += [(4_000, "a a a a a a a a a a a", "zz"), (4_001, "x y " * 10_000, "zz")]
    kept = {r.doc_id: r.kept for r in check(spark, rows)}
    assert all(kept[i] for i in range(150)) and not any(kept[i] for i in kept if 1_000 <= i)


def test_odd_rows(spark):
    check(spark, [(1, None, None), (1, "", "en"), (None, "null id " * 30, None), (2, "\n \n\t", "en"), (3, "same text", "de"), (3, "same text", "de"), (4, "É\x0b中 \x0c|" * 40, "fr"), (5, "a\n\na\n b\nb \n", "en")])
    assert judge(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0
