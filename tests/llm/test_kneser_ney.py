"""The model against one counted in Python dictionaries."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from meterlake.llm import kneser_ney

END, BEGIN = object(), object()


def tokens(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), END]


def discounts(counts):
    n = [sum(1 for c in counts if c == k) for k in (1, 2, 3, 4)]
    if min(n) == 0:
        return [0, 0.5, 1.0, 1.5]
    y = n[0] / (n[0] + 2 * n[1])
    return [0, *(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.01), k) for k in (1, 2, 3))]


def plain(texts, train):
    unigrams, pairs = Counter(), Counter()
    for t in train:
        ts = tokens(t)
        unigrams.update(ts)
        pairs.update(zip([BEGIN, *ts[:-1]], ts))
    after, context = Counter(w for _, w in pairs), defaultdict(list)
    for (u, _), c in pairs.items():
        context[u].append(c)
    d2, d1, types, total = discounts(pairs.values()), discounts(after.values()), len(pairs), sum(unigrams.values())
    rest = sum(d1[min(c, 3)] for c in after.values()) / types if types else 1.0

    def word(w):
        c = after[w]
        return (c - d1[min(c, 3)]) / max(types, 1) + rest / (len(unigrams) + 1)

    def pair(u, w):
        if u not in context:
            return word(w)
        c, all_ = pairs[u, w], context[u]
        return (c - d2[min(c, 3)] + sum(d2[min(x, 3)] for x in all_) * word(w)) / sum(all_)

    out = []
    for t in texts:
        ts = tokens(t)
        base = sum(math.log10((unigrams[x] + 1) / (total + len(unigrams) + 1)) for x in ts)
        score = sum(math.log10(pair(u, w)) for u, w in zip([BEGIN, *ts[:-1]], ts))
        out.append((len(ts), sum(x in unigrams for x in ts), total, base, score))
    return out, pair, unigrams


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = lambda i: zlib.crc32(str(i if i is not None else "").encode()) % 7 == 2
    want, pair, unigrams = plain([t for _, t in rows], [t for i, t in rows if not out(i)])
    got = kneser_ney.token_scores(docs).collect()
    key = lambda r: (str(r[0]), r[2], r[5])
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=key)
    want = sorted(((i, out(i), *w) for (i, _), w in zip(rows, want)), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)
    return pair, unigrams


def test_sample_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    pair, unigrams = check(spark, [(r.doc_id, r.text) for r in docs.collect()])
    for u in ("the", "never-seen", BEGIN):  # with one unknown word, probabilities add up to one
        assert sum(pair(u, w) for w in [*unigrams, "unknown"]) == pytest.approx(1)


def test_odd_rows(spark):
    rows = [(1, "a b a"), (1, "a b a"), (None, "A b"), (2, None), (3, ""), (4, " \n\t"), (5, "z " * 50_000), (6, "é É b"), (7, "b a"), (8, "new words")]
    check(spark, rows)
    check(spark, [(i, "text of the only rows") for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 2])


def test_other_columns_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b", 5, "x")], "doc_id long, text string, n_tokens int, ngram string")
    model = kneser_ney.fit(docs)
    assert kneser_ney.score(docs, model).columns[:3] == ["doc_id", "text", "ngram"]
    assert kneser_ney.score(docs.limit(0), model).count() == 0
    assert kneser_ney.score(docs, kneser_ney.fit(docs.limit(0))).first().score == 0.0
