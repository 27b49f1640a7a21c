"""Benchmark windows against a search of every place."""

import random

import pytest

from meterlake.llm.decontaminate import find_benchmark, folded_words


def plain(text, items, window):
    words, hit, found = folded_words(text), set(), set()
    for item, other in items:
        other = folded_words(other)
        n = min(window, len(other))
        for i in range(len(other) - n + 1 if n else 0):
            for j in range(len(words) - n + 1):
                if words[j : j + n] == other[i : i + n]:
                    hit |= set(range(j, j + n))
                    found.add("" if item is None else str(item))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("window,block_bytes", [(4, 1 << 20), (4, 300), (1, 1 << 20), (13, 1 << 20)])
def test_random_texts(spark, window, block_bytes):
    rng = random.Random(window)
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice("a b c dd É 7".split()) for _ in range(n))
    items = [(i, text(rng.randint(0, 9))) for i in range(40)] + [(None, text(5)), (3, text(6)), (90, None), (91, "... !"), (92, "q")]
    docs = [(i, text(rng.randint(0, 40))) for i in range(80)] + [(None, items[2][1]), (5, None), (5, ""), (6, "Q; " + "z " * 50_000), (7, items[4][1]), (7, items[4][1])]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, items string, extra int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = find_benchmark(df, bench, window, block_bytes=block_bytes)
    assert got.columns == ["doc_id", "text", "extra", "n_words", "n_hit", "items", "contaminated"]
    want = [(i, *plain(t, items, window)) for i, t in docs]
    rows = got.collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in rows), key=str) == sorted(want, key=str)
    assert all(r.contaminated == (r.n_hit > 0 and 20 * r.n_hit >= r.n_words) for r in rows)


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_hit, r.contaminated) for r in find_benchmark(docs, bench).collect()] == [(0, False)]
    assert find_benchmark(docs.limit(0), bench).count() == 0


@pytest.mark.parametrize("block_bytes", [1 << 20, 8])
def test_clashing_names(spark, block_bytes):
    docs = spark.createDataFrame([(1, "say a b c d now", 7)], "doc_id long, text string, n_hit long")
    docs = docs.selectExpr("doc_id", "text", "n_hit as __hit_mask", "n_hit as N_words", "n_hit as `__hit_mask_`")
    bench = spark.createDataFrame([(1, "a b c d"), (2, "c d now"), (3, "x y")], "item_id long, text string")
    row = find_benchmark(docs, bench, 3, block_bytes=block_bytes).first()
    assert (row.n_words, row.n_hit, row["items"], row["__hit_mask"], row["__hit_mask_"]) == (6, 5, ["1", "2"], 7, 7)
