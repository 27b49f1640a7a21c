"""Targets against a plain loop; documents are taken near them."""

import random
from collections import defaultdict

import pytest

from meterlake.llm.mixing import emit_copies, mix_sources, source_targets


def plain_targets(sizes, weights, share, most):
    """Shares by weight; what is above a cap goes to the others, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > most * sizes[s]}
        if not over:
            return {**target, **{s: left * weight[s] / total for s in open_}}
        for s in over:
            target[s] = most * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


@pytest.mark.parametrize("share", [0.0, 0.4, 1.5, 1.99, 2.0, 9.0])
def test_targets(spark, share):
    rng = random.Random(share)
    sizes = {None: 300, "": 20, "é": 0, "z": 1, **{f"s{i}": rng.choice([0, 1, 50, 10**rng.randint(0, 6)]) for i in range(30)}}
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in source_targets(rows, [5.0, 2.0, 1.0], share, 2.0).collect()}
    assert got == pytest.approx(plain_targets(sizes, [5.0, 2.0, 1.0], share, 2.0))


def test_documents_come_near_the_targets(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(1, 30), rng.choice(["hot", "hot", "hot", "a", "b", None])) for i in range(6_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mix_sources(docs)
    first, again = mixed.collect(), mix_sources(docs.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in first) == sorted((r.doc_id, r.taken) for r in again)
    taken, target = defaultdict(int), {}
    for r in first:
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken <= 2 * r.size
    assert taken == pytest.approx(target, rel=0.05)
    copies = emit_copies(mixed, docs.columns)
    assert copies.columns == docs.columns and copies.count() == sum(r.copies for r in first)


def test_odd_rows(spark):
    rows = [(1, None, None, 5), (1, "", "s", 5), (None, "a b", None, 5), (2, "a b", "s", 5), (2, "a b", "s", 5), (3, "\t \n", "t", None), (4, "long " * 100_000, "u", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long")
    got = mix_sources(docs)
    assert sorted(got.columns) == sorted([*docs.columns, "source_size", "target", "copies", "taken"])
    by = [(r.doc_id, r.source, r.size) for r in got.collect()]
    assert sorted(by, key=str) == sorted([(1, None, 0), (1, "s", 0), (None, None, 2), (2, "s", 2), (2, "s", 2), (3, "t", 0), (4, "u", 100_000)], key=str)
    assert len({r.taken for r in got.where("doc_id = 2").collect()}) == 1
    assert mix_sources(docs.limit(0)).count() == 0
