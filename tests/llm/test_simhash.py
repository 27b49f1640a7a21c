"""SimHash classes against brute force over all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from meterlake.llm import simhash

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


def plain_print(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, distance):
    """The smallest member of the class of each distinct fingerprint, by union of all near pairs."""
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    nodes = sorted(root)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if (a ^ b).bit_count() <= distance:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {p: find(p) for p in nodes}


def check(rows, got, distance=2):
    prints = [plain_print(t) for _, t in rows]
    classes = plain_components(set(prints), distance)
    least = {}
    for (i, _), p in zip(rows, prints):
        if i is not None:
            least[classes[p]] = min(least.get(classes[p], i), i)
    want = sorted(((i, f"{p:016x}", least.get(classes[p])) for (i, _), p in zip(rows, prints)), key=str)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == want


def test_sample_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    check([(r.doc_id, r.text) for r in docs.collect()], simhash.simhash_components(docs).collect())


HALF = (1 << 32) - 1
PLANS = [(d, b, None) for d in (0, 1, 2, 3) for b in (1, 64)] + [(2, b, [(HALF << 32, 1), (HALF, 0)]) for b in (1, 64)] + [(2, 64, [(HALF << 32 | 1, 0), (HALF - 1, 1)])]


@pytest.mark.parametrize("distance,bucket_rows,probes", PLANS)
def test_links_of_prints(spark, distance, bucket_rows, probes):
    rng = random.Random(distance)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for p in list(prints):
        for _ in range(3):
            q = p
            for b in rng.sample(range(64), rng.randint(1, 4)):
                q ^= 1 << b
            prints.add(q)
    df = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "fp long")
    found = simhash.components(simhash.similar_prints(df, distance, bucket_rows, probes)).collect()
    got = {r.node % (1 << 64): r.component % (1 << 64) for r in found}
    classes = plain_components(prints, distance)
    same = lambda of: {frozenset(p for p in prints if of(p) == c) for c in {of(p) for p in prints}}
    assert same(lambda p: got.get(p, p)) == same(lambda p: classes[p])


def test_odd_rows(spark):
    rows = [(5, None), (4, ""), (3, "  \n"), (None, "one two three four"), (9, "One TWO three four"), (9, "one two three four"), (7, "x"), (8, "a b c " * 20_000), (None, "alone here now")]
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows], SCHEMA + ", fp string")
    check(rows, simhash.simhash_components(docs).collect())
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)[:1] == [(3, "  \n")]
    assert kept.count() == 5


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert simhash.simhash_components(docs).count() == 0
    assert simhash.drop_near_duplicates(docs).count() == 0


def test_plan_covers_all_pairs():
    sample = np.random.default_rng(1).integers(0, 1 << 63, 500, dtype=np.uint64)
    for n in (1_000, 10**9, 10**11):
        for distance in (0, 1, 2, 3):
            plan = simhash.plan_probes(sample, n, distance)
            assert sum(t + 1 for _, t in plan) == distance + 1
            masks = [m for m, _ in plan]
            assert all(a & b == 0 for i, a in enumerate(masks) for b in masks[:i])
