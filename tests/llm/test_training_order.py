"""Round trips: the permutation is one, and shards give back every text."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterlake.llm import training_order as order


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1_000, 4_097, 100_000])
def test_permutation(n):
    p = order.Permutation(n, 5)
    slots = p.slot(np.arange(n))
    assert np.array_equal(np.sort(slots), np.arange(n))
    assert np.array_equal(p.sequence(slots), np.arange(n))
    if n > 60:
        assert not np.array_equal(slots, order.Permutation(n, 6).slot(np.arange(n)))


def test_splitting_long_texts(monkeypatch):
    e = order.tokenizer(order.TOKENIZER)
    texts = ["some words, 12 of them ; é 中  here\n\n and  there " * 40, "x" * 500, " " * 300]
    whole = [e.encode_ordinary(t) for t in texts]
    monkeypatch.setattr(order, "PIECE_CHARACTERS", 37)
    assert [np.concatenate(order._ids(e, t)).tolist() for t in texts] == whole


def stream_of(folder, n_sequences, length, per_shard):
    slots = order.read_slots(folder, 0, n_sequences, length, per_shard)
    return slots[order.Permutation(n_sequences, order.SEED).slot(np.arange(n_sequences))].reshape(-1)


def check(docs, length, per_shard, tmp):
    texts = {(r.doc_id, hashlib.md5((r.text or "").encode()).hexdigest()): r.text or "" for r in docs.collect()}
    keyed = docs.withColumn("key", F.md5(F.coalesce("text", F.lit(""))))
    rows, shards, folder = order.materialise(keyed, folder=f"{tmp}/out", length=length, per_shard=per_shard)
    rows, shards = rows.collect(), shards.collect()
    total = sum(r.n_tokens for r in rows)
    n = -(-total // length)
    assert sum(s.n_sequences for s in shards) == n and len(shards) == -(-n // per_shard)
    for s in shards:
        data = open(s.path, "rb").read()
        assert len(data) == s.n_sequences * length * 2 and hashlib.sha256(data).hexdigest() == s.sha256 and s.first_slot == s.shard * per_shard
    stream, p, e = stream_of(folder, n, length, per_shard), order.Permutation(n, order.SEED), order.tokenizer(order.TOKENIZER)
    spans = sorted((r.first_token, r.first_token + r.n_tokens) for r in rows)
    assert spans[0][0] == 0 and spans[-1][1] == total and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    for r in rows:
        ids = stream[r.first_token : r.first_token + r.n_tokens].tolist()
        assert ids[-1] == e.n_vocab and e.decode(ids[:-1]) == texts[r.doc_id, r.key]
        assert r.slots == p.slot(np.arange(r.first_token // length, (r.first_token + r.n_tokens - 1) // length + 1)).tolist()
        assert r.shards == sorted({x // per_shard for x in r.slots})
    assert (stream[total:] == e.n_vocab).all()
    return rows, n, folder


def test_sample_table(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    _, n, folder = check(docs, 64, 100, tmp_path)
    assert np.array_equal(order.read_slots(folder, 150, 77, 64, 100), order.read_slots(folder, 0, n, 64, 100)[150:227])
    assert len(order.read_slots(folder, n - 3, 10, 64, 100)) == 3


def test_odd_rows(spark, tmp_path):
    rows = [(1, None), (1, ""), (None, "null id"), (2, "twice"), (2, "twice"), (3, "word " * 100_000), (4, "é中\U0001f600 <|endoftext|>")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, slots int")
    got, _, _ = check(docs, 16, 8, tmp_path)
    assert len(got) == 7 and sorted(r.n_tokens for r in got)[:2] == [1, 1]


def test_empty_table(spark, tmp_path):
    rows, shards, _ = order.materialise(spark.createDataFrame([], "doc_id long, text string"), folder=f"{tmp_path}/out")
    assert rows.count() == 0 and shards.count() == 0
