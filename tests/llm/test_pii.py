"""Base spans against Python's regular expressions; identifiers that only bootstrapping finds."""

import hashlib
import random
import re

from meterlake.llm.pii import KINDS, find_personal_data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 10 <= len(digits) <= 15


def plain(text):
    out = []
    for k, kind in enumerate(KINDS):
        out += [(m.start(), k, m.end()) for m in re.finditer(PLAIN[kind], text or "") if valid(kind, m.group())]
    return [f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(out)]


def check(rows, got):
    want = sorted([(i, ",".join(plain(t))) for i, t in rows], key=str)
    base = sorted([(i, hashlib.sha256(x.encode()).hexdigest(), *(x.count(k + ":") for k in KINDS)) for i, x in want], key=str)
    assert sorted([(r.doc_id, r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in got], key=str) == base
    for r in got:
        spans = set(r.spans.split(",")) - {""}
        assert any(i == r.doc_id and set(x.split(",")) - {""} <= spans and len(spans) == r.n_added + len(set(x.split(",")) - {""}) for i, x in want)


def test_sample_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = find_personal_data(docs).collect()
    check([(r.doc_id, r.text) for r in docs.collect()], got)
    assert sum(r.n_email + r.n_phone + r.n_ip + r.n_card for r in got) > 50


def test_odd_texts(spark):
    rng = random.Random(4)
    parts = ["a@b.c", "@", ".", "_x@d.e", "1.2.3.4", "256.1.1.1", "001.02.0003.4", "4111 1111-1111 1111", "+1 (23) 456-7890", "+1", "é", "中", " ", "-", "9", "  ", "%", "12345678901234567890123", "x.y@z-.q..r", "+49.", "\n"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))) for i in range(600)]
    rows += [(None, "a@b.c"), (3, None), (4, ""), (5, "7" * 50_000 + " " + "a" * 50_000), (5, "a@b.c"), (6, "word " * 20_000 + "a@b.co 10.0.0.1")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, spans string")
    check(rows, find_personal_data(docs).collect())
    assert find_personal_data(docs.limit(0)).count() == 0


def test_one_text_of_many_matches(spark):
    """Places and overlaps are found block by block: lengths about a square number, and thousands of matches in one text."""
    rng = random.Random(6)
    parts = ["a@b.c", "_x@d.e and", "1.2.3.4", "256.1.1.1", "4111 1111-1111 1111", "+1 (23) 456-7890", "é 中", "1234567", "word"]
    rows = [(n, " ".join(rng.choice(parts) for _ in range(n))) for n in [*range(1, 28), 99, 100, 101, 6000]]
    check(rows, find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def card(rng, right=True):
    digits = [rng.randint(1, 9) for _ in range(15)]
    last = next(d for d in range(10) if luhn("".join(map(str, [*digits, d]))) == right)
    return "".join(map(str, [*digits, last]))


def test_bootstrapping_adds_glued_cards_only(spark):
    rng = random.Random(8)
    rows = [(i, f"pay with {card(rng)} now") for i in range(40)] + [(100 + i, f"order number {card(rng, False)} sent") for i in range(40)]
    a, b, bad = card(rng), card(rng), card(rng, False)
    rows += [(200, f"use {a} {b} or"), (201, f"use {bad} {bad} or"), (202, "version 1.2 of 3")]
    got = {r.doc_id: r for r in find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[200].spans == "card:4:20,card:21:37" and got[200].n_card == 0
    assert all(r.n_added == 0 for i, r in got.items() if i != 200)
    assert sum(r.n_card for r in got.values()) == 40
