"""The toxicity score beside a plain version of all its parts: words, marks, vectors, neighbours, votes, curve."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterlake.llm import toxicity


def words_of(text):
    line = "".join(c if c.isalnum() else " " for c in (text or "").lower())
    return line.split()


def pieces(words):
    out = set()
    for w in words:
        w = f" {w} "
        out |= {w} | {w[i : i + 5] for i in range(len(w) - 4)} | {w[:n] for n in (6, 7, 8, 9) if n < len(w)}
    return out


class Plain:
    """examples: (doc_id, text, label, set apart)."""

    def __init__(self, examples):
        first = {}
        for i, text, label, apart in examples:
            key = (" ".join(words_of(text)), label > 0)
            first[key] = min(first.get(key, (i, apart)), (i, apart))
        self.rows = sorted((i, line.split(), toxic, apart) for (line, toxic), (i, apart) in first.items())
        sketch = {i: min(zlib.crc32(" ".join(w[k : k + 5]).encode()) for k in range(max(1, len(w) - 4))) for i, w, _, _ in self.rows}
        groups = Counter((sketch[i], toxic) for i, _, toxic, _ in self.rows)
        have, total = defaultdict(lambda: [0.0, 0.0]), [0.0, 0.0]
        for i, w, toxic, apart in self.rows:
            if not apart:
                total[toxic] += 1 / groups[sketch[i], toxic]
                for p in pieces(w):
                    have[p][toxic] += 1 / groups[sketch[i], toxic]
        self.marks = {}
        clean, toxic = total
        for p, (b, a) in have.items():
            a, b = round(a, 6), round(b, 6)
            c, d = toxic - a, clean - b
            chi2 = (clean + toxic) * (a * d - b * c) ** 2 / ((a + b) * (c + d) * max(toxic, 1) * max(clean, 1) + 1e-9)
            if a >= 3 and chi2 >= 25 and a * clean >= 2 * b * toxic:
                self.marks[p] = math.log((clean + toxic + 1) / (a + b + 1)) + 1
        n = len(self.rows)
        df = Counter(w for _, ws, _, _ in self.rows for w in set(ws))
        self.idf = {w: math.log((n + 1) / (k + 0.5)) for w, k in df.items()}
        self.vectors = [self.vector(ws) for _, ws, _, _ in self.rows]
        self.prior = sum(r[2] for r in self.rows) / n
        facts, bare = [], []
        for i, ws, toxic, apart in self.rows:
            if apart:
                near, strength = self.nearest(ws, i), self.strength(ws)
                if not strength:
                    bare.append(toxic)
                if near:
                    facts.append((self.facts(near, strength), toxic))
        self.unmatched = (sum(bare) + self.prior) / (len(bare) + 1)
        x, y = np.array([f for f, _ in facts]).reshape(-1, 4), np.array([t for _, t in facts], float)
        # The minimum of the logistic loss with a pull towards (1, 0, 0, 0), by small steps downhill.
        b = np.array([1.0, 0, 0, 0])
        scale = 1 / (0.25 * np.linalg.norm(x, 2) ** 2 + 0.1) if len(x) else 0
        for _ in range(200_000 if len(x) else 0):
            slope = x.T @ (1 / (1 + np.exp(-x @ b)) - y) + 0.1 * (b - np.array([1.0, 0, 0, 0]))
            if np.abs(slope).max() < 1e-9:
                break
            b = b - scale * slope
        self.curve = b

    def vector(self, words):
        v = {w: (1 + math.log(k)) * self.idf[w] for w, k in Counter(words).items() if w in self.idf}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()} if norm else {}

    def strength(self, words):
        line = f" {' '.join(words)} " if words else " "
        total = 0.0
        for p, idf in self.marks.items():
            k = sum(line.startswith(p, i) for i in range(len(line)))
            if k:
                total += ((1 + math.log(k)) * idf) ** 2
        return math.sqrt(total)

    def nearest(self, words, but=None):
        v = self.vector(words)
        found = [(sum(x * o.get(w, 0) for w, x in v.items()), r) for r, o in zip(self.rows, self.vectors) if r[0] != but]
        return sorted(((c, r) for c, r in found if c > 1e-12), key=lambda x: (-round(x[0], 9), x[1][0]))[:15]

    def facts(self, near, strength):
        weights = [c * c / (1.01 - min(c, 1)) for c, _ in near]
        vote = (sum(w for w, (_, r) in zip(weights, near) if r[2]) + 0.02 * self.prior) / (sum(weights) + 0.02)
        vote = min(max(vote, 1e-3), 1 - 1e-3)
        return [math.log(vote / (1 - vote)), math.log1p(strength), 1.0, float(strength == 0)]

    def score(self, text):
        words = words_of(text)
        near = self.nearest(words)
        return 1 / (1 + math.exp(-np.dot(self.facts(near, self.strength(words)), self.curve))) if near else self.unmatched


def texts(rng, n):
    words = ["".join(rng.choice("abdeghlmnorstu") for _ in range(rng.randint(3, 7))) for _ in range(150)]
    rows = []
    for i in range(n):
        toxic = int(rng.random() < 0.3)
        line = [words[min(int(rng.expovariate(0.03)), 149)] for _ in range(rng.randint(5, 40))]
        if toxic:
            line += rng.choices(["Idiot!", "scum", "idiots", "moron"], k=rng.randint(1, 3))
        rng.shuffle(line)
        if rows and rng.random() < 0.1:
            line = rows[rng.randrange(len(rows))][1].split(" ")[: rng.randint(1, 60)]
        rows.append((i, rng.choice([" ", ", "]).join(line), toxic))
    return rows


@pytest.mark.parametrize("block,seed", [(512, 1), (8, 2)])
def test_whole_score(spark, block, seed):
    rng = random.Random(seed)
    rows = texts(rng, 320)
    known, other = rows[:260], [r[1] for r in rows[240:]] + ["", None, "unseen", "idiot idiot", known_text(rows)]
    examples = spark.createDataFrame(known, "doc_id long, text string, label int")
    apart = F.udf(lambda t: toxicity._sketch(toxicity.normal(t)), "long")
    flags = {r.doc_id: r.a for r in examples.select("doc_id", (F.pmod(F.xxhash64(apart("text")), F.lit(4)) == 0).alias("a")).collect()}
    plain = Plain([(i, t, y, flags[i]) for i, t, y in known])
    index = toxicity.fit(examples, block)
    assert sorted(index.marks) == sorted(plain.marks) and len(plain.marks) > 5 and index.n == len(plain.rows) < 260
    assert index.mark_idf == pytest.approx([plain.marks[m] for m in index.marks])
    assert index.curve == pytest.approx(plain.curve.tolist(), abs=1e-4)
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(list(enumerate(other)), "doc_id long, text string"), index).collect()}
    for i, text in enumerate(other):
        near = plain.nearest(words_of(text))
        assert [e.cosine for e in got[i].evidence] == pytest.approx([c for c, _ in near[:3]], abs=1e-6)
        assert got[i].score == pytest.approx(plain.score(text), abs=1e-4), text


def known_text(rows):
    return rows[3][1].upper()


def test_search_skips_blocks_and_misses_nothing(spark):
    """Examples of two languages: blocks of the other one are not looked at."""
    rng = random.Random(7)
    tongues = [["".join(rng.choice(letters) for _ in range(5)) for _ in range(40)] for letters in ("abcd", "wxyz")]
    rows = [(i, " ".join(rng.choice(tongues[i % 2]) for _ in range(25)), i % 3 == 0) for i in range(200)]
    examples = spark.createDataFrame([(i, t, int(y)) for i, t, y in rows], "doc_id long, text string, label int")
    index = toxicity.fit(examples, 16)
    seen = []
    matrix = index.matrix

    class Counting(np.ndarray):
        def __getitem__(self, b):
            if isinstance(b, int):
                seen.append(b)
            return np.asarray(super().__getitem__(b))

    index.matrix = matrix.view(Counting)
    line = toxicity.normal(rows[0][1])
    near = index.nearest([line], 5)[0]
    assert near[0][0] == pytest.approx(1) and index.ids[near[0][1]] == "0"
    assert all(int(index.ids[i]) % 2 == 0 for _, i in near)
    assert len(set(seen)) <= len(matrix) // 2 + 1
