"""The pipeline against a brute-force version, and its stages on odd rows."""

import hashlib
import re
from collections import Counter

import corpus_pipeline
from meterlake.llm import toxicity, training_order
from meterlake.llm.labelled import examples
from test_simhash import plain_components, plain_print
from test_toxicity_plain import Plain

FOLDER = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def contaminated(text, items):
    w = words(text)
    hit = set()
    for item in items:
        n = min(13, len(item))
        for i in range(len(item) - n + 1):
            for j in range(len(w) - n + 1 if n else 0):
                if w[j : j + n] == item[i : i + n]:
                    hit |= set(range(j, j + n))
    return len(hit) > 0 and 20 * len(hit) >= len(w)


def copies(kept):
    """How often the mix takes each document: shares of 150 % by the weights 5, 2, 1, with what is above twice a source's size reshared."""
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for i, r in kept.items()}
    sources = sorted({r.source for r in kept.values()}, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    total = {s: sum(size[i] for i, r in kept.items() if r.source == s) for s in sources}
    left, open_, target = 1.5 * sum(total.values()), set(sources), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * total[s]}
        if not full:
            target |= share
            break
        target |= {s: 2 * total[s] for s in full}
        left -= sum(2 * total[s] for s in full)
        open_ -= full
    out = Counter()
    for i, r in kept.items():
        rate = target[r.source] / total[r.source] if total[r.source] else 0
        md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
        chance = int(md5(f"7|{i}|{md5(r.text or '')}")[:12], 16) / 2**48
        out[i] = int(rate) + (chance < rate - int(rate))
    return +out


def test_run_against_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    known = examples(docs.select("doc_id", "text"), spark.read.parquet(f"{FOLDER}/labels.parquet"), "toxic", toxicity.MOST_EXAMPLES, 3, 1).collect()
    sketches = spark.createDataFrame([(r.doc_id, toxicity._sketch(toxicity.normal(r.text))) for r in known], "doc_id long, sketch long")
    apart = {r.doc_id: r.a for r in sketches.selectExpr("doc_id", "pmod(xxhash64(sketch), 4) = 0 as a").collect()}
    plain = Plain([(r.doc_id, r.text, r.label, apart[r.doc_id]) for r in known])
    kept = {i: r for i, r in rows.items() if plain.score(r.text) < toxicity.THRESHOLD}
    assert 0 < len(kept) < len(rows)
    prints = {i: plain_print(r.text) for i, r in kept.items()}
    classes, least = plain_components(set(prints.values()), 2), {}
    for i, p in prints.items():
        least[classes[p]] = min(least.get(classes[p], i), i)
    kept = {i: kept[i] for i in least.values()}
    items = [words(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    kept = {i: r for i, r in kept.items() if not contaminated(r.text, items)}
    got = corpus_pipeline.run(spark, FOLDER).collect()
    assert Counter(r.doc_id for r in got) == copies(kept)
    encoding = training_order.tokenizer(training_order.TOKENIZER)
    assert all(r.n_tokens == len(encoding.encode_ordinary(rows[r.doc_id].text)) + 1 for r in got)
    assert max(Counter(r.doc_id for r in got).values()) <= 2


def test_odd_rows_pass_every_stage(spark):
    benchmark = spark.read.parquet(f"{FOLDER}/benchmark.parquet").orderBy("item_id").first().text
    rows = [(1, "a calm line of text", "en", "s", 1, 1.0, "i"), (1, "a calm line of text", "en", "s", 1, 1.0, "i"), (None, "no id here at all", None, None, None, None, None), (2, None, "en", "s", 0, 2.0, "j"),
            (3, "", "en", None, 0, None, "k"), (4, benchmark, "en", "s", 9, 3.0, "l"), (5, "w " * 50_000, "en", "s", 9, 3.0, "l")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, items string")
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, FOLDER)
            assert out.columns == docs.columns
            out.collect()
        assert corpus_pipeline.mix_sources(spark, frame.selectExpr("*", "lang as `_`", "lang as `__rest_`"), FOLDER).columns[-2:] == ["_", "__rest_"]
        assert corpus_pipeline.write_shards(spark, frame, FOLDER).count() == frame.count()
    assert {r.score for r in corpus_pipeline.drop_toxic(spark, docs, FOLDER).collect()} == {1.0, 2.0, 3.0, None}
    unique = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, FOLDER).collect()]
    assert sorted(map(str, unique)) == sorted(map(str, {(r[0], r[1]) for r in rows} - {(3, "")}))
    assert 4 not in {r.doc_id for r in corpus_pipeline.drop_contaminated(spark, docs, FOLDER).collect()}
