"""The registered queries of this package, and their DuckDB counterparts where SQL can express them."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.llm import decontaminate, divergence, kneser_ney, mixing, pairwise, periodic, pii, simhash, spelling, substrings, suffixes, toxicity, training_order
from meterlake.llm.labelled import fold
from meterlake.llm.shared import ship_package


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _list_sha256(items: Column) -> Column:
    return F.sha2(F.array_join(items, ",").cast("binary"), 256)


def op1_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "source", "text")
    return mixing.mix_sources(docs).select("doc_id", "size", "source_size", "target", "copies", "taken")


SQL_SIZE = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)"

OP1_SQL = rf"""
WITH d AS (SELECT doc_id, source, text, {SQL_SIZE}::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
r AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER up, 0) AS left_, sum(weight) OVER () - coalesce(sum(weight) OVER up, 0) AS open_ FROM w
  WINDOW up AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT max(left_ / open_) FILTER (WHERE left_ / open_ * weight <= cap) AS level FROM r),
t AS (SELECT source, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, level * weight) END AS target FROM r, l),
c AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
  ('0x' || substr(md5(concat_ws('|', '7', coalesce(doc_id::VARCHAR, ''), md5(coalesce(text, '')))), 1, 12))::BIGINT::DOUBLE / 281474976710656.0 AS chance
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
n AS (SELECT *, (floor(rate) + CASE WHEN chance < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies FROM c)
SELECT doc_id, size, source_size::BIGINT AS source_size, target::DOUBLE AS target, copies, (size * copies)::BIGINT AS taken FROM n
"""


def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return substrings.mark_repeats(docs, length=35).drop("spans")


OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
h AS (SELECT r, k, md5(array_to_string(w[k : k + 34], ' ')) AS m FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS k FROM d)),
c AS (SELECT DISTINCT r, unnest(range(k, k + 35)) AS pos FROM h WHERE m IN (SELECT m FROM h GROUP BY m HAVING count(*) > 1)),
p AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
k AS (SELECT r, count(c.pos) AS gone, string_agg(word, ' ' ORDER BY p.pos) FILTER (WHERE c.pos IS NULL) AS kept FROM p LEFT JOIN c USING (r, pos) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)
"""


def op3_training_order(spark: SparkSession, folder: str) -> DataFrame:
    """Where each document's tokens are in the shards that are written to the shared folder."""
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return training_order.materialise(docs)[0]


def op4_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    found = decontaminate.find_benchmark(docs, _table(spark, folder, "benchmark"))
    size = F.size("items").cast("long").alias("n_items")
    return found.select("doc_id", "n_words", "n_hit", size, _list_sha256(F.col("items")).alias("items_sha256"), "contaminated")


_FOLDED = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP4_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_FOLDED}, []) AS w FROM documents),
i AS (SELECT coalesce(item_id::VARCHAR, '') AS item, coalesce({_FOLDED}, []) AS w FROM benchmark),
p AS (SELECT DISTINCT item, n, array_to_string(w[k : k + n - 1], ' ') AS window_ FROM (SELECT item, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS k FROM i WHERE len(w) > 0)),
x AS (SELECT r, n, k, array_to_string(w[k : k + n - 1], ' ') AS window_ FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM p))),
m AS (SELECT r, item, n, k FROM x JOIN p USING (n, window_)),
h AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS pos FROM (SELECT DISTINCT r, n, k FROM m)) GROUP BY r),
q AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN q USING (r)
"""


def op10_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return simhash.simhash_components(docs, shingle=3, distance=2).select("doc_id", "fingerprint", "component_id")


def op5_distribution_divergence(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text", "lang")
    return divergence.judge(docs).drop("char_distance", "word_distance")


def _js(p: str, q: str) -> str:
    part = lambda x: f"CASE WHEN {x} > 0 THEN {x} * log2(2 * {x} / ({p} + {q})) / 2 ELSE 0 END"
    return f"({part(p)} + {part(q)})"


_BINS = [*divergence.CLASSES, "blanks"]
_KEPT_OF = {n: f"length(regexp_replace(t, '{p.replace(chr(39), chr(39) * 2)}', '', 'g'))" for n, p in divergence.CLASSES.items()}

OP5_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, lang FROM documents),
b AS (SELECT r, doc_id, lang, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, length(t) AS n_chars, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
  {", ".join(f"{x} AS {n}" for n, x in _KEPT_OF.items())}, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
a AS (SELECT *, len(w) AS n_words, n_chars - word_chars AS blanks, len(lines) - len(list_distinct(lines)) AS n_dup_lines FROM b),
h AS (SELECT r, k, md5(array_to_string(w[k : k + 7], ' ')) AS m FROM (SELECT r, w, unnest(range(1, n_words - 6)) AS k FROM a)),
o AS (SELECT r, count(DISTINCT pos) AS n_repeat_words FROM (SELECT r, unnest(range(k, k + 8)) AS pos FROM (SELECT r, k, count(*) OVER (PARTITION BY r, m) AS n FROM h) WHERE n > 1) GROUP BY r),
l AS (SELECT r, lang, unnest(list_transform(w, lambda x: lower(x))) AS word FROM a),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS k FROM (SELECT lang, word, count(*) AS n FROM l GROUP BY ALL)) WHERE k <= {divergence.COMMON_WORDS}),
g AS (SELECT lang, sum(n_chars) AS all_chars, sum(n_words) AS all_words, {", ".join(f"sum({n}) AS all_{n}" for n in _BINS)} FROM a GROUP BY lang),
x AS (SELECT a.*, g.* EXCLUDE (lang), coalesce(n_repeat_words, 0) AS n_repeat_words FROM a LEFT JOIN o USING (r) JOIN g ON a.lang IS NOT DISTINCT FROM g.lang),
u AS (SELECT l.r, c.k, count(*) AS n FROM l JOIN c ON l.lang IS NOT DISTINCT FROM c.lang AND l.word = c.word GROUP BY ALL),
v AS (SELECT x.r, sum({_js("(coalesce(u.n, 0) / x.n_words)", "(c.n / x.all_words)")}) AS own, sum(coalesce(u.n, 0)) / any_value(x.n_words) AS p, sum(c.n) / any_value(x.all_words) AS q
  FROM x JOIN c ON x.lang IS NOT DISTINCT FROM c.lang LEFT JOIN u ON u.r = x.r AND u.k = c.k WHERE x.n_words > 0 GROUP BY x.r),
y AS (SELECT x.*, sqrt(greatest(0, own + {_js("(1 - p)", "(1 - q)")})) AS word_distance, {", ".join(f"{n} / n_chars AS p_{n}, all_{n} / all_chars AS q_{n}" for n in _BINS)} FROM x LEFT JOIN v USING (r)),
z AS (SELECT *, 1 - ({" + ".join(f"p_{n}" for n in _BINS)}) AS p_rest, 1 - ({" + ".join(f"q_{n}" for n in _BINS)}) AS q_rest FROM y),
e AS (SELECT *, sqrt(greatest(0, {" + ".join(_js(f"(CASE WHEN p_{n} > 1e-12 THEN p_{n} ELSE 0 END)", f"(CASE WHEN q_{n} > 1e-12 THEN q_{n} ELSE 0 END)") for n in [*_BINS, "rest"])})) AS char_distance,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM z)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND NOT (n_chars >= {divergence.LEAST_CHARACTERS} AND char_distance > {divergence.CHARACTERS_APART} OR n_words >= {divergence.LEAST_WORDS} AND word_distance > {divergence.WORDS_APART}) AS kept
FROM e
"""


def _scored(spark: SparkSession, folder: str, module, threshold: float, *more: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    learned = module.learn(docs, _table(spark, folder, "labels"), modulus=3, held_out=1)
    predicted = (F.col("score") >= threshold).cast("int").alias("predicted")
    return module.score(docs, learned).select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", predicted, *more)


def op6_nearest_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder, toxicity, toxicity.THRESHOLD, "evidence")


def op7_bootstrapped_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find_personal_data(_table(spark, folder, "documents").select("doc_id", "text"))


def op9_pairwise_quality(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder, pairwise, 0.5)


def op8_kneser_ney_scores(spark: SparkSession, folder: str) -> DataFrame:
    return kneser_ney.token_scores(_table(spark, folder, "documents").select("doc_id", "text"))


def _mistyped(doc_id: int | None, run: str) -> str:
    """The run without one code point, for one run of a document in 31, by the checksum of both."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    return run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]


def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return spelling.group_variants(spelling.count_words(docs, 7, 2, _mistyped), ratio=10)


def _with_loops(docs: DataFrame) -> DataFrame:
    """Of one document in ten, by the checksum of its id, the words from one place on are replaced by its words there again and again."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    rows = docs.select("doc_id", "text", words.alias("w"), F.floor(h / 10).alias("g"))
    rows = rows.select("doc_id", "text", F.expr("if(size(w) > 0, w, null)").alias("w"), "g", F.expr("if(size(w) > 0, cast(g % size(w) as int), 0)").alias("a"))
    rows = rows.select("doc_id", "text", "w", "a", F.expr("cast(1 + (size(w) - a) div (3 + g % 8) as int)").alias("p"))
    again = F.expr("slice(concat(slice(w, 1, a), flatten(array_repeat(slice(w, a + 1, p), cast(ceil((size(w) - a) / p) as int)))), 1, size(w))")
    return rows.select("doc_id", F.coalesce(F.array_join(again, " "), "text").alias("text"))


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic.find_runs(_with_loops(_table(spark, folder, "documents").select("doc_id", "text")))
    best = F.expr("array_max(transform(runs, r -> struct(r.length AS length, -r.start AS start, -r.period AS period)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    rows = found.select("doc_id", "n_words", "runs", best.alias("best"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    start, length, period = -F.col("best.start"), F.col("best.length"), -F.col("best.period")
    milli = F.expr("1000 * best.length div -best.period")
    return rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"), milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256", "n_words")


def op13_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = suffixes.remove_repeats(_table(spark, folder, "documents").select("doc_id", "text"), length=200)
    size = F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.first)").alias("n_removed")
    return found.select("doc_id", "n_bytes", size, F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_source_mixing": op1_source_mixing,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_training_order": op3_training_order,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_distribution_divergence": op5_distribution_divergence,
    "op6_nearest_toxicity": op6_nearest_toxicity,
    "op7_bootstrapped_pii": op7_bootstrapped_pii,
    "op8_kneser_ney_scores": op8_kneser_ney_scores,
    "op9_pairwise_quality": op9_pairwise_quality,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_suffix_array_dedup": op13_suffix_array_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op1_source_mixing": OP1_SQL,
    "op2_substring_dedup": OP2_SQL,
    "op4_benchmark_decontamination": OP4_SQL,
    "op5_distribution_divergence": OP5_SQL,
}
