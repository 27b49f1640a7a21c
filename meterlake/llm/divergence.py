"""Quality rules by distribution divergence, in DataFrame expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.llm.shared import staged

BLANKS = r"[\x20\x09-\x0D]+"
#: Words of a language that its histogram is made of.
COMMON_WORDS = 20
#: Jensen-Shannon distances (0 to 1) above which a text is unlike its language, and the least length to be judged.
CHARACTERS_APART, WORDS_APART = 0.35, 0.5
LEAST_CHARACTERS, LEAST_WORDS = 400, 60
#: References of so many languages are broadcast; more are joined by a shuffle.
BROADCAST_LANGUAGES = 10_000

#: What is left of a text without all characters but those of a class.
CLASSES = {
    "capitals": r"[^A-Z]+",
    "small": r"[^a-z]+",
    "digits": r"[^0-9]+",
    "symbols": r"[^#*$%&|<>]+",
    "marks": r"[^!\"'()+,\-./:;=?@\[\\\]^_`{}~]+",
}


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeat_words(words: Column, width: int = 8) -> Column:
    """Number of words in windows of `width` words that occur at least twice in the array.

    A window's hash is made of those of its halves, so `width` is a power of two. Without repeated windows the hashes are
    only compared as a set; otherwise hashes with places are sorted and the places of equal neighbours are put together.
    No step is more than n log n.
    """
    n = F.size(words)

    def joined(by: int) -> Callable[[Column], Column]:
        return lambda h: F.zip_with(F.slice(h, 1, F.size(h) - by), F.slice(h, 1 + by, F.size(h) - by), lambda a, b: F.xxhash64(a, b))

    hashes, half = F.transform(words, lambda w: F.xxhash64(w)), 1
    while half < width:
        hashes, half = let(hashes, joined(half)), 2 * half

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        same = lambda a, i, j: F.coalesce(F.get(a, j)["h"] == F.get(a, i)["h"], F.lit(False))
        found = let(placed, lambda a: F.filter(F.transform(a, lambda x, i: F.when(same(a, i, i - 1) | same(a, i, i + 1), x["p"])), lambda p: p.isNotNull()))
        gaps = lambda p: F.transform(p, lambda x, i: F.least(F.lit(width), F.coalesce(F.get(p, i + 1) - x, F.lit(width))))
        return let(F.sort_array(found), lambda p: F.aggregate(gaps(p), F.lit(0), lambda s, x: s + x))

    counted = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(n > width, counted).otherwise(F.lit(0)).cast("long")


def _described(docs: DataFrame, common: DataFrame) -> DataFrame:
    """Counts of each text; how often it uses each common word of its language."""
    blank = F.col("text")
    words = F.split(F.btrim("text", F.lit(" \t\n\x0b\f\r")), BLANKS)
    split = docs.withColumn("words", F.when(F.length(F.btrim("text", F.lit(" \t\n\x0b\f\r"))) > 0, words).otherwise(F.array().cast("array<string>")))
    # With two blanks between words, each word has its own blanks.
    spaced = F.lower(F.concat(F.lit(" "), F.array_join("words", "  "), F.lit(" ")))
    times = lambda t, w: ((F.octet_length(t) - F.octet_length(F.replace(t, F.concat(F.lit(" "), w, F.lit(" ")), F.lit("")))) / (F.octet_length(w) + 2)).cast("int")
    used = let(spaced, lambda t: F.transform("common", lambda w: times(t, w)))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\f\r"))) > 0)
    joined = _with_small(split, common, BROADCAST_LANGUAGES)
    return joined.select(
        "doc_id", "lang",
        F.size("words").cast("long").alias("n_words"),
        F.length("text").cast("long").alias("n_chars"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        *[F.length(F.regexp_replace(blank, p, "")).cast("long").alias(n) for n, p in CLASSES.items()],
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words")).alias("n_repeat_words"),
        F.coalesce(used, F.array().cast("array<int>")).alias("used"),
    )


def _with_small(df: DataFrame, small: DataFrame, most: int) -> DataFrame:
    """A left join on lang, null to null; the small side is broadcast if it has at most so many rows."""
    small = small.withColumnRenamed("lang", "own_lang")
    if small.count() <= most:
        small = F.broadcast(small)
    return df.join(small, df.lang.eqNullSafe(small.own_lang), "left").drop("own_lang")


def common_words(docs: DataFrame, most: int = COMMON_WORDS) -> DataFrame:
    """(lang, common): the words, in lower case, that a language's documents use most; of equals the first in code point order."""
    words = docs.select("lang", F.explode(F.split(F.lower("text"), BLANKS)).alias("word")).where("word != ''")
    counted = words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("rank") <= most)
    listed = ranked.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("rank", "word"))).alias("r"))
    return listed.select("lang", F.transform("r", lambda x: x["word"]).alias("common"))


def _distance(terms: list[Column]) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), sum(terms[1:], terms[0])))


def _divergence(p: Column, q: Column) -> Column:
    """What one bin adds to the Jensen-Shannon divergence of p and q, in bits."""
    part = lambda x: F.when(x > 0, x * F.log2(2 * x / (p + q)) / 2).otherwise(F.lit(0.0))
    return part(p) + part(q)


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """A row for each of docs: its id, counts, char_distance, word_distance, base_failed, kept.

    Counts are those of whole texts. base_failed: fewer than 20 words, or over 30 % of them in repeated windows of 8. The
    references of a language are the sums of its documents' character classes and of their COMMON_WORDS commonest words,
    with the rest as one bin. A text is unlike its language if its histogram's Jensen-Shannon distance is above
    CHARACTERS_APART (judged from LEAST_CHARACTERS characters) or WORDS_APART (judged from LEAST_WORDS words). kept:
    neither base_failed nor unlike its language.

    Two passes over the texts, without shuffling them: common words are counted by map tasks first; the descriptions of
    texts (no text in them) are staged, and references are sums over them. Nulls: a null text is empty; null is a
    language of its own. Repeated rows count each time. Other columns of docs are not looked at.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), F.col(f"`{lang}`").alias("lang"))
    described = staged(_described(rows, staged(common_words(rows), "common")), "described")
    classes = {**{n: F.col(n) for n in CLASSES}, "blanks": F.col("n_chars") - F.col("word_chars")}
    sums = described.groupBy("lang").agg(F.sum("n_chars").alias("all_chars"), F.sum("n_words").alias("all_words"), *[F.sum(c).alias(f"all_{n}") for n, c in classes.items()])
    used = described.select("lang", F.posexplode("used").alias("k", "n")).groupBy("lang", "k").agg(F.sum("n").alias("n"))
    used = used.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("k", "n"))).alias("u")).select("lang", F.transform("u", lambda x: x["n"]).alias("all_used"))
    reference = staged(sums.alias("s").join(used.alias("u"), F.col("s.lang").eqNullSafe(F.col("u.lang")), "left").select("s.*", "all_used"), "reference")
    joined = _with_small(described, reference, BROADCAST_LANGUAGES)
    share = lambda n, of: F.when(of > 0, n / of).otherwise(F.lit(0.0))
    bins = [(share(c, F.col("n_chars")), share(F.col(f"all_{n}"), F.col("all_chars"))) for n, c in classes.items()]
    bins.append((F.lit(1.0) - sum((p for p, _ in bins[1:]), bins[0][0]), F.lit(1.0) - sum((q for _, q in bins[1:]), bins[0][1])))
    above = [(F.when(p > 1e-12, p).otherwise(F.lit(0.0)), F.when(q > 1e-12, q).otherwise(F.lit(0.0))) for p, q in bins]
    characters = _distance([_divergence(p, q) for p, q in above])
    total = lambda a: F.coalesce(F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x), F.lit(0))
    each = F.zip_with("used", "all_used", lambda n, m: _divergence(share(n, F.col("n_words")), share(m, F.col("all_words"))))
    others = _divergence(1 - share(total("used"), F.col("n_words")), 1 - share(total("all_used"), F.col("all_words")))
    words = F.when(F.col("n_words") > 0, _distance([F.aggregate(each, F.lit(0.0), lambda s, x: s + x), others])).otherwise(F.lit(0.0))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    apart = (F.col("n_chars") >= LEAST_CHARACTERS) & (F.col("char_distance") > CHARACTERS_APART) | (F.col("n_words") >= LEAST_WORDS) & (F.col("word_distance") > WORDS_APART)
    measured = joined.withColumn("char_distance", F.when(F.col("n_chars") > 0, characters).otherwise(F.lit(0.0))).withColumn("word_distance", words)
    return measured.withColumn("base_failed", failed).select(
        "doc_id", "n_words", "word_chars", F.col("symbols").alias("n_symbols"), "n_dup_lines", "n_repeat_words", "char_distance", "word_distance", "base_failed", (~F.col("base_failed") & ~apart).alias("kept")
    )
