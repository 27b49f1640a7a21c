"""Spelling variants: words one edit apart, found by joining chunks of one word with grams of the other."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.llm.shared import staged
from meterlake.llm.words import LOWER

#: Different words that a task counts before it hands its counts on.
HELD_WORDS = 500_000
_FOLD = LOWER.tobytes()


def count_words(docs: DataFrame, least_length: int = 7, least_count: int = 2, change: Callable[[object, str], str] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): runs of letters A-Z, a-z and U+00C0 to U+00FF of whole texts, A-Z lower-cased, and how often each occurs.

    change(doc_id, run), if given, replaces a run by what it returns, which must not be longer. Words of fewer than
    least_length code points or fewer than least_count occurrences are left out. Map tasks count before anything is
    shuffled, so a word that all texts have is one row of each task. Null and empty texts have no words; repeated rows count
    repeatedly. Columns of docs other than the two named are not looked at.
    """
    run = re.compile(f"[a-zÀ-ÿ]{{{max(1, least_length)},}}")
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for i, t in zip(batch.column("doc_id"), batch.column("text")):
                # A run can be much longer than most, but never longer than its text.
                found = Counter(run.findall((t.as_py() or "").encode().translate(_FOLD).decode()))
                if change is None:
                    held.update(found)
                else:
                    i = i.as_py()
                    for word, n in found.items():
                        held[change(i, word)] += n
                if len(held) >= HELD_WORDS:
                    yield from _batches(held)
                    held = Counter()
        yield from _batches(held)

    counted = rows.mapInArrow(counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where((F.length("word") >= least_length) & (F.col("n") >= least_count))


def _batches(counts: Counter) -> Iterator[pa.RecordBatch]:
    words = list(counts)
    for i in range(0, len(words), 50_000):
        part = words[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([counts[w] for w in part], pa.int64())], ["word", "n"])


def _chunk_keys() -> Column:
    """Keys under which `word` meets words of `m` code points, itself having so many and `more` (0 or 1).

    The shorter word is cut into two chunks. One edit leaves one of them as it is; the longer word has that chunk among its
    grams, at the same place or moved by the one place that it is longer. The other chunk is within one edit of what the
    longer word has in its place, so of its two halves again one is whole. A key is the chunk and that half: all of the word
    but a quarter, by code points before and after the gap, hashed.
    """
    keys = []
    for i, (start, end) in enumerate(_QUARTERS):
        before = F.substring("word", F.lit(1), F.expr(start.format("m")))
        after = F.substring("word", F.expr(f"{end.format('m')} + more + 1"), F.col("m"))
        keys.append(F.xxhash64("m", F.lit(i), before, after))
    return F.array(*keys)


_HALF = "({0} div 2)"
_EDGES = ["0", "({0} div 4)", _HALF, "(({0} div 2 + {0}) div 2)", "{0}"]
_QUARTERS = list(zip(_EDGES[:-1], _EDGES[1:]))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n), both ways, for all of the different words (word, n) that are exactly one edit apart.

    An edit inserts, deletes or replaces a code point. Words that share a key are compared. A key leaves only a quarter of
    a word open, so the words that share one are bounded by what letters can stand there, not by the size of the vocabulary.
    """
    sized = words.select("word", "n", F.length("word").alias("m"))
    own = sized.withColumn("more", F.lit(0))
    longer = sized.withColumn("m", F.col("m") - 1).withColumn("more", F.lit(1)).where("m > 0")
    with_keys = lambda rows: rows.select("word", "n", "m", "more", F.explode(_chunk_keys()).alias("key"))
    left = with_keys(own).select("key", "word", "n")
    right = with_keys(own).unionByName(with_keys(longer)).select("key", F.col("word").alias("other"), F.col("n").alias("other_n"), "more")
    one = (F.col("more") == 1) | (F.col("word") < F.col("other"))
    pairs = left.join(right, "key").where(one & (F.levenshtein("word", "other", 1) == 1)).select("word", "n", "other", "other_n").distinct()
    back = pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    return pairs.unionByName(back)


def group_variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each of the different words (word, n).

    n_near: words one edit apart. form: the most frequent of them (of equal ones the first in code-point order), if it is at
    least `ratio` (above 1) times as frequent as the word, or null; form_n: its count. root: the last word that forms lead to,
    the word itself if it has no form. Counts grow along forms, so no chain is a circle; roots are found by doubling steps.
    An empty table gives an empty table.
    """
    words = staged(words.select("word", "n"), "words")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best")
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    joined = words.join(near, "word", "left").withColumn("form_n", -F.col("best.less"))
    much = F.col("form_n") >= F.lit(ratio) * F.col("n")
    rows = joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(much, F.col("best.form")).alias("form"), F.when(much, F.col("form_n")).alias("form_n"))
    rows = staged(rows, "forms")
    steps = rows.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        further = staged(steps.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        steps = further.select("word", "root")
        if not further.where("moved").limit(1).count():
            break
    return rows.join(steps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
