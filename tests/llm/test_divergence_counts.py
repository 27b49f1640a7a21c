"""Counts of a text are made of its words, which are split once."""

import io
from contextlib import redirect_stdout

from meterlake.llm import divergence

TEXTS = ["The the\x0b\tTHE  end\r\n the", " ΟΔΟΣ οδος\nΟΔΟΣ ", "", " \r\n\x0c", "the", "ÀB àb é x the the", "İx ix the the the"]


def described(spark):
    rows = spark.createDataFrame([(i, t, "l") for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string")
    return divergence._described(rows, divergence.common_words(rows)), divergence.common_words(rows).first().common


def test_blanks_are_searched_once(spark):
    """Blanks were searched three times in each text: for its words, for its characters and for its common words."""
    rows, _ = described(spark)
    plan = io.StringIO()
    with redirect_stdout(plan):
        rows.explain("extended")
    analysed = plan.getvalue().split("== Analyzed Logical Plan ==")[1].split("== Optimized")[0]
    assert "regexp_replace(lower(text" not in analysed and analysed.count("regexp_replace(text") == len(divergence.CLASSES)


def test_counts_of_words(spark):
    rows, common = described(spark)
    blanks = " \t\n\x0b\x0c\r"
    lowered = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").selectExpr("doc_id", "lower(text) t").collect()
    words = {r.doc_id: r.t.translate({ord(b): " " for b in blanks}).split(" ") for r in lowered}
    for r in rows.collect():
        assert r.word_chars == sum(c not in blanks for c in TEXTS[r.doc_id])
        assert r.used == [words[r.doc_id].count(w) for w in common]
