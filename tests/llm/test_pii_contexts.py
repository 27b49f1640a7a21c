"""Identifiers in new formats, which only the words around them show, and of several words."""

import random

import pytest
from pyspark.sql import functions as F

from meterlake.llm import pii
from meterlake.llm.pii import find_personal_data
from test_pii import card


def found(spark, rows):
    return {r.doc_id: r for r in find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def phone(rng):
    return f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"


def test_new_formats_in_the_context_of_seeds(spark):
    rng = random.Random(3)
    rows = [(i, f"please call {phone(rng)} today") for i in range(30)]
    rows += [(100 + i, f"mail to bob{i}@site.org soon") for i in range(30)] + [(200 + i, f"order {rng.randint(10**7, 10**8)} sent") for i in range(30)]
    rows += [(300, "please call 0171-5550199 today"), (301, "please call 0171 555 0199 today"), (302, "mail to ann at site.org soon"), (303, "please call 3 today"), (304, "order 0172 555 0198 sent")]
    got = found(spark, rows)
    assert got[300].spans == "phone:12:24" and got[301].spans == "phone:12:25" and got[302].spans == "email:8:23"
    assert got[303].n_added == got[304].n_added == 0 and all(r.n_added == 0 for i, r in got.items() if i < 300)


def test_discovered_values_induce_patterns(spark):
    rng = random.Random(4)
    national = [f"0171-555{i:04d}" for i in range(12)]
    rows = [(i, f"please call {phone(rng)} today") for i in range(400)]
    rows += [(1000 + i, f"please call {x} today, desk {x} here") for i, x in enumerate(national)]
    assert found(spark, [*rows, (2000, "desk 99-88-77-66 here")])[2000].spans == "phone:5:16"


def test_cards_with_blanks_are_seeds(spark):
    rng = random.Random(5)
    apart = lambda c: " ".join(c[i : i + 4] for i in range(0, 16, 4))
    rows = [(i, f"pay with {apart(card(rng))} now") for i in range(30)] + [(99, "pay with 6304 1234 5678 now")]
    assert found(spark, rows)[99].spans == "card:9:23"


@pytest.mark.parametrize("last,gap,word", [(True, "x " * 300 + "Card no: ", "no"), (True, "(card) -- ", "card"), (False, " -- Now, " + "y" * 400, "now,"), (False, "z" * 400 + " a", "z" * 400), (True, "a " + "z" * 400, "z" * 400), (True, "", ""), (False, " .. ", "")])
def test_next_word_whatever_its_length(spark, last, gap, word):
    assert spark.createDataFrame([(gap,)], "gap string").select(pii._word(F.col("gap"), last)).first()[0] == word
