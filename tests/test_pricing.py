import datetime as dt
import json
import random
from decimal import ROUND_HALF_UP, Decimal, localcontext

import pytest
from pyspark.sql import functions as F

from meterlake.functions.money import Modifiers
from meterlake.sources.pricing import PricingError, cost_at, is_stale, load_pricing, price, price_table
from meterlake.sources.samples import SAMPLE_MODIFIERS

M = 1_000_000
# Sample rates: large-a 5 and 25, medium 3 and 15 (also for unknown models), small 1 and 5 dollars a million.
CASES = [
    # model, input, output, cache read, cache write, ttl, batch, dollars
    ("medium", 70, 0, 0, 0, None, False, "0.00021"),
    ("medium", 70, 11, 0, 0, None, False, "0.000375"),
    ("medium", 0, 0, 900, 0, None, False, "0.00027"),
    ("medium", 0, 0, 0, 800, None, False, "0.003"),
    ("medium", 0, 0, 0, 800, "5m", False, "0.003"),
    ("medium", 0, 0, 0, 800, "1h", False, "0.0048"),
    ("large-a", 30, 4, 200, 60, "1h", False, "0.00095"),
    ("large-a", 30, 4, 200, 60, "1h", True, "0.000475"),
    ("not in the table", 33, 7, 0, 0, None, False, "0.000204"),
    (None, 33, 7, 0, 0, None, True, "0.000102"),
    ("small", 3, 0, 0, 0, None, True, "0.000002"),
    ("small", 0, 0, 14, 0, None, False, "0.000001"),
    ("small", 0, 0, 0, 0, None, False, "0"),
]


def test_costs(spark, prices):
    names = "model string, input_tokens bigint, output_tokens bigint, cache_read_tokens bigint, cache_creation_tokens bigint, cache_ttl string, is_batch boolean, want string"
    rows = price(spark.createDataFrame(CASES, names), prices).collect()
    assert [r.cost_usd for r in rows] == [Decimal(r.want).quantize(Decimal("1e-6")) for r in rows]
    assert {r.model for r in rows if not r.known_model} == {"not in the table", None}


def test_cost_out_of_range_is_null_and_no_failure(usage):
    row = usage({"model": "large-a", "input_tokens": 2**63 - 1, "output_tokens": 2**63 - 1}).first()
    assert row.cost_usd is None


def test_costs_in_64_bits_and_in_decimals(usage):
    """Sums that fit into 64 bits, that just do not, of either sign and at half a micro-dollar, as decimals have them."""
    random.seed(5)
    ends = [0, 1, 3, 14, M, 2**40, 2**53 + 1, 10**18, 2**63 - 1]
    # The first two models' input rates are 5 and 3 units of 10^-6 dollars; tokens around 2^63 of their 10^8 parts.
    ends += [(2**63 + d) // (rate * 10**8) + e for rate in (1, 3, 5) for d in (-50_000_000, 0) for e in (-1, 0, 1)]
    rates = {"large-a": (5, 25), "medium": (3, 15), "small": (1, 5)}
    rows = []
    for _ in range(400):
        tokens = [random.choice(ends) * random.choice((1, 1, 1, -1)) if random.random() < 0.6 else random.randrange(10**5) for _ in range(4)]
        names = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")
        ttl, batch = random.choice([None, "5m", "1h"]), random.random() < 0.5
        rows.append({"model": random.choice(list(rates)), "cache_ttl": ttl, "is_batch": batch, **dict(zip(names, tokens))})
    for row, priced in zip(rows, sorted(usage(*rows).collect(), key=lambda r: int(r.event_uid[1:]))):
        into, out = map(Decimal, rates[row["model"]])
        write = into * Decimal("2.0" if row["cache_ttl"] == "1h" else "1.25")
        each = zip((into, out, into / 10, write), (row["input_tokens"], row["output_tokens"], row["cache_read_tokens"], row["cache_creation_tokens"]))
        with localcontext(prec=60):
            micros = (sum(rate * n for rate, n in each) * (Decimal("0.5") if row["is_batch"] else 1)).quantize(Decimal(1), ROUND_HALF_UP)
            assert priced.cost_usd == (micros / M if abs(micros) < 10**18 else None), row


def test_cost_at_other_model(usage, prices):
    events = usage({"model": "large-a", "input_tokens": M, "output_tokens": M})
    assert events.select(cost_at(prices, "small")).first()[0] == Decimal("6")
    assert cost_at(prices, "no-such-model") is None


FILE = {
    "updated": "2026-06-20",
    "models": {"a": {"input": 5.0, "output": 25.0, "fast_input": 10}, "b": {"input": 1, "output": 5}},
    "modifiers": {
        "cache_read_multiplier": 0.1,
        "cache_write_5m_multiplier": 1.25,
        "cache_write_1h_multiplier": 2.0,
        "batch_multiplier": 0.5,
    },
    "fallback_model": "b",
}


def write(folder, **changes):
    path = folder / "pricing.json"
    path.write_text(json.dumps({**FILE, **changes}))
    return str(path)


def test_load(spark, tmp_path):
    table = load_pricing(spark, write(tmp_path))
    assert table.modifiers == SAMPLE_MODIFIERS
    assert table.updated == dt.date(2026, 6, 20)
    assert table.rates_of("a") == (Decimal(5), Decimal(25))
    assert (table.fallback_input, table.fallback_output) == (Decimal(1), Decimal(5))
    assert table.model_count == 2


@pytest.mark.parametrize(
    "changes",
    [
        {"models": {}},
        {"models": {"b": {"input": 1}}},
        {"models": {"b": {"input": -1, "output": 1}}},
        {"fallback_model": "c"},
        {"modifiers": None},
        {"modifiers": {**FILE["modifiers"], "batch_multiplier": -1}},
    ],
)
def test_bad_files(spark, tmp_path, changes):
    with pytest.raises(PricingError):
        load_pricing(spark, write(tmp_path, **changes))


@pytest.mark.parametrize(
    "models, modifiers, fallback",
    [
        ({}, SAMPLE_MODIFIERS, "a"),
        ({"a": (1, None)}, SAMPLE_MODIFIERS, "a"),
        ({"a": (1, 1)}, SAMPLE_MODIFIERS, "b"),
        ({"a": (1, 1)}, Modifiers(1, 1, None, 1), "a"),
    ],
)
def test_bad_values(spark, models, modifiers, fallback):
    with pytest.raises(PricingError):
        price_table(spark, models, modifiers, fallback)


def test_staleness(spark):
    now = dt.datetime(2026, 7, 20, 0, 0, 1, tzinfo=dt.timezone.utc)
    dates = spark.createDataFrame([(dt.date(2026, 6, 20),), (dt.date(2026, 6, 21),), (None,)], "d date")
    assert [r[0] for r in dates.select(is_stale(F.col("d"), now)).collect()] == [True, False, True]


@pytest.mark.parametrize("rate", ["0.00004", "0.12345", "3.00001"])
def test_rates_are_never_rounded(spark, tmp_path, rate):
    with pytest.raises(PricingError, match="decimal places"):
        load_pricing(spark, write(tmp_path, models={"b": {"input": float(rate), "output": 5}}))
    with pytest.raises(PricingError, match="decimal places"):
        price_table(spark, {"a": (rate, 5)}, SAMPLE_MODIFIERS, "a")
    assert load_pricing(spark, write(tmp_path, models={"b": {"input": 0.1234, "output": 5}})).rates_of("b")[0] == Decimal("0.1234")
