"""Exact cost arithmetic.

Rates are dollars per million tokens, so tokens times rate is micro-dollars and
rounding to a whole micro-dollar is rounding to six decimal places. Everything is
decimal: a sum does not depend on the order in which partitions arrive.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


def places(decimal_type: str) -> int:
    """The scale of a decimal type written as text."""
    return int(decimal_type.rstrip(")").split(",")[1])


# 19 digits hold any BIGINT. Times a 16-digit rate, summed in pairs, this is 38
# digits, the most a Spark decimal has, so no digit is lost before rounding.
TOKENS = "decimal(19,0)"
UNIT_RATE = "decimal(16,8)"
SAVING = "decimal(24,10)"
SCALE = "decimal(13,8)"
# A rate has eight places, so it is a whole number of units, 10^8 of which are a micro-dollar.
UNITS = 10 ** places(UNIT_RATE)


class Modifiers(NamedTuple):
    cache_read: Decimal
    cache_write_5m: Decimal
    cache_write_1h: Decimal
    batch: Decimal


class UnitRates(NamedTuple):
    """Units, 10^-8 micro-dollars, per token of each kind, as BIGINT, the batch discount included."""

    input: Column
    output: Column
    cache_read: Column
    cache_write_5m: Column
    cache_write_1h: Column


def unit_rates(input_rate: Column, output_rate: Column, modifiers: Modifiers, batch: bool) -> UnitRates:
    discount = modifiers.batch if batch else Decimal(1)

    def rate(base: Column, factor: Decimal) -> Column:
        return ((base * F.lit(factor * discount)).cast(UNIT_RATE) * F.lit(Decimal(UNITS))).cast("bigint")

    return UnitRates(
        rate(input_rate, Decimal(1)),
        rate(output_rate, Decimal(1)),
        rate(input_rate, modifiers.cache_read),
        rate(input_rate, modifiers.cache_write_5m),
        rate(input_rate, modifiers.cache_write_1h),
    )


def rates_for(is_batch: Column, batched: UnitRates, direct: UnitRates) -> UnitRates:
    return UnitRates(*[F.when(is_batch, b).otherwise(d) for b, d in zip(batched, direct)])


def cost_usd(rates: UnitRates) -> Column:
    """Dollars of one event, rounded to six places; NULL beyond ``DECIMAL(18,6)``.

    Whole units are multiplied and summed in 64 bits. Only an event for which they are
    too few, or whose sum is negative, is computed in decimals, with the same result.
    """
    write_rate = F.when(F.col("cache_ttl") == "1h", rates.cache_write_1h).otherwise(rates.cache_write_5m)
    kinds = [
        (F.col("input_tokens"), rates.input),
        (F.col("output_tokens"), rates.output),
        (F.col("cache_read_tokens"), rates.cache_read),
        (F.col("cache_creation_tokens"), write_rate),
    ]
    units = reduce(F.try_add, [F.try_multiply(tokens, rate) for tokens, rate in kinds], F.lit(UNITS // 2))
    in_64_bits = F.when(units >= UNITS // 2, F.call_function("div", units, F.lit(UNITS)))

    def exact(tokens: Column, rate: Column) -> Column:
        return tokens.cast(TOKENS) * (rate.cast("decimal(16,0)") * F.lit(Decimal(1) / UNITS)).cast(UNIT_RATE)

    fresh, written, read, created = [exact(tokens, rate) for tokens, rate in kinds]
    in_decimals = F.round((fresh + written) + (read + created), 0).try_cast("bigint")
    micros = F.coalesce(in_64_bits, in_decimals).try_cast("decimal(18,0)")
    return (micros * F.lit(Decimal("0.000001"))).try_cast("decimal(18,6)")


def monthly(saving: Column, span_days: float) -> Column:
    """A window's saving as a figure per 30 days, rounded to cents."""
    factor = (Decimal(30) / Decimal(repr(span_days))).quantize(Decimal("1e-8"), ROUND_HALF_UP)
    return F.round(saving.cast(SAVING) * F.lit(factor).cast(SCALE), 2).cast("decimal(20,2)")


def dollars(amount: Column) -> Column:
    """``$`` and the amount with two decimals."""
    return F.concat(F.lit("$"), F.round(amount, 2).cast("decimal(20,2)").cast("string"))
