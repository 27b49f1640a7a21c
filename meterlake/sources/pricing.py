"""The price table and pricing of events."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.functions import money
from meterlake.functions.calendar import DAY_MICROS, as_utc
from meterlake.functions.money import Modifiers, UnitRates

EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
RATE = "decimal(12,4)"
# As wide as files are read, so that a rate that RATE would round is seen.
READ_RATE = "decimal(38,18)"

# A price table up to this many models goes to every executor; a larger one is
# joined however Spark's own statistics say.
BROADCAST_MODELS = 50_000

PRICING_FILE_SCHEMA = (
    f"updated DATE, models MAP<STRING, STRUCT<input: {READ_RATE}, output: {READ_RATE}>>, "
    f"modifiers STRUCT<cache_read_multiplier: {READ_RATE}, cache_write_5m_multiplier: {READ_RATE}, "
    f"cache_write_1h_multiplier: {READ_RATE}, batch_multiplier: {READ_RATE}>, fallback_model STRING"
)


class PricingError(ValueError):
    """The price table is incomplete or invalid."""


@dataclass(frozen=True)
class PriceTable:
    """Rates per model as a DataFrame; the few single values as plain fields."""

    rates: DataFrame  # model, input_rate, output_rate: dollars per million tokens
    model_count: int
    modifiers: Modifiers
    fallback_model: str
    fallback_input: Decimal
    fallback_output: Decimal
    updated: dt.date | None = None

    def joinable_rates(self) -> DataFrame:
        return F.broadcast(self.rates) if self.model_count <= BROADCAST_MODELS else self.rates

    def rates_of(self, model: str) -> tuple[Decimal, Decimal] | None:
        """Input and output rate of one model, or None when it has no own rates."""
        row = self.rates.where(F.col("model") == model).first()
        return None if row is None else (row.input_rate, row.output_rate)


def _check_modifiers(modifiers: Modifiers) -> None:
    if any(m is None or m < 0 for m in modifiers):
        raise PricingError("a price modifier is missing or negative")


def _places(value: Column) -> Column:
    """Decimal places that a number needs."""
    return F.length(F.regexp_replace(F.split_part(value.cast("decimal(38,18)").cast("string"), F.lit("."), F.lit(2)), "0+$", ""))


def _check_places(facts, modifiers: Modifiers) -> None:
    """Costs are exact only if a rate times its factors fits the unit rate's places; nothing is rounded to make it fit."""
    factors = max(-(m.normalize().as_tuple().exponent) for m in modifiers[:3]) + max(0, -modifiers.batch.normalize().as_tuple().exponent)
    if facts > money.places(RATE) or facts + max(0, factors) > money.places(money.UNIT_RATE):
        raise PricingError(f"a rate has {facts} decimal places, too many to be kept exactly with these modifiers")


def load_pricing(spark: SparkSession, path: str) -> PriceTable:
    """Read and check a pricing file (one JSON object)."""
    raw = spark.read.schema(PRICING_FILE_SCHEMA).json(path, multiLine=True)
    head = raw.select("updated", "modifiers", "fallback_model").first()
    if head is None or head.modifiers is None:
        raise PricingError(f"no price table in {path}")
    modifiers = Modifiers(*head.modifiers)
    _check_modifiers(modifiers)
    rates = raw.select(F.explode("models").alias("model", "rate")).select(
        "model",
        F.col("rate.input").alias("input_rate"),
        F.col("rate.output").alias("output_rate"),
    )
    most_places = rates.agg(F.max(F.greatest(_places(F.col("input_rate")), _places(F.col("output_rate"))))).first()[0]
    _check_places(most_places or 0, modifiers)
    rates = rates.select("model", F.col("input_rate").try_cast(RATE).alias("input_rate"), F.col("output_rate").try_cast(RATE).alias("output_rate"))
    is_fallback = F.col("model") == F.lit(head.fallback_model)
    facts = rates.agg(
        F.count(F.lit(1)).alias("models"),
        F.count_if(
            ~F.coalesce((F.col("input_rate") >= 0) & (F.col("output_rate") >= 0), F.lit(False))
        ).alias("bad"),
        F.max(F.when(is_fallback, F.struct("input_rate", "output_rate"))).alias("fallback"),
    ).first()
    if facts.models == 0:
        raise PricingError("the price table has no models")
    if facts.bad:
        raise PricingError(f"{facts.bad} models have a missing or negative rate")
    if facts.fallback is None:
        raise PricingError("fallback_model must name a model in the price table")
    return PriceTable(rates, facts.models, modifiers, head.fallback_model, *facts.fallback, head.updated)


def price_table(
    spark: SparkSession,
    models: Mapping[str, tuple],
    modifiers: Modifiers,
    fallback_model: str,
    updated: dt.date | None = None,
) -> PriceTable:
    """A price table from values in the program: model to input and output rate."""
    modifiers = Modifiers(*[None if m is None else Decimal(str(m)) for m in modifiers])
    _check_modifiers(modifiers)
    rates = {model: [None if r is None else Decimal(str(r)) for r in pair] for model, pair in models.items()}
    if not rates:
        raise PricingError("the price table has no models")
    bad = [model for model, pair in rates.items() if any(r is None or r < 0 for r in pair)]
    if bad:
        raise PricingError(f"models with a missing or negative rate: {bad}")
    if fallback_model not in rates:
        raise PricingError("fallback_model must name a model in the price table")
    _check_places(max(max(0, -r.normalize().as_tuple().exponent) for pair in rates.values() for r in pair), modifiers)
    columns = {"model": list(rates)} | {
        name: [str(pair[i]) for pair in rates.values()] for i, name in enumerate(("input_rate", "output_rate"))
    }
    table = spark.createDataFrame(pa.table(columns)).select(
        "model", F.col("input_rate").cast(RATE), F.col("output_rate").cast(RATE)
    )
    return PriceTable(table, len(rates), modifiers, fallback_model, *rates[fallback_model], updated)


def _literal_rates(prices: PriceTable, input_rate: Decimal, output_rate: Decimal) -> UnitRates:
    """Unit rates of one known model, chosen by each event's batch flag."""
    direct, batched = (
        money.unit_rates(F.lit(input_rate).cast(RATE), F.lit(output_rate).cast(RATE), prices.modifiers, batch)
        for batch in (False, True)
    )
    return money.rates_for(F.col("is_batch"), batched, direct)


def _unit_rate_table(prices: PriceTable) -> DataFrame:
    """Two rows per model, for direct and for batch calls, with all factors multiplied in."""
    sides = [
        prices.rates.select(
            F.col("model").alias("rate_model"),
            F.lit(batch).alias("rate_batch"),
            *[
                rate.alias(f"rate_{kind}")
                for kind, rate in money.unit_rates(
                    F.col("input_rate"), F.col("output_rate"), prices.modifiers, batch
                )._asdict().items()
            ],
        )
        for batch in (False, True)
    ]
    table = sides[0].unionAll(sides[1])
    return F.broadcast(table) if prices.model_count <= BROADCAST_MODELS else table


def price(events: DataFrame, prices: PriceTable, model: str = "model") -> DataFrame:
    """Add ``known_model`` and ``cost_usd`` to events (reprices when already priced).

    ``model`` names the column to price by: the reported name, which may be null
    or unknown and is then priced as the fallback model.
    """
    table = _unit_rate_table(prices)
    same = (F.col(model) == F.col("rate_model")) & (F.col("is_batch") == F.col("rate_batch"))
    fallback = _literal_rates(prices, prices.fallback_input, prices.fallback_output)
    rates = UnitRates(
        *[F.coalesce(F.col(f"rate_{kind}"), rate) for kind, rate in fallback._asdict().items()]
    )
    return events.join(table, same, "left").withColumns(
        {"known_model": F.col("rate_model").isNotNull(), "cost_usd": money.cost_usd(rates)}
    ).drop(*table.columns)


def cost_at(prices: PriceTable, model: str) -> Column | None:
    """Cost of each event had it run on ``model``; None when that has no rates."""
    found = prices.rates_of(model)
    return None if found is None else money.cost_usd(_literal_rates(prices, *found))


def is_stale(updated: Column, now: dt.datetime, days: int = 30) -> Column:
    """Whether a price table of that date is older than ``days``, or undated.

    The age is measured in time from the start of that day, so it turns stale
    as soon as ``days`` whole days have passed.
    """
    limit = round((as_utc(now) - EPOCH) / dt.timedelta(microseconds=1)) - days * DAY_MICROS
    return F.coalesce(F.unix_date(updated).cast("long") * F.lit(DAY_MICROS) < F.lit(limit), F.lit(True))
