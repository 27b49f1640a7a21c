"""What every source ends in: priced usage events and rejected records.

A source produces *drafts*: one row per raw record with the columns below, where
``reject_reason`` says why a record is no usage event. ``reported_model`` is the
name in the record, which may be missing or unknown to the price table. ``dated``
says that a record with the same key always has the same time, so that it can
only be stored on that day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.functions.calendar import utc_date
from meterlake.functions.labels import event_uid
from meterlake.schema import MONEY, RAW_META, TOKEN_COLUMNS, USAGE_COLUMNS
from meterlake.sources.pricing import PriceTable, price

DRAFT_COLUMNS = [
    "event_uid",
    "ts",
    "source",
    "project",
    "reported_model",
    *TOKEN_COLUMNS,
    "is_batch",
    "cache_ttl",
    "session_id",
    "dated",
    "collector",
    "reported_cost_usd",
    "aggregated_cost",
    "reject_reason",
    "location",
    "raw",
]


def any_tokens() -> Column:
    total = F.lit(False)
    for name in TOKEN_COLUMNS:
        total = total | (F.col(name) > 0)
    return total


def priced(drafts: DataFrame, prices: PriceTable) -> DataFrame:
    """Drafts with the columns of a usage event, still with their reject reasons."""
    rows = price(drafts, prices, model="reported_model")
    aggregated = F.col("aggregated_cost")
    meta = F.struct(
        F.when(~F.col("known_model"), F.lit(True)).alias("unknown_model"),
        F.when(~F.col("known_model"), F.col("reported_model")).alias("reported_model"),
        "collector",
        F.when(~aggregated, F.col("reported_cost_usd")).alias("reported_cost_usd"),
        F.when(aggregated, F.lit(True)).alias("aggregated_cost"),
    ).cast(RAW_META)
    has_meta = ~F.col("known_model") | F.col("collector").isNotNull()
    return (
        rows.withColumns(
            {
                "model": F.coalesce("reported_model", F.lit(prices.fallback_model)),
                "cost_usd": F.when(aggregated, F.col("reported_cost_usd")).otherwise(F.col("cost_usd")).cast(MONEY),
                "raw_meta": F.when(has_meta, meta),
                "event_date": utc_date(F.col("ts")),
            }
        )
        .withColumn(
            "reject_reason",
            F.coalesce("reject_reason", F.when(F.col("cost_usd").isNull(), F.lit("cost_out_of_range"))),
        )
        .select(*USAGE_COLUMNS, "dated", "reject_reason", "location", "raw")
    )


def accepted(rows: DataFrame) -> DataFrame:
    return rows.where("reject_reason IS NULL").select(*USAGE_COLUMNS, "dated")


def rejected(rows: DataFrame) -> DataFrame:
    """Rejected records under a key of their place and text."""
    return rows.where("reject_reason IS NOT NULL").select(
        event_uid(F.col("source"), F.col("location"), F.col("raw")).alias("reject_uid"),
        "source",
        "location",
        "reject_reason",
        "raw",
    )
