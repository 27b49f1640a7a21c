"""Spend reports: totals, time series, breakdowns, pivot."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.functions.calendar import bucket_key
from meterlake.schema import TOKEN_COLUMNS
from meterlake.sources.pricing import is_stale

DIMENSIONS = ("project", "model", "source")

OTHER = "other"


def total_tokens() -> Column:
    return sum((F.col(name) for name in TOKEN_COLUMNS[1:]), F.col(TOKEN_COLUMNS[0]))


def _measures() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("call_count"),
        F.coalesce(F.sum("cost_usd"), F.lit(0)).cast("decimal(28,6)").alias("spend_usd"),
        F.coalesce(F.sum(total_tokens()), F.lit(0)).alias("tokens"),
    ]


def cache_efficiency(cache_read: Column, input_tokens: Column) -> Column:
    """Share of input served from cache; 0 without any input."""
    return F.round(F.coalesce(F.try_divide(cache_read, input_tokens + cache_read), F.lit(0.0)), 6)


def summary(events: DataFrame) -> DataFrame:
    """One row of totals; zeros when there are no events."""
    sums = [F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in TOKEN_COLUMNS]
    totals = events.agg(
        F.count(F.lit(1)).alias("call_count"),
        F.coalesce(F.sum("cost_usd"), F.lit(0)).cast("decimal(28,6)").alias("total_spend_usd"),
        *sums,
    )
    return totals.withColumns(
        {
            "total_tokens": total_tokens(),
            "cache_efficiency": cache_efficiency(F.col("cache_read_tokens"), F.col("input_tokens")),
        }
    )


def timeseries(events: DataFrame, granularity: str = "day") -> DataFrame:
    """Calls, spend and tokens per time bucket and model, in that order."""
    bucket = bucket_key(F.col("ts"), granularity)
    return events.groupBy(bucket.alias("bucket"), "model").agg(*_measures()).orderBy("bucket", "model")


def breakdown(events: DataFrame, by: str = "project") -> DataFrame:
    """Calls, spend and tokens per project, model or source, largest spend first.

    Events without a project form their own group with a null key.
    """
    if by not in DIMENSIONS:
        raise ValueError(f"by must be one of {DIMENSIONS}, got {by!r}")
    groups = events.groupBy(F.col(by).alias("key")).agg(*_measures())
    return groups.orderBy(F.desc("spend_usd"), F.asc_nulls_first("key"))


def breakdown_all(events: DataFrame) -> DataFrame:
    """All three breakdowns in one pass; ``dimension`` says which one a row is of.

    The events are first summed per combination of the three, which a map task
    does in place, so only those combinations are copied once per dimension.
    """
    combined = events.groupBy(*DIMENSIONS).agg(*_measures())
    sides = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("key")) for d in DIMENSIONS])
    measures = ("call_count", "spend_usd", "tokens")
    return (
        combined.select(F.inline(sides), *measures)
        .groupBy("dimension", "key")
        .agg(*[F.sum(m).alias(m) for m in measures])
        .orderBy("dimension", F.desc("spend_usd"), F.asc_nulls_first("key"))
    )


def spend_pivot(
    events: DataFrame, granularity: str = "day", models: Sequence[str] | None = None
) -> DataFrame:
    """Spend per time bucket: one column for each of ``models`` and one, ``other``, for all the rest, missing cells 0.

    The columns of a bucket add up to its spend. Without ``models`` the result is
    long, ``(bucket, model, spend_usd)``, however many models there are.
    """
    bucket = bucket_key(F.col("ts"), granularity).alias("bucket")
    if models is None:
        spend = F.sum("cost_usd").cast("decimal(28,6)").alias("spend_usd")
        return events.groupBy(bucket, "model").agg(spend).orderBy("bucket", "model")
    if OTHER in models:
        raise ValueError(f"{OTHER!r} is the column of the models that are not named")
    columns = [*models, OTHER]
    named = F.when(F.col("model").isin(list(models)), F.col("model")).otherwise(F.lit(OTHER)).alias("column")
    spend = events.groupBy(bucket, named).agg(F.sum("cost_usd").alias("cost_usd"))
    wide = spend.groupBy("bucket").pivot("column", columns).agg(F.sum("cost_usd"))
    filled = {m: F.coalesce(F.col(f"`{m}`"), F.lit(0)).cast("decimal(28,6)") for m in columns}
    return wide.withColumns(filled).orderBy("bucket")


def project_list(events: DataFrame) -> DataFrame:
    """The names of all projects."""
    return events.where((F.col("project") != "")).select("project").distinct().orderBy("project")


def health(events: DataFrame, pricing_updated: dt.date | None, now: dt.datetime, stored: bool = True) -> DataFrame:
    """One row: whether the store is there, how many events, how old the prices are."""
    updated = F.lit(pricing_updated).cast("date")
    return events.agg(F.count(F.lit(1)).alias("event_count")).select(
        F.lit("ok" if stored else "degraded").alias("status"),
        "event_count",
        updated.alias("pricing_updated"),
        is_stale(updated, now).alias("pricing_stale"),
    )
