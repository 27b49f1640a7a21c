"""Budget status and alert crossings."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.functions.calendar import PERIODS, period_bounds, period_key
from meterlake.operators.filters import in_range
from meterlake.sources.budgets import DEFAULT_FRACTIONS, checked_fractions

AMBER = Decimal("0.8")
RED = Decimal("1")
FRACTION = "decimal(10,4)"


def period_spend(events: DataFrame, now: dt.datetime) -> DataFrame:
    """``(project, period, spend)`` for the periods that hold ``now``.

    One pass over the days that any of the periods covers sums all three at once.
    The row with ``is_global`` is the sum over all projects.
    """
    bounds = {period: period_bounds(period, now) for period in PERIODS}
    covered = in_range(
        events,
        min(start for start, _ in bounds.values()),
        max(end for _, end in bounds.values()),
        end_inclusive=False,
    )
    sums = [
        F.sum(F.when((F.col("ts") >= F.lit(start)) & (F.col("ts") < F.lit(end)), F.col("cost_usd"))).alias(period)
        for period, (start, end) in bounds.items()
    ]
    per_project = covered.groupBy("project").agg(*sums)
    scopes = F.array(
        F.struct(F.lit(False).alias("is_global"), F.col("project").alias("scope_project")),
        F.struct(F.lit(True).alias("is_global"), F.lit(None).cast("string").alias("scope_project")),
    )
    periods = F.array(*[F.struct(F.lit(p).alias("period"), F.col(p).alias("spend")) for p in PERIODS])
    return (
        per_project.select(F.inline(scopes), *PERIODS)
        .select("is_global", F.col("scope_project").alias("project"), F.inline(periods))
        .groupBy("is_global", "project", "period")
        .agg(F.sum("spend").cast("decimal(28,6)").alias("spend"))
    )


def _in_order(period: Column) -> Column:
    return F.array_position(F.array(*[F.lit(p) for p in PERIODS]), period)


def budget_status(events: DataFrame, budgets: DataFrame, now: dt.datetime) -> DataFrame:
    """Spend against each budget in its current period; a budget without spend has 0."""
    spend = period_spend(events, now).select(
        F.coalesce(F.concat(F.lit("project:"), F.col("project")), F.when(F.col("is_global"), "global")).alias("scope"),
        "period",
        "spend",
    )
    key = F.lit(None).cast("string")
    for period in PERIODS:
        key = F.when(F.col("period") == period, period_key(F.lit(now).cast("timestamp"), period)).otherwise(key)
    spent = F.coalesce("spend", F.lit(0)).cast("decimal(28,6)")
    return (
        budgets.join(spend, ["scope", "period"], "left")
        .withColumn("spend", spent)
        .select(
            "scope",
            "project",
            "period",
            key.alias("period_key"),
            "budget",
            "spend",
            F.round(F.col("spend") / F.col("budget"), 6).cast("decimal(24,6)").alias("fraction_used"),
            F.when(F.col("spend") >= F.col("budget") * F.lit(RED), "red")
            .when(F.col("spend") >= F.col("budget") * F.lit(AMBER), "amber")
            .otherwise("ok")
            .alias("level"),
        )
        .orderBy("scope", _in_order(F.col("period")))
    )


def fraction_label(fraction: Column) -> Column:
    """``0.8`` and ``1`` rather than ``0.8000`` and ``1.0000``."""
    return F.regexp_replace(fraction.cast(FRACTION).cast("string"), r"[.]?0+$", "")


def dedupe_key(calendar_key: Column, fraction: Column) -> Column:
    return F.concat(calendar_key, F.lit("@"), fraction_label(fraction))


def split_dedupe_key(key: Column) -> tuple[Column, Column]:
    """Calendar key and fraction of a combined key."""
    fraction = F.nullif(F.split_part(key, F.lit("@"), F.lit(2)), F.lit("")).try_cast(FRACTION)
    return F.split_part(key, F.lit("@"), F.lit(1)), fraction


def crossings(status: DataFrame, fractions: Sequence[str | Decimal] = DEFAULT_FRACTIONS) -> DataFrame:
    """One row per budget and alert fraction that its spend has reached."""
    marks = F.array(*[F.lit(f).cast(FRACTION) for f in checked_fractions(fractions)])
    threshold = F.round(F.col("fraction") * F.col("budget"), 6).cast("decimal(24,6)")
    return (
        status.select("*", F.explode(marks).alias("fraction"))
        .where(F.col("spend") >= F.col("fraction") * F.col("budget"))
        .select(
            "scope",
            "project",
            "period",
            F.col("period_key").alias("calendar_key"),
            dedupe_key(F.col("period_key"), F.col("fraction")).alias("period_key"),
            "fraction",
            threshold.alias("threshold"),
            F.col("spend").alias("actual"),
        )
    )


def not_fired(crossed: DataFrame, fired: DataFrame) -> DataFrame:
    """Crossings that are not in the alert log yet."""
    keys = ["scope", "period", "calendar_key", "fraction"]
    return crossed.join(fired.select(*keys), keys, "left_anti")


def recent_alerts(fired: DataFrame, limit: int = 50) -> DataFrame:
    """The latest alerts, newest first."""
    return (
        fired.select("*", dedupe_key(F.col("calendar_key"), F.col("fraction")).alias("period_key"))
        .orderBy(F.desc("ts"), "scope", "period", F.desc("fraction"), "calendar_key")
        .limit(limit)
    )


def alert_messages(alerts: DataFrame) -> DataFrame:
    """Title, text and JSON payload of each alert, for whatever delivers them."""
    percent = F.round(F.col("fraction") * 100, 0).cast("bigint")
    title = F.format_string("%s budget of %s: %d%% reached", "period", "scope", percent)
    body = F.format_string(
        "spend_usd=%s threshold_usd=%s",
        F.round("actual", 2).cast("decimal(20,2)").cast("string"),
        F.round("threshold", 2).cast("decimal(20,2)").cast("string"),
    )
    named = alerts.withColumns({"title": title, "message": body})
    payload = F.to_json(
        F.struct(
            "title",
            "message",
            "scope",
            "period",
            F.col("fraction").cast("double").alias("fraction"),
            F.col("threshold").cast("double").alias("threshold"),
            F.col("actual").cast("double").alias("actual"),
            "period_key",
        )
    )
    return named.select("title", "message", payload.alias("payload"))
