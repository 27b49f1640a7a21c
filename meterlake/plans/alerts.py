"""Fire-once budget alerts."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.operators.budgets import alert_messages, budget_status, crossings, not_fired
from meterlake.plans.store import UsageStore
from meterlake.schema import ALERT_SCHEMA
from meterlake.sources.budgets import DEFAULT_FRACTIONS
from meterlake.staging import stage


def fire_alerts(
    store: UsageStore,
    budgets: DataFrame,
    now: dt.datetime,
    fractions: Sequence[str | Decimal] = DEFAULT_FRACTIONS,
    outbox: bool = False,
) -> DataFrame:
    """Record crossings that have not fired yet in their period, and return them.

    ``outbox`` also writes a JSON message for each. Messages are written before
    the log: a job that dies in between repeats a message rather than losing it.
    """
    crossed = crossings(budget_status(store.events(), budgets, now), fractions)
    new = stage(not_fired(crossed, store.alerts()), "new-alerts")
    if outbox:
        alert_messages(new).select("payload").write.mode("append").text(store.outbox_path)
    log = new.select(F.lit(now).cast("timestamp").alias("ts"), *[c for c in ALERT_SCHEMA.fieldNames() if c != "ts"])
    log.coalesce(1).write.mode("append").parquet(store.alerts_path)
    return new
