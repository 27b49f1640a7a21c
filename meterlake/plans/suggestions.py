"""All savings rules over one look-back window."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.functions.calendar import DEFAULT_RANGE_DAYS, resolve_range, span_days
from meterlake.operators import rules
from meterlake.operators.filters import in_range
from meterlake.sources.pricing import PriceTable


def savings_suggestions(
    events: DataFrame,
    prices: PriceTable,
    now: dt.datetime,
    start: str | dt.datetime | None = None,
    end: str | dt.datetime | None = None,
    project: str | None = None,
    model: str | None = None,
    lookback_days: int = DEFAULT_RANGE_DAYS,
    downgrade: Mapping | None = None,
    cache: Mapping | None = None,
    batch: Mapping | None = None,
) -> DataFrame:
    """Suggestions of the three rules, largest monthly saving first.

    Each rule reads its own columns and filters its own rows in the scan, which
    moves less than keeping the whole window for all three. ``downgrade``,
    ``cache`` and ``batch`` change parameters of the rules.
    """
    lower, upper = resolve_range(start, end, now, lookback_days)
    rows = in_range(events, lower, upper, project, model)
    days = span_days(lower, upper)
    found = (
        rules.model_downgrade(rows, prices, days, **(downgrade or {}))
        .unionByName(rules.missing_prompt_cache(rows, prices, days, **(cache or {})))
        .unionByName(rules.batch_candidates(rows, prices, days, **(batch or {})))
    )
    in_rule_order = F.array_position(
        F.array(*[F.lit(r) for r in ("model_downgrade", "missing_prompt_cache", "batch_candidates")]), F.col("rule")
    )
    return found.orderBy(
        F.desc("estimated_monthly_savings_usd"), in_rule_order, "project", "model", "input_bucket"
    )
