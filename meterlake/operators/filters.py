"""Row selection shared by reports, budgets and savings rules."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.functions.calendar import as_utc


def in_range(
    events: DataFrame,
    start: dt.datetime | None = None,
    end: dt.datetime | None = None,
    project: str | None = None,
    model: str | None = None,
    end_inclusive: bool = True,
) -> DataFrame:
    """Events of a time range, and of one project or model where given.

    An empty project or model means no filter. Spark derives no partition filter
    from a filter on ``ts``, so stored events are also filtered by ``event_date``.
    """
    stored = "event_date" in events.columns
    if start is not None:
        start = as_utc(start)
        events = events.where(F.col("ts") >= F.lit(start))
        if stored:
            events = events.where(F.col("event_date") >= F.lit(start.date()))
    if end is not None:
        end = as_utc(end)
        events = events.where(F.col("ts") <= F.lit(end) if end_inclusive else F.col("ts") < F.lit(end))
        if stored:
            events = events.where(F.col("event_date") <= F.lit(end.date()))
    if project:
        events = events.where(F.col("project") == project)
    if model:
        events = events.where(F.col("model") == model)
    return events
