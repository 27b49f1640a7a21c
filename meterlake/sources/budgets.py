"""Budgets as rows, from a settings file or from program values."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.functions.calendar import PERIODS

BUDGET = "decimal(18,6)"
PERIOD_MAP = f"MAP<STRING, {BUDGET}>"
BUDGET_FILE_SCHEMA = (
    f"budgets STRUCT<global: {PERIOD_MAP}, projects: MAP<STRING, {PERIOD_MAP}>>, "
    "alert_fractions ARRAY<decimal(10,4)>"
)
DEFAULT_FRACTIONS = ("0.8", "1.0")


class BudgetError(ValueError):
    """A budget or alert fraction is invalid."""


def _checked(budgets: DataFrame) -> DataFrame:
    bad = budgets.where(~F.col("period").isin(*PERIODS) | (F.col("budget") <= 0)).first()
    if bad is not None:
        raise BudgetError(
            f"budget of {bad.scope} must be positive and daily, weekly or monthly: {bad.period}={bad.budget}"
        )
    return budgets


def load_budgets(spark: SparkSession, path: str) -> DataFrame:
    """``(scope, project, period, budget)`` of a settings file; null budgets mean no limit."""
    raw = spark.read.schema(BUDGET_FILE_SCHEMA).json(path, multiLine=True).select("budgets.*")
    overall = raw.select(F.lit(None).cast("string").alias("project"), F.col("global").alias("limits"))
    per_project = raw.select(F.explode("projects").alias("project", "limits"))
    rows = overall.unionByName(per_project).select("project", F.explode("limits").alias("period", "budget"))
    return _checked(_with_scope(rows.where("budget IS NOT NULL")))


def load_alert_fractions(spark: SparkSession, path: str) -> tuple[Decimal, ...]:
    """The alert fractions of a settings file, ascending; the defaults where it has none."""
    row = spark.read.schema(BUDGET_FILE_SCHEMA).json(path, multiLine=True).select("alert_fractions").first()
    found = DEFAULT_FRACTIONS if row is None or row.alert_fractions is None else row.alert_fractions
    return checked_fractions(found)


def checked_fractions(fractions: Iterable[str | Decimal]) -> tuple[Decimal, ...]:
    values = sorted(Decimal(str(f)) for f in fractions if f is not None)
    if not values or values[0] <= 0:
        raise BudgetError("alert fractions must be one or more positive numbers")
    return tuple(values)


def budget_table(
    spark: SparkSession,
    overall: Mapping[str, object] | None = None,
    projects: Mapping[str, Mapping[str, object]] | None = None,
) -> DataFrame:
    """The same rows from program values."""
    entries = [(None, period, budget) for period, budget in (overall or {}).items()]
    for project, limits in (projects or {}).items():
        entries += [(project, period, budget) for period, budget in limits.items()]
    entries = [(p, period, str(budget)) for p, period, budget in entries if budget is not None]
    columns = ("project", "period", "budget")
    rows = spark.createDataFrame(
        pa.table(
            {name: [e[i] for e in entries] for i, name in enumerate(columns)},
            schema=pa.schema([(name, pa.string()) for name in columns]),
        )
    )
    return _checked(_with_scope(rows.withColumn("budget", F.col("budget").cast(BUDGET))))


def _with_scope(rows: DataFrame) -> DataFrame:
    scope = F.coalesce(F.concat(F.lit("project:"), F.col("project")), F.lit("global"))
    return rows.select(scope.alias("scope"), "project", "period", "budget")
