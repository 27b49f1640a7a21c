"""Usage and cost analytics for metered model APIs, on Spark DataFrames."""

from meterlake.functions.calendar import resolve_range
from meterlake.operators.budgets import budget_status, crossings, recent_alerts
from meterlake.operators.filters import in_range
from meterlake.operators.reports import breakdown, breakdown_all, health, project_list, spend_pivot, summary, timeseries
from meterlake.plans.alerts import fire_alerts
from meterlake.plans.ingest import IngestFailed, api_record_source, ingest, org_report_source, session_log_source
from meterlake.plans.store import UsageStore
from meterlake.plans.suggestions import savings_suggestions
from meterlake.sources.budgets import budget_table, load_budgets
from meterlake.sources.pricing import PriceTable, load_pricing, price, price_table

__all__ = [
    "IngestFailed",
    "PriceTable",
    "UsageStore",
    "api_record_source",
    "breakdown",
    "breakdown_all",
    "budget_status",
    "budget_table",
    "crossings",
    "fire_alerts",
    "health",
    "in_range",
    "ingest",
    "load_budgets",
    "load_pricing",
    "org_report_source",
    "price",
    "price_table",
    "project_list",
    "recent_alerts",
    "resolve_range",
    "savings_suggestions",
    "session_log_source",
    "spend_pivot",
    "summary",
    "timeseries",
]
