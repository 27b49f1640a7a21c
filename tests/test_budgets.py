import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from times import at
from meterlake import UsageStore, budget_status, budget_table, crossings, fire_alerts, load_budgets, recent_alerts
from meterlake.operators.budgets import alert_messages, fraction_label, split_dedupe_key
from meterlake.sources.budgets import BudgetError, load_alert_fractions

NOW = at("2026-06-20T12:00:00")


def test_levels_and_zero_spend(spark, usage):
    events = usage(
        {"ts": at("2026-06-20T01:00:00"), "model": "large-a", "input_tokens": 2_000_000, "project": "a"},
        {"ts": at("2026-06-15T00:00:00"), "model": "large-a", "input_tokens": 1_000_000, "project": None},
        {"ts": at("2026-06-14T23:59:59"), "model": "large-a", "input_tokens": 1_000_000, "project": "b"},
        {"ts": at("2026-05-31T23:59:59"), "model": "large-a", "input_tokens": 9_000_000, "project": "a"},
    )
    budgets = budget_table(
        spark,
        {"daily": 20, "weekly": 15, "monthly": 25},
        {"a": {"daily": 10, "weekly": None}, "idle": {"monthly": 1}, "b": {"weekly": 5, "monthly": 6}},
    )
    rows = {(r.scope, r.period): r for r in budget_status(events, budgets, NOW).collect()}
    got = {k: (r.spend, r.fraction_used, r.level, r.period_key) for k, r in rows.items()}
    assert got == {
        ("global", "daily"): (10, Decimal("0.5"), "ok", "2026-06-20"),
        ("global", "weekly"): (15, Decimal("1"), "red", "2026-W25"),
        ("global", "monthly"): (20, Decimal("0.8"), "amber", "2026-06"),
        ("project:a", "daily"): (10, Decimal("1"), "red", "2026-06-20"),
        ("project:b", "weekly"): (0, Decimal("0"), "ok", "2026-W25"),
        ("project:b", "monthly"): (5, Decimal("0.833333"), "amber", "2026-06"),
        ("project:idle", "monthly"): (0, Decimal("0"), "ok", "2026-06"),
    }


def test_a_project_called_like_the_overall_scope(spark, usage):
    events = usage({"ts": NOW, "model": "large-a", "input_tokens": 1_000_000, "project": "global"})
    rows = budget_status(events, budget_table(spark, {"daily": 10}, {"global": {"daily": 5}}), NOW).collect()
    assert [(r.scope, r.spend) for r in rows] == [("global", 5), ("project:global", 5)]


# 47.50 dollars in May.
MAY = {"ts": at("2027-05-11T06:30:00"), "model": "large-a", "input_tokens": 4_500_000, "output_tokens": 1_000_000}


def test_fire_once(spark, usage, tmp_path):
    store = UsageStore(spark, str(tmp_path))
    store.append_events(usage(MAY))
    budgets, when = budget_table(spark, {"monthly": 50}), at("2027-05-12")
    marks = ["0.25", "0.95", "0.96"]
    fired = fire_alerts(store, budgets, when, marks, outbox=True).orderBy("fraction").collect()
    assert [(r.period_key, r.threshold, r.actual) for r in fired] == [("2027-05@0.25", Decimal("12.5"), Decimal("47.5")), ("2027-05@0.95", Decimal("47.5"), Decimal("47.5"))]
    assert fire_alerts(store, budgets, when, marks, outbox=True).count() == 0
    # Another mark fires by itself, and so does each mark in another month.
    assert [r.period_key for r in fire_alerts(store, budgets, when, ["0.25", "0.6"]).collect()] == ["2027-05@0.6"]
    store.append_events(usage({"event_uid": "august", "ts": at("2027-08-31T23:00:00"), "model": "small", "output_tokens": 3_000_000}))
    assert [r.period_key for r in fire_alerts(store, budgets, at("2027-08-31T23:30:00"), marks).collect()] == ["2027-08@0.25"]
    assert [r.period_key for r in recent_alerts(store.alerts(), 3).collect()] == ["2027-08@0.25", "2027-05@0.95", "2027-05@0.6"]
    payloads = [json.loads(r.value) for r in spark.read.text(store.outbox_path).collect()]
    assert sorted(p["period_key"] for p in payloads) == ["2027-05@0.25", "2027-05@0.95"]
    assert {(p["scope"], p["period"], p["actual"]) for p in payloads} == {("global", "monthly", 47.5)}
    assert {key for p in payloads for key in p} == {"title", "message", "scope", "period", "fraction", "threshold", "actual", "period_key"}


@pytest.mark.parametrize("budget, want", [("47.5", ["0.8", "1"]), ("47.500001", ["0.8"]), ("59.375", ["0.8"]), ("59.375001", [])])
def test_crossings(spark, usage, budget, want):
    status = budget_status(usage(MAY), budget_table(spark, {"monthly": budget}), at("2027-05-31T23:59:59"))
    assert sorted(r.period_key for r in crossings(status).collect()) == [f"2027-05@{f}" for f in want]
    with pytest.raises(ValueError):
        crossings(status, [])
    with pytest.raises(ValueError):
        crossings(status, ["0"])


def test_message(spark, usage):
    status = budget_status(usage(MAY), budget_table(spark, {"monthly": "55"}), at("2027-05-20"))
    row = alert_messages(crossings(status)).first()
    assert (row.title, row.message) == ("monthly budget of global: 80% reached", "spend_usd=47.50 threshold_usd=44.00")


def test_labels(spark):
    labels = spark.createDataFrame([("0.8",), ("1",), ("10",), ("0.75",), ("100",)], "f string")
    text = labels.select(fraction_label(F.col("f").cast("decimal(10,4)"))).collect()
    assert [r[0] for r in text] == ["0.8", "1", "10", "0.75", "100"]
    keys = spark.createDataFrame([("2026-06@0.8",), ("2026-06",)], "k string")
    assert [tuple(r) for r in keys.select(*split_dedupe_key(F.col("k"))).collect()] == [
        ("2026-06", Decimal("0.8")), ("2026-06", None),
    ]


def test_load(spark, tmp_path):
    path = tmp_path / "settings.json"
    path.write_text(json.dumps({
        "budgets": {"global": {"daily": None, "monthly": 200}, "projects": {"a": {"weekly": 5.5}}},
        "alert_fractions": [0.8],
    }, indent=1))
    rows = {tuple(r) for r in load_budgets(spark, str(path)).collect()}
    assert rows == {("global", None, "monthly", Decimal(200)), ("project:a", "a", "weekly", Decimal("5.5"))}
    assert load_alert_fractions(spark, str(path)) == (Decimal("0.8"),)
    path.write_text(json.dumps({"budgets": {"global": {"monthly": 1}}, "alert_fractions": [0.5, -1]}))
    with pytest.raises(BudgetError):
        load_alert_fractions(spark, str(path))
    path.write_text(json.dumps({"budgets": {"global": {"monthly": 1}}}))
    assert load_budgets(spark, str(path)).count() == 1
    assert load_alert_fractions(spark, str(path)) == (Decimal("0.8"), Decimal("1.0"))


@pytest.mark.parametrize("limits", [{"yearly": 1}, {"daily": 0}, {"daily": -1}])
def test_bad_budgets(spark, limits):
    with pytest.raises(BudgetError):
        budget_table(spark, limits)
    with pytest.raises(BudgetError):
        budget_table(spark, {}, {"p": limits})


def test_no_budgets(spark, usage):
    assert budget_status(usage({}), budget_table(spark), NOW).count() == 0
