"""A source or a step that fails must not leave what looks like a whole result."""

import json

import pytest

import __spark_entry__ as registered
from times import at
from meterlake import IngestFailed, UsageStore, budget_table, ingest, session_log_source
from meterlake.plans import ingest as plan
from meterlake.plans.ingest import FileSource

LINE = json.dumps({"id": "m", "model": "small", "timestamp": "2027-05-09T23:59:59Z", "usage": {"input_tokens": 1_000_000}})


def broken(area, files, since):
    raise AssertionError


@pytest.fixture
def source(tmp_path):
    log = tmp_path / "projects/-Users-x-demo/session-1.jsonl"
    log.parent.mkdir(parents=True)
    log.write_text(f"{LINE}\nno object\n")
    return session_log_source(str(tmp_path))


@pytest.fixture
def store(spark, tmp_path):
    return UsageStore(spark, str(tmp_path / "store"))


def test_rejects_of_a_failed_source_are_not_left_out(spark, tmp_path, monkeypatch):
    """the query gave the rows of the other sources when one had failed."""
    rows = [(n, at("2024-01-09"), 7, t, 1.0, '{"k":1}') for n, t in enumerate(["view", "purchase", "error", "view"])]
    names = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
    spark.createDataFrame(rows, names).write.parquet(str(tmp_path / "events.parquet"))
    done = []

    def all_but_calls(store, source, prices):
        done.append(source.name)
        if source.name == "api":
            raise RuntimeError("no such thing")
        return plan.Ingested(source.name)

    monkeypatch.setattr(plan, "ingest_source", all_but_calls)
    with pytest.raises(IngestFailed, match="api failed: RuntimeError: no such thing") as failed:
        registered.queries()["stored_rejects"](spark, str(tmp_path)).collect()
    assert done == ["session_log", "api", "org_report"]
    assert [step for step, _ in failed.value.errors] == ["api"]


def test_strict_ingest_fails_after_all_is_done(spark, prices, store, source):
    bad = FileSource("bad", source.pattern, broken)
    budgets = budget_table(spark, {"monthly": "0.5"})
    with pytest.raises(IngestFailed, match="bad failed: AssertionError"):
        ingest(store, [bad, source], prices, budgets, at("2027-05-20"), strict=True)
    assert (store.events().count(), store.rejects().count()) == (1, 1)
    assert store.alerts().count() > 0
    assert ingest(store, [source], prices, strict=True).first().files_unchanged == 1


def test_numbers_of_a_failed_source_are_unknown(prices, store, source, monkeypatch):
    """Its events may be stored although it failed, and an error without a text is still one."""

    def late(*_):
        raise AssertionError

    monkeypatch.setattr(UsageStore, "record_files", late)
    row = ingest(store, [source], prices).first()
    assert row.error == "AssertionError: "
    assert [row.files_scanned, row.files_unchanged, row.rows_added, row.duplicates, row.records_skipped] == [None] * 5
    assert (row.events_before, row.events_after) == (0, 1)


def test_failed_alert_step_is_reported(spark, prices, store, source, monkeypatch):
    def late(*_):
        raise OSError("no room")

    monkeypatch.setattr(plan, "fire_alerts", late)
    budgets = budget_table(spark, {"monthly": "1"})
    rows = ingest(store, [source], prices, budgets, at("2027-05-20")).collect()
    assert [(r.source, r.rows_added, r.error) for r in rows] == [("session_log", 1, None), ("alerts", None, "OSError: no room")]
    with pytest.raises(IngestFailed, match="alerts failed: OSError: no room"):
        ingest(store, [source], prices, budgets, at("2027-05-20"), strict=True)
