import datetime as dt
import json

from pyspark.sql import functions as F

from times import at
from meterlake import UsageStore, budget_table, session_log_source
from meterlake.operators.density import densest_window
from meterlake.streaming import streams
from test_ingest import FLAT, NESTED, NO_USAGE, write_log


def land(rows, folder, name):
    """One more Parquet file of a table."""
    rows.coalesce(1).write.mode("append").parquet(str(folder / name))
    return str(folder / name)


def test_append_stream_is_exact_across_batches_and_restarts(spark, usage, tmp_path):
    store = UsageStore(spark, str(tmp_path / "store"))
    checkpoint = str(tmp_path / "checkpoint")
    path = land(usage({"event_uid": "a"}, {"event_uid": "b"}, {"event_uid": "a"}), tmp_path, "in")

    def run():
        streams.append_stream(streams.read_table_stream(spark, path), store, checkpoint).awaitTermination()
        return sorted(r.event_uid for r in store.events().collect())

    assert run() == ["a", "b"]
    # A repeat long after any watermark is still recognised.
    land(usage({"event_uid": "a", "ts": at("2027-01-01")}, {"event_uid": "c", "ts": at("2020-01-01")}), tmp_path, "in")
    assert run() == ["a", "b", "c"]
    again = streams.append_stream(streams.read_table_stream(spark, path), store, str(tmp_path / "other"))
    again.awaitTermination()
    assert store.events().count() == 3


def test_tumbling_spend_drops_late_rows_and_holds_open_windows(spark, usage, tmp_path):
    minute = dt.timedelta(minutes=1)
    start = at("2026-06-20T00:00:00")
    path = land(usage(*[{"ts": start + i * 10 * minute, "input_tokens": 1} for i in range(24)]), tmp_path, "in")
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def run():
        spend = streams.tumbling_spend(streams.read_table_stream(spark, path), "30 minutes")
        rows = streams.write_available(spend, "spend", out, checkpoint)
        return {r[0]: r[1] for r in rows.select(F.hour("window_start"), "call_count").collect()}

    # The last row is at 03:50, so what ends after 03:20 is still open.
    assert run() == {0: 6, 1: 6, 2: 6}
    late = usage({"ts": start + 5 * minute}, {"ts": start + 235 * minute}, {"ts": start + 300 * minute})
    land(late, tmp_path, "in")
    assert run() == {0: 6, 1: 6, 2: 6, 3: 7}


def test_bursts_are_a_subset_of_the_exact_count(spark, usage, tmp_path):
    start = at("2026-06-20T00:00:00")
    rows = [{"ts": start + dt.timedelta(seconds=i * 20), "source": "api", "project": "p"} for i in range(120)]
    rows.append({"ts": start + dt.timedelta(days=1), "source": "api", "project": "q"})
    events = usage(*rows)
    path = land(events, tmp_path, "in")
    found = streams.write_available(
        streams.call_bursts(streams.read_table_stream(spark, path), "1 hour", 100), "bursts"
    )
    assert found.count() > 0 and found.where("project = 'q'").count() == 0
    exact = {r.project: r.max_in_window for r in densest_window(events, "project", 60).collect()}
    assert found.agg(F.max("calls")).first()[0] <= exact["p"]


def test_deduplicated_within_delay(spark, usage, tmp_path):
    path = land(usage({"event_uid": "a"}, {"event_uid": "a"}, {"event_uid": "b"}), tmp_path, "in")
    once = streams.write_available(streams.deduplicated(streams.read_table_stream(spark, path), "1 hour"), "once")
    assert sorted(r.event_uid for r in once.collect()) == ["a", "b"]


def test_ingest_stream_fires_alerts_once(spark, prices, tmp_path):
    store = UsageStore(spark, str(tmp_path / "store"))
    source = session_log_source(str(tmp_path))
    budgets = budget_table(spark, {"monthly": "0.0001"})

    def run():
        streams.ingest_stream(
            store, source, prices, str(tmp_path / "checkpoint"), budgets, lambda: at("2027-05-20"), files_per_batch=1
        ).awaitTermination()
        return store.events().count(), store.rejects().count(), store.alerts().count()

    write_log(tmp_path, f"{NESTED}\n{NO_USAGE}\n{FLAT}\n", "one")
    assert run() == (2, 1, 2)
    write_log(tmp_path, json.dumps({**json.loads(FLAT), "model": "unlisted"}), "two")
    assert run() == (3, 1, 2)
    assert run() == (3, 1, 2)
