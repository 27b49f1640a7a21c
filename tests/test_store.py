import datetime as dt

from pyspark.sql import functions as F

from times import at
from meterlake import UsageStore, in_range, summary
from meterlake.operators.dedup import first_per_key, not_stored
from meterlake.staging import staging_root


def test_hot_key_keeps_its_first_row(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("key"),
        (F.col("id") * 7919 % 3000).alias("place"),
        F.col("id"),
    )
    kept = first_per_key(rows, "key", ["place"])
    assert kept.count() == 2001
    hot = rows.where("key = 'hot'").orderBy("place").first()
    assert kept.where("key = 'hot'").first() == hot
    assert kept.columns == rows.columns
    shuffled = first_per_key(rows.repartition(7, "id"), "key", ["place"])
    assert sorted(shuffled.collect()) == sorted(kept.collect())


def test_not_stored(spark):
    new, stored = spark.range(10).withColumnRenamed("id", "k"), spark.range(5, 20).withColumnRenamed("id", "k")
    assert sorted(r.k for r in not_stored(new, stored, "k").collect()) == list(range(5))


def test_append_twice_is_append_once(spark, usage, tmp_path):
    store = UsageStore(spark, str(tmp_path))
    events = usage(
        {"event_uid": "a", "ts": at("2026-06-02"), "input_tokens": 5},
        {"event_uid": "a", "ts": at("2026-06-01"), "input_tokens": 9},
        {"event_uid": "b", "ts": at("2026-06-03")},
    )
    assert store.append_events(events) == 2
    assert store.append_events(events) == 0
    more = usage({"event_uid": "b", "ts": at("2026-01-01"), "input_tokens": 77}, {"event_uid": "c"})
    assert store.append_events(more) == 1
    rows = {r.event_uid: r for r in store.events().collect()}
    assert set(rows) == {"a", "b", "c"}
    # The earliest of new ones counts, and a stored one is not replaced.
    assert (rows["a"].input_tokens, rows["b"].input_tokens) == (9, 0)


def test_row_order_does_not_matter(usage):
    events = usage(*[{"input_tokens": 10**i, "model": m} for i in range(9) for m in ("large-a", "small", "unlisted")])
    assert summary(events).collect() == summary(events.repartition(5).orderBy(F.rand(3))).collect()


def test_reports_read_only_the_days_they_need(spark, usage, tmp_path):
    store = UsageStore(spark, str(tmp_path))
    store.append_events(usage(*[{"ts": at("2026-06-01") + dt.timedelta(days=d)} for d in range(10)]))
    rows = in_range(store.events(), at("2026-06-03"), at("2026-06-04T12:00:00"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan and "event_date#" in plan.split("PartitionFilters")[1]
    assert rows.count() == 2
    assert len(rows.inputFiles()) == 10  # the listing; the filter leaves two of them
    summed = summary(rows)._jdf.queryExecution().executedPlan().toString()
    assert "session_id" not in summed and "raw_meta" not in summed


def test_staging_follows_the_session_setting(spark):
    assert staging_root(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_dated_events_are_looked_up_on_their_day(spark, usage, tmp_path):
    store = UsageStore(spark, str(tmp_path))
    first = usage({"event_uid": "a", "ts": at("2026-06-01")}, {"event_uid": "b", "ts": at("2026-06-02")})
    assert store.append_events(first.withColumn("dated", F.lit(True))) == 2
    again = usage(
        {"event_uid": "a", "ts": at("2026-06-01")},
        {"event_uid": "b", "ts": at("2026-06-05")},
        {"event_uid": "c", "ts": at("2026-06-01")},
    )
    # "b" comes with another time, so it must not claim to be dated.
    assert store.append_events(again.withColumn("dated", F.col("event_uid") != "b")) == 1
    assert sorted(r.event_uid for r in store.events().collect()) == ["a", "b", "c"]


def test_staged_tables_are_removed(spark, usage, tmp_path):
    import pathlib

    UsageStore(spark, str(tmp_path)).append_events(usage({}))
    assert not list(pathlib.Path(staging_root(spark)).glob("meterlake/append-events-*"))
