"""The tables that grow by runs, and the store's use of them."""

import pathlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlake import UsageStore
from meterlake.plans import runs as runs_module
from meterlake.plans.runs import KeyedRuns, slots_for
from times import at

SCHEMA = T.StructType([T.StructField("key", T.StringType(), False), T.StructField("n", T.LongType())])


def numbers(spark, start, stop):
    return spark.range(start, stop).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") * 3).alias("n"))


@pytest.mark.parametrize("rows, slots", [(0, 1), (1, 1), (10, 1), (11, 2), (20, 2), (21, 4), (41, 8), (80, 8)])
def test_slots(rows, slots):
    assert slots_for(rows, 10) == slots


def test_a_large_run_is_not_merged_with_small_ones(spark, tmp_path):
    table = KeyedRuns(spark, str(tmp_path / "t"), SCHEMA, "key", rows_per_bucket=64)
    table.append(numbers(spark, 0, 1_000), 1_000)
    large = table.snapshot().live[0]
    for n in range(8):
        table.append(numbers(spark, 1_000 + n, 1_001 + n), 1)
    assert large.level == 3 and large in table.snapshot().live
    assert [(r.level, r.rows) for r in table.snapshot().live] == [(3, 1_000), (1, 8)]
    assert table.read().count() == 1_008


def test_many_appends_leave_few_runs(spark, tmp_path):
    table = KeyedRuns(spark, str(tmp_path / "t"), SCHEMA, "key", rows_per_bucket=16)
    assert table.read().count() == 0 and table.stored(numbers(spark, 0, 3)).count() == 0
    for batch in range(20):
        table.append(numbers(spark, batch * 5, batch * 5 + 5), 5)
    table.append(numbers(spark, 0, 0), 0)
    now = table.snapshot()
    assert sorted(r.level for r in now.live) == [0, 0, 0, 0, 1, 1]
    assert sum(r.rows for r in now.live) == 100
    assert {r.slots for r in now.live} == {1, 4}
    assert sorted(map(tuple, table.read().collect())) == sorted(map(tuple, numbers(spark, 0, 100).collect()))
    # Runs of the last merge may still be read; those of the one before are gone.
    folders = {p.name.removeprefix("run=") for p in (tmp_path / "t").glob("run=*")}
    assert folders == {r.name for r in now.live} | set(now.retired)
    assert len([p for p in (tmp_path / "t" / "_snapshots").iterdir() if p.name.isdigit()]) <= runs_module.SNAPSHOTS_KEPT


@pytest.mark.parametrize("named", [0, 4_096])
def test_lookup_finds_stored_keys_alone(spark, tmp_path, monkeypatch, named):
    monkeypatch.setattr(runs_module, "NAMED_BUCKETS", named)
    table = KeyedRuns(spark, str(tmp_path / "t"), SCHEMA, "key", rows_per_bucket=8)
    for start, stop in ((0, 100), (100, 101), (101, 140)):
        table.append(numbers(spark, start, stop), stop - start)
    found = table.stored(numbers(spark, 90, 200))
    assert sorted(r.key for r in found.collect()) == sorted(f"k{i}" for i in range(90, 140))


def test_lookup_opens_only_its_buckets(spark, tmp_path):
    table = KeyedRuns(spark, str(tmp_path / "t"), SCHEMA, "key", rows_per_bucket=8)
    table.append(numbers(spark, 0, 1_000), 1_000)
    plan = table.stored(numbers(spark, 7, 8))._jdf.queryExecution().executedPlan().toString()
    filters = next(line for line in plan.splitlines() if "FileScan parquet" in line and "PartitionFilters" in line)
    assert "bucket#" in filters.split("PartitionFilters: [")[1].split("]")[0]


def test_merged_rows_are_one_per_key(spark, tmp_path):
    def greatest(rows):
        return rows.groupBy("key").agg(F.max("n").alias("n"))

    table = KeyedRuns(spark, str(tmp_path / "t"), SCHEMA, "key", greatest)
    for n in range(9):
        table.append(spark.createDataFrame([("a", n), (f"b{n}", n)], SCHEMA), 2)
    assert [(r.level, r.rows) for r in table.snapshot().live] == [(1, 9), (0, 2)]
    assert {r.key: r.n for r in table.read().collect()} == {"a": 8, **{f"b{n}": n for n in range(9)}}


def test_prepared_rows_count_when_committed(spark, tmp_path):
    table = KeyedRuns(spark, str(tmp_path / "t"), SCHEMA, "key")
    table.prepare(numbers(spark, 0, 4), 4)
    assert table.read().count() == 0 and table.prepared_rows().count() == 4
    with pytest.raises(RuntimeError):
        table.prepare(numbers(spark, 4, 5), 1)
    table.commit()
    assert table.read().count() == 4 and table.prepared_rows() is None


def test_a_second_writer_is_refused(spark, tmp_path):
    table = KeyedRuns(spark, str(tmp_path / "t"), SCHEMA, "key")
    stale = table.snapshot()
    table.append(numbers(spark, 0, 2), 2)
    with pytest.raises(RuntimeError, match="another writer"):
        table._publish(runs_module.Snapshot(stale.number + 1))
    assert table.read().count() == 2


@pytest.mark.parametrize("written", [False, True])
def test_a_job_that_died_around_the_append(spark, usage, tmp_path, monkeypatch, written):
    store = UsageStore(spark, str(tmp_path))
    store.append_events(usage({"event_uid": "a"}))
    batch = usage({"event_uid": "b", "ts": at("2026-06-01")}, {"event_uid": "c", "ts": at("2026-06-02")})
    if written:
        # The events are there, their keys do not count yet.
        monkeypatch.setattr(KeyedRuns, "commit", lambda self: (_ for _ in ()).throw(OSError("died")))
    else:
        monkeypatch.setattr(UsageStore, "events_path", property(lambda self: (_ for _ in ()).throw(OSError("died"))))
        monkeypatch.setattr(UsageStore, "_settle_keys", lambda self, area: None)
    with pytest.raises(OSError):
        store.append_events(batch)
    monkeypatch.undo()
    assert store.append_events(batch) == (0 if written else 2)
    assert sorted(r.event_uid for r in store.events().collect()) == ["a", "b", "c"]
    assert sorted(r.event_uid for r in store.event_keys.read().collect()) == ["a", "b", "c"]


def test_a_store_without_keys_is_given_them(spark, usage, tmp_path):
    store = UsageStore(spark, str(tmp_path))
    usage({"event_uid": "a"}, {"event_uid": "b"}).write.partitionBy("event_date").parquet(store.events_path)
    assert store.append_events(usage({"event_uid": "b"}, {"event_uid": "c"})) == 1
    assert sorted(r.event_uid for r in store.events().collect()) == ["a", "b", "c"]


def test_many_batches_of_rejects_and_files(spark, tmp_path):
    store = UsageStore(spark, str(tmp_path))
    for n in range(10):
        row = (f"r{n}", "api", f"f:{n}", "no_usage", "x")
        rejects = spark.createDataFrame([row, ("r0", "api", "f:0", "no_usage", "x")], store.reject_runs.schema)
        assert store.append_rejects(rejects) == 1
        files = spark.createDataFrame([("same", n, at("2026-06-01")), (f"f{n}", n, at("2026-06-01"))], "file_path string, length bigint, modified timestamp")
        store.record_files(files)
    assert store.rejects().count() == 10 and len(store.reject_runs.snapshot().live) == 3
    manifest = {r.file_path: r.length for r in store.manifest().collect()}
    assert manifest == {"same": 9, **{f"f{n}": n for n in range(10)}}
    assert len(list(pathlib.Path(store.root, "rejects").rglob("*.parquet"))) <= 11
