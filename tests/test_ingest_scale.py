"""What an ingest reads, stages and joins must not grow faster than its input."""

import io
import pathlib
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registered
from times import at
from meterlake import UsageStore
from meterlake.functions import jsonfields
from meterlake.plans.runs import KeyedRuns
from meterlake.schema import KEY_SCHEMA
from meterlake.sources import files as landed
from meterlake.staging import StagingArea


def plan_of(df):
    text = io.StringIO()
    with redirect_stdout(text):
        df.explain()
    return text.getvalue()


def test_small_splits_do_not_make_many_tasks(spark, tmp_path):
    """16 KB splits were one task and one staged file each."""
    (tmp_path / "projects/p").mkdir(parents=True)
    (tmp_path / "projects/p/s.jsonl").write_text("".join(f"line {n}\n" for n in range(1, 30_001)))
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionNum")
    before = [spark.conf.get(n, None) for n in names]
    with StagingArea(spark, "lines") as area:
        rows = landed.read_lines(area, f"{tmp_path}/projects/*/*.jsonl", whole_file_bytes=0, split_bytes=4096)
        assert sorted((r.line_number, r.value) for r in rows.collect()) == [(n, f"line {n}") for n in range(1, 30_001)]
        cut = spark.read.parquet(f"{area.folder}/split-lines-*")
        assert cut.select("split_start").distinct().count() > 60
        parts = list(pathlib.Path(area.folder.removeprefix("file:")).glob("split-lines-*/part-*"))
        # Splits are packed whole, so there may be some more tasks than asked for.
        assert len(parts) < 2 * landed.TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    assert [spark.conf.get(n, None) for n in names] == before


def test_keyed_lines_are_not_joined(spark):
    """drafts were joined with their lines by place."""
    lines = spark.createDataFrame([("/logs/projects/-a-p/session-p.jsonl", at("2026-06-01"), 1, '{"id":"m7","model":"small","usage":{}}')], "file_path string, modified timestamp, line_number long, value string")
    rows = registered._keyed_lines(lines, "whole")
    assert "Join" not in plan_of(rows)
    row = rows.first()
    assert (row.project, row.line_number, row.event_uid, row.key_holds) == ("p", 1, "7", True)


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r", ""])
@pytest.mark.parametrize("mark", ["", "﻿"])
def test_ends_of_lines(spark, tmp_path, end, mark):
    """texts without a carriage return are split without a regular expression."""
    (tmp_path / "a.txt").write_bytes(f"{mark}x\n\ny é{end}".encode())
    with StagingArea(spark, "lines") as area:
        rows = [sorted((r.line_number, r.value) for r in landed.read_lines(area, f"{tmp_path}/*.txt", whole_file_bytes=limit).collect()) for limit in (0, 10**9)]
    assert rows[0] == rows[1] == [(1, "x"), (2, ""), (3, "y é")]


def test_full_times_are_cast_as_they_are(spark):
    """a time in full form went through some twenty regular expressions."""
    texts = ["2024-01-01T00:00:11.172425Z", "2024-02-30T00:00:00Z", "2024-01-01 23:59:59+05:30", "2024-01-01T00:00:00.1234567z", "2024-01-01T24:00:00Z",
             "2024-01-01T00:00:00-0530", " 2024-01-01T00:00:00Z", "2024-01-01T00:00:00", "20240101T000000Z", "x", "", None, "2024-01-01T10:00:00+19:00", "2024-01-01T10:00:00Z\n"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    found = rows.select(jsonfields.text_instant(F.col("t")).alias("a"), jsonfields._loose_instant(F.col("t")).alias("b")).collect()
    assert [r.a for r in found] == [r.b for r in found] and found[0].a is not None


def test_new_events_are_staged_once(spark, usage, tmp_path, monkeypatch):
    """all new events were staged a second time after their keys were looked up."""
    staged, plain = [], StagingArea.stage

    def stage(self, df, label):
        rows = plain(self, df, label)
        staged.append((label, rows.count()))
        return rows

    store = UsageStore(spark, str(tmp_path))
    day = at("2026-06-01")
    first = usage(*[{"event_uid": f"e{i}", "ts": day} for i in range(40)])
    assert store.append_events(first.withColumn("dated", F.col("event_uid") < "e2")) == 40
    monkeypatch.setattr(StagingArea, "stage", stage)
    more = usage(*[{"event_uid": f"e{i}", "ts": day} for i in range(35, 60)])
    assert store.append_events(more.withColumn("dated", F.col("event_uid").isin("e36", "e50", "e51"))) == 20
    assert sorted(r.event_uid for r in store.events().collect()) == sorted(f"e{i}" for i in range(60))
    assert sorted(r.event_uid for r in store.event_keys.read().collect()) == sorted(f"e{i}" for i in range(60))
    assert sum(n for _, n in staged) == 25 + 5


def test_many_keys_are_looked_up_without_their_buckets(spark, tmp_path):
    """each key was repeated for each size of run and its bucket worked out, though all buckets were read."""
    table = KeyedRuns(spark, str(tmp_path), KEY_SCHEMA, "event_uid", None, 8)
    rows = lambda a, b: spark.range(a, b).select(F.col("id").cast("string").alias("event_uid"), F.current_date().alias("event_date"))
    for a, b in ((0, 40), (40, 50)):
        with StagingArea(spark, "keys") as area:
            table.append(area.stage(rows(a, b), "rows"), b - a)
    many, few = table.stored(rows(30, 1000)), table.stored(rows(45, 60))
    assert "Generate" not in plan_of(many) and "Generate" in plan_of(few)
    assert sorted(int(r[0]) for r in many.collect()) == list(range(30, 50))
    assert sorted(int(r[0]) for r in few.collect()) == list(range(45, 50))
