"""Streams over files that are in no order of time lose nothing."""

import functools

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from meterlake.streaming import streams


@pytest.mark.parametrize("name", ["tumbling_spend_stream", "burst_stream", "stream_dedup"])
def test_shuffled_files_one_a_batch(spark, tmp_path, monkeypatch, name):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.coalesce(1).write.parquet(str(tmp_path / "one" / "events.parquet"))
    events.repartition(5, F.xxhash64(*events.columns)).write.parquet(str(tmp_path / "many" / "events.parquet"))
    monkeypatch.setattr(streams, "read_table_stream", functools.partial(streams.read_table_stream, files_per_batch=1))
    rows = {k: sorted(map(str, entry.queries()[name](spark, str(tmp_path / k)).collect())) for k in ("one", "many")}
    assert rows["many"] == rows["one"] and rows["one"]
    if name == "stream_dedup":
        assert len(rows["one"]) == events.count()
    if name == "tumbling_spend_stream":
        assert entry.queries()[name](spark, str(tmp_path / "many")).agg(F.sum("call_count")).first()[0] == events.count()
