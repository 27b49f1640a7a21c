"""Queries on a larger, skewed copy of the sample tables: python tests/scale.py new-folder [copies] [name ...]

A third of all events belong to one project, and a third of all line items have
one key. For each query the script prints seconds, shuffled and spilled bytes and
the input of the largest task.
"""

from __future__ import annotations

import pathlib
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

import __spark_entry__ as registered  # noqa: E402

SAMPLE = "/root/testdata/sf0.1"
STREAMS_AND_PARSERS = ("parse_session_lines", "api_records", "flatten_org_report", "ingest_report")


def copies_of(spark: SparkSession, table: str, copies: int) -> DataFrame:
    rows = spark.read.parquet(f"{SAMPLE}/{table}.parquet")
    numbers = spark.range(copies).withColumnRenamed("id", "copy").repartition(min(copies, 64))
    return numbers.crossJoin(F.broadcast(rows))


def write_skewed(spark: SparkSession, folder: str, copies: int) -> None:
    events = copies_of(spark, "events", copies)
    shift = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("copy") * 0.37)
    events.withColumns(
        {
            "event_id": F.col("event_id") + F.col("copy") * 10_000_000,
            "ts": F.col("ts") + shift,
            "user_id": F.when(F.col("event_id") % 3 == 0, 0).otherwise(F.col("user_id")).cast("bigint"),
        }
    ).drop("copy").write.parquet(f"{folder}/events.parquet")
    items = copies_of(spark, "lineitem", max(copies // 6, 1))
    hot = F.col("l_partkey") % 3 == 0
    items.withColumns(
        {
            "l_orderkey": F.when(hot, 1).otherwise(F.col("l_orderkey") + F.col("copy") * 10_000_000).cast("bigint"),
            "l_linenumber": F.when(hot, 1).otherwise(F.col("l_linenumber")).cast("int"),
        }
    ).drop("copy").write.parquet(f"{folder}/lineitem.parquet")


def stages(spark: SparkSession) -> dict[int, object]:
    store = spark._jsc.sc().statusStore()
    found = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return {found.apply(i).stageId(): found.apply(i) for i in range(found.size())}


def main() -> None:
    folder, copies = sys.argv[1], int(sys.argv[2]) if len(sys.argv) > 2 else 100
    names = sys.argv[3:] or [n for n in registered.queries() if n not in STREAMS_AND_PARSERS and not n.endswith("stream")]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "32")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    if not pathlib.Path(folder, "lineitem.parquet").exists():
        write_skewed(spark, folder, copies)
    for name in names:
        before = set(stages(spark))
        start = time.perf_counter()
        registered.queries()[name](spark, folder).write.format("noop").mode("overwrite").save()
        took = time.perf_counter() - start
        new = [s for number, s in stages(spark).items() if number not in before]
        shuffled = sum(s.shuffleWriteBytes() for s in new) / 1e6
        rows = sum(s.shuffleWriteRecords() for s in new)
        spilled = sum(s.diskBytesSpilled() for s in new) / 1e6
        print(f"{name:36s} {took:7.2f} s  shuffle {shuffled:9.2f} MB {rows:>10d} rows  spill {spilled:8.1f} MB", flush=True)


if __name__ == "__main__":
    main()
