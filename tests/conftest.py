from __future__ import annotations

import datetime as dt
import itertools
import pathlib
import sys

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from meterlake.sources.pricing import price  # noqa: E402
from meterlake.sources.samples import sample_prices  # noqa: E402

UTC = dt.timezone.utc


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("meterlake-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def prices(spark):
    return sample_prices(spark)


DEFAULTS = {
    "source": "session_log",
    "project": "demo",
    "model": "medium",
    "input_tokens": 0,
    "output_tokens": 0,
    "cache_creation_tokens": 0,
    "cache_read_tokens": 0,
    "is_batch": False,
    "cache_ttl": None,
    "session_id": None,
}
SCHEMA = (
    "event_uid string, ts timestamp, source string, project string, model string, input_tokens bigint, "
    "output_tokens bigint, cache_creation_tokens bigint, cache_read_tokens bigint, is_batch boolean, "
    "cache_ttl string, session_id string"
)


@pytest.fixture(scope="session")
def usage(spark, prices):
    """Priced events from dicts that name only what matters."""

    def make(*rows: dict):
        numbers = itertools.count()
        full = []
        for row in rows:
            number = next(numbers)
            values = {"event_uid": f"u{number}", "ts": dt.datetime(2026, 6, 20, tzinfo=UTC), **DEFAULTS, **row}
            full.append(tuple(values[name.split()[0]] for name in SCHEMA.split(", ")))
        priced = price(spark.createDataFrame(full, SCHEMA), prices)
        empty_meta = "struct<unknown_model:boolean,reported_model:string,collector:string,reported_cost_usd:decimal(18,6),aggregated_cost:boolean>"
        return priced.withColumn("raw_meta", F.lit(None).cast(empty_meta)).withColumn("event_date", F.to_date("ts"))

    return make
