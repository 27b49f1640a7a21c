"""Usage events derived from the TPC-H-like sample tables.

They exercise every operator on data of any scale: ``usage_from_events`` has
short-term traffic of seven projects, ``usage_from_lineitem`` has volume, years
of months and real duplicates.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.functions import labels
from meterlake.functions.money import Modifiers
from meterlake.sources.pricing import PriceTable, price, price_table

# Dollars per million tokens, and what caching and batches cost.
SAMPLE_RATES = {
    "large-a": ("5", "25"),
    "large-b": ("5", "25"),
    "large-legacy": ("15", "75"),
    "medium": ("3", "15"),
    "small": ("1", "5"),
}
SAMPLE_MODIFIERS = Modifiers(Decimal("0.10"), Decimal("1.25"), Decimal("2.00"), Decimal("0.50"))
SAMPLE_FALLBACK = "medium"

# Models by remainder; the last one has no rates of its own.
SAMPLE_MODELS = ("large-a", "large-legacy", "medium", "small", "large-b", "unlisted")


def sample_prices(spark: SparkSession) -> PriceTable:
    return price_table(spark, SAMPLE_RATES, SAMPLE_MODIFIERS, SAMPLE_FALLBACK)


def _model(number: Column) -> Column:
    return F.get(F.array(*[F.lit(m) for m in SAMPLE_MODELS]), (number % 6).cast("int"))


def usage_from_events(events: DataFrame) -> DataFrame:
    """Unpriced usage of ``events (event_id, ts, user_id, event_type, value, props)``."""
    k, g = F.col("k"), F.col("g")
    type_ = F.col("event_type")
    return (
        events.withColumns(
            {"k": F.get_json_object("props", "$.k").cast("bigint"), "g": F.col("user_id") % 7}
        )
        .select(
            F.col("event_id").cast("string").alias("event_uid"),
            F.col("ts").cast("timestamp").alias("ts"),
            F.when(type_.isin("view", "click"), labels.SESSION_LOG)
            .when(type_ == "error", labels.ORG_REPORT)
            .otherwise(labels.API)
            .alias("source"),
            F.concat(F.lit("p"), g).alias("project"),
            _model(k).alias("model"),
            F.when(g == 0, k * k * 10).otherwise(k * 50 + 1000).alias("input_tokens"),
            F.floor(F.col("value") * F.when(g == 1, 20).otherwise(4)).cast("bigint").alias("output_tokens"),
            F.when(k % 5 == 0, k * 20).otherwise(0).alias("cache_creation_tokens"),
            F.when(k % 3 == 0, k * 40).otherwise(0).alias("cache_read_tokens"),
            (k % 10 == 9).alias("is_batch"),
            F.when(k % 5 == 0, F.when(k % 2 == 0, "5m").otherwise("1h")).alias("cache_ttl"),
            F.col("user_id").cast("string").alias("session_id"),
        )
    )


def usage_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """Unpriced usage of ``lineitem``, with its order columns for telling rows apart."""
    return lineitem.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("event_uid"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        F.when(F.col("l_returnflag") == "A", labels.SESSION_LOG)
        .when(F.col("l_returnflag") == "N", labels.API)
        .otherwise(labels.ORG_REPORT)
        .alias("source"),
        F.concat(F.lit("s"), F.col("l_suppkey") % 20).alias("project"),
        _model(F.col("l_partkey")).alias("model"),
        (F.col("l_quantity") * 100).cast("bigint").alias("input_tokens"),
        F.floor(F.col("l_extendedprice") / 100).cast("bigint").alias("output_tokens"),
        F.lit(0).cast("bigint").alias("cache_creation_tokens"),
        F.lit(0).cast("bigint").alias("cache_read_tokens"),
        F.lit(False).alias("is_batch"),
        F.lit(None).cast("string").alias("cache_ttl"),
        F.lit(None).cast("string").alias("session_id"),
        "l_partkey",
        "l_suppkey",
        "l_extendedprice",
        "l_quantity",
        "l_discount",
        "l_tax",
    )


def priced_events(spark: SparkSession, folder: str) -> DataFrame:
    return price(usage_from_events(spark.read.parquet(f"{folder}/events.parquet")), sample_prices(spark))


def priced_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    return price(usage_from_lineitem(spark.read.parquet(f"{folder}/lineitem.parquet")), sample_prices(spark))


def session_lines(events: DataFrame) -> DataFrame:
    """Log lines as a collector finds them, in both shapes, some of them broken.

    Of every 50 events one line is cut off and one has no usage.
    """
    usage = F.struct(
        "input_tokens",
        "output_tokens",
        F.col("cache_creation_tokens").alias("cache_creation_input_tokens"),
        F.col("cache_read_tokens").alias("cache_read_input_tokens"),
    )
    number = F.col("event_uid").cast("bigint")
    time = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    identity = F.concat(F.lit("m"), F.col("event_uid"))
    nested = F.to_json(
        F.struct(
            F.lit("assistant").alias("type"),
            time.alias("timestamp"),
            F.struct(identity.alias("id"), "model", usage.alias("usage")).alias("message"),
        )
    )
    flat = F.to_json(F.struct(time.alias("ts"), "model", identity.alias("id"), usage.alias("usage")))
    unused = F.to_json(
        F.struct(F.lit("user").alias("type"), F.struct(F.lit("hello").alias("content")).alias("message"))
    )
    whole = F.when(number % 2 == 0, nested).otherwise(flat)
    value = F.when(number % 50 == 0, F.expr("substring(line, 1, length(line) - 10)")).when(
        number % 50 == 1, unused
    ).otherwise(F.col("line"))
    return events.withColumn("line", whole).select(
        F.concat(F.lit("/logs/projects/-home-team-"), F.col("project"), F.lit("/s"), F.col("session_id"), F.lit(".jsonl"))
        .alias("file_path"),
        F.col("ts").alias("modified"),
        number.alias("line_number"),
        value.alias("value"),
    )


def api_calls(events: DataFrame) -> DataFrame:
    """Logged responses of the API events, each logged twice; one in five has no id."""
    usage = F.struct(
        "input_tokens",
        "output_tokens",
        F.when(F.col("cache_creation_tokens") > 0, F.col("cache_creation_tokens")).alias("cache_creation_input_tokens"),
        F.when(F.col("cache_read_tokens") > 0, F.col("cache_read_tokens")).alias("cache_read_input_tokens"),
    )
    number = F.col("event_uid").cast("bigint")
    identity = F.when(number % 5 != 0, F.concat(F.lit("r"), F.col("event_uid")))
    logged = events.where(F.col("source") == labels.API).select(
        F.to_json(F.struct(identity.alias("id"), "model", usage.alias("usage"))).alias("response"),
        "project",
        "is_batch",
        "cache_ttl",
        F.col("ts").alias("logged_at"),
        "event_uid",
    )
    copies = logged.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    return copies.withColumn("location", F.concat_ws(":", "event_uid", "copy")).drop("copy", "event_uid")


def report_pages(events: DataFrame) -> DataFrame:
    """One report page per day: a bucket of sums per model and project.

    What goes into a page are sums, so a page has as many records as there are
    models times projects, whatever the number of events. Each page also has a
    record with only a cost, one without anything, and one that is no object.
    """
    sums = (
        events.groupBy(F.to_date("ts").alias("day"), "model", "project", "is_batch")
        .agg(*[F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "cache_read_tokens")])
    )
    record = F.to_json(
        F.struct(
            "model",
            F.col("project").alias("workspace_id"),
            F.col("input_tokens").alias("uncached_input_tokens"),
            "output_tokens",
            F.col("cache_read_tokens").alias("cache_read_input_tokens"),
            F.when(F.col("is_batch"), "batch").otherwise("standard").alias("service_tier"),
        )
    )
    others = '{"workspace_id":"costs","cost_usd":42.5},{"workspace_id":"none"},"junk"'
    pages = sums.withColumn("record", record).groupBy("day").agg(
        F.array_join(F.array_sort(F.collect_list("record")), ",").alias("records")
    )
    payload = F.concat(
        F.lit('{"data":[{"starting_at":"'),
        F.date_format("day", "yyyy-MM-dd'T'00:00:00'Z'"),
        F.lit('","results":['),
        F.col("records"),
        F.lit(f",{others}]}}]}}"),
    )
    return pages.select(payload.alias("payload"), F.concat(F.lit("page-"), F.col("day")).alias("location"))
