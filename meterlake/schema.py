"""Fixed table layouts of the usage store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Money is held in dollars with six decimals, which is one micro-dollar: 18
# digits fit a 64-bit word, so sums and shuffles stay on Spark's compact path.
MONEY = T.DecimalType(18, 6)

TOKEN_COLUMNS = (
    "input_tokens",
    "output_tokens",
    "cache_creation_tokens",
    "cache_read_tokens",
)

RAW_META = T.StructType(
    [
        T.StructField("unknown_model", T.BooleanType()),
        T.StructField("reported_model", T.StringType()),
        T.StructField("collector", T.StringType()),
        T.StructField("reported_cost_usd", MONEY),
        T.StructField("aggregated_cost", T.BooleanType()),
    ]
)

USAGE_SCHEMA = T.StructType(
    [
        T.StructField("event_uid", T.StringType(), False),
        T.StructField("ts", T.TimestampType(), False),
        T.StructField("source", T.StringType(), False),
        T.StructField("project", T.StringType()),
        T.StructField("model", T.StringType(), False),
        *[T.StructField(name, T.LongType(), False) for name in TOKEN_COLUMNS],
        T.StructField("is_batch", T.BooleanType(), False),
        T.StructField("cache_ttl", T.StringType()),
        T.StructField("cost_usd", MONEY, False),
        T.StructField("session_id", T.StringType()),
        T.StructField("raw_meta", RAW_META),
        T.StructField("event_date", T.DateType(), False),
    ]
)

KEY_SCHEMA = T.StructType([f for f in USAGE_SCHEMA.fields if f.name in ("event_uid", "event_date")])

REJECT_SCHEMA = T.StructType(
    [
        T.StructField("reject_uid", T.StringType(), False),
        T.StructField("source", T.StringType(), False),
        T.StructField("location", T.StringType()),
        T.StructField("reject_reason", T.StringType(), False),
        T.StructField("raw", T.StringType()),
    ]
)

MANIFEST_SCHEMA = T.StructType(
    [
        T.StructField("file_path", T.StringType(), False),
        T.StructField("length", T.LongType()),
        T.StructField("modified", T.TimestampType()),
        T.StructField("ingested", T.TimestampType()),
    ]
)

ALERT_SCHEMA = T.StructType(
    [
        T.StructField("ts", T.TimestampType(), False),
        T.StructField("scope", T.StringType(), False),
        T.StructField("period", T.StringType(), False),
        T.StructField("calendar_key", T.StringType(), False),
        T.StructField("fraction", T.DecimalType(10, 4), False),
        T.StructField("threshold", T.DecimalType(24, 6)),
        T.StructField("actual", T.DecimalType(28, 6)),
    ]
)

USAGE_COLUMNS = USAGE_SCHEMA.fieldNames()


def hadoop_path(spark: SparkSession, path: str):
    """File system and path object of ``path``, by the scheme it names."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), found


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, found = hadoop_path(spark, path)
    return fs.exists(found)


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, found = hadoop_path(spark, path)
    return fs.exists(found) and fs.getFileStatus(found).isDirectory()


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The Parquet table at ``path``, or an empty one when nothing was written yet."""
    if path_exists(spark, path):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)
