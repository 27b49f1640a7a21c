"""Logged API responses: the response with what its caller knows about the call."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlake.functions import jsonfields as J
from meterlake.functions import labels
from meterlake.sources.records import DRAFT_COLUMNS

FIELDS = "id: VARIANT, model: VARIANT, usage: VARIANT"
LOGGED = (
    "response: VARIANT, project: VARIANT, is_batch: VARIANT, cache_ttl: VARIANT, logged_at: VARIANT"
)


def logged_calls(lines: DataFrame) -> DataFrame:
    """Landed JSON lines ``{response, project, is_batch, cache_ttl, logged_at}`` as records.

    A call without ``logged_at`` counts at the time its file was written.
    """
    entry = F.col("entry")
    return J.with_object(lines, "entry", "value", LOGGED).select(
        F.to_json(entry["response"]).alias("response"),
        J.any_text(entry["project"]).alias("project"),
        F.coalesce(J.truthy(entry["is_batch"]) & entry["is_batch"].isNotNull(), F.lit(False)).alias("is_batch"),
        J.only_text(entry["cache_ttl"]).alias("cache_ttl"),
        F.coalesce(J.instant(entry["logged_at"]), F.col("modified")).alias("logged_at"),
        F.concat_ws(":", "file_path", "line_number").alias("location"),
        F.col("value").alias("raw"),
    )


def parse_api_records(records: DataFrame) -> DataFrame:
    """Drafts from ``(response, project, is_batch, cache_ttl, logged_at, location)``.

    A response id with project, batch flag and cache lifetime is one call,
    however often it was logged. A response without id is told apart by its
    ``location``, which unlike a random key stays the same on a second run.
    """
    record = F.col("record")
    rows = J.with_object(records, "record", "response", FIELDS)
    if not isinstance(records.schema["logged_at"].dataType, T.TimestampType):
        raise TypeError("logged_at must be a timestamp")
    if "raw" not in records.columns:
        rows = rows.withColumn("raw", F.col("response"))
    response_id = J.any_text(record["id"])
    source = F.lit(labels.API)
    known = labels.event_uid(
        source,
        response_id,
        F.coalesce("project", F.lit("")),
        F.when(F.col("is_batch"), "1").otherwise("0"),
        F.coalesce("cache_ttl", F.lit("")),
    )
    unknown = labels.event_uid(source, F.lit("noid"), F.col("location"))

    def tokens(key: str):
        return J.token_count(record["usage"], f"$.{key}")

    reason = F.when(record.isNull(), "not_a_json_object")
    return rows.withColumns(
        {
            "event_uid": F.when(response_id.isNotNull(), known).otherwise(unknown),
            "ts": F.col("logged_at"),
            "source": source,
            "reported_model": J.only_text(record["model"]),
            "input_tokens": tokens("input_tokens"),
            "output_tokens": tokens("output_tokens"),
            "cache_creation_tokens": tokens("cache_creation_input_tokens"),
            "cache_read_tokens": tokens("cache_read_input_tokens"),
            "session_id": response_id,
            # The same response may be logged again on another day.
            "dated": F.lit(False),
            "collector": F.lit(None).cast("string"),
            "reported_cost_usd": F.lit(None).cast("decimal(18,6)"),
            "aggregated_cost": F.lit(False),
            "reject_reason": reason,
            "raw": F.when(reason.isNotNull(), F.col("raw")),
        }
    ).select(*DRAFT_COLUMNS)
