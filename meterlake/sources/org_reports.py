"""Organisation usage reports: JSON pages of time buckets with nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.functions import jsonfields as J
from meterlake.functions import labels
from meterlake.functions.calendar import utc_text
from meterlake.sources.records import DRAFT_COLUMNS, any_tokens

# The alternative keys under which reports carry a field, in the
# order in which they are tried.
RECORD_LISTS = ("results", "items", "usage", "breakdown")
TIME_KEYS = ("starting_at", "start_time", "start", "date", "timestamp", "ts")
MODEL_KEYS = ("model", "model_id", "model_name")
PROJECT_KEYS = (
    "workspace_id",
    "workspace",
    "project",
    "api_key_id",
    "api_key",
    "key_label",
    "service_tier",
)
INPUT_KEYS = ("input_tokens", "uncached_input_tokens", "prompt_tokens")
OUTPUT_KEYS = ("output_tokens", "completion_tokens")
CACHE_WRITE_KEYS = ("cache_creation_input_tokens", "cache_creation_tokens", "cache_write_tokens")
CACHE_READ_KEYS = ("cache_read_input_tokens", "cache_read_tokens")
COST_KEYS = ("cost_usd", "cost", "amount", "total_cost")
BATCH_KEYS = ("is_batch", "batch")
TIER_KEYS = ("service_tier", "tier")

END_MARK = "\u2402 end of page \u2402"


def flatten_reports(payloads: DataFrame) -> DataFrame:
    """``(record, bucket_time, unparsed, location)`` of every record in ``(payload, location)``.

    A payload is a list of entries, an object holding one under ``data`` or
    ``results``, or a single bare entry. An entry is a record, or a bucket with
    its records in a nested list; those inherit the bucket's time. A payload that is
    not exactly one JSON value comes out as one row with a null record and its text
    in ``unparsed``, and every entry that is no object as a row with a null record,
    so that both can be counted.
    """
    page = F.col("page")
    data = F.try_variant_get(page, "$.data", "variant")
    results = F.try_variant_get(page, "$.results", "variant")
    held = F.coalesce(*[F.when(~F.is_variant_null(c), c) for c in (data, results)])
    entries = (
        F.when(J.kind(page).startswith("ARRAY"), J.list_items(page))
        .when(held.isNotNull(), J.list_items(held))
        .when(J.is_object(page), F.array(page))
    )
    # With brackets and a mark behind it, a payload that is not exactly one value
    # comes out as something other than two items with the mark at the end.
    wrapped = F.try_parse_json(F.concat(F.lit("["), F.col("payload"), F.lit(f', "{END_MARK}"]')))
    items = F.try_variant_get(wrapped, "$", "array<variant>")
    is_one = (F.size(items) == 2) & (F.try_variant_get(F.get(items, F.lit(1)), "$", "string") == END_MARK)
    top = payloads.withColumn("page", F.when(is_one, F.get(items, F.lit(0)))).select(
        "location",
        F.when(F.col("page").isNull(), F.col("payload")).alias("unparsed"),
        F.posexplode(F.coalesce(entries, F.array(F.lit(None).cast("variant")))).alias("entry_number", "entry"),
    )
    entry = F.col("entry")
    nested = F.coalesce(
        *[J.list_items(F.try_variant_get(entry, f"$.{key}", "variant")) for key in RECORD_LISTS]
    )
    # A bare record is treated as a bucket of one, without a time to pass on.
    return top.select(
        "location",
        "unparsed",
        "entry_number",
        J.first_of(entry, *TIME_KEYS).alias("bucket_time"),
        F.posexplode(F.coalesce(nested, F.array(entry))).alias("record_number", "record"),
    ).select(
        "record",
        "bucket_time",
        "unparsed",
        F.concat_ws(":", "location", "entry_number", "record_number").alias("location"),
    )


def parse_org_reports(payloads: DataFrame) -> DataFrame:
    """Drafts from ``(payload, location)``.

    Tokens are priced; a record that has only a dollar amount keeps it and is
    marked as an aggregate. The key is time, model, project and batch flag, so a
    report that is fetched again adds nothing.
    """
    record = F.col("record")
    rows = flatten_reports(payloads)
    project = J.first_of(record, *PROJECT_KEYS)
    tier = J.first_of(record, *TIER_KEYS)
    flag = J.first_of(record, *BATCH_KEYS)
    tier_is_batch = F.lower(J.only_text(tier)).contains("batch")
    ts = F.coalesce(J.instant(J.first_of(record, *TIME_KEYS)), J.instant(F.col("bucket_time")))
    rows = rows.withColumns(
        {
            "ts": ts,
            "source": F.lit(labels.ORG_REPORT),
            "project": F.try_variant_get(project, "$", "string"),
            "reported_model": J.only_text(J.first_of(record, *MODEL_KEYS)),
            "input_tokens": J.token_count(J.first_of(record, *INPUT_KEYS)),
            "output_tokens": J.token_count(J.first_of(record, *OUTPUT_KEYS)),
            "cache_creation_tokens": J.token_count(J.first_of(record, *CACHE_WRITE_KEYS)),
            "cache_read_tokens": J.token_count(J.first_of(record, *CACHE_READ_KEYS)),
            "is_batch": F.when(flag.isNotNull(), J.truthy(flag)).otherwise(F.coalesce(tier_is_batch, F.lit(False))),
            "reported_cost_usd": J.money_or_null(J.first_of(record, *COST_KEYS)),
        }
    )
    key = labels.event_uid(
        F.col("source"),
        utc_text(F.col("ts")),
        F.coalesce("reported_model", F.lit("")),
        F.coalesce("project", F.lit("")),
        F.when(F.col("is_batch"), "1").otherwise("0"),
    )
    reason = (
        F.when(~J.is_object(record), "not_a_json_object")
        .when(~any_tokens() & F.col("reported_cost_usd").isNull(), "no_usage")
        .when(F.col("ts").isNull(), "no_time")
    )
    return rows.withColumns(
        {
            "event_uid": key,
            "cache_ttl": F.lit(None).cast("string"),
            "session_id": F.lit(None).cast("string"),
            "dated": F.lit(True),
            "collector": F.lit(labels.ORG_REPORT),
            "aggregated_cost": ~any_tokens(),
            "reject_reason": reason,
            "raw": F.when(reason.isNotNull(), F.coalesce(F.to_json(record), F.col("unparsed"))),
        }
    ).select(*DRAFT_COLUMNS)
