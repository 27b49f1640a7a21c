"""Session logs: one JSON object per line, one file per session."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.functions import jsonfields as J
from meterlake.functions import labels
from meterlake.sources.records import DRAFT_COLUMNS

# Only these keys are built from a line; message contents are skipped over.
FIELDS = (
    "timestamp: VARIANT, ts: VARIANT, id: VARIANT, model: VARIANT, usage: VARIANT, "
    "message: STRUCT<id: VARIANT, model: VARIANT, usage: VARIANT>"
)


def log_pattern(root: str) -> str:
    """Where the session files of a log root are: ``<root>/projects/<dir>/<session>.jsonl``.

    ``root`` may also be the ``projects`` folder itself.
    """
    root = root.rstrip("/")
    if not root.endswith("/projects"):
        root = f"{root}/projects"
    return f"{root}/*/*.jsonl"


def parse_session_lines(lines: DataFrame, dedupe_on: str = "line", keep: Sequence[str] = ()) -> DataFrame:
    """Drafts from ``(file_path, modified, line_number, value)``, with the columns of ``lines`` named by ``keep``.

    Two shapes occur: model, id and usage inside ``message``, or at the top. The
    key is file, line and message id; ``dedupe_on='message_id'`` leaves file and
    line out wherever there is a message id, so that a copied log counts once.
    """
    if dedupe_on not in ("line", "message_id"):
        raise ValueError(f"dedupe_on must be 'line' or 'message_id', got {dedupe_on!r}")
    record = F.col("record")
    nested, flat = record["message"], record
    rows = J.with_object(lines, "record", "value", FIELDS)
    rows = rows.withColumn(
        "used",
        F.when(J.is_object(nested["usage"]), nested["usage"]).when(J.is_object(flat["usage"]), flat["usage"]),
    )
    message_id = F.coalesce(J.any_text(nested["id"]), J.any_text(flat["id"]))

    def tokens(key: str):
        return J.token_count("used", f"$.{key}")

    source = F.lit(labels.SESSION_LOG)
    key = labels.event_uid(source, F.col("file_path"), F.col("line_number").cast("string"), message_id)
    if dedupe_on == "message_id":
        key = F.when(message_id.isNotNull(), labels.event_uid(source, message_id)).otherwise(key)
    # A column of its own, as it is needed twice.
    rows = rows.withColumn("stated", F.coalesce(J.instant(record["timestamp"]), J.instant(record["ts"])))
    stated = F.col("stated")
    reason = (
        F.when(F.trim("value") == "", "blank")
        .when(record.isNull(), "not_a_json_object")
        .when(F.col("used").isNull(), "no_usage")
    )
    return rows.withColumns(
        {
            "event_uid": key,
            "ts": F.coalesce(stated, F.col("modified")),
            "source": source,
            "project": labels.project_label(labels.parent_directory(F.col("file_path"))),
            "reported_model": F.coalesce(J.only_text(nested["model"]), J.only_text(flat["model"])),
            "input_tokens": tokens("input_tokens"),
            "output_tokens": tokens("output_tokens"),
            "cache_creation_tokens": tokens("cache_creation_input_tokens"),
            "cache_read_tokens": tokens("cache_read_input_tokens"),
            "is_batch": F.lit(False),
            "cache_ttl": F.lit(None).cast("string"),
            "session_id": labels.session_label(F.col("file_path")),
            # Without an id, another message may take the place of a line; without
            # a time of its own, a line gets the one of the file; and a message id
            # alone says nothing of the time.
            "dated": stated.isNotNull() & message_id.isNotNull() & F.lit(dedupe_on == "line"),
            "collector": F.lit(None).cast("string"),
            "reported_cost_usd": F.lit(None).cast("decimal(18,6)"),
            "aggregated_cost": F.lit(False),
            "reject_reason": reason,
            "location": F.concat_ws(":", "file_path", "line_number"),
            "raw": F.when(reason.isNotNull(), F.col("value")),
        }
    ).select(*DRAFT_COLUMNS, *keep)
