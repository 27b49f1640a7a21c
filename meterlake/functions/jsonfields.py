"""Schema-tolerant access to JSON records, by key and never by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Epoch seconds of the years 1 and 9999, the range a timestamp can print.
MIN_EPOCH = -62135596800
MAX_EPOCH = 253402300799


def with_object(rows: DataFrame, name: str, text: str, fields: str) -> DataFrame:
    """Add ``name``: the column ``text`` parsed as exactly one JSON object.

    Wrapping the text in brackets makes the parser read to its end, so trailing
    junk, a cut-off record or a second value give NULL instead of being ignored.
    Only ``fields`` are built; the parser skips over every other key.
    """
    wrapped = F.concat(F.lit("["), F.col(text), F.lit("]"))
    parsed = rows.withColumn(name, F.from_json(wrapped, f"ARRAY<STRUCT<{fields}>>"))
    is_one = (F.size(name) == 1) & F.rtrim(F.col(text)).endswith("}")
    return parsed.withColumn(name, F.when(is_one, F.get(name, F.lit(0))))


def kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def is_object(value: Column) -> Column:
    return F.coalesce(kind(value).startswith("OBJECT"), F.lit(False))


def only_text(value: Column) -> Column:
    """The string in ``value``; NULL for other types and for the empty string."""
    text = F.when(kind(value) == "STRING", F.try_variant_get(value, "$", "string"))
    return F.nullif(text, F.lit(""))


def any_text(value: Column) -> Column:
    """The scalar in ``value`` as text; NULL when missing or the empty string."""
    return F.nullif(F.try_variant_get(value, "$", "string"), F.lit(""))


def token_count(value: Column | str, path: str = "$") -> Column:
    """A whole, non-negative count at ``path`` of ``value``; anything missing or unusable counts as 0."""
    return F.greatest(F.coalesce(F.try_variant_get(value, path, "bigint"), F.lit(0)), F.lit(0))


def money_or_null(value: Column) -> Column:
    """A dollar amount; booleans and text that is no number give NULL."""
    return F.when(
        kind(value) != "BOOLEAN", F.try_variant_get(value, "$", "double")
    ).try_cast("decimal(18,6)")


# What needs no rewriting before it is cast: date, time to the second and zone, all with their separators.
FULL_INSTANT = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:[zZ]|[+-]\d{2}:\d{2})$"


def text_instant(text: Column) -> Column:
    """ISO-8601 text to an instant; text without a zone is UTC, whatever the session's zone is.

    Times may be written without separators (``20260601T120000Z``). A text without a
    leading year is not a date. A full time, which nearly all are, is cast as it is, as
    the expressions for all other forms cost many times as much.
    """
    return F.when(text.rlike(FULL_INSTANT), text.try_cast("timestamp")).otherwise(_loose_instant(text))


def _loose_instant(text: Column) -> Column:
    trimmed = F.trim(text)
    for digits in (r"(\d{2})(\d{2})(\d{2})", r"(\d{2})(\d{2})"):
        times = "$4:$5:$6$7" if digits.count("2") == 3 else "$4:$5$6"
        trimmed = F.regexp_replace(trimmed, rf"^(\d{{4}})(\d{{2}})(\d{{2}})[T ]{digits}(?!\d)(.*)$", f"$1-$2-$3T{times}")
    zoned = trimmed.rlike(r"^\d{4}-[^T ]*[T ].*(?:[zZ]|[+-]\d{1,2}(?::?\d{2}){0,2}|[A-Za-z_/]{3,})$")
    with_zone = F.when(zoned, trimmed).when(trimmed.rlike("[T ]"), F.concat(trimmed, F.lit("Z"))).otherwise(F.concat(trimmed, F.lit("T00:00:00Z")))
    for given, full in ((r"([T ]\d{1,2})(?![\d:])", "$1:00:00"), (r"([T ]\d{1,2}:\d{2})(?![\d:])", "$1:00")):
        with_zone = F.regexp_replace(with_zone, given, full)
    return F.when(trimmed.rlike(r"^\d{4}-"), with_zone.try_cast("timestamp"))


def instant(value: Column) -> Column:
    """ISO text or epoch seconds to an instant; NULL when neither."""
    seconds = F.try_variant_get(value, "$", "double")
    is_number = kind(value).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    return F.when(kind(value) == "STRING", text_instant(F.try_variant_get(value, "$", "string"))).when(
        is_number & seconds.between(MIN_EPOCH, MAX_EPOCH), F.timestamp_seconds(seconds)
    )


def truthy(value: Column) -> Column:
    """JSON truth: false, 0, empty text and null are false, other values true."""
    return F.when(
        kind(value) == "BOOLEAN", F.try_variant_get(value, "$", "boolean")
    ).when(
        kind(value) == "STRING", F.try_variant_get(value, "$", "string") != ""
    ).otherwise(F.coalesce(F.try_variant_get(value, "$", "double") != 0, F.lit(True)))


def first_of(record: Column, *keys: str) -> Column:
    """The first of several alternative keys whose value is not null."""
    candidates = [F.try_variant_get(record, f"$.{key}", "variant") for key in keys]
    return F.coalesce(*[F.when(~F.is_variant_null(c), c) for c in candidates])


def list_items(value: Column) -> Column:
    """The items of a JSON list; NULL when ``value`` is not a list."""
    return F.when(
        kind(value).startswith("ARRAY"), F.try_variant_get(value, "$", "array<variant>")
    )
