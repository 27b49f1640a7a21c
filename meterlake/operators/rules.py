"""Three savings rules. Each returns rows of the columns in ``SUGGESTION_COLUMNS``.

Events without a project count together under the empty name.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.functions import labels, money
from meterlake.operators.density import densest_window, slot_counts
from meterlake.sources.pricing import RATE, PriceTable, cost_at
from meterlake.staging import stage

SUGGESTION_COLUMNS = [
    "rule",
    "project",
    "model",
    "input_bucket",
    "calls",
    "saving_usd",
    "estimated_monthly_savings_usd",
    "confidence",
    "title",
    "detail",
]

# Thresholds of the rules.
MEDIAN_OUTPUT_MAX = 300
MIN_CALLS = 100
MAX_INPUT_CV = 0.5
CACHE_INPUT_MIN = 2000
CACHE_BUCKET_SIZE = 500
CACHE_MIN_REPEATS = 10
CACHE_READ_SAVING = Decimal("0.90")
CACHE_WRITE_FACTOR = Decimal("1.25")
BATCH_MIN_CALLS = 100
BATCH_WINDOW_MINUTES = 60
BATCH_SAVING = Decimal("0.50")

MILLION = Decimal(1_000_000)

# Above any token count.
INPUT_RANGE = Decimal(10**19)


def _project() -> Column:
    return F.coalesce("project", F.lit(""))


def _suggestions(found: DataFrame, rule: str, span_days: float, confidence: str, **columns: Column) -> DataFrame:
    """Common columns of a rule's groups; only groups that save something stay."""
    base = found.where("saving_usd > 0").withColumns(
        {
            "rule": F.lit(rule),
            "estimated_monthly_savings_usd": money.monthly(F.col("saving_usd"), span_days),
            "confidence": F.lit(confidence),
        }
    )
    return base.withColumns(columns).select(*SUGGESTION_COLUMNS)


def in_family(model: Column, markers: Sequence[str]) -> Column:
    """Whether a model name contains one of the markers, in any case."""
    lowered = F.lower(model)
    found = F.lit(False)
    for marker in markers:
        found = found | lowered.contains(marker.lower())
    return found


def downgrade_groups(
    events: DataFrame,
    target_cost: Column,
    family: Sequence[str],
    median_output_max: int = MEDIAN_OUTPUT_MAX,
    min_calls: int = MIN_CALLS,
    max_input_cv: float = MAX_INPUT_CV,
) -> DataFrame:
    """Projects whose calls to a model family are many, short and alike."""
    # Outputs from twice the limit on count as twice the limit. A median below the
    # limit is the mean of two values that are both below that, so it is not
    # changed by this, and the exact median needs few distinct values per group.
    short_output = F.least(F.col("output_tokens"), F.lit(2 * median_output_max))
    groups = (
        events.where(in_family(F.col("model"), family))
        .groupBy(_project().alias("project"))
        .agg(
            F.count(F.lit(1)).alias("calls"),
            F.percentile(short_output, F.lit(0.5)).alias("median_output"),
            F.avg("input_tokens").alias("mean_input"),
            F.stddev_pop("input_tokens").alias("sd_input"),
            F.sum("cost_usd").alias("current_usd"),
            F.sum(target_cost).alias("target_usd"),
        )
    )
    return groups.where(
        (F.col("calls") >= min_calls)
        & (F.col("median_output") < median_output_max)
        & (F.col("mean_input") > 0)
        & (F.try_divide("sd_input", "mean_input") <= max_input_cv)
    ).withColumn("saving_usd", (F.col("current_usd") - F.col("target_usd")).cast(money.SAVING))


def facts(**values: Column) -> Column:
    """The figures behind a suggestion as ``name=value`` text, in the order given."""
    return F.concat_ws(" ", *[F.concat(F.lit(f"{name}="), value.cast("string")) for name, value in values.items()])


def model_downgrade(
    events: DataFrame,
    prices: PriceTable,
    span_days: float,
    target: str = "small",
    family: Sequence[str] = ("large",),
    **limits,
) -> DataFrame:
    """Rule 1: calls to an expensive family that a cheaper model could serve.

    Without rates for ``target`` there is nothing to suggest.
    """
    target_cost = cost_at(prices, target)
    if target_cost is None:
        events, target_cost = events.where(F.lit(False)), F.col("cost_usd")
    found = downgrade_groups(events, target_cost, family, **limits)
    saved = money.monthly(F.col("saving_usd"), span_days)
    percent = F.round(F.col("saving_usd") * 100 / F.col("current_usd"), 0).cast("bigint")
    detail = facts(
        calls=F.col("calls"),
        median_output_tokens=F.floor("median_output"),
        usd_now=money.dollars(F.col("current_usd")),
        usd_on_target=money.dollars(F.col("target_usd")),
        usd_saved_monthly=money.dollars(saved),
        percent_saved=percent,
    )
    return _suggestions(
        found, "model_downgrade", span_days, "high",
        model=F.lit(None).cast("string"),
        input_bucket=F.lit(None).cast("bigint"),
        title=F.concat(F.lit(f"Cheaper model ({target}): "), F.col("project")),
        detail=detail,
    )


def cache_groups(
    events: DataFrame,
    input_min: int = CACHE_INPUT_MIN,
    bucket_size: int = CACHE_BUCKET_SIZE,
    min_repeats: int = CACHE_MIN_REPEATS,
) -> DataFrame:
    """Recurring large inputs that never read a cache, by project, model and size."""
    bucket = (F.bround(F.col("input_tokens") / F.lit(bucket_size)) * bucket_size).cast("bigint")
    # The input of the first call: among calls of the same instant, the smallest.
    # Time and input make one number, as a minimum of numbers is kept in a hash
    # table, while a minimum of structs would sort all calls first.
    by_time = F.unix_micros("ts").cast("decimal(18,0)") * F.lit(INPUT_RANGE) + F.col("input_tokens")
    first = F.pmod(F.min(by_time), F.lit(INPUT_RANGE)).cast("bigint")
    groups = (
        events.where((F.col("input_tokens") >= input_min) & (F.col("cache_read_tokens") == 0))
        .groupBy(_project().alias("project"), "model", bucket.alias("input_bucket"))
        .agg(
            F.count(F.lit(1)).alias("calls"),
            (F.sum("input_tokens") - first).alias("repeated_input_tokens"),
        )
    )
    return groups.where(F.col("calls") >= min_repeats)


def missing_prompt_cache(
    events: DataFrame,
    prices: PriceTable,
    span_days: float,
    read_saving: Decimal = CACHE_READ_SAVING,
    write_factor: Decimal = CACHE_WRITE_FACTOR,
    **limits,
) -> DataFrame:
    """Rule 2: repeated inputs that a prompt cache would serve.

    All calls after the first would read the cache, which the first one writes.
    """
    rates = prices.joinable_rates().select("model", "input_rate")
    rate = F.coalesce("input_rate", F.lit(prices.fallback_input).cast(RATE))
    micros = rate * (
        F.col("repeated_input_tokens").cast("decimal(18,0)") * F.lit(read_saving)
        - F.col("input_bucket").cast("decimal(18,0)") * F.lit(write_factor)
    )
    found = (
        cache_groups(events, **limits)
        .join(rates, "model", "left")
        .withColumn("saving_usd", (micros / F.lit(MILLION)).cast(money.SAVING))
    )
    saved = money.monthly(F.col("saving_usd"), span_days)
    detail = facts(
        calls=F.col("calls"),
        model=F.col("model"),
        input_tokens_each=F.col("input_bucket"),
        input_tokens_repeated=F.col("repeated_input_tokens"),
        usd_saved_monthly=money.dollars(saved),
    )
    return _suggestions(
        found, "missing_prompt_cache", span_days, "medium",
        title=F.concat(F.lit("Prompt cache ("), F.col("model"), F.lit("): "), F.col("project")),
        detail=detail,
    )


def batch_candidates(
    events: DataFrame,
    prices: PriceTable,
    span_days: float,
    min_calls: int = BATCH_MIN_CALLS,
    window_minutes: int = BATCH_WINDOW_MINUTES,
    saving: Decimal = BATCH_SAVING,
) -> DataFrame:
    """Rule 3: bursts of direct API calls that could go through the batch interface.

    One dense window qualifies a project; the saving is on all its direct calls.
    """
    calls = events.where((F.col("source") == labels.API) & ~F.col("is_batch")).withColumn("project", _project())
    slots = stage(
        slot_counts(calls, "project", window_minutes, F.sum("cost_usd").alias("cost_usd")), "call-slots"
    )
    totals = slots.groupBy("project").agg(
        F.sum("calls").alias("calls"), F.sum("cost_usd").cast("decimal(28,6)").alias("cost_usd")
    )
    dense = densest_window(calls, "project", window_minutes, min_calls, slots)
    found = totals.join(dense, "project").withColumn(
        "saving_usd", (F.col("cost_usd") * F.lit(saving)).cast(money.SAVING)
    )
    saved = money.monthly(F.col("saving_usd"), span_days)
    detail = facts(
        direct_calls=F.col("calls"),
        window_minutes=F.lit(window_minutes),
        most_calls_in_window=F.col("max_in_window"),
        usd_saved_monthly=money.dollars(saved),
    )
    return _suggestions(
        found, "batch_candidates", span_days, "medium",
        model=F.lit(None).cast("string"),
        input_bucket=F.lit(None).cast("bigint"),
        title=F.concat(F.lit("Batch interface: "), F.col("project")),
        detail=detail,
    )
