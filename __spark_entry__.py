
from __future__ import annotations

import datetime as dt
import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlake.functions import calendar, labels
from meterlake.functions.calendar import utc_date
from meterlake.operators import budgets, dedup, density, reports, rules
from meterlake.operators.filters import in_range
from meterlake.plans.alerts import fire_alerts
from meterlake.plans.ingest import ingest
from meterlake.plans.store import UsageStore
from meterlake.plans.suggestions import savings_suggestions
from meterlake.schema import RAW_META, USAGE_COLUMNS
from meterlake.sources import landing, samples
from meterlake.sources.api_records import parse_api_records
from meterlake.sources.budgets import budget_table, load_alert_fractions, load_budgets
from meterlake.sources.files import read_lines
from meterlake.sources.org_reports import parse_org_reports
from meterlake.sources.records import accepted, priced
from meterlake.sources.session_logs import log_pattern, parse_session_lines
from meterlake.sources.pricing import load_pricing
from meterlake.staging import StagingArea, new_staging_path, stage
from meterlake.streaming import streams

try:
    import corpus_pipeline
    from meterlake.llm.queries import ORACLE_SQL as LLM_SQL
    from meterlake.llm.queries import QUERIES as LLM_QUERIES

    LLM_QUERIES = {**LLM_QUERIES, "pipeline": corpus_pipeline.run}
    if corpus_pipeline.ORACLE_SQL:
        LLM_SQL = {**LLM_SQL, "pipeline": corpus_pipeline.ORACLE_SQL}
except ImportError as missing:
    # The package, or a library that only it needs, is not there: the queries on usage don't depend on it.
    logging.getLogger(__name__).warning("text corpus queries are left out: %s", missing)
    LLM_QUERIES, LLM_SQL = {}, {}

UTC = dt.timezone.utc
BUDGET_NOW = dt.datetime(2024, 1, 17, 12, tzinfo=UTC)
MONTH_END = dt.datetime(2024, 1, 31, tzinfo=UTC)
BURST_MINUTES = 360
BURST_CALLS = 6
# Not all models, so that the column of the others has something in it.
PIVOTED = samples.SAMPLE_MODELS[:3]


def _doubles(df: DataFrame) -> DataFrame:
    """Decimals as doubles, so that both engines show the same type."""
    return df.select(
        *[
            F.col(f"`{f.name}`").cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def _events(spark: SparkSession, folder: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return samples.priced_events(spark, folder)


def _lineitem(spark: SparkSession, folder: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return samples.priced_lineitem(spark, folder)


def _ntz(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in names})


def _budget_rows(spark: SparkSession) -> DataFrame:
    return budget_table(
        spark,
        {"daily": "12", "weekly": "120", "monthly": "400"},
        {"p0": {"weekly": "50", "monthly": "300"}, "p1": {"daily": "2"}, "idle": {"monthly": "10"}, "p2": {"daily": None}},
    )


# --- queries ----------------------------------------------------------------


def priced_events(spark, folder):
    rows = _events(spark, folder).select("event_uid", "model", "known_model", "is_batch", "cache_ttl", "cost_usd")
    return _doubles(rows)


def usage_summary(spark, folder):
    return _doubles(reports.summary(_events(spark, folder)))


def usage_summary_filtered(spark, folder):
    start, end = calendar.resolve_range("2024-01-08", "2024-01-21T12:00:00Z", MONTH_END)
    return _doubles(reports.summary(in_range(_events(spark, folder), start, end, "p3", "large-a")))


def _timeseries(granularity, table=_events):
    return lambda spark, folder: _doubles(reports.timeseries(table(spark, folder), granularity))


def iso_week_spend(spark, folder):
    key = calendar.period_key(F.col("ts"), "weekly")
    rows = _lineitem(spark, folder).groupBy(key.alias("period_key")).agg(F.sum("cost_usd").alias("spend_usd"))
    return _doubles(rows)


def _breakdown(by):
    return lambda spark, folder: _doubles(reports.breakdown(_events(spark, folder), by))


def breakdown_grouping_sets(spark, folder):
    return _doubles(reports.breakdown_all(_events(spark, folder)))


def spend_pivot(spark, folder):
    return _doubles(reports.spend_pivot(_events(spark, folder), "day", PIVOTED))


def project_list(spark, folder):
    return reports.project_list(_events(spark, folder))


def health(spark, folder):
    row = reports.health(_events(spark, folder), dt.date(2024, 1, 1), MONTH_END)
    return row.withColumn("pricing_updated", F.col("pricing_updated").cast("string"))


LINEITEM_ORDER = ["ts", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]


def dedup_first(spark, folder):
    rows = dedup.first_per_key(_lineitem(spark, folder), "event_uid", LINEITEM_ORDER)
    columns = ("event_uid", "ts", "source", "project", "model", "input_tokens", "output_tokens", "cost_usd")
    return _ntz(_doubles(rows.select(*columns)), "ts")


def append_new_events(spark, folder):
    rows = _lineitem(spark, folder)
    stored = rows.where(F.col("l_quantity") <= 30)
    arriving = stage(dedup.first_per_key(rows.where(F.col("l_quantity") >= 20), "event_uid", LINEITEM_ORDER), "arriving")
    new = dedup.not_stored(arriving, stored, "event_uid")
    return _ntz(_doubles(new.select("event_uid", "ts", "model", "input_tokens", "cost_usd")), "ts")


def _status(spark, folder):
    return budgets.budget_status(_events(spark, folder), _budget_rows(spark), BUDGET_NOW)


def budget_status_daily_weekly_monthly(spark, folder):
    return _doubles(_status(spark, folder))


def _crossings(spark, folder):
    return budgets.crossings(_status(spark, folder), ("0.5", "0.8", "1"))


def budget_crossings(spark, folder):
    return _doubles(_crossings(spark, folder))


def alerts_fire_once(spark, folder):
    """Crossings at noon that had not fired by the end of the second week."""
    earlier = budgets.budget_status(
        _events(spark, folder).where(F.col("ts") < F.lit(dt.datetime(2024, 1, 15, tzinfo=UTC))),
        _budget_rows(spark),
        BUDGET_NOW,
    )
    fired = budgets.crossings(earlier, ("0.5", "0.8", "1"))
    return _doubles(budgets.not_fired(_crossings(spark, folder), fired))


def recent_alerts(spark, folder):
    fired = _crossings(spark, folder).select(
        F.lit(BUDGET_NOW).alias("ts"), "scope", "period", "calendar_key", "fraction", "threshold", "actual"
    )
    return _ntz(_doubles(budgets.recent_alerts(fired, 5)), "ts")


def alert_outbox(spark, folder):
    return budgets.alert_messages(_crossings(spark, folder)).select("title", "message")


def _rule(rule, **limits):
    def run(spark, folder):
        return _doubles(rule(_events(spark, folder), samples.sample_prices(spark), 30.0, **limits))

    return run


def max_calls_in_window(spark, folder):
    calls = _events(spark, folder).where((F.col("source") == "api") & ~F.col("is_batch"))
    return density.densest_window(calls, "project", BURST_MINUTES)


def suggestions(spark, folder):
    rows = savings_suggestions(
        _events(spark, folder),
        samples.sample_prices(spark),
        MONTH_END,
        batch={"window_minutes": BURST_MINUTES, "min_calls": BURST_CALLS},
    )
    return _doubles(rows)


USAGE = (
    "event_uid", "ts", "source", "project", "model", "input_tokens", "output_tokens",
    "cache_creation_tokens", "cache_read_tokens", "is_batch", "cost_usd", "session_id",
)


def _parsed_logs(spark, folder):
    return priced(parse_session_lines(samples.session_lines(_events(spark, folder))), samples.sample_prices(spark))


def _parsed_calls(spark, folder):
    return priced(parse_api_records(samples.api_calls(_events(spark, folder))), samples.sample_prices(spark))


def _parsed_reports(spark, folder):
    return priced(parse_org_reports(samples.report_pages(_events(spark, folder))), samples.sample_prices(spark))


def parse_session_lines_query(spark, folder):
    rows = _parsed_logs(spark, folder).select(*USAGE, "reject_reason")
    keep = F.col("reject_reason").isNull()
    # A rejected line has no usage to compare; its key and place still count.
    return _ntz(_doubles(rows.withColumn("cost_usd", F.when(keep, F.col("cost_usd")))), "ts").select(
        "event_uid", "project", "session_id", "reject_reason", "cost_usd",
        *[F.when(keep, F.col(c)).alias(c) for c in ("ts", "model", "input_tokens", "output_tokens",
                                                     "cache_creation_tokens", "cache_read_tokens")],
    )


def api_records(spark, folder):
    rows = dedup.first_per_key(accepted(_parsed_calls(spark, folder)).select(*USAGE, "cache_ttl"), "event_uid", ["ts"])
    return _ntz(_doubles(rows), "ts")


def flatten_org_report(spark, folder):
    rows = accepted(_parsed_reports(spark, folder))
    meta = F.coalesce(F.col("raw_meta.aggregated_cost"), F.lit(False)).alias("aggregated_cost")
    return _ntz(_doubles(rows.select(*[c for c in USAGE if c != "session_id"], meta)), "ts")


def _landed(spark, folder):
    """A fresh root of landed files, its sources, and prices and budgets read from files."""
    events = _events(spark, folder)
    root = new_staging_path(spark, "landed")
    landing.land_settings(root, spark, samples.sample_prices(spark), _budget_rows(spark))
    landing.land_pages(root, events)
    prices, limits = load_pricing(spark, f"{root}/pricing"), load_budgets(spark, f"{root}/settings")
    return events, root, landing.landed_sources(root), prices, limits


def _ingested(spark, folder):
    """Even events land and are ingested; then odd ones land in the same folders, and only their files are read.

    A source that fails is an error of the query, whose rows would lack that source's otherwise.
    """
    events, root, sources, prices, limits = _landed(spark, folder)
    store = UsageStore(spark, f"{root}/store")
    reports = []
    for part in (0, 1):
        landing.land(root, events.where(F.col("event_uid").cast("bigint") % 2 == part))
        reports.append(ingest(store, sources, prices, strict=True).withColumn("run", F.lit(part + 1).cast("bigint")))
    return store, reports[0].unionByName(reports[1])


STORED = [c for c in USAGE if c not in ("event_uid", "session_id")]


def _stored(events):
    day = F.col("event_date").cast("string").alias("event_date")
    return _ntz(_doubles(events.select(*STORED, "cache_ttl", day)), "ts")


def stored_events(spark, folder):
    return _stored(_ingested(spark, folder)[0].events())


def stored_events_of_two_days(spark, folder):
    """A range whose ends lie on midnights."""
    start, end = (dt.datetime(2024, 1, d, tzinfo=UTC) for d in (9, 11))
    return _stored(in_range(_ingested(spark, folder)[0].events(), start, end))


def stored_rejects(spark, folder):
    rejects = _ingested(spark, folder)[0].rejects()
    return rejects.groupBy("source", "reject_reason").agg(F.count(F.lit(1)).alias("records"), F.count_if(F.length("raw") > 0).alias("with_text"))


def file_manifest(spark, folder):
    store, _ = _ingested(spark, folder)
    files = store.manifest()
    kind = F.split_part("file_path", F.lit("/"), F.lit(-3)).alias("kind")
    return files.groupBy(kind, labels.parent_directory(F.col("file_path")).alias("folder")).agg(F.count(F.lit(1)).alias("files"))


def ingest_report(spark, folder):
    return _ingested(spark, folder)[1].drop("error")


def fired_alerts(spark, folder):
    """The alert log after two firings, with the messages of the outbox."""
    events, root, _, _, limits = _landed(spark, folder)
    store = UsageStore(spark, f"{root}/store")
    store.append_events(events.withColumn("raw_meta", F.lit(None).cast(RAW_META)).withColumn("event_date", utc_date(F.col("ts"))).select(*USAGE_COLUMNS))
    fractions = load_alert_fractions(spark, f"{root}/settings")
    for _ in range(2):
        fire_alerts(store, limits, BUDGET_NOW, fractions, outbox=True)
    sent = spark.read.text(store.outbox_path).select(F.from_json("value", "title string, scope string, period_key string, actual double").alias("m"))
    calendar_key, fraction = budgets.split_dedupe_key(F.col("m.period_key"))
    sent = sent.select("m.title", F.col("m.scope").alias("scope"), calendar_key.alias("calendar_key"), fraction.cast("decimal(10,4)").alias("fraction"), F.col("m.actual").alias("sent_usd"))
    return _ntz(_doubles(store.alerts().join(sent, ["scope", "calendar_key", "fraction"])), "ts")


def _streamed(spark, folder):
    """A store that all files went into as a stream of small batches, with alerts after each."""
    events, root, sources, prices, limits = _landed(spark, folder)
    landing.land(root, events)
    store = UsageStore(spark, f"{root}/store")
    fractions = load_alert_fractions(spark, f"{root}/settings")
    for source in sources:
        checkpoint = f"{root}/checkpoint-{source.name}"
        streams.ingest_stream(store, source, prices, checkpoint, limits, lambda: BUDGET_NOW, fractions, files_per_batch=8).awaitTermination()
    return store


def ingest_stream_events(spark, folder):
    return _stored(_streamed(spark, folder).events())


def stream_alerts(spark, folder):
    """Alerts that fired while files came in, each once; what was spent at that time depends on the files' order."""
    reached = (F.col("actual") >= F.col("threshold")).alias("reached")
    return _doubles(_streamed(spark, folder).alerts().select("scope", "period", "calendar_key", "fraction", "threshold", reached))


def landed_lines(spark, folder):
    """Numbers, sessions and keys of landed log lines, from files read whole and from files read in splits."""
    events, root = _events(spark, folder), new_staging_path(spark, "landed-lines")
    landing.land_logs(root, events)
    pattern = log_pattern(root)
    whole = stage(read_lines(StagingArea(spark, "whole-lines"), pattern), "whole-lines")
    split = stage(read_lines(StagingArea(spark, "split-lines"), pattern, whole_file_bytes=0, split_bytes=16 * 1024), "split-lines")
    return _keyed_lines(whole, "whole").unionByName(_keyed_lines(split, "split"))


def _keyed_lines(lines, reader):
    """Drafts of lines beside the event that the line itself names. Paths differ from run to run, so the key is made again from its parts."""
    event = F.regexp_extract("value", '"id":"m([0-9]+)"', 1)
    usable = F.col("reject_reason").isNull()
    key = F.sha2(F.concat_ws("\x1f", F.lit("session_log"), F.col("file_path"), F.col("line_number").cast("string"), F.concat(F.lit("m"), "event")), 256)
    drafts = parse_session_lines(lines, keep=("file_path", "line_number", "value")).withColumn("event", event)
    return drafts.select(
        F.lit(reader).alias("reader"), "project", "session_id", "line_number", "reject_reason",
        F.when(usable, F.col("event")).alias("event_uid"), F.when(usable, F.col("event_uid") == key).alias("key_holds"),
    )


def _event_stream(spark, folder):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    streams.keep_state_on_disk(spark)
    raw = streams.read_table_stream(spark, f"{folder}/events.parquet")
    return samples.price(samples.usage_from_events(raw), samples.sample_prices(spark))


def tumbling_spend_stream(spark, folder):
    windows = streams.tumbling_spend(_event_stream(spark, folder), None)
    rows = streams.write_latest(windows, ["window_start", "window_end", "model"], "tumbling-spend")
    return _ntz(_doubles(rows), "window_start", "window_end")


def _deduplicated(spark, twice, label):
    full = twice.withColumn("raw_meta", F.lit(None).cast(RAW_META)).withColumn("event_date", utc_date(F.col("ts"))).select(*USAGE_COLUMNS)
    root = new_staging_path(spark, label)
    store = UsageStore(spark, f"{root}/store")
    streams.append_stream(full, store, f"{root}/checkpoint").awaitTermination()
    return _ntz(_doubles(store.events().select("event_uid", "ts", "model", "cost_usd")), "ts")


def stream_dedup(spark, folder):
    """Every event arrives twice and is kept once, in whatever order the files are."""
    twice = _event_stream(spark, folder).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("copy")
    return _deduplicated(spark, twice, "stream-dedup")


def stream_dedup_batches(spark, folder):
    """The two arrivals of an event lie in different batches, with merges of the key table between them."""
    path = new_staging_path(spark, "two-arrivals")
    for salt in (1, 2):
        raw = spark.read.parquet(f"{folder}/events.parquet")
        raw.repartition(5, F.xxhash64("event_id", F.lit(salt))).write.mode("append").parquet(path)
    streams.keep_state_on_disk(spark)
    stream = streams.read_table_stream(spark, path, files_per_batch=1)
    return _deduplicated(spark, samples.price(samples.usage_from_events(stream), samples.sample_prices(spark)), "stream-dedup-batches")


def burst_stream(spark, folder):
    bursts = streams.call_bursts(_event_stream(spark, folder), None, 4, "6 hours", "1 hour")
    rows = streams.write_latest(bursts, ["window_start", "window_end", "project"], "bursts")
    return _ntz(rows, "window_start", "window_end")


def entry(spark: SparkSession) -> DataFrame:
    """Flagship query: weekly spend per model at the smallest scale."""
    return queries()["timeseries_week"](spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "priced_events": priced_events,
        "usage_summary": usage_summary,
        "usage_summary_filtered": usage_summary_filtered,
        "timeseries_hour": _timeseries("hour"),
        "timeseries_day": _timeseries("day"),
        "timeseries_week": _timeseries("week"),
        "timeseries_month": _timeseries("month", _lineitem),
        "iso_week_spend": iso_week_spend,
        "breakdown_project": _breakdown("project"),
        "breakdown_model": _breakdown("model"),
        "breakdown_source": _breakdown("source"),
        "breakdown_grouping_sets": breakdown_grouping_sets,
        "spend_pivot": spend_pivot,
        "project_list": project_list,
        "health": health,
        "dedup_first": dedup_first,
        "append_new_events": append_new_events,
        "budget_status_daily_weekly_monthly": budget_status_daily_weekly_monthly,
        "budget_crossings": budget_crossings,
        "alerts_fire_once": alerts_fire_once,
        "recent_alerts": recent_alerts,
        "alert_outbox": alert_outbox,
        "rule_model_downgrade": _rule(rules.model_downgrade),
        "rule_missing_cache": _rule(rules.missing_prompt_cache),
        "rule_batch_candidates": _rule(rules.batch_candidates, window_minutes=BURST_MINUTES, min_calls=BURST_CALLS),
        "max_calls_in_window": max_calls_in_window,
        "savings_suggestions": suggestions,
        "parse_session_lines": parse_session_lines_query,
        "api_records": api_records,
        "flatten_org_report": flatten_org_report,
        "ingest_report": ingest_report,
        "stored_events": stored_events,
        "stored_events_of_two_days": stored_events_of_two_days,
        "stored_rejects": stored_rejects,
        "file_manifest": file_manifest,
        "fired_alerts": fired_alerts,
        "ingest_stream_events": ingest_stream_events,
        "tumbling_spend_stream": tumbling_spend_stream,
        "stream_dedup": stream_dedup,
        "stream_dedup_batches": stream_dedup_batches,
        "stream_alerts": stream_alerts,
        "landed_lines": landed_lines,
        "burst_stream": burst_stream,
        **LLM_QUERIES,
    }


# --- DuckDB counterparts ----------------------------------------------------

# Micro-dollars of an event, exact: rounding to whole ones is rounding dollars
# to six places.
RATES = """
rates(rate_model, ir, orr) AS (VALUES
  ('large-a', 5::DECIMAL(9,4), 25::DECIMAL(9,4)), ('large-b', 5, 25), ('large-legacy', 15, 75),
  ('medium', 3, 15), ('small', 1, 5))
"""


def _priced_sql(ir: str = "coalesce(ir, 3::DECIMAL(9,4))", orr: str = "coalesce(orr, 15::DECIMAL(9,4))") -> str:
    return f"""
round((input_tokens::DECIMAL(12,0) * {ir} + output_tokens::DECIMAL(12,0) * {orr}
  + cache_read_tokens::DECIMAL(12,0) * {ir} * 0.10
  + cache_creation_tokens::DECIMAL(12,0) * {ir} * (CASE WHEN cache_ttl = '1h' THEN 2.00 ELSE 1.25 END))
  * (CASE WHEN is_batch THEN 0.50 ELSE 1.00 END), 0)::BIGINT
"""


MODEL_OF = "['large-a', 'large-legacy', 'medium', 'small', 'large-b', 'unlisted'][{n} % 6 + 1]"

EVENTS = f"""
WITH {RATES}, keyed AS (
  SELECT *, json_extract(props, '$.k')::BIGINT AS k, user_id % 7 AS g FROM events),
usage AS (
  SELECT event_id, event_id::VARCHAR AS event_uid, ts,
    CASE WHEN event_type IN ('view', 'click') THEN 'session_log' WHEN event_type = 'error' THEN 'org_report' ELSE 'api' END AS source,
    'p' || g AS project, {MODEL_OF.format(n='k')} AS model,
    CASE WHEN g = 0 THEN k * k * 10 ELSE 1000 + k * 50 END AS input_tokens,
    floor(value * CASE WHEN g = 1 THEN 20 ELSE 4 END)::BIGINT AS output_tokens,
    CASE WHEN k % 5 = 0 THEN k * 20 ELSE 0 END AS cache_creation_tokens,
    CASE WHEN k % 3 = 0 THEN k * 40 ELSE 0 END AS cache_read_tokens,
    k % 10 = 9 AS is_batch,
    CASE WHEN k % 5 = 0 THEN CASE WHEN k % 2 = 0 THEN '5m' ELSE '1h' END END AS cache_ttl,
    user_id::VARCHAR AS session_id
  FROM keyed),
e AS (
  SELECT *, {_priced_sql()} AS micros,
    input_tokens + output_tokens + cache_creation_tokens + cache_read_tokens AS tokens
  FROM usage LEFT JOIN rates ON model = rate_model)
"""

LINEITEM = f"""
WITH {RATES}, usage AS (
  SELECT *, l_orderkey || '-' || l_linenumber AS event_uid, l_shipdate AS ts,
    CASE l_returnflag WHEN 'A' THEN 'session_log' WHEN 'N' THEN 'api' ELSE 'org_report' END AS source,
    's' || (l_suppkey % 20) AS project, {MODEL_OF.format(n='l_partkey')} AS model,
    (l_quantity * 100)::BIGINT AS input_tokens, floor(l_extendedprice / 100)::BIGINT AS output_tokens,
    0 AS cache_creation_tokens, 0 AS cache_read_tokens, false AS is_batch, NULL::VARCHAR AS cache_ttl
  FROM lineitem),
l AS (
  SELECT *, {_priced_sql()} AS micros, input_tokens + output_tokens AS tokens
  FROM usage LEFT JOIN rates ON model = rate_model)
"""

USD = "sum(micros)::DOUBLE / 1e6"


def _timeseries_sql(source: str, table: str, key: str) -> str:
    return f"""{source}
SELECT {key} AS bucket, model, count(*) AS call_count, {USD} AS spend_usd, sum(tokens)::BIGINT AS tokens
FROM {table} GROUP BY 1, 2"""


def _breakdown_sql(by: str) -> str:
    return f"""{EVENTS}
SELECT {by} AS key, count(*) AS call_count, {USD} AS spend_usd, sum(tokens)::BIGINT AS tokens
FROM e GROUP BY 1"""


def _summary_sql(where: str = "true") -> str:
    return f"""{EVENTS}
SELECT count(*) AS call_count, coalesce({USD}, 0) AS total_spend_usd,
  coalesce(sum(input_tokens), 0)::BIGINT AS input_tokens, coalesce(sum(output_tokens), 0)::BIGINT AS output_tokens,
  coalesce(sum(cache_creation_tokens), 0)::BIGINT AS cache_creation_tokens,
  coalesce(sum(cache_read_tokens), 0)::BIGINT AS cache_read_tokens,
  coalesce(sum(tokens), 0)::BIGINT AS total_tokens,
  coalesce(round(sum(cache_read_tokens) / nullif(sum(input_tokens + cache_read_tokens), 0), 6), 0)::DOUBLE AS cache_efficiency
FROM e WHERE {where}"""


def _first_sql(table: str, where: str) -> str:
    return f"""
SELECT * FROM {table} WHERE {where}
QUALIFY row_number() OVER (PARTITION BY event_uid ORDER BY ts, l_partkey, l_suppkey, l_extendedprice,
  l_quantity, l_discount, l_tax) = 1"""


BUDGETS = """
b(scope, project, period, budget) AS (VALUES
  ('global', NULL, 'daily', 12), ('global', NULL, 'weekly', 120), ('global', NULL, 'monthly', 400),
  ('project:p0', 'p0', 'weekly', 50), ('project:p0', 'p0', 'monthly', 300),
  ('project:p1', 'p1', 'daily', 2), ('project:idle', 'idle', 'monthly', 10)),
p(period, period_key, lo, hi) AS (VALUES
  ('daily', strftime(TIMESTAMP '2024-01-17', '%Y-%m-%d'), TIMESTAMP '2024-01-17', TIMESTAMP '2024-01-18'),
  ('weekly', strftime(TIMESTAMP '2024-01-17', '%G-W%V'), TIMESTAMP '2024-01-15', TIMESTAMP '2024-01-22'),
  ('monthly', strftime(TIMESTAMP '2024-01-17', '%Y-%m'), TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-01'))
"""


def _status_cte(name: str, where: str = "true", events: str = "e") -> str:
    return f"""
{name} AS (
  SELECT b.scope, b.project, b.period, p.period_key, b.budget, coalesce(sum(e.micros), 0)::BIGINT AS spent
  FROM b JOIN p USING (period)
  LEFT JOIN {events} e ON e.ts >= p.lo AND e.ts < p.hi AND (b.project IS NULL OR b.project = e.project) AND {where}
  GROUP BY ALL)"""


def _crossings_cte(name: str, status: str) -> str:
    return f"""
{name} AS (
  SELECT scope, project, period, period_key AS calendar_key, period_key || '@' || label AS period_key,
    fraction::DOUBLE AS fraction, (fraction * budget)::DOUBLE AS threshold, spent::DOUBLE / 1e6 AS actual
  FROM {status} CROSS JOIN (VALUES (0.5, '0.5'), (0.8, '0.8'), (1.0, '1')) f(fraction, label)
  WHERE spent >= fraction * budget * 1000000)"""


BUDGET_EVENTS = f"{EVENTS}, {BUDGETS}, {_status_cte('s')}, {_crossings_cte('c', 's')}"

# The columns of a suggestion, from groups with an exact saving in dollars.
SUGGESTION = """
  saving::DOUBLE AS saving_usd, round(saving, 2)::DOUBLE AS estimated_monthly_savings_usd
"""


def _usd(expression: str) -> str:
    return f"('$' || round({expression}, 2)::DECIMAL(20,2))"


DOWNGRADE = f"""
d AS (
  SELECT project, count(*) AS calls, median(output_tokens) AS med, avg(input_tokens) AS mean_in,
    stddev_pop(input_tokens) AS sd_in, sum(micros)::DECIMAL(20,0) AS cur,
    sum({_priced_sql('1::DECIMAL(9,4)', '5::DECIMAL(9,4)')})::DECIMAL(20,0) AS alt
  FROM e WHERE lower(model) LIKE '%large%' GROUP BY project),
rule1 AS (
  SELECT 'model_downgrade' AS rule, project, NULL::VARCHAR AS model, NULL::BIGINT AS input_bucket, calls,
    ((cur - alt) * 0.000001)::DECIMAL(24,10) AS saving, 'high' AS confidence,
    'Cheaper model (small): ' || project AS title,
    'calls=' || calls || ' median_output_tokens=' || floor(med)::BIGINT || ' usd_now=' || {_usd('cur * 0.000001')}
      || ' usd_on_target=' || {_usd('alt * 0.000001')} || ' usd_saved_monthly=' || {_usd('(cur - alt) * 0.000001')}
      || ' percent_saved=' || round((cur - alt) * 100.0 / cur, 0)::BIGINT AS detail
  FROM d WHERE calls >= 100 AND med < 300 AND mean_in > 0 AND sd_in / mean_in <= 0.5 AND cur > alt)
"""

CACHE = f"""
g AS (
  SELECT project, model, any_value(coalesce(ir, 3)) AS rate, round_even(input_tokens / 500.0, 0)::BIGINT * 500 AS input_bucket,
    count(*) AS calls, (sum(input_tokens) - arg_min(input_tokens, {{'a': ts, 'b': input_tokens}}))::BIGINT AS repeated
  FROM e WHERE input_tokens >= 2000 AND cache_read_tokens = 0 GROUP BY project, model, 4),
g2 AS (
  SELECT *, ((rate * (repeated::DECIMAL(15,0) * 0.90 - input_bucket::DECIMAL(10,0) * 1.25)) * 0.000001)::DECIMAL(24,10) AS saving FROM g),
rule2 AS (
  SELECT 'missing_prompt_cache' AS rule, project, model, input_bucket, calls, saving, 'medium' AS confidence,
    'Prompt cache (' || model || '): ' || project AS title,
    'calls=' || calls || ' model=' || model || ' input_tokens_each=' || input_bucket || ' input_tokens_repeated=' || repeated
      || ' usd_saved_monthly=' || {_usd('saving')} AS detail
  FROM g2 WHERE calls >= 10 AND saving > 0)
"""

BATCH = f"""
a AS (
  SELECT project, micros, count(*) OVER (PARTITION BY project ORDER BY ts
    RANGE BETWEEN INTERVAL {BURST_MINUTES} MINUTES PRECEDING AND CURRENT ROW) AS in_window
  FROM e WHERE source = 'api' AND NOT is_batch),
a2 AS (
  SELECT project, count(*) AS calls, max(in_window) AS peak,
    (sum(micros)::DECIMAL(20,0) * 0.0000005)::DECIMAL(24,10) AS saving FROM a GROUP BY project),
rule3 AS (
  SELECT 'batch_candidates' AS rule, project, NULL::VARCHAR AS model, NULL::BIGINT AS input_bucket, calls, saving,
    'medium' AS confidence, 'Batch interface: ' || project AS title,
    'direct_calls=' || calls || ' window_minutes={BURST_MINUTES} most_calls_in_window=' || peak
      || ' usd_saved_monthly=' || {_usd('saving')} AS detail
  FROM a2 WHERE peak >= {BURST_CALLS} AND saving > 0)
"""


def _rule_sql(cte: str, rule: str) -> str:
    return f"""{EVENTS}, {cte}
SELECT rule, project, model, input_bucket, calls, {SUGGESTION}, confidence, title, detail FROM {rule}"""


PARSED_LOGS = """
logs AS (
  SELECT *, '/logs/projects/-home-team-' || project || '/s' || session_id || '.jsonl' AS file_path,
    CASE WHEN event_id % 50 = 0 THEN 'not_a_json_object' WHEN event_id % 50 = 1 THEN 'no_usage' END AS reject_reason
  FROM (SELECT * REPLACE (NULL::VARCHAR AS cache_ttl, false AS is_batch) FROM e))
"""

PARSED_CALLS = """
calls AS (
  SELECT *, CASE WHEN event_id % 5 <> 0 THEN 'r' || event_id END AS response_id, copy
  FROM e CROSS JOIN (VALUES (0), (1)) c(copy) WHERE source = 'api'),
keyed_calls AS (
  SELECT *, CASE WHEN response_id IS NOT NULL
    THEN sha256(concat_ws(chr(31), 'api', response_id, project, CASE WHEN is_batch THEN '1' ELSE '0' END, coalesce(cache_ttl, '')))
    ELSE sha256(concat_ws(chr(31), 'api', 'noid', event_id || ':' || copy)) END AS call_uid
  FROM calls)
"""

REPORT_RECORDS = f"""
sums AS (
  SELECT date_trunc('day', ts)::TIMESTAMP AS ts, model, project, is_batch, sum(input_tokens)::BIGINT AS input_tokens,
    sum(output_tokens)::BIGINT AS output_tokens, sum(cache_read_tokens)::BIGINT AS cache_read_tokens,
    0::BIGINT AS cache_creation_tokens, NULL::VARCHAR AS cache_ttl
  FROM e GROUP BY ALL),
records AS (
  SELECT ts, model, project, is_batch, input_tokens, output_tokens, cache_read_tokens, cache_creation_tokens,
    {_priced_sql()}::DOUBLE / 1e6 AS cost_usd, false AS aggregated_cost, model AS reported
  FROM sums LEFT JOIN rates ON model = rate_model
  UNION ALL
  SELECT DISTINCT ts, 'medium', 'costs', false, 0, 0, 0, 0, 42.5, true, '' FROM sums)
"""


# What the stored table holds after all files are read; logged calls count once for each id, or each time without one.
STORED_ROWS = f"""{EVENTS}, {PARSED_LOGS}, {PARSED_CALLS}, {REPORT_RECORDS}, stored AS (
  SELECT ts, 'session_log' AS source, project, model, input_tokens, output_tokens, cache_creation_tokens, cache_read_tokens, is_batch,
    {_priced_sql()}::DOUBLE / 1e6 AS cost_usd, cache_ttl, event_id FROM logs WHERE reject_reason IS NULL
  UNION ALL SELECT ts, source, project, model, input_tokens, output_tokens, cache_creation_tokens, cache_read_tokens, is_batch,
    micros::DOUBLE / 1e6, cache_ttl, event_id FROM keyed_calls WHERE copy = 0 OR response_id IS NULL
  UNION ALL SELECT ts, 'org_report', project, model, input_tokens, output_tokens, cache_creation_tokens, cache_read_tokens, is_batch,
    cost_usd, NULL, NULL FROM records)
"""
STORED_LIST = """ts, source, project, model, input_tokens, output_tokens, cache_creation_tokens, cache_read_tokens, is_batch, cost_usd,
  cache_ttl, strftime(ts, '%Y-%m-%d') AS event_date"""


def oracle_sql() -> dict[str, str]:
    return {
        "priced_events": f"""{EVENTS}
SELECT event_uid, model, rate_model IS NOT NULL AS known_model, is_batch, cache_ttl, micros::DOUBLE / 1e6 AS cost_usd FROM e""",
        "usage_summary": _summary_sql(),
        "usage_summary_filtered": _summary_sql(
            "ts >= TIMESTAMP '2024-01-08' AND ts <= TIMESTAMP '2024-01-21 12:00:00' AND project = 'p3' AND model = 'large-a'"
        ),
        "timeseries_hour": _timeseries_sql(EVENTS, "e", "strftime(ts, '%Y-%m-%dT%H')"),
        "timeseries_day": _timeseries_sql(EVENTS, "e", "strftime(ts, '%Y-%m-%d')"),
        "timeseries_week": _timeseries_sql(EVENTS, "e", "strftime(ts, '%Y-W%W')"),
        "timeseries_month": _timeseries_sql(LINEITEM, "l", "strftime(ts, '%Y-%m')"),
        "iso_week_spend": f"{LINEITEM} SELECT strftime(ts, '%G-W%V') AS period_key, {USD} AS spend_usd FROM l GROUP BY 1",
        "breakdown_project": _breakdown_sql("project"),
        "breakdown_model": _breakdown_sql("model"),
        "breakdown_source": _breakdown_sql("source"),
        "breakdown_grouping_sets": f"""{EVENTS}
SELECT CASE WHEN grouping(project) = 0 THEN 'project' WHEN grouping(model) = 0 THEN 'model' ELSE 'source' END AS dimension,
  coalesce(project, model, source) AS key, count(*) AS call_count, {USD} AS spend_usd, sum(tokens)::BIGINT AS tokens
FROM e GROUP BY GROUPING SETS ((project), (model), (source))""",
        "spend_pivot": f"""{EVENTS}
SELECT strftime(ts, '%Y-%m-%d') AS bucket, {", ".join(
    f"coalesce(sum(micros) FILTER (model = '{m}'), 0)::DOUBLE / 1e6 AS " + f'"{m}"' for m in PIVOTED)},
  coalesce(sum(micros) FILTER (model NOT IN ({", ".join(f"'{m}'" for m in PIVOTED)})), 0)::DOUBLE / 1e6 AS other
FROM e GROUP BY 1""",
        "project_list": f"{EVENTS} SELECT DISTINCT project FROM e WHERE project <> ''",
        "health": "SELECT 'ok' AS status, count(*) AS event_count, '2024-01-01' AS pricing_updated, false AS pricing_stale FROM events",
        "dedup_first": f"""{LINEITEM}, f AS ({_first_sql('l', 'true')})
SELECT event_uid, ts, source, project, model, input_tokens, output_tokens, micros::DOUBLE / 1e6 AS cost_usd FROM f""",
        "append_new_events": f"""{LINEITEM}, f AS ({_first_sql('l', 'l_quantity >= 20')})
SELECT event_uid, ts, model, input_tokens, micros::DOUBLE / 1e6 AS cost_usd FROM f
WHERE event_uid NOT IN (SELECT event_uid FROM l WHERE l_quantity <= 30)""",
        "budget_status_daily_weekly_monthly": f"""{BUDGET_EVENTS}
SELECT scope, project, period, period_key, budget::DOUBLE AS budget, spent::DOUBLE / 1e6 AS spend,
  round(spent / 1e6 / budget, 6)::DOUBLE AS fraction_used,
  CASE WHEN spent >= budget * 1000000 THEN 'red' WHEN spent >= budget * 800000 THEN 'amber' ELSE 'ok' END AS level
FROM s""",
        "budget_crossings": f"{BUDGET_EVENTS} SELECT * FROM c",
        "alerts_fire_once": f"""{BUDGET_EVENTS},
{_status_cte('s0', "e.ts < TIMESTAMP '2024-01-15'")}, {_crossings_cte('c0', 's0')}
SELECT * FROM c WHERE (scope, period, calendar_key, fraction) NOT IN (SELECT (scope, period, calendar_key, fraction) FROM c0)""",
        "recent_alerts": f"""{BUDGET_EVENTS}
SELECT TIMESTAMP '2024-01-17 12:00:00' AS ts, scope, period, calendar_key, fraction, threshold, actual, period_key
FROM c ORDER BY scope, period, fraction DESC LIMIT 5""",
        "alert_outbox": f"""{BUDGET_EVENTS}
SELECT period || ' budget of ' || scope || ': ' || round(fraction * 100)::BIGINT || '% reached' AS title,
  'spend_usd=' || round(actual::DECIMAL(20,6), 2)::DECIMAL(20,2) || ' threshold_usd=' || threshold::DECIMAL(20,2) AS message
FROM c""",
        "rule_model_downgrade": _rule_sql(DOWNGRADE, "rule1"),
        "rule_missing_cache": _rule_sql(CACHE, "rule2"),
        "rule_batch_candidates": _rule_sql(BATCH, "rule3"),
        "max_calls_in_window": f"{EVENTS}, {BATCH} SELECT project, max(in_window) AS max_in_window FROM a GROUP BY 1",
        "savings_suggestions": _rule_sql(
            f"{DOWNGRADE}, {CACHE}, {BATCH}, found AS (FROM rule1 UNION ALL FROM rule2 UNION ALL FROM rule3)", "found"
        ),
        "parse_session_lines": f"""{EVENTS}, {PARSED_LOGS}, keyed_logs AS (
  SELECT *, sha256(concat_ws(chr(31), 'session_log', file_path, event_id::VARCHAR,
    CASE WHEN reject_reason IS NULL THEN 'm' || event_id END)) AS log_uid, {_priced_sql()} AS log_micros FROM logs)
SELECT log_uid AS event_uid, project, 's' || session_id AS session_id, reject_reason,
  {", ".join(f"CASE WHEN reject_reason IS NULL THEN {x} END AS {n}" for n, x in [
      ("cost_usd", "log_micros::DOUBLE / 1e6"), *[(c, c) for c in (
          "ts", "model", "input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens")]])}
FROM keyed_logs""",
        "api_records": f"""{EVENTS}, {PARSED_CALLS}
SELECT DISTINCT call_uid AS event_uid, ts, source, project, model, input_tokens, output_tokens, cache_creation_tokens,
  cache_read_tokens, is_batch, micros::DOUBLE / 1e6 AS cost_usd, response_id AS session_id, cache_ttl
FROM keyed_calls""",
        "flatten_org_report": f"""{EVENTS}, {REPORT_RECORDS}
SELECT sha256(concat_ws(chr(31), 'org_report', strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), reported, project,
    CASE WHEN is_batch THEN '1' ELSE '0' END)) AS event_uid,
  ts, 'org_report' AS source, project, model, input_tokens, output_tokens, cache_creation_tokens, cache_read_tokens,
  is_batch, cost_usd, aggregated_cost
FROM records""",
        "stored_events": f"{STORED_ROWS} SELECT {STORED_LIST} FROM stored",
        "ingest_stream_events": f"{STORED_ROWS} SELECT {STORED_LIST} FROM stored",
        "stored_events_of_two_days": f"""{STORED_ROWS} SELECT {STORED_LIST} FROM stored
WHERE ts >= TIMESTAMP '2024-01-09' AND ts <= TIMESTAMP '2024-01-11'""",
        "stored_rejects": f"""{EVENTS}, {PARSED_LOGS}, {REPORT_RECORDS}
SELECT 'session_log' AS source, reject_reason, count(*) AS records, count(*) AS with_text FROM logs WHERE reject_reason IS NOT NULL GROUP BY 2
UNION ALL SELECT 'org_report', reason, count(DISTINCT ts), count(DISTINCT ts) FROM records, (VALUES ('no_usage'), ('not_a_json_object')) r(reason) GROUP BY 2""",
        "file_manifest": f"""{EVENTS}
SELECT 'projects' AS kind, 'folder=-home-team-' || project AS folder, count(DISTINCT event_id % 2) AS files FROM e GROUP BY project
UNION ALL SELECT 'calls', 'project=' || project, count(DISTINCT event_id % 2) FROM e WHERE source = 'api' GROUP BY project
UNION ALL SELECT 'pages', 'page=page-' || strftime(ts, '%Y-%m-%d'), 1 FROM e GROUP BY ALL""",
        "ingest_report": f"""{STORED_ROWS}, f AS (
  SELECT 'session_log' AS source, count(DISTINCT project) FILTER (event_id % 2 = 0) AS even, count(DISTINCT project) FILTER (event_id % 2 = 1) AS odd FROM e
  UNION ALL SELECT 'api', count(DISTINCT project) FILTER (event_id % 2 = 0), count(DISTINCT project) FILTER (event_id % 2 = 1) FROM e WHERE source = 'api'
  UNION ALL SELECT 'org_report', count(DISTINCT ts), 0 FROM records),
r AS (
  SELECT source, event_id % 2 AS odd, count(*) AS n FROM stored GROUP BY ALL),
k AS (
  SELECT 'session_log' AS source, event_id % 2 AS odd, count(*) AS n FROM logs WHERE reject_reason IS NOT NULL GROUP BY ALL
  UNION ALL SELECT 'org_report', NULL, 2 * count(DISTINCT ts) FROM records),
d AS (SELECT event_id % 2 AS odd, count(*) FILTER (copy = 1 AND response_id IS NOT NULL) AS n FROM keyed_calls GROUP BY ALL),
t AS (SELECT sum(n) FILTER (coalesce(odd, 0) = 0) AS one, sum(n) FILTER (odd = 1) AS two FROM r)
SELECT run::BIGINT AS run, source, (CASE run WHEN 1 THEN f.even ELSE f.even + f.odd END)::BIGINT AS files_scanned,
  (CASE run WHEN 1 THEN 0 ELSE f.even END)::BIGINT AS files_unchanged,
  coalesce((SELECT n FROM r WHERE r.source = f.source AND coalesce(r.odd, 0) = run - 1), 0)::BIGINT AS rows_added,
  coalesce((SELECT n FROM d WHERE f.source = 'api' AND d.odd = run - 1), 0)::BIGINT AS duplicates,
  coalesce((SELECT n FROM k WHERE k.source = f.source AND coalesce(k.odd, 0) = run - 1), 0)::BIGINT AS records_skipped,
  (CASE run WHEN 1 THEN 0 ELSE one END)::BIGINT AS events_before, (CASE run WHEN 1 THEN one ELSE one + two END)::BIGINT AS events_after
FROM f, t, (VALUES (1), (2)) v(run)""",
        "fired_alerts": f"""{BUDGET_EVENTS}
SELECT TIMESTAMP '2024-01-17 12:00:00' AS ts, scope, period, calendar_key, fraction, threshold, actual,
  period || ' budget of ' || scope || ': ' || round(fraction * 100)::BIGINT || '% reached' AS title, actual AS sent_usd
FROM c""",
        "tumbling_spend_stream": f"""{EVENTS}, w AS (
  SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, * FROM e)
SELECT window_start, window_end, model, count(*) AS call_count, {USD} AS spend_usd, sum(tokens)::BIGINT AS tokens
FROM w GROUP BY 1, 2, 3""",
        "stream_dedup": f"{EVENTS} SELECT event_uid, ts, model, micros::DOUBLE / 1e6 AS cost_usd FROM e",
        "stream_dedup_batches": f"{EVENTS} SELECT event_uid, ts, model, micros::DOUBLE / 1e6 AS cost_usd FROM e",
        "stream_alerts": f"""{STORED_ROWS}, paid AS (SELECT *, round(cost_usd * 1e6)::BIGINT AS micros FROM stored),
{BUDGETS}, {_status_cte('s', events='paid')}, {_crossings_cte('c', 's')}
SELECT scope, period, calendar_key, fraction, threshold, true AS reached FROM c""",
        "landed_lines": f"""{EVENTS}
SELECT reader, project, 'session-' || project AS session_id, row_number() OVER (PARTITION BY reader, project ORDER BY event_id) AS line_number,
  CASE event_id % 50 WHEN 0 THEN 'not_a_json_object' WHEN 1 THEN 'no_usage' END AS reject_reason,
  CASE WHEN event_id % 50 > 1 THEN event_uid END AS event_uid, CASE WHEN event_id % 50 > 1 THEN true END AS key_holds
FROM e CROSS JOIN (VALUES ('whole'), ('split')) v(reader)""",
        "burst_stream": f"""{EVENTS}, w AS (
  SELECT date_trunc('hour', ts) - back * INTERVAL 1 HOUR AS window_start, project
  FROM e CROSS JOIN range(6) r(back) WHERE source = 'api' AND NOT is_batch)
SELECT window_start, window_start + INTERVAL 6 HOUR AS window_end, project, count(*) AS calls
FROM w GROUP BY 1, 2, 3
HAVING count(*) >= 4""",
        **LLM_SQL,
    }
