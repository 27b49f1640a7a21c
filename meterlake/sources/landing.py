"""Sample raw records as the files that collectors leave: logs, API calls, report pages, prices and budgets."""

from __future__ import annotations

import json
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.functions.calendar import utc_text
from meterlake.schema import hadoop_path
from meterlake.plans.ingest import FileSource, api_record_source, org_report_source
from meterlake.sources import files as landed
from meterlake.sources import samples
from meterlake.sources.pricing import PriceTable
from meterlake.sources.session_logs import parse_session_lines


def _write_by(rows: DataFrame, folder: str, path: str) -> None:
    """Lines `value` into one file for each `folder` value; another call adds files."""
    rows.repartition(folder).write.mode("append").partitionBy(folder).text(path)


def land(root: str, events: DataFrame) -> None:
    """Log lines of all events and logged calls of the API events, below root; a second call adds to the folders."""
    lines = samples.session_lines(events).select(F.split_part("file_path", F.lit("/"), F.lit(-2)).alias("folder"), "value")
    _write_by(lines, "folder", f"{root}/projects")
    text = lambda c: F.coalesce(F.concat(F.lit('"'), c, F.lit('"')), F.lit("null"))
    calls = samples.api_calls(events)
    entry = F.concat(
        F.lit('{"response":'), "response", F.lit(',"project":'), text(F.col("project")), F.lit(',"is_batch":'), F.col("is_batch").cast("string"),
        F.lit(',"cache_ttl":'), text(F.col("cache_ttl")), F.lit(',"logged_at":'), text(F.concat(utc_text(F.col("logged_at")), F.lit("Z"))), F.lit("}"),
    )
    _write_by(calls.select("project", entry.alias("value")), "project", f"{root}/calls")


def land_logs(root: str, events: DataFrame) -> None:
    """Log lines by number, one file for each project, where a collector leaves them: projects/<dir>/<session>.jsonl below root."""
    spark = events.sparkSession
    lines = samples.session_lines(events).select(F.split_part("file_path", F.lit("/"), F.lit(-2)).alias("folder"), "line_number", "value")
    ordered = lines.repartition("folder").sortWithinPartitions("folder", "line_number")
    ordered.drop("line_number").write.partitionBy("folder").text(f"{root}/written")
    fs, written = hadoop_path(spark, f"{root}/written/folder=*/part-*")
    for status in fs.globStatus(written):
        folder = status.getPath().getParent().getName().removeprefix("folder=")
        _, target = hadoop_path(spark, f"{root}/projects/{folder}/session-{folder.rpartition('-')[2]}.jsonl")
        fs.mkdirs(target.getParent())
        fs.rename(status.getPath(), target)


def land_pages(root: str, events: DataFrame) -> None:
    """One file for each report page."""
    pages = samples.report_pages(events).select(F.col("location").alias("page"), F.col("payload").alias("value"))
    _write_by(pages, "page", f"{root}/pages")


def land_settings(root: str, spark: SparkSession, prices: PriceTable, budgets: DataFrame) -> None:
    """A pricing file and a settings file with the given prices and budgets."""
    number = lambda x: None if x is None else float(x)
    models = {r.model: {"input": number(r.input_rate), "output": number(r.output_rate)} for r in prices.rates.collect()}
    names = ("cache_read_multiplier", "cache_write_5m_multiplier", "cache_write_1h_multiplier", "batch_multiplier")
    pricing = {"models": models, "modifiers": {n: number(m) for n, m in zip(names, prices.modifiers)}, "fallback_model": prices.fallback_model}
    limits: dict = {"global": {}, "projects": {}}
    for r in budgets.collect():
        (limits["global"] if r.project is None else limits["projects"].setdefault(r.project, {}))[r.period] = number(Decimal(r.budget))
    for name, value in (("pricing", pricing), ("settings", {"budgets": limits, "alert_fractions": [0.5, 0.8, 1.0]})):
        spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.text(f"{root}/{name}")


def landed_sources(root: str) -> list[FileSource]:
    """Sources over what land and land_pages have written. Spark names the files, so the log pattern is its own."""
    logs = f"{root}/projects/*/*.txt"

    def drafts(area, files, since):
        return parse_session_lines(landed.read_lines(area, logs, files, since))

    return [FileSource("session_log", logs, drafts), api_record_source(f"{root}/calls/*/*.txt"), org_report_source(f"{root}/pages/*/*.txt")]
