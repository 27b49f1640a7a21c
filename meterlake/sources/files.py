"""Landed files: which changed, and their numbered lines."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, Window
from pyspark.sql import functions as F

from meterlake.schema import hadoop_path, path_exists
from meterlake.staging import StagingArea, broadcast_if_small

# Files up to this size are read as one row each, which numbers their lines
# without a shuffle. Larger ones are read in splits.
WHOLE_FILE_BYTES = 32 * 1024 * 1024

# Up to so many files are opened by their paths, which the driver holds. More are found again by listing the
# pattern and joining the list, with the same rows as the result.
NAMED_FILES = 10_000

# What ends a line, the longest first.
LINE_END = r"\r\n|\n|\r"

# Splits of a given size are dealt to so many tasks for each core, however many there are.
TASKS_PER_CORE = 4

# Characters that stand for others in a path to read from.
GLOB_CHARACTER = r"[{}\[\]*?\\]"


def list_files(spark: SparkSession, pattern: str) -> DataFrame:
    """``(file_path, length, modified)`` of the files under ``pattern``, contents unread."""
    return (
        spark.read.format("binaryFile")
        .load(pattern)
        .select(
            F.col("_metadata.file_path").alias("file_path"),
            "length",
            F.col("modificationTime").alias("modified"),
        )
    )


def latest_entries(entries: DataFrame) -> DataFrame:
    """The latest manifest entry per file."""
    latest = F.max_by(F.struct("length", "modified", "ingested"), F.struct("ingested", "modified", "length"))
    return entries.groupBy("file_path").agg(latest.alias("last")).select("file_path", "last.*")


def oldest_change(files: DataFrame) -> dt.datetime | None:
    """The earliest modification time among ``files``; None when there are none."""
    micros = files.agg(F.min(F.unix_micros("modified"))).first()[0]
    return None if micros is None else dt.datetime.fromtimestamp(micros / 1e6, dt.timezone.utc)


def changed_files(listed: DataFrame, manifest: DataFrame) -> DataFrame:
    """Listed files whose length or modification time is not the recorded one."""
    seen = manifest.select("file_path", "length", "modified")
    return listed.join(seen, ["file_path", "length", "modified"], "left_anti")


def _without_mark(text: str) -> Column:
    """A file's text without a byte-order mark, which Spark's split reader leaves out too."""
    return F.regexp_replace(text, "^\ufeff", "")


def _numbered_small(files: DataFrame) -> DataFrame:
    """Lines of files that arrive whole. What follows the last line end is no line."""
    text = _without_mark("value")
    by_any_end = F.split(F.regexp_replace(text, rf"({LINE_END})\z", ""), LINE_END)
    # A single character needs no search by a regular expression.
    by_newline = F.split(F.when(F.endswith(text, F.lit("\n")), F.left(text, F.length(text) - 1)).otherwise(text), "\n")
    lines = F.when(F.contains("value", F.lit("\r")), by_any_end).otherwise(by_newline)
    return (
        files.where(F.length("value") > 0)
        .select("file_path", "modified", F.posexplode(lines).alias("position", "value"))
        .select("file_path", "modified", (F.col("position") + 1).cast("long").alias("line_number"), "value")
    )


@contextmanager
def _splits_of(spark: SparkSession, split_bytes: int | None) -> Iterator[None]:
    """Files scanned meanwhile are cut into splits of ``split_bytes``, many of which are one task's; None leaves Spark's own."""
    if split_bytes is None:
        yield
        return
    settings = {
        "spark.sql.files.maxPartitionBytes": str(split_bytes),
        "spark.sql.files.openCostInBytes": str(split_bytes // 16),
        "spark.sql.files.maxPartitionNum": str(TASKS_PER_CORE * spark.sparkContext.defaultParallelism),
    }
    before = {name: spark.conf.get(name, None) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _numbered_large(lines: DataFrame, area: StagingArea, split_bytes: int | None) -> DataFrame:
    """Lines of files that arrive in splits, numbered without moving the text.

    Rows keep their order inside a split, so a line's number is its place in the
    split plus the lines of the splits before it. Where Spark cuts the splits
    depends on the cores it has at that moment, so the cut lines are staged and
    counted from there. Only the counts, one row per split, are shuffled.
    """
    with _splits_of(area.spark, split_bytes):
        lines = area.stage(lines, "split-lines")
    split_key = ["file_path", "split_start", "task"]
    counts = lines.groupBy(*split_key).agg(F.count(F.lit(1)).alias("lines"), F.min("place").alias("first_place"))
    before = Window.partitionBy("file_path").orderBy("split_start").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        *split_key, "first_place", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("lines_before")
    )
    return lines.join(broadcast_if_small(area.stage(starts, "split-starts")), split_key).select(
        "file_path",
        "modified",
        (F.col("lines_before") + F.col("place") - F.col("first_place") + 1).alias("line_number"),
        "value",
    )


@dataclass(frozen=True)
class Choice:
    """Where to read: paths or patterns, and the list that their files must be on, if any."""

    paths: list[str]
    on_list: DataFrame | None = None

    def chosen(self, rows: DataFrame) -> DataFrame:
        return rows if self.on_list is None else rows.join(self.on_list, "file_path", "left_semi")


def choose(pattern: str, files: DataFrame | None) -> Choice:
    """How to read the listed ``files`` of a pattern; all of it without a list.

    A short list names its files, so nothing else is listed, however many files the pattern matches.
    """
    if files is None:
        return Choice([pattern])
    literal = F.regexp_replace(plain_path(F.col("file_path")), GLOB_CHARACTER, r"\\$0")
    named = [r.path for r in files.select(literal.alias("path")).distinct().limit(NAMED_FILES + 1).collect()]
    if len(named) <= NAMED_FILES:
        return Choice(named)
    return Choice([pattern], broadcast_if_small(files.select("file_path")))


def _reader(spark: SparkSession, since: dt.datetime | None) -> DataFrameReader:
    if since is None:
        return spark.read
    bound = (since - dt.timedelta(seconds=1)).strftime("%Y-%m-%dT%H:%M:%S")
    return spark.read.options(modifiedAfter=bound, timeZone="UTC")


def _facts() -> list[Column]:
    return [
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_modification_time").alias("modified"),
    ]


def plain_path(path: Column) -> Column:
    """A file path as it is on disk; Spark's metadata encodes it as in a URL.

    Decoding would turn ``+`` into a space, so that is encoded first.
    """
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def _readable(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"file_path": plain_path(F.col("file_path")), "value": F.make_valid_utf8("value")})


def read_whole(
    spark: SparkSession, pattern: str, files: DataFrame | None = None, since: dt.datetime | None = None
) -> DataFrame:
    """``(file_path, modified, value)`` with each file's whole text."""
    choice = choose(pattern, files)
    rows = _reader(spark, since).text(choice.paths, wholetext=True)
    return _readable(choice.chosen(rows.select(*_facts(), _without_mark("value").alias("value"))))


def read_lines(
    area: StagingArea,
    pattern: str,
    files: DataFrame | None = None,
    since: dt.datetime | None = None,
    whole_file_bytes: int = WHOLE_FILE_BYTES,
    split_bytes: int | None = None,
) -> DataFrame:
    """``(file_path, modified, line_number, value)`` of every line.

    ``files`` (a staged list, not empty) keeps only those files. ``since`` is a bound on
    their modification time that lets Spark leave older files out of the scan
    altogether; it need not be tight, because the exact choice is that of
    ``files``. Lines of large files are staged in ``area``; ``split_bytes`` is the size
    of the splits they are read in, by default the session's.
    """
    spark = area.spark
    choice = choose(pattern, files)
    reader = _reader(spark, since)
    is_small = F.col("_metadata.file_size") <= whole_file_bytes
    whole = reader.text(choice.paths, wholetext=True).where(is_small).select(*_facts(), "value")
    lines = _numbered_small(choice.chosen(whole))
    large_files = list_files(spark, pattern) if files is None else files
    if not large_files.where(F.col("length") > whole_file_bytes).isEmpty():
        cut = reader.text(choice.paths, wholetext=False).where(~is_small).select(
            *_facts(),
            F.col("_metadata.file_block_start").alias("split_start"),
            F.spark_partition_id().alias("task"),
            F.monotonically_increasing_id().alias("place"),
            "value",
        )
        lines = lines.unionByName(_numbered_large(choice.chosen(cut), area, split_bytes))
    return _readable(lines)


def matches_any(spark: SparkSession, pattern: str) -> bool:
    """Whether a glob pattern matches at least one path."""
    if not any(c in pattern for c in "*?[{"):
        return path_exists(spark, pattern)
    fs, globbed = hadoop_path(spark, pattern)
    found = fs.globStatus(globbed)
    return found is not None and len(found) > 0
