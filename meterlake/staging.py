"""Staged tables: compute once, cut the lineage, survive a lost executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.schema import hadoop_path


def staging_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    A cluster names it in ``spark.checkpoint.dir`` and can't go without, as its
    machines see only their own temporary folders. A local session, which is one
    process, is given one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="meterlake-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_staging_path(spark: SparkSession, label: str) -> str:
    return f"{staging_root(spark)}/meterlake/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write ``df`` once to the staging folder and read it back.

    Later uses (append, count, report) then see the same rows even though the
    tables ``df`` was derived from change in between.
    """
    path = path or new_staging_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class StagingArea:
    """Staged tables of one job, removed when the job is over."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.folder = new_staging_path(spark, label)

    def stage(self, df: DataFrame, label: str) -> DataFrame:
        return stage(df, label, f"{self.folder}/{label}-{uuid.uuid4().hex}")

    def __enter__(self) -> StagingArea:
        return self

    def __exit__(self, *_) -> None:
        fs, folder = hadoop_path(self.spark, self.folder)
        fs.delete(folder, True)


# Keys and paths are some 100 bytes a row, so a list up to this long goes to
# every executor; a longer one is joined by a shuffle.
BROADCAST_ROWS = 500_000


def broadcast_if_small(keys: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``keys`` with a broadcast hint when a count shows that they are few.

    A staged table is counted from the footers of its files.
    """
    return F.broadcast(keys) if keys.count() <= limit else keys
