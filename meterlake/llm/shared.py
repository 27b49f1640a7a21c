"""The folder that driver and executors share, and tables staged there."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_root(spark: SparkSession) -> str:
    """What `spark.checkpoint.dir` names. Only a local session may go without: it gets a temporary folder."""
    root = spark.conf.get(CHECKPOINT_DIR, None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"{CHECKPOINT_DIR} must name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='llm-')}"
        spark.conf.set(CHECKPOINT_DIR, root)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def mounted(folder: str) -> str:
    """The path under which tasks can open files of a shared folder; only mounted folders have one."""
    parts = urlsplit(folder)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"tasks open files here, so {CHECKPOINT_DIR} must name a mounted folder, not {folder}")
    return parts.path


def staged(df: DataFrame, name: str) -> DataFrame:
    """The rows of df from a Parquet table in the shared folder; cuts the lineage like checkpoint()."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


_shipped: dict[str, str] = {}


def ship_package(spark: SparkSession) -> None:
    """Gives this package to the Python workers of an application, once; they need not find it on their own path."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="llm-package-")
    with zipfile.ZipFile(f"{folder}/{package.name}.zip", "w") as archive:
        for path in sorted(package.rglob("*.py")):
            archive.write(path, path.relative_to(package.parent))
    context.addPyFile(f"{folder}/{package.name}.zip")
    _shipped[context.applicationId] = folder
