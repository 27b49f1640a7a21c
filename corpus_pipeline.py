"""From documents to shuffled token shards: toxicity, near duplicates, benchmark passages, source weights, training order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.llm import decontaminate, mixing, simhash, toxicity, training_order
from meterlake.llm.shared import fresh, ship_package, staged

REST = "__rest"


def _apart(docs: DataFrame, *needed: str) -> DataFrame:
    """The needed columns, and all others in one, so that an operator's new columns replace none of them."""
    ship_package(docs.sparkSession)
    others = [F.col(f"`{c}`") for c in docs.columns if c not in needed]
    # A struct must have a field.
    return docs.select(*needed, F.struct(F.lit(0).alias(fresh(docs, "_")), *others).alias(REST))


def _together(rows: DataFrame, docs: DataFrame, *needed: str) -> DataFrame:
    return rows.select(*[F.col(f"`{c}`") if c in needed else F.col(f"{REST}.`{c}`") for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the nearest labelled examples don't call toxic; learns from the same labels as the query of the operator."""
    rows = _apart(docs, "doc_id", "text")
    index = toxicity.learn(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _together(toxicity.score(rows, index).where(F.col("score") < toxicity.THRESHOLD), docs, "doc_id", "text")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays."""
    ship_package(spark)
    return simhash.drop_near_duplicates(docs, shingle=3, distance=2)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of which less than a twentieth lies in benchmark passages."""
    rows = _apart(docs, "doc_id", "text")
    found = decontaminate.find_benchmark(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _together(found.where(~F.col("contaminated")), docs, "doc_id", "text")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight takes it."""
    ship_package(spark)
    needed = ("doc_id", "text", "source")
    mixed = mixing.mix_sources(_apart(docs, *needed))
    return _together(mixing.emit_copies(mixed, [*needed, REST]), docs, *needed)


def write_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards in the shared folder; returns for each document where its tokens are."""
    ship_package(spark)
    documents, _, _ = training_order.materialise(docs)
    return documents


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
    ("training_order", write_shards),
]

#: Neither learned toxicity nor 64-bit XXH64 fingerprints can be written in SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
