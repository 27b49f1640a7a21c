"""A bounded sample of labelled documents to learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo a number; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def examples(docs: DataFrame, labels: DataFrame, label: str, most: int, modulus: int | None = None, held_out: int | None = None) -> DataFrame:
    """Rows (doc_id, text, label) of at most `most` labelled documents, those with the least hash of their id.

    Ids and labels that are null are left out, as are ids of the fold `held_out`. Of labels or documents with the same id
    the largest label and the least text count.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    if modulus is not None:
        known = known.where(fold(F.col("doc_id"), modulus) != held_out)
    known = known.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    return texts.groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.first("label").alias("label"))
