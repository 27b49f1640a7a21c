"""Mixing sources to target weights: how often each document is taken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.llm.shared import fresh, staged

#: Targets of so many sources are broadcast (a few MB); more are joined by a shuffle that AQE splits.
BROADCAST_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words between white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """Columns source, source_size, target of a table (source, source_size) with a row for each source.

    Sources in code point order, null last, weigh `weights` in turn and share `share` times all sizes. A target stops at
    `most` times its source's size; what is above goes to the others by weight, until none is above. That is one level:
    target = min(level * weight, most * size), where the level makes the targets add up. Sources are capped in the order of
    cap / weight, so the level follows from running sums over the sources (not over documents). If share >= most, or
    for a source without words, the target is the cap.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    listed = F.array(*[F.lit(float(w)) for w in weights])
    weighed = sizes.withColumn("weight", F.element_at(listed, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    ranked = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = ranked.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    capped = weighed.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    capped = capped.withColumn("left", F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(upto), F.lit(0.0)))
    capped = capped.withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
    # A source's own level, if all before it are capped and none after. The first that is not above its cap sets the level;
    # from there on own levels only fall, so that is the highest one.
    capped = capped.withColumn("own", F.col("left") / F.col("open"))
    level = F.max(F.when(F.col("own") * F.col("weight") <= F.col("cap"), F.col("own"))).over(everything)
    capped = capped.withColumn("level", level)
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("weight")))
    return capped.select("source", "source_size", target.alias("target"))


def mix_sources(
    docs: DataFrame,
    weights: list[float] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 7,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
) -> DataFrame:
    """All columns of docs, and size, source_size, target, copies, taken.

    A source's repetition rate is its target over its size. Each document is taken floor(rate) times, and once more if a
    fraction made from a hash of seed, doc_id and text is below the rate's fraction: reruns agree, and equal rows are taken
    alike. Nulls: a null text has size 0 and is still a row; null is a source of its own, last in order; a null doc_id is
    hashed as an empty string. An empty table gives an empty table. Columns of docs that have one of the new names are
    replaced. Sizes are summed by map tasks first, so a source with most rows is no large group.
    """
    added = ("size", "source_size", "target", "copies", "taken")
    own = [c for c in docs.columns if c.lower() not in added or c in (text, source, doc_id)]
    key = fresh(docs, "__source")
    sized = docs.select(*[F.col(f"`{c}`") for c in own], F.col(f"`{source}`").alias(key), word_count(F.col(f"`{text}`")).alias("size"))
    sizes = sized.groupBy(F.col(key).alias("source")).agg(F.sum("size").alias("source_size"))
    targets = staged(source_targets(sizes, list(weights), share, most).withColumnRenamed("source", f"{key}_t"), "targets")
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    joined = sized.join(targets, F.col(key).eqNullSafe(F.col(f"{key}_t")), "left")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    text_key = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")), F.md5(F.coalesce(F.col(f"`{text}`"), F.lit(""))))
    chance = F.conv(F.substring(F.md5(text_key), 1, 12), 16, 10).cast("double") / F.lit(float(16**12))
    copies = F.floor(rate) + F.when(chance < rate - F.floor(rate), 1).otherwise(0)
    return joined.drop(key, f"{key}_t").withColumn("copies", copies.cast("long")).withColumn("taken", F.col("size") * F.col("copies"))


def emit_copies(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: each document as often as it is taken."""
    n = fresh(mixed, "__n")
    taken = mixed.where(F.col("copies") > 0)
    return taken.withColumn(n, F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select(*[F.col(f"`{c}`") for c in columns])
