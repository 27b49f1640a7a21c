"""SimHash near-duplicates by the generalised pigeonhole principle, and their connected components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlake.llm.shared import fresh, staged
from meterlake.llm.words import LOWER, pieces

BITS = 64
#: Fingerprints whose bits are looked at to plan the probes. The plan changes the work, never the result.
PLAN_ROWS = 4_096
#: A bucket of more fingerprints is probed by shared midpoints instead of pair by pair.
BUCKET_ROWS = 64
_FOLD = LOWER.tobytes()


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit fingerprint, unsigned: bits set in over half of the hashes of all shingles."""
    words = text.encode().translate(_FOLD).split() if text else []
    if not words:
        return 0
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words))).tolist()
    ends = ends[shingle - 1 :].tolist() or [len(line)]
    h = np.array([digest(line[s:e], 42) for s, e in zip(starts, ends)], np.uint64)
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 65_536):
        part = h[i : i + 65_536]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, column: str, text: str = "text", shingle: int = 3) -> DataFrame:
    """docs with its fingerprint as a signed long; null and empty texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, text):
                prints = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(text)], np.uint64)
                yield batch.append_column(column, pa.array(prints.view(np.int64)))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(column, T.LongType())]))


def plan_probes(sample: np.ndarray, n: int, distance: int) -> list[tuple[int, int]]:
    """(mask, threshold) of each part that is probed, for n distinct fingerprints of which sample are some.

    Bits that agree or differ together go to one part. With thresholds that add up to distance - parts + 1, any two
    fingerprints within the distance are within the threshold in one part (-1: the part is not probed). Dynamic
    programming shares out the thresholds by estimated candidates: pairs of the sample within the threshold, scaled to n,
    and the keys that a probe makes. Of all numbers of parts the cheapest is taken.
    """
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float) if len(sample) else np.zeros((1, BITS))
    with np.errstate(all="ignore"):
        alike = np.abs(np.nan_to_num(np.corrcoef(bits.T)))
    part = sample[: 1 + PLAN_ROWS // 4]
    pairs = part[:, None] ^ part[None, :]
    upper = np.triu_indices(len(part), 1)
    differ = pairs[upper] if len(part) > 1 else np.empty(0, np.uint64)
    scale = n * max(n - 1, 0) / 2 / max(len(differ), 1)
    best: tuple[float, list[tuple[int, int]]] = (float("inf"), [])
    for m in range(1, min(distance + 2, 8) + 1):
        masks, left = [], list(range(BITS))
        for k in range(m):
            size = len(left) // (m - k)
            grown = [left.pop(0)]
            while len(grown) < size:
                grown.append(left.pop(int(np.argmax(alike[np.ix_(left, grown)].sum(axis=1)))))
            masks.append(sum(1 << b for b in grown))
        costs = []
        for mask in masks:
            far = np.bitwise_count(differ & np.uint64(mask))
            width, row = mask.bit_count(), [0.0]
            for t in range(distance + 1):
                keys = sum(_choose(width, i) for i in range(t + 1))
                row.append(float((far <= t).sum() + 0.5) * scale * 0.05 + n * keys)
            costs.append(row)
        table = {0: (0.0, [])}
        for row in costs:
            new: dict[int, tuple[float, list[int]]] = {}
            for used, (cost, plan) in table.items():
                for units in range(distance + 2 - used):
                    step = (cost + row[units], [*plan, units - 1])
                    if used + units not in new or step[0] < new[used + units][0]:
                        new[used + units] = step
            table = new
        cost, thresholds = table[distance + 1]
        if cost < best[0]:
            best = (cost, [(mask, t) for mask, t in zip(masks, thresholds) if t >= 0])
    return best[1]


def _choose(n: int, k: int) -> int:
    out = 1
    for i in range(k):
        out = out * (n - i) // (i + 1)
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _ball(mask: int, radius: int) -> list[tuple[int, int]]:
    """(flips, number of flipped bits) of all ways to flip up to radius bits of mask."""
    bits = [1 << b for b in range(BITS) if mask >> b & 1]
    return [(_signed(sum(c)), r) for r in range(radius + 1) for c in combinations(bits, r)]


def _longs(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])


def _keys(prints: DataFrame, probes: list[tuple[int, int]], around: bool) -> DataFrame:
    """Rows (part, key, fp): the part's own bits, or all keys within its threshold of them."""
    def part(i: int, mask: int, t: int) -> Column:
        own = F.col("fp").bitwiseAND(F.lit(_signed(mask)).cast("long"))
        keys = F.transform(_longs([x for x, _ in _ball(mask, t)]), lambda x: own.bitwiseXOR(x)) if around and t else F.array(own)
        return F.transform(keys, lambda k: F.struct(F.lit(i).alias("part"), k.alias("key")))

    each = [part(i, mask, t) for i, (mask, t) in enumerate(probes)]
    return prints.select("fp", F.explode(F.concat(*each)).alias("k")).select("k.part", "k.key", "fp")


def similar_prints(prints: DataFrame, distance: int, bucket_rows: int = BUCKET_ROWS, probes: list[tuple[int, int]] | None = None) -> DataFrame:
    """Edges (a, b), a > b, that connect all of the distinct fingerprints `fp` within the distance, and no others.

    Probed buckets of up to bucket_rows fingerprints are verified pair by pair. Fingerprints of larger buckets are linked
    by midpoints: two are within the distance if one lies at most floor(distance / 2) and the other at most
    ceil(distance / 2) flips from the same point. A point has no more fingerprints than its ball, so no group is large.
    """
    if probes is None:
        sample = [r.fp for r in prints.orderBy(F.xxhash64("fp"), "fp").limit(PLAN_ROWS).collect()]
        probes = plan_probes(np.array(sample, np.int64).view(np.uint64), prints.count(), distance)
    own = _keys(prints, probes, False)
    around = _keys(prints, probes, True) if any(t for _, t in probes) else own
    sizes = around.groupBy("part", "key").count()
    large = sizes.where(F.col("count") > bucket_rows).select("part", "key")
    crowded = staged(around.join(large, ["part", "key"], "left_semi").select("fp").distinct(), "crowded")
    few = sizes.where((F.col("count") > 1) & (F.col("count") <= bucket_rows)).select("part", "key")
    index = own.join(few, ["part", "key"], "left_semi")
    probe = around.join(few, ["part", "key"], "left_semi") if around is not own else index
    a, b = probe.withColumnRenamed("fp", "a"), index.withColumnRenamed("fp", "b")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    both_ways = F.col("a") != F.col("b") if around is not own else F.col("a") > F.col("b")
    pairs = a.join(b, ["part", "key"]).where(both_ways & near).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    ball = _ball((1 << BITS) - 1, (distance + 1) // 2)
    point = F.explode(F.arrays_zip(_longs([x for x, _ in ball]).alias("flips"), F.array(*[F.lit(r) for _, r in ball]).alias("radius"))).alias("p")
    points = crowded.select("fp", point).select("fp", F.col("fp").bitwiseXOR(F.col("p.flips")).alias("at"), (F.col("p.radius") <= distance // 2).alias("inner"))
    hubs = points.groupBy("at").agg(F.min(F.when(F.col("inner"), F.col("fp"))).alias("hub"), F.count(F.lit(1)).alias("n")).where("hub IS NOT NULL AND n > 1")
    stars = points.join(hubs, "at").where("fp != hub").select(F.greatest("fp", "hub").alias("a"), F.least("fp", "hub").alias("b"))
    return pairs.union(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of edges (a, b), a > b: the smallest node that each can reach.

    Large and small stars in turn, until nothing changes. A round is staged in the shared folder; degrees are combined by
    map tasks, and the joins can be split, so a node with very many edges is no large group.
    """
    edges, before = staged(edges, "edges"), None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = staged(large.where("a > b").distinct(), "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        linked = large.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = staged(linked.union(least.select("a", F.col("m").alias("b"))).distinct(), "small")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = now


def simhash_components(docs: DataFrame, shingle: int = 3, distance: int = 2, doc_id: str = "doc_id", text: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """A row (doc_id, row_key, fingerprint, component_id) for each row of docs.

    fingerprint: 16 hexadecimal digits. component_id: the smallest doc_id that links of up to `distance` differing bits
    reach, null if all ids there are null. row_key: a hash of doc_id and text, the same for equal rows. Texts without words
    have fingerprint zero and are linked like others. Repeated rows stay repeated. Other columns of docs are not looked at.
    """
    key = F.md5(F.concat_ws("|", F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")), F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")))))
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), key.alias("row_key"), F.col(f"`{text}`").alias("text"))
    rows = staged(with_fingerprint(rows, "fp", "text", shingle).drop("text"), "fingerprints")
    prints = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "prints")
    groups = components(similar_prints(prints.select("fp"), distance, bucket_rows))
    classed = prints.join(groups, prints.fp == groups.node, "left").select("fp", "least_id", F.coalesce("component", "fp").alias("component"))
    least = classed.groupBy("component").agg(F.min("least_id").alias("component_id"))
    classed = classed.join(least, "component").select("fp", "component_id", F.col("component"))
    return rows.join(classed, "fp").select("doc_id", "row_key", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", F.col("component").alias("class_print"))


def drop_near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of docs for each component: the one with the smallest doc_id (null last), then the smallest row_key."""
    classes = simhash_components(docs, shingle, distance, doc_id, text)
    first = classes.groupBy("class_print").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("first"))
    name = fresh(docs, "__row_key")
    key = F.md5(F.concat_ws("|", F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")), F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")))))
    kept = first.select(F.col("first.row_key").alias(name)).distinct()
    return docs.withColumn(name, key).join(kept, name, "left_semi").dropDuplicates([name]).drop(name)
