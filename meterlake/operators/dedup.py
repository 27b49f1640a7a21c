"""One row per key, and rows whose key is not stored yet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.staging import broadcast_if_small


def first_per_key(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The first row per ``key`` by ``order``; ties go to the least remaining columns.

    A minimum over whole rows is combined before the shuffle, so a key that holds
    a third of all rows leaves each map task as a single row. A window would send
    all of them to one task.
    """
    rest = [c for c in rows.columns if c != key and c not in order]
    first = F.min(F.struct(*order, *rest))
    return rows.groupBy(key).agg(first.alias("first")).select(
        *[F.col(key) if c == key else F.col(f"first.{c}").alias(c) for c in rows.columns]
    )


def stored_keys(keys: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """The values of ``key`` in ``keys`` that occur in ``stored``.

    The semi join has the new keys on its small side: Spark can broadcast them
    or filter the stored table by them before its shuffle. A plain anti join
    would have to move every stored key, as only its stored side may be broadcast.
    A key stored many times is one row of the result, combined by map tasks.
    """
    return stored.select(key).join(broadcast_if_small(keys.select(key)), key, "left_semi").distinct()


def not_stored(rows: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` does not occur in ``stored``."""
    return rows.join(stored_keys(rows, stored, key), key, "left_anti")


def on_days_of(stored: DataFrame, rows: DataFrame, day: str) -> DataFrame:
    """Stored rows of the days that occur in ``rows``.

    There are at most as many days as the calendar has, so they are broadcast,
    and Spark leaves the partitions of other days out of the scan.
    """
    return stored.join(F.broadcast(rows.select(day).distinct()), day, "left_semi")
