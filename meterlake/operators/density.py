"""The densest time window per group, exactly and without a task per group.

A group may hold a third of all events, so no task gets all events of a group.
Time is cut into slots, sixty to a window. Counts per slot bound how full a window
ending in a slot can be, and only slots whose bound reaches the fullest window
already certain are looked at event by event. One such look needs the events of
two slots and nothing else, because the slots between count whole:

    slot:   i-60      i-59 ... i-1       i
            [..####]  [##########]   [###..]
               ^ at or after t-W        ^ up to t
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterlake.staging import stage

SLOTS = 60
MICROS_PER_MINUTE = 60_000_000
# Events that one look at a candidate may take, and parts of one cut.
LOOK_ROWS, PARTS = 200_000, 1_000


def slot_counts(events: DataFrame, key: str, minutes: int, *sums) -> DataFrame:
    """Events per ``key`` and slot, with further ``sums`` over the slot."""
    slot = F.floor(F.unix_micros("ts") / F.lit(minutes * MICROS_PER_MINUTE // SLOTS))
    return events.groupBy(key, slot.alias("slot")).agg(F.count(F.lit(1)).alias("calls"), *sums)


def candidate_slots(slots: DataFrame, key: str, min_calls: int) -> DataFrame:
    """Slots in which a fullest window of at least ``min_calls`` can end.

    ``between`` is the count of the whole slots inside such a window, ``at_ends`` that
    of the two slots which the window cuts.
    """
    ordered = Window.partitionBy(key).orderBy("slot")
    in_key = Window.partitionBy(key)
    bounds = slots.select(
        key,
        "slot",
        F.sum("calls").over(ordered.rangeBetween(-SLOTS, 0)).alias("at_most"),
        F.sum("calls").over(ordered.rangeBetween(1 - SLOTS, 0)).alias("at_least"),
        F.coalesce(F.sum("calls").over(ordered.rangeBetween(1 - SLOTS, -1)), F.lit(0)).alias("between"),
    ).withColumn("certain", F.greatest(F.max("at_least").over(in_key), F.lit(min_calls)))
    return bounds.where("at_most >= certain").select(
        key, "slot", "between", (F.col("at_most") - F.col("between")).alias("at_ends")
    )


def _part_counts(events: DataFrame, ends: DataFrame, key: str, window: int, width: int, part: int) -> DataFrame:
    """Events in each part of the slots that a window ending in one of ``ends`` cuts.

    A part is counted by its place in the slot: in the slot where the window ends as
    ``end_calls``, in the one where it starts as ``start_calls``. Map tasks count
    first, so a part is one row of each, however many events it has.
    """
    looks = ends.select(
        key,
        F.col("slot").alias("end_slot"),
        "between",
        F.inline(
            F.array(
                F.struct(F.col("slot").alias("slot"), F.lit(True).alias("is_end")),
                F.struct((F.col("slot") - window // width).alias("slot"), F.lit(False).alias("is_end")),
            )
        ),
    )
    micros = F.unix_micros("ts")
    placed = events.select(
        key,
        F.floor(micros / F.lit(width)).alias("slot"),
        F.floor(F.pmod(micros, F.lit(width)) / F.lit(part)).alias("part"),
    )
    return (
        placed.join(looks, [key, "slot"])
        .groupBy(key, "end_slot", "part")
        .agg(
            F.count_if("is_end").alias("end_calls"),
            F.count_if(~F.col("is_end")).alias("start_calls"),
            F.first("between").alias("between"),
        )
    )


def _part_bounds(parts: DataFrame, key: str) -> DataFrame:
    """Bounds of the windows that end in a part; equal if a part is one instant."""
    in_slot = Window.partitionBy(key, "end_slot")
    up_to = in_slot.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # What starts here or later, as a difference: a frame up to the last row is summed anew for each row.
    starts = F.sum("start_calls").over(in_slot) - F.sum("start_calls").over(up_to) + F.col("start_calls")
    at_most = F.sum("end_calls").over(up_to) + starts + F.col("between")
    return parts.withColumn("at_most", at_most).where("end_calls > 0")


def _cut(events: DataFrame, ends: DataFrame, key: str, window: int, width: int, part: int, min_calls: int) -> DataFrame:
    """Candidates of width ``part`` inside those of width ``width``."""
    bounds = stage(_part_bounds(_part_counts(events, ends, key, window, width, part), key), "slot-parts")
    # The window that ends with the part's last event has all but the events at its start for certain.
    certain = bounds.groupBy(key).agg(
        F.greatest(F.max(F.col("at_most") - F.col("start_calls")), F.lit(min_calls)).alias("certain")
    )
    at_ends = F.col("end_calls") + F.col("start_calls")
    return stage(
        bounds.join(certain, key)
        .where("at_most >= certain")
        .select(
            key,
            (F.col("end_slot") * F.lit(width // part) + F.col("part")).alias("slot"),
            (F.col("at_most") - at_ends).alias("between"),
            at_ends.alias("at_ends"),
        ),
        "slot-ends",
    )


def densest_window(
    events: DataFrame,
    key: str,
    minutes: int,
    min_calls: int = 1,
    slots: DataFrame | None = None,
    look_rows: int = LOOK_ROWS,
) -> DataFrame:
    """``(key, max_in_window)``: most events in any ``minutes`` ending at an event.

    Both ends of a window count. Groups whose fullest window is below
    ``min_calls`` are left out. ``slots`` may pass slot counts already staged;
    they are staged because their true size then tells Spark whether to broadcast
    the candidates, which spares the events a shuffle. A candidate with more than
    ``look_rows`` events is cut first, which changes the work and not the result.
    """
    window = minutes * MICROS_PER_MINUTE
    width = window // SLOTS
    slots = stage(slot_counts(events, key, minutes), "slots") if slots is None else slots
    ends = candidate_slots(slots, key, min_calls)
    while width > 1 and (ends.agg(F.max("at_ends")).first()[0] or 0) > look_rows:
        # Widths are a million, a thousand and one times the minutes, so that parts fill a slot evenly.
        part = width // PARTS if width % PARTS == 0 else 1
        ends, width = _cut(events, ends, key, window, width, part, min_calls), part
    # Equal instants are one row of the parts.
    return (
        _part_bounds(_part_counts(events, ends, key, window, width, 1), key)
        .groupBy(key)
        .agg(F.max("at_most").alias("max_in_window"))
        .where(F.col("max_in_window") >= min_calls)
    )
