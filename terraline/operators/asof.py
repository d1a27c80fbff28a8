"""As-of and exact-minute lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Levels, finest first, and how far before and after a target each one looks, in seconds.
CASCADE = (("1m", 2_700, 60), ("5m", 7_200, 3_600), ("15m", 21_600, 7_200), ("60m", 172_800, 86_400), ("1d", 604_800, 86_400))


def asof(left: DataFrame, right: DataFrame, by: str, ts: str, value: str, earliest: bool = False, out: str = "asof_value", slice_seconds: int = 86_400) -> DataFrame:
    """Adds the last ``value`` at or before each left row's time; with ``earliest``, the key's first value where none is.

    A key's rows are dealt by slices of time, so however many there are they spread over tasks: one union and one window
    that keeps a single row answer what lies in the same slice, and the last value of each slice, a row for a key and slice,
    is carried on to the slices after it. Right rows without a time answer nothing."""
    slot = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(slice_seconds * 1_000_000))
    held = right.where(F.col(ts).isNotNull()).select(by, ts, F.col(value).alias("_value")).withColumn("_slot", slot)
    both = left.withColumns({"_side": F.lit(1), "_value": F.lit(None).cast(right.schema[value].dataType), "_slot": slot}).unionByName(held.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    upto = Window.partitionBy(by, "_slot").orderBy(ts, "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = F.last(F.when(F.col("_side") == 0, F.struct("_value")), ignorenulls=True).over(upto)
    answered = both.withColumn("_found", found).where("_side = 1").drop("_side", "_value")
    ends = held.groupBy(by, "_slot").agg(F.max_by(F.struct("_value"), ts).alias("_end"))
    slots = left.select(by, slot.alias("_slot")).distinct().join(ends, [by, "_slot"], "full")
    before = Window.partitionBy(by).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = slots.select(F.col(by).alias("_by"), F.col("_slot").alias("_s"), F.last("_end", ignorenulls=True).over(before).alias("_carried")).where("_carried is not null")
    answered = answered.join(carried, (F.col(by) == F.col("_by")) & (F.col("_slot") == F.col("_s")), "left").withColumn("_found", F.coalesce("_found", "_carried")).drop("_by", "_s", "_carried")
    if earliest:
        firsts = held.groupBy(F.col(by).alias("_by")).agg(F.min_by(F.struct("_value"), ts).alias("_first"))
        answered = answered.join(firsts, F.col(by) == F.col("_by"), "left").withColumn("_found", F.coalesce("_found", "_first")).drop("_by", "_first")
    return answered.withColumn(out, F.col("_found._value")).drop("_found", "_slot")


def cascade(requests: DataFrame, bars: DataFrame, key: str = "ticker", request_id: str = "request_id") -> DataFrame:
    """(request_id, price, level): at each level the last close at or before the target in the level's range, else the
    range's earliest, so a level with any bar answers; the finest level that answers wins. Requests go to the level's
    time slots of the range's width, so the join has key, level and slot to hash by."""
    parts = []
    for rank, (level, before, after) in enumerate(CASCADE):
        width = before + after
        t = F.unix_timestamp("ts")
        asked = requests.select(request_id, key, F.col("ts").alias("target"), F.explode(F.sequence(F.floor((t - before) / width), F.floor((t + after) / width))).alias("slot"))
        held = bars.where(F.col("interval") == level).select(key, "ts", "close", F.floor(t / width).alias("slot"))
        near = asked.join(held, [key, "slot"]).where((F.col("ts") >= F.col("target") - F.expr(f"interval {before} seconds")) & (F.col("ts") < F.col("target") + F.expr(f"interval {after} seconds")))
        at = F.max_by(F.when(F.col("ts") <= F.col("target"), F.col("close")), F.when(F.col("ts") <= F.col("target"), F.col("ts")))
        parts.append(near.groupBy(request_id).agg(F.coalesce(at, F.min_by("close", "ts")).alias("price")).withColumns({"rank": F.lit(rank), "level": F.lit(level)}))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    best = found.groupBy(request_id).agg(F.min_by(F.struct("price", "level"), "rank").alias("b"))
    return requests.select(request_id).join(best, request_id, "left").select(request_id, "b.price", "b.level")


def exact_minute(requests: DataFrame, bars: DataFrame, key: str, request_id: str) -> DataFrame:
    """(request_id, price, status): the last close within the target's minute, "no bar" without one."""
    minute = bars.groupBy(key, F.date_trunc("minute", "ts").alias("_minute")).agg(F.max_by("close", "ts").alias("price"))
    asked = requests.select(request_id, key, F.date_trunc("minute", "ts").alias("_minute"))
    return asked.join(minute, [key, "_minute"], "left").select(request_id, "price", F.when(F.col("price").isNull(), "no bar").otherwise("ok").alias("status"))
