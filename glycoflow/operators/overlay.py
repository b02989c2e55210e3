"""Intervals laid over readings: the first closing after each opening, cutting to a day, snapping to readings."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import between, local, midnight, minute_of_day, window_bounds


def first_after(rows: DataFrame, opens: Column, closes: Column) -> DataFrame:
    """Opening rows (pump_serial, seqnum, start_ts) with end_ts, the first closing strictly after each; null if none."""
    t = F.col("timestamp")
    w = Window.partitionBy("pump_serial").orderBy("timestamp").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    closed = rows.where(closes).select("pump_serial", t.alias("timestamp"), t.alias("c"), F.lit(-1).cast("long").alias("seqnum"))
    opened = rows.where(opens).select("pump_serial", (t + F.expr("interval 1 microsecond")).alias("timestamp"), F.lit(None).cast("timestamp").alias("c"), "seqnum")
    both = opened.unionByName(closed).withColumn("end_ts", F.min("c").over(w)).where("c is null")
    return both.select("pump_serial", "seqnum", (t - F.expr("interval 1 microsecond")).alias("start_ts"), "end_ts")


def clipped(intervals: DataFrame, start: str, end: str, tz: str, day: date) -> DataFrame:
    """Intervals that touch a local day, cut to it, in minutes from its midnight; one without an end lasts all day."""
    since, until = midnight(F.lit(day), tz), midnight(F.lit(day) + F.expr("interval 1 day"), tz)
    rows = intervals.where((F.col(start) < until) & (F.col(end).isNull() | (F.col(end) >= since)))
    s, e = F.greatest(F.col(start), since), F.least(F.coalesce(F.col(end), until), until)
    minute = lambda x: (F.unix_seconds(x) - F.unix_seconds(since)) / 60
    return rows.select("pump_serial", F.col(start).alias("start_ts"), minute(s).alias("start_minute"), minute(e).alias("end_minute"))


def snapped(intervals: DataFrame, readings: DataFrame, start: str = "start_ts", end: str = "end_ts") -> DataFrame:
    """Adds snap_start, the last reading at or before the start, and snap_end, the first at or after the end.

    Intervals and readings are swept in one order, so no interval meets all readings.
    """
    c = readings.select("pump_serial", F.col("timestamp").alias("_t"), F.col("timestamp").alias("_r"))
    w = Window.partitionBy("pump_serial").orderBy("_t")
    back = intervals.withColumn("_t", F.col(start)).unionByName(c, allowMissingColumns=True)
    back = back.withColumn("snap_start", F.max("_r").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))).where(F.col("_r").isNull()).drop("_t", "_r")
    ahead = back.withColumn("_t", F.col(end)).unionByName(c, allowMissingColumns=True)
    return ahead.withColumn("snap_end", F.min("_r").over(w.rangeBetween(Window.currentRow, Window.unboundedFollowing))).where(F.col("_r").isNull()).drop("_t", "_r")


def day_chart(frames: dict[str, DataFrame], day: date, tz: str) -> DataFrame:
    """All that a day's chart shows, one row each: pump_serial, layer, minute, until_minute, value, backfilled.

    Points: readings, boluses, basal rates, by minute of the local day.  Areas: sensor gaps and site issues, cut to the
    day, then snapped to the day's readings; where there is none before or after, to the first or last.  Areas without
    readings, or of no length, go.  Gaps without an end last to the end of the day, site issues without one for an hour.
    """
    since, until = window_bounds(day, 1, tz)
    lo, hi = F.lit(since).cast("timestamp"), F.lit(until).cast("timestamp")
    on = lambda name: between(frames[name], "timestamp", since, until)
    minute, none = minute_of_day(local("timestamp", tz)).alias("minute"), F.lit(None)
    point = lambda name, layer, value, filled=none: on(name).select("pump_serial", F.lit(layer).alias("layer"), minute, none.cast("int").alias("until_minute"), F.col(value).cast("double").alias("value"), filled.cast("boolean").alias("backfilled"))
    gaps = frames["cgm_gaps"].select("pump_serial", F.lit("gap").alias("layer"), F.col("start_ts").alias("s"), F.coalesce("end_ts", hi).alias("e"))
    issues = frames["site_issues"].select("pump_serial", F.lit("site_issue").alias("layer"), F.col("first_occlusion_ts").alias("s"), F.coalesce("last_occlusion_ts", F.col("first_occlusion_ts") + F.expr("interval 1 hour")).alias("e"))
    areas = gaps.unionByName(issues).select("pump_serial", "layer", F.greatest("s", lo).alias("s"), F.least("e", hi).alias("e")).where("s < e")
    edges = on("cgm").groupBy("pump_serial").agg(F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
    laid = snapped(areas, on("cgm"), "s", "e").join(edges, "pump_serial").select("pump_serial", "layer", F.coalesce("snap_start", "first").alias("x1"), F.coalesce("snap_end", "last").alias("x2")).where("x1 < x2")
    at = lambda c: minute_of_day(local(c, tz))
    shown = laid.select("pump_serial", "layer", at("x1").alias("minute"), at("x2").alias("until_minute"), none.cast("double").alias("value"), none.cast("boolean").alias("backfilled"))
    return point("cgm", "cgm", "bg_mgdl", F.col("backfilled")).unionByName(point("bolus", "bolus", "insulin_units")).unionByName(point("basal", "basal", "commanded_rate")).unionByName(shown)
