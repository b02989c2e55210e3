"""Daily features: all local days of all pumps in one pass over each table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.time import local_date, midnight, minutes_between
from ..schema import FOOD_CARRYING
from .joins import range_join


def exact_sum(amount: Column) -> Column:
    """A sum of units that doesn't depend on the order of rows: millionths are added as decimals."""
    return F.sum(amount.cast("decimal(20,6)")).cast("double")


def basal_units(basal: DataFrame, tz: str, approximate: bool = False, by: tuple[str, ...] = ("pump_serial", "day")) -> DataFrame:
    """Units by pump and local day: each rate holds until the next row of that day, the last until midnight.

    approximate: every row counts as five minutes.  Rates are whole thousandths of a unit an hour, as the pump reports
    them, and are added up as integers, so that results don't depend on the order of rows.
    """
    rows = basal.select("*", local_date("timestamp", tz).alias("day"), F.round(F.col("commanded_rate") * 1000).cast("long").alias("_milli"))
    if approximate:
        return rows.groupBy(*by).agg((F.sum("_milli") * 5 / 60000.0).alias("basal_units"))
    until = F.lead("timestamp").over(Window.partitionBy("pump_serial", "day").orderBy("timestamp", "seqnum" if "seqnum" in basal.columns else "timestamp"))
    micros = F.unix_micros(F.coalesce(until, midnight(F.date_add("day", 1), tz))) - F.unix_micros("timestamp")
    dose = (F.col("_milli") * F.greatest(micros, F.lit(0))).cast("decimal(20,0)")
    return rows.withColumn("_dose", dose).groupBy(*by).agg((F.sum("_dose").cast("double") / 3.6e12).alias("basal_units"))


def overlap_minutes(intervals: DataFrame, start: str, end: str, tz: str, last_day: str, name: str) -> DataFrame:
    """Minutes of each local day that intervals cover; one without an end lasts to the end of the last day."""
    until = F.coalesce(F.col(end), midnight(F.date_add(F.lit(last_day).cast("date"), 1), tz))
    rows = intervals.select("pump_serial", F.col(start).alias("_s"), until.alias("_e")).where("_e >= _s")
    days = rows.withColumn("day", F.explode(F.sequence(local_date("_s", tz), local_date("_e", tz))))
    part = minutes_between(F.greatest(F.col("_s"), midnight("day", tz)), F.least(F.col("_e"), midnight(F.date_add("day", 1), tz)))
    return days.groupBy("pump_serial", "day").agg(F.sum(F.greatest(part, F.lit(0.0))).alias(name))


def postprandial_peak(cgm: DataFrame, requests: DataFrame, tz: str, before: int = 600, after: int = 7200) -> DataFrame:
    """Mean rise from the last reading up to ten minutes before a meal to the highest in two hours from it, within the day."""
    meals = requests.where(F.col("bolus_category").isin(FOOD_CARRYING)).select("pump_serial", "bolus_id", F.unix_seconds("timestamp").alias("meal_t"), local_date("timestamp", tz).alias("day"))
    readings = cgm.select("pump_serial", F.unix_seconds("timestamp").alias("t"), "seqnum", F.col("bg_mgdl").cast("double").alias("bg"), local_date("timestamp", tz).alias("bg_day"))
    near = range_join(meals, readings, "pump_serial", "meal_t", "t", before, after).where("bg_day = day")
    each = near.groupBy("pump_serial", "day", "bolus_id").agg(
        F.max_by(F.when(F.col("t") <= F.col("meal_t"), F.col("bg")), F.when(F.col("t") <= F.col("meal_t"), F.struct("t", "seqnum"))).alias("anchor"),
        F.max(F.when(F.col("t") >= F.col("meal_t"), F.col("bg"))).alias("peak"),
    )
    return each.where("anchor is not null and peak is not null").groupBy("pump_serial", "day").agg(F.avg(F.col("peak") - F.col("anchor")).alias("postprandial_peak"))


def daily_features(frames: dict[str, DataFrame], config: Config, last_day: str) -> DataFrame:
    """One row for each pump and local day with readings."""
    tz, t = config.timezone, config.bg_targets
    cgm, bg = frames["cgm"].withColumn("day", local_date("timestamp", tz)), F.col("bg_mgdl").cast("double")
    share = lambda c: F.try_divide(F.count_if(c).cast("double"), F.count(bg))
    offset = (F.unix_seconds("timestamp") - F.unix_seconds(midnight("day", tz))) / 3600
    span = lambda a, b: F.avg(F.when((offset >= a) & (offset < b), bg))
    day = cgm.groupBy("pump_serial", "day").agg(
        F.avg(bg).alias("mean_bg"), F.stddev_pop(bg).alias("sd_bg"), F.try_divide(F.stddev_pop(bg), F.avg(bg)).alias("cv"), share((bg >= t.low) & (bg <= t.high)).alias("tir"),
        share(bg < t.low).alias("below"), share((bg > t.high) & (bg <= 250)).alias("above"), share(bg > 250).alias("severe"), F.count(bg).alias("n_readings"), (span(4, 6) - span(0, 2)).alias("overnight_dip"),
    )
    by = ["pump_serial", "day"]
    bolus = frames["bolus"].groupBy("pump_serial", local_date("timestamp", tz).alias("day")).agg(exact_sum(F.col("insulin_units")).alias("bolus_units"))
    food = F.col("bolus_category").isin(FOOD_CARRYING)
    meals = frames["requests"].groupBy("pump_serial", local_date("timestamp", tz).alias("day")).agg(F.count_if(food).alias("meal_count"), F.coalesce(F.sum(F.when(food, F.col("carbs_g"))), F.lit(0)).cast("long").alias("carbs_g"))
    alarms = frames["alarms"].groupBy("pump_serial", local_date("timestamp", tz).alias("day")).agg(F.count_if(F.col("action") == "activated").alias("alarm_count"))
    sides = [
        bolus, basal_units(frames["basal"], tz), meals, alarms, postprandial_peak(frames["cgm"], frames["requests"], tz),
        overlap_minutes(frames["suspension"], "suspend_timestamp", "resume_timestamp", tz, last_day, "suspension_minutes"), overlap_minutes(frames["cgm_gaps"], "start_ts", "end_ts", tz, last_day, "out_of_range_minutes"),
    ]
    # Every side has one row a pump and day and columns of its own: put side by side by one grouping, not by seven joins.
    both = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [day, *sides])
    day = both.groupBy(*by).agg(*(F.max(c).alias(c) for c in both.columns if c not in by)).where("n_readings is not null")
    zero = {c: 0.0 for c in ("bolus_units", "basal_units", "suspension_minutes", "out_of_range_minutes")} | {c: 0 for c in ("meal_count", "carbs_g", "alarm_count")}
    day = day.fillna(zero)
    return day.withColumn("tdi", F.col("bolus_units") + F.col("basal_units")).withColumn("basal_bolus_ratio", F.try_divide("basal_units", F.nullif("bolus_units", F.lit(0.0))))
