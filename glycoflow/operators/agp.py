"""Ambulatory glucose profile: percentiles by local time of day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.sequences import smooth_circular
from ..functions.time import local, minute_of_day

PERCENTILES = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}


def profile(cgm: DataFrame, tz: str, bucket_minutes: int = 15, smooth: int = 3) -> DataFrame:
    """minute, n and exact percentiles of each bucket with readings; smoothed around the clock, widths made odd."""
    rows = cgm.select((F.floor(minute_of_day(local("timestamp", tz)) / bucket_minutes) * bucket_minutes).cast("int").alias("minute"), F.col("bg_mgdl").cast("double").alias("bg"))
    made = rows.groupBy("minute").agg(F.count("bg").alias("n"), F.percentile("bg", F.array(*map(F.lit, PERCENTILES.values()))).alias("p")).where("n > 0")
    made = made.select("minute", "n", *(F.col("p")[i].alias(k) for i, k in enumerate(PERCENTILES)))
    half = (smooth + (smooth % 2 == 0)) // 2 if smooth > 1 else 0
    if not half:
        return made
    # At most 1440 buckets: one small array holds the whole clock.
    clock = made.agg(F.array_sort(F.collect_list(F.struct("minute", "n", *PERCENTILES))).alias("b"))
    sides = clock.select("b", *(F.col(f"b.{k}").alias(k) for k in PERCENTILES))
    smoothed = sides.select("b", *(smooth_circular(k, half).alias(k) for k in PERCENTILES))
    return smoothed.select(F.inline(F.arrays_zip(F.col("b.minute").alias("minute"), F.col("b.n").alias("n"), *PERCENTILES)))


def hourly(cgm: DataFrame, tz: str) -> DataFrame:
    """All 24 local hours; percentiles are null and n is 0 where there are no readings."""
    spark: SparkSession = cgm.sparkSession
    hours = spark.range(24).select(F.col("id").cast("int").alias("hour"))
    made = cgm.groupBy(F.hour(local("timestamp", tz)).alias("hour")).agg(F.count("bg_mgdl").alias("n"), F.percentile(F.col("bg_mgdl").cast("double"), F.array(*map(F.lit, PERCENTILES.values()))).alias("p"))
    return hours.join(made, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).cast("long").alias("n"), *(F.col("p")[i].alias(k) for i, k in enumerate(PERCENTILES)))
