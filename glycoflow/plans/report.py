"""The full glucose report: one row for each group of readings."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics as m
from ..functions.time import between, expected_readings, local, second_of_day
from ..operators.variability import mage_of, swings

MIN_DAYS, MIN_ACTIVE = 14, 70.0


def cgm_report(cgm: DataFrame, since: datetime, until: datetime, tz: str, group: str | None = "pump_serial", low: float = 70, high: float = 180) -> DataFrame:
    """Bands, central tendency, glycation, risk, variability and sufficiency over [since, until).

    GMI, GRI and its components are null unless 14 local days and 70 % of the expected readings are there; LBGI and HBGI
    are null without readings, and so is tir_config, the time in the configured range.

    Two scans: one deals readings by second of the day, where MODD compares consecutive days, and then adds everything
    up; the other deals them by chunk of time for CONGA and MAGE.  A pooled group's chunks are shorter.
    """
    rows = between(cgm, "timestamp", since, until)
    rows = rows.withColumn("grp", F.col(group) if group else F.lit("all")).withColumn("bg_mgdl", m.valid_bg())
    bg, bands = m.bg_column(), m.time_in_bands()
    expected, wall = expected_readings(since, until), local("timestamp", tz)
    same_second = Window.partitionBy("grp", "_second").orderBy("_day", "seqnum").rowsBetween(Window.unboundedPreceding, -1)
    dealt = rows.withColumns({"_second": second_of_day(wall), "_day": F.to_date(wall)}).withColumn("_diff", F.abs(bg - F.last(bg, ignorenulls=True).over(same_second)))
    one = dealt.groupBy("grp").agg(
        F.count("bg_mgdl").alias("n_readings"), F.count(F.lit(1)).alias("n_rows"), F.size(F.collect_set(F.when(bg.isNotNull(), F.col("_day")))).cast("long").alias("n_days"), F.avg("_diff").alias("modd"),
        *(c.alias(k) for k, c in bands.items()), m.time_in_range(bg, low, high, None).alias("tir_config"), F.avg(bg).alias("mean_bg"), F.median(bg).alias("median_bg"), F.stddev_samp(bg).alias("sd_bg"), m.lbgi().alias("lbgi"), m.hbgi().alias("hbgi"),
        F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"),
    )
    active = 100.0 * F.col("n_rows") / expected
    enough = (F.col("n_days") >= MIN_DAYS) & (active >= MIN_ACTIVE) & (F.col("n_readings") >= 2)
    some = F.col("n_readings") > 0
    one = one.select(
        "*", F.lit(expected).cast("long").alias("n_expected"), active.alias("active_percent"), ((F.col("n_days") >= MIN_DAYS) & (active >= MIN_ACTIVE)).alias("sufficient"),
        m.cv_percent(F.col("mean_bg"), F.col("sd_bg")).alias("cv_percent"), F.when(enough, m.gmi(F.col("mean_bg"))).alias("gmi"), F.when(some, m.ea1c(F.col("mean_bg"))).alias("ea1c"),
        F.when(enough, m.gri(F.col("tbr_level2"), F.col("tbr_level1"), F.col("tar_level1"), F.col("tar_level2"))).alias("gri"),
        F.when(enough, m.gri_hypo(F.col("tbr_level2"), F.col("tbr_level1"))).alias("gri_hypo"), F.when(enough, m.gri_hyper(F.col("tar_level1"), F.col("tar_level2"))).alias("gri_hyper"), m.j_index(F.col("mean_bg"), F.col("sd_bg")).alias("j_index"),
    )
    one = one.withColumn("cv_stable", F.col("cv_percent") <= 36).withColumn("lbgi", F.when(some, F.col("lbgi"))).withColumn("hbgi", F.when(some, F.col("hbgi")))
    known = rows.where("bg_mgdl is not null")
    got = one.join(swings(known, "grp", 7 * 86400 if group else 6 * 3600), "grp", "left")
    return got.withColumn("modd", F.when(F.col("n_days") >= 2, F.col("modd"))).withColumn("mage", F.when(some, mage_of(F.col("sd_bg"), F.col("n_readings")))).drop("amplitude", "times")
