"""Detectors over glucose series: anchored windows, fast rises, thinning, scoring, threshold crossings, flat lines, meal runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Anomaly, Calibration, MealRise, MealRun
from ..functions.sequences import theil_sen
from ..functions.time import iso_minute, local
from ..schema import CORRECTIONS, FOOD_CARRYING
from ..shipping import stored
from .joins import best_matches, range_join, with_halo
from .sequences import thin

#: Seconds of one halo chunk: what one task needs of a series to judge its anchors.
CHUNK = 7 * 86400
#: Rows of one chunk where thinning goes by row numbers.
ROWS = 8192


def anchored_windows(cgm: DataFrame, c: MealRise, chunk: int = CHUNK) -> DataFrame:
    """Each reading with the samples of [t - window, t], both ends included, and their coverage.

    A week of a pump is one partition; rows near its end also go to the next week, so long series spread over tasks.
    """
    pre = c.window_minutes * 60
    rows = with_halo(cgm.withColumn("t", F.unix_seconds("timestamp")), "t", chunk, pre)
    w = Window.partitionBy("pump_serial", "chunk").orderBy("t").rangeBetween(-pre, Window.currentRow)
    samples = F.array_sort(F.collect_list(F.struct("t", "seqnum", F.col("bg_mgdl").cast("double").alias("v"))).over(w))
    got = rows.withColumn("samples", samples).where("_own").drop("_own", "chunk")
    n = F.size("samples")
    return got.withColumn("n_samples", n).withColumn("coverage", n / (F.lit(c.window_minutes // c.expected_interval_minutes) + 1))


def flag_gaps(windows: DataFrame, gaps: DataFrame, c: MealRise, ongoing_hours: int = 12) -> DataFrame:
    """has_gap: whether an out-of-range interval touches the window; one without an end counts for so many hours.

    Gap minutes are shared out to hour buckets, so this is an equi-join on pump and hour."""
    pre = c.window_minutes * 60
    spans = gaps.select("pump_serial", F.unix_seconds("start_ts").alias("gs"), F.coalesce(F.unix_seconds("end_ts"), F.unix_seconds("start_ts") + ongoing_hours * 3600).alias("ge"))
    spans = spans.withColumn("h", F.explode(F.sequence(F.floor(F.col("gs") / 3600), F.floor(F.col("ge") / 3600))))
    keyed = windows.select("pump_serial", "seqnum", "t").withColumn("h", F.explode(F.sequence(F.floor((F.col("t") - pre) / 3600), F.floor(F.col("t") / 3600))))
    hit = keyed.join(spans, ["pump_serial", "h"]).where((F.col("gs") <= F.col("t")) & (F.col("ge") >= F.col("t") - pre)).select("pump_serial", "seqnum").distinct().withColumn("has_gap", F.lit(True))
    return windows.join(hit, ["pump_serial", "seqnum"], "left").fillna({"has_gap": False})


def hour_multiplier(hour: Column, c: MealRise) -> Column:
    out = F.lit(float(c.off_hours_multiplier))
    for a, b, m in reversed(c.meal_windows):
        out = F.when((hour >= a) & (hour <= b), F.lit(float(m))).otherwise(out)
    return out


def rise_slopes(cgm: DataFrame, c: MealRise, tz: str, gaps: DataFrame | None = None) -> DataFrame:
    """Everything a fast-rise decision needs but the base slope, for each anchor that passes the guards."""
    rows = anchored_windows(cgm, c)
    if gaps is not None:
        rows = flag_gaps(rows, gaps, c).where("not has_gap")
    rows = rows.where((F.col("n_samples") >= c.min_samples) & (F.col("coverage") >= c.min_coverage))
    rows = rows.withColumn("start_level", F.element_at("samples", 1)["v"].cast("int")).withColumn("end_level", F.element_at("samples", -1)["v"].cast("int"))
    rows = rows.where(F.col("start_level").between(c.start_level_min, c.start_level_max))
    hour = F.hour(local("timestamp", tz))
    return rows.withColumn("slope", theil_sen("samples")).where("slope is not null").select(
        "pump_serial", "seqnum", F.col("timestamp").alias("anchor_ts"), "t", (F.col("timestamp") - F.expr(f"interval {c.window_minutes} minutes")).alias("rise_start_ts"), "n_samples", "coverage",
        "start_level", "end_level", (F.col("end_level") - F.col("start_level")).alias("delta"), "slope", hour.alias("hour_of_day"), hour_multiplier(hour, c).alias("multiplier"),
        F.transform("samples", lambda s: s["v"].cast("int")).alias("glucose_values"),
    )


def meal_rises(cgm: DataFrame, c: MealRise, tz: str, gaps: DataFrame | None = None) -> DataFrame:
    return rise_slopes(cgm, c, tz, gaps).where(F.col("slope") >= c.base_slope_mgdl_per_min * F.col("multiplier"))


def instances(detections: DataFrame, c: MealRise) -> DataFrame:
    """Detections at least the refractory time apart."""
    return thin(detections, "pump_serial", "t", c.refractory_minutes * 60)


def score(detections: DataFrame, requests: DataFrame, c: Calibration, tz: str, keep: list[str] | None = None) -> DataFrame:
    """Labels each detection by the nearest food bolus around the rise's start; what is uncovered by its first correction."""
    d = detections.withColumn("rise_t", F.unix_seconds("rise_start_ts"))
    r = requests.select("pump_serial", "bolus_id", F.unix_seconds("timestamp").alias("bt"), "bolus_category", "carbs_g")
    bt, gap = F.col("_r_bt"), F.col("_r_bt") - F.col("_t")
    pre, late, fix = c.pre_bolus_lookback_minutes * 60, c.late_bolus_lookahead_minutes * 60, c.correction_lookahead_minutes * 60
    is_food = F.col("_r_bolus_category").isin(FOOD_CARRYING) & (gap >= -pre) & (gap <= late)
    is_fix = F.col("_r_bolus_category").isin(CORRECTIONS) & (gap >= 0) & (gap <= fix)
    take = {
        "_food": (is_food, F.struct(F.abs(gap), bt, F.col("_r_bolus_id")), F.struct(bt.alias("t"), F.col("_r_bolus_category").alias("category"), F.col("_r_carbs_g").alias("carbs"))),
        "_fix": (is_fix, F.struct(bt, F.col("_r_bolus_id")), F.struct(bt.alias("t"), F.col("_r_bolus_category").alias("category"))),
    }
    d = best_matches(d, r.where(F.col("bolus_category").isin([*FOOD_CARRYING, *CORRECTIONS])), "pump_serial", ["seqnum"], "rise_t", "bt", pre, max(late, fix), take)
    d = d.select("*", F.col("_food.t").alias("food_t"), F.col("_food.category").alias("matched_bolus_category"), F.col("_food.carbs").alias("matched_bolus_carbs"), F.col("_fix.t").alias("fix_t"), F.col("_fix.category").alias("fix"))
    covered = F.col("food_t").isNotNull()
    label = F.when(~covered, "uncovered").when(F.col("food_t") < F.col("rise_t"), "pre_bolused").otherwise("late_bolused")
    resolution = F.when(~covered, F.when(F.col("fix") == "auto_correction", "auto_correction").when(F.col("fix").isNotNull(), "user_correction").otherwise("none"))
    return d.select(
        F.concat(F.lit("meal_rise:"), iso_minute(F.col("anchor_ts"), tz)).alias("event_ref"), "pump_serial", "seqnum", "anchor_ts", "rise_start_ts", "start_level", "end_level", "delta", "slope", "hour_of_day", label.alias("label"),
        "matched_bolus_category", "matched_bolus_carbs", F.when(covered, (F.col("food_t") - F.col("rise_t")) / 60).alias("bolus_delay_min"), resolution.alias("resolution"),
        F.when(~covered, (F.col("fix_t") - F.col("rise_t")) / 60).alias("resolution_delay_min"), *(keep or []),
    )


def slope_sweep(slopes: DataFrame, values: list[float], c: MealRise, requests: DataFrame | None = None, calibration: Calibration | None = None, tz: str | None = None) -> DataFrame:
    """Firings and instances for each base slope; with requests, also how many instances get each label.

    Windows and slopes are computed once for all base slopes, and all instances are scored in one join.  What fires at
    the lowest base slope is stored, without its samples: counts and thinning both read it.
    """
    slopes = stored(slopes.where(F.col("slope") >= min(values) * F.col("multiplier")).drop("glucose_values"), "fired")
    swept = slopes.withColumn("base", F.explode(F.array(*map(F.lit, values)))).where(F.col("slope") >= F.col("base") * F.col("multiplier"))
    keyed = swept.withColumn("series", F.concat_ws("|", F.col("base").cast("string"), "pump_serial"))
    kept = thin(keyed, "series", "t", c.refractory_minutes * 60)
    fired = swept.groupBy("base").agg(F.count(F.lit(1)).alias("firings"))
    if requests is None:
        return fired.join(kept.groupBy("base").agg(F.count(F.lit(1)).alias("instances")), "base")
    # The same anchor may stand for several base slopes: it is scored once.
    bases = kept.groupBy("pump_serial", "seqnum").agg(F.collect_list("base").alias("bases"), F.first(F.struct(*(x for x in slopes.columns if x not in ("pump_serial", "seqnum")))).alias("_row"))
    labels = score(bases.select("pump_serial", "seqnum", "_row.*", "bases"), requests, calibration, tz, keep=["bases"]).withColumn("base", F.explode("bases"))
    n = F.count(F.lit(1))
    counts = labels.groupBy("base").agg(n.alias("instances"), *(F.count_if(F.col("label") == x).alias(x) for x in ("pre_bolused", "late_bolused", "uncovered")))
    return fired.join(counts, "base").withColumn("uncovered_rate", F.col("uncovered") / F.col("instances"))


def crossings(cgm: DataFrame, a: Anomaly) -> DataFrame:
    """Readings that cross the high threshold upwards or the low one downwards."""
    w = Window.partitionBy("pump_serial").orderBy("timestamp", "seqnum")
    rows = cgm.withColumn("bg", F.col("bg_mgdl").cast("double")).withColumn("before", F.lag("bg").over(w)).withColumn("minutes", (F.unix_seconds("timestamp") - F.unix_seconds(F.lag("timestamp").over(w))) / 60)
    spike = (F.col("bg") > a.spike_threshold) & (F.col("before") <= a.spike_threshold)
    drop = (F.col("bg") < a.drop_threshold) & (F.col("before") >= a.drop_threshold)
    sure = F.when(spike, (F.col("bg") - a.spike_threshold) / a.spike_threshold).otherwise((a.drop_threshold - F.col("bg")) / a.drop_threshold)
    return rows.where((F.col("minutes") > 0) & (spike | drop)).select("pump_serial", "seqnum", "timestamp", F.when(spike, "spike").otherwise("drop").alias("anomaly_type"), F.col("bg_mgdl").alias("bg_at_event"), ((F.col("bg") - F.col("before")) / F.col("minutes")).alias("rate_mgdl_per_min"), F.least(F.lit(1.0), sure).alias("confidence"), F.col("backfilled").alias("is_backfilled_context"))


def flatlines(cgm: DataFrame, a: Anomaly, max_gap_minutes: float = 7.0) -> DataFrame:
    """Runs of readings with little variance and no long gap, each reading in one run at most."""
    k, w = a.flatline_consecutive_intervals, Window.partitionBy("pump_serial").orderBy("timestamp", "seqnum")
    inside = w.rowsBetween(-(k - 1), 0)
    rows = cgm.withColumn("bg", F.col("bg_mgdl").cast("double")).withColumn("row", F.row_number().over(w).cast("long")).withColumn("gap", (F.unix_seconds("timestamp") - F.unix_seconds(F.lag("timestamp").over(w))) / 60)
    rows = rows.withColumn("var", F.when(F.count("bg").over(inside) == k, F.var_samp("bg").over(inside))).withColumn("longest", F.max("gap").over(w.rowsBetween(-(k - 2), 0)))
    hits = rows.where((F.col("var") < a.flatline_tolerance) & (F.col("longest") <= max_gap_minutes))
    return thin(hits, "pump_serial", "row", k, max(1, ROWS // k)).select("pump_serial", "seqnum", "timestamp", F.lit("flatline").alias("anomaly_type"), F.col("bg_mgdl").alias("bg_at_event"), F.lit(0.0).alias("rate_mgdl_per_min"), F.greatest(F.lit(0.0), 1 - F.col("var") / a.flatline_tolerance).alias("confidence"), F.col("backfilled").alias("is_backfilled_context"))


def meal_runs(cgm: DataFrame, requests: DataFrame, m: MealRun, high: float, min_gap: float = 4.0, max_gap: float = 7.0, tz: str | None = None) -> DataFrame:
    """Sustained rises that no food bolus just before explains; suppressed runs use up their readings too."""
    s, w = m.sustained_intervals, Window.partitionBy("pump_serial").orderBy("timestamp", "seqnum")
    rows = cgm.withColumn("bg", F.col("bg_mgdl").cast("double")).withColumn("t", F.unix_seconds("timestamp")).withColumn("row", F.row_number().over(w).cast("long"))
    rows = rows.withColumn("before", F.lag("bg").over(w)).withColumn("gap", (F.col("t") - F.lag("t").over(w)) / 60).withColumn("rise", F.col("bg") - F.col("before"))
    ok = F.coalesce(F.col("gap").between(min_gap, max_gap) & (F.col("rise") >= m.rise_threshold_per_5min), F.lit(False))
    ahead = w.rowsBetween(0, s - 1)
    rows = rows.withColumn("_ok", ok.cast("int")).withColumn("_run", F.sum("_ok").over(ahead)).withColumn("rate", F.avg("rise").over(ahead))
    runs = thin(rows.where(F.col("_run") == s), "pump_serial", "row", s, max(1, ROWS // s))
    # Food boluses before and readings after a run come from one side of one join; the runs themselves are read once.
    food = requests.where(F.col("bolus_category").isin(FOOD_CARRYING)).select("pump_serial", F.unix_seconds("timestamp").alias("pt"), F.lit(None).cast("int").alias("pbg"))
    later = cgm.select("pump_serial", F.unix_seconds("timestamp").alias("pt"), F.col("bg_mgdl").alias("pbg"))
    gap, peak = F.col("_r_pt") - F.col("_t"), F.col("_r_pbg")
    before = m.no_bolus_window_minutes * 60
    take = {"_taken": (F.col("_r_food") & (gap >= -before) & (gap <= 0), gap, F.lit(True)), "bg_peak": (~F.col("_r_food") & (gap >= 0), -peak, peak)}
    side = food.withColumn("food", F.lit(True)).unionByName(later.withColumn("food", F.lit(False)))
    free = best_matches(runs, side, "pump_serial", ["row"], "t", "pt", before, 7200, take).where("_taken is null")
    hour = F.hour(local("timestamp", tz) if tz else F.col("timestamp"))
    label = F.lit("off_window")
    for i, (a, b) in reversed(list(enumerate(m.meal_windows))):
        label = F.when((hour >= a) & (hour < b), f"window_{i}").otherwise(label)
    sure = F.least(F.lit(1.0), F.col("rate") / (2 * m.rise_threshold_per_5min)) + F.when(label != "off_window", 0.1).otherwise(0.0) + F.when(F.col("bg_peak") > high, 0.1).otherwise(0.0)
    return free.select("pump_serial", "seqnum", "timestamp", F.col("before").cast("int").alias("bg_start"), "bg_peak", F.col("rate").alias("rise_rate_per_5min"), label.alias("meal_window"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure)).alias("confidence"))
