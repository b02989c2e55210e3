"""Dashboard queries over the domain tables."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics as m
from ..functions.time import day_spine, local, local_date, midnight, minute_of_day, window_bounds, between
from ..operators.features import basal_units, exact_sum
from ..operators.sequences import sessions
from ..schema import FOOD_CARRYING


def trends(cgm: DataFrame, tz: str, low: float = 70, high: float = 180, very_high: float = 250) -> DataFrame:
    """By local day: shares below, in, above and far above range, mean, n."""
    bg = m.bg_column()
    return cgm.groupBy(local_date("timestamp", tz).alias("day")).agg(
        m.percent(bg < low).alias("below_percent"), m.time_in_range(bg, low, high).alias("tir_percent"), m.percent(bg > high).alias("above_percent"), m.percent(bg > very_high).alias("very_high_percent"), F.avg(bg).alias("mean_bg"), F.count(bg).alias("n"),
    )


def tir_windows(cgm: DataFrame, tz: str, end: date, windows: tuple[int, ...] = (7, 14, 30)) -> DataFrame:
    """Time in range over trailing windows of local days: one scan, one row each; null without readings."""
    bg, rows = m.bg_column(), between(cgm, "timestamp", *window_bounds(end, max(windows), tz))
    inside = lambda d: F.when(F.col("timestamp") >= F.lit(window_bounds(end, d, tz)[0]), bg)
    one = rows.agg(*(c for d in windows for c in (m.time_in_range(inside(d), 70, 180, None).alias(f"t{d}"), F.count(inside(d)).alias(f"n{d}"))))
    return one.select(F.inline(F.array(*(F.struct(F.lit(d).alias("days"), F.col(f"t{d}").alias("tir_percent"), F.col(f"n{d}").alias("n")) for d in windows))))


def heatmap(cgm: DataFrame, tz: str) -> DataFrame:
    wall = local("timestamp", tz)
    return cgm.groupBy(F.to_date(wall).alias("day"), F.hour(wall).alias("hour")).agg(F.avg(m.bg_column()).alias("avg_bg"), F.median(m.bg_column()).alias("median_bg"), F.count(m.bg_column()).alias("n"))


def heatmap_pivot(cgm: DataFrame, tz: str, days: list[date]) -> DataFrame:
    """Hours by dates, all 24 hours there: medians, named d_YYYYMMDD, and counts of readings, named n_YYYYMMDD."""
    rows = between(cgm, "timestamp", window_bounds(days[0], 1, tz)[0], window_bounds(days[-1], 1, tz)[1])
    wall = local("timestamp", tz)
    cells = rows.select(F.date_format(wall, "yyyyMMdd").alias("d"), F.hour(wall).alias("hour"), m.bg_column().alias("bg"))
    wide = cells.groupBy("hour").pivot("d", [f"{d:%Y%m%d}" for d in days]).agg(F.median("bg").alias("d"), F.count("bg").alias("n"))
    hours = cgm.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    return hours.join(wide, "hour", "left").select("hour", *(F.col(f"{d:%Y%m%d}_d").alias(f"d_{d:%Y%m%d}") for d in days), *(F.coalesce(f"{d:%Y%m%d}_n", F.lit(0)).alias(f"n_{d:%Y%m%d}") for d in days))


def insulin_daily(bolus: DataFrame, basal: DataFrame, tz: str, first: date, last: date, approximate: bool = False) -> DataFrame:
    """Units by local day over all pumps; days without rows are zero."""
    units = basal_units(basal, tz, approximate, by=("day",))
    shots = bolus.groupBy(local_date("timestamp", tz).alias("day")).agg(exact_sum(F.col("insulin_units")).alias("bolus_units"))
    days = day_spine(bolus.sparkSession, first, last).join(shots, "day", "left").join(units, "day", "left").fillna({"bolus_units": 0.0, "basal_units": 0.0})
    return days.withColumn("total_units", F.col("bolus_units") + F.col("basal_units"))


def day_search(cgm: DataFrame, alarms: DataFrame, tz: str, tir_below: float | None = None, min_low: int | None = None, min_alarms: int | None = None, page: int = 1, page_size: int = 30) -> DataFrame:
    """Days with their time in range, low readings and activated alarms; filters that are not given don't filter.

    total counts all matching days.  A page beyond the last has no rows, and so no total.
    """
    days = cgm.groupBy(local_date("timestamp", tz).alias("day")).agg(m.time_in_range(m.bg_column(), 70, 180).alias("tir_percent"), F.count_if(m.bg_column() < 70).alias("low_count"))
    rings = alarms.groupBy(local_date("timestamp", tz).alias("day")).agg(F.count_if(F.col("action") == "activated").alias("alarm_count"))
    got = days.join(rings, "day", "left").fillna({"alarm_count": 0})
    for column, value, keep in (("tir_percent", tir_below, lambda c, v: c < v), ("low_count", min_low, lambda c, v: c >= v), ("alarm_count", min_alarms, lambda c, v: c >= v)):
        if value is not None:
            got = got.where(keep(F.col(column), value))
    # A row a day is left: one window counts them, so readings are added up once.
    total = F.count(F.lit(1)).over(Window.partitionBy())
    return got.withColumn("total", total).orderBy(F.col("day").desc()).offset((page - 1) * page_size).limit(page_size)


def alert_page(alerts: DataFrame, page: int = 1, page_size: int = 30) -> DataFrame:
    total = alerts.agg(F.count(F.lit(1))).scalar()
    return alerts.orderBy(F.col("fired_at").desc(), F.col("id").desc()).offset((page - 1) * page_size).limit(page_size).withColumn("total", total)


def status(cgm: DataFrame, alarms: DataFrame, now: Column, fresh: float = 15, stale: float = 60) -> DataFrame:
    """Latest reading and alarm of each pump, their age and what it means."""
    last = cgm.groupBy("pump_serial").agg(F.max("timestamp").alias("last_cgm"), F.max_by("bg_mgdl", F.struct("timestamp", "seqnum")).alias("last_bg"))
    rung = alarms.where("action = 'activated'").groupBy("pump_serial").agg(F.max("timestamp").alias("last_alarm"), F.max_by("alarm_name", F.struct("timestamp", "seqnum")).alias("last_alarm_name"))
    age = (F.unix_seconds(now) - F.unix_seconds("last_cgm")) / 60
    return last.join(rung, "pump_serial", "left").withColumn("age_minutes", age).withColumn("freshness", m.freshness(F.col("age_minutes"), fresh, stale)).withColumn("age", m.age_label(F.col("age_minutes")))


#: Hours until a signal is stale.
CGM_HOURS, LIVE_HOURS, DETECTION_HOURS = 26.0, 0.25, 24.0


def status_signals(cgm: DataFrame, fetch_state: DataFrame, results: DataFrame, alerts: DataFrame, now: Column, live_source: str = "live_cron") -> DataFrame:
    """One row for each signal: latest reading, heartbeat of the live loop, each bookmark, last detection, last alert.

    freshness: missing, ok or stale; an alert's follows its delivery, failed being stale.
    """
    def signal(df: DataFrame, label: Column, t: Column, hours: float | None, detail: Column, ok: Column | None = None) -> DataFrame:
        age = (F.unix_seconds(now) - F.unix_seconds(t)) / 3600
        fresh = F.when(t.isNull(), "missing").when(ok if ok is not None else age <= hours, "ok").otherwise("stale")
        return df.select(label.alias("label"), t.alias("signal_ts"), fresh.alias("freshness"), detail.alias("detail"))

    none, state = F.lit(None).cast("string"), F.col("source_id")
    live = fetch_state.where(state == live_source).agg(F.max("last_synced_at").alias("t"))
    synced = fetch_state.where(state != live_source)
    last = alerts.agg(F.max_by(F.struct("fired_at", "delivery"), F.struct("fired_at", "id")).alias("a"))
    parts = [
        signal(cgm.agg(F.max("timestamp").alias("t")), F.lit("cgm_data"), F.col("t"), CGM_HOURS, none),
        signal(live, F.lit("live_loop"), F.col("t"), LIVE_HOURS, none),
        signal(synced, F.concat(F.lit("sync:"), state), F.col("last_synced_at"), CGM_HOURS, F.col("source_kind")),
        signal(synced.agg(F.count(F.lit(1)).alias("n")).where("n = 0"), F.lit("sync"), F.lit(None).cast("timestamp"), CGM_HOURS, none),
        signal(results.agg(F.max("created_at").alias("t")), F.lit("last_detection"), F.col("t"), DETECTION_HOURS, none),
        signal(last, F.lit("last_alert"), F.col("a.fired_at"), None, F.col("a.delivery"), F.col("a.delivery") != "failed"),
    ]
    return reduce(DataFrame.unionByName, parts)


def day_sanity(frames: dict[str, DataFrame], day: date, tz: str, low: float = 70, high: float = 180) -> DataFrame:
    """One row for each pump with anything on a local day: readings, boluses, meals, basal by source, total dose,
    suspensions, mode and site changes, alarms.  Every table is read once, grouped by pump, and put side by side."""
    since, until = window_bounds(day, 1, tz)
    on = lambda name, t="timestamp": between(frames[name], t, since, until)
    n, bg = F.count(F.lit(1)), m.bg_column()
    by = lambda df, *aggregates: df.groupBy("pump_serial").agg(*aggregates)
    meal = F.col("carbs_g") > 0
    source = on("basal").groupBy("pump_serial", "rate_source").agg(n.alias("n")).groupBy("pump_serial")
    parts = [
        by(on("cgm"), n.alias("readings"), F.avg(bg).alias("mean_bg"), F.min("bg_mgdl").alias("min_bg"), F.max("bg_mgdl").alias("max_bg"), m.time_in_range(bg, low, high).alias("tir_percent"), (100.0 * n / 288).alias("coverage_percent")),
        by(on("bolus"), n.alias("boluses"), exact_sum(F.col("insulin_units")).alias("bolus_units")),
        by(on("requests"), n.alias("requests"), F.count_if(meal).alias("meals"), F.sum(F.when(meal, F.col("carbs_g"))).cast("long").alias("carbs_g")),
        by(on("basal"), n.alias("basal_entries")), basal_units(on("basal"), tz, approximate=True, by=("pump_serial",)),
        source.agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "rate_source", F.col("n").cast("string")))), ",").alias("basal_sources")),
        by(on("suspension", "suspend_timestamp"), n.alias("suspensions"), F.count_if("pairing_suspect").alias("suspect_suspensions"), F.sum(F.floor("duration_minutes")).cast("long").alias("suspended_minutes")),
        by(on("events"), F.count_if(F.col("event_type") == "mode_change").alias("mode_changes"), F.count_if(F.col("event_type") == "site_change").alias("site_changes")),
        by(on("alarms"), F.count_if(F.col("action") == "activated").alias("alarms_activated"), n.alias("alarm_rows")),
    ]
    both = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
    got = both.groupBy("pump_serial").agg(*(F.max(c).alias(c) for c in both.columns if c != "pump_serial"))
    return got.withColumn("total_units", F.col("bolus_units") + F.col("basal_units"))


def day_summary(frames: dict[str, DataFrame], tz: str) -> DataFrame:
    """By local day: readings, insulin by both basal rules, carbs by both rules, alarms by both rules."""
    day, bg = local_date("timestamp", tz).alias("day"), m.bg_column()
    out = frames["cgm"].groupBy(day).agg(m.time_in_range(bg, 70, 180).alias("tir_percent"), F.avg(bg).alias("mean_bg"), F.min("bg_mgdl").alias("min_bg"), F.max("bg_mgdl").alias("max_bg"), F.coalesce(F.stddev_samp(bg), F.lit(0.0)).alias("sd_bg"), F.count(bg).alias("readings"))
    shots = frames["bolus"].groupBy(day).agg(exact_sum(F.col("insulin_units")).alias("bolus_units"), F.count(F.lit(1)).alias("bolus_count"))
    exact, rough = (basal_units(frames["basal"], tz, a, by=("day",)).withColumnRenamed("basal_units", n) for a, n in ((False, "basal_units"), (True, "basal_units_5min")))
    food = F.col("bolus_category").isin(FOOD_CARRYING)
    carbs = frames["requests"].groupBy(day).agg(F.coalesce(F.sum(F.when(food, F.col("carbs_g"))), F.lit(0)).cast("long").alias("carbs_meals"), F.coalesce(F.sum(F.when(F.col("carbs_g") > 0, F.col("carbs_g"))), F.lit(0)).cast("long").alias("carbs_all"))
    rings = frames["alarms"].groupBy(day).agg(F.count_if(F.col("action") == "activated").alias("alarm_count"), F.count(F.lit(1)).alias("alarm_rows"))
    for side in (shots, exact, rough, carbs, rings):
        out = out.join(side, "day", "left")
    return out.fillna(0).fillna(0.0)


def compare_days(cgm: DataFrame, tz: str, a: date, b: date) -> DataFrame:
    """Mean readings of two local days by minute of day, whichever of the two has one."""
    wall = local("timestamp", tz)
    side = lambda d, name: between(cgm, "timestamp", *window_bounds(d, 1, tz)).groupBy(minute_of_day(wall).alias("minute")).agg(F.avg(m.bg_column()).alias(name))
    return side(a, "bg_a").join(side(b, "bg_b"), "minute", "full")


def bolus_clusters(bolus: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """Boluses at most so far apart: their middle one, total and count."""
    runs = sessions(bolus, "pump_serial", ["timestamp", "bolus_id"], F.unix_seconds("timestamp"), gap_minutes * 60)
    one = runs.groupBy("pump_serial", "session").agg(F.array_sort(F.collect_list(F.struct("timestamp", "bolus_id"))).alias("b"), F.sum("insulin_units").alias("total_units"), F.count(F.lit(1)).alias("n"))
    return one.select("pump_serial", F.element_at("b", 1)["timestamp"].alias("first_ts"), F.element_at("b", (F.floor(F.size("b") / 2) + 1).cast("int"))["timestamp"].alias("centre_ts"), "total_units", "n")


def local_peaks(cgm: DataFrame, high: float = 180, reach: int = 3) -> DataFrame:
    """Readings above range that none within `reach` rows exceeds."""
    w = Window.partitionBy("pump_serial").orderBy("timestamp", "seqnum")
    return cgm.withColumn("top", F.max("bg_mgdl").over(w.rowsBetween(-reach, reach))).where((F.col("bg_mgdl") == F.col("top")) & (F.col("bg_mgdl") > high)).drop("top")


def downward_crossings(cgm: DataFrame, levels: tuple[float, ...] = (180, 250)) -> DataFrame:
    """Readings with which the series falls to a level or below, one row for each level."""
    w = Window.partitionBy("pump_serial").orderBy("timestamp", "seqnum")
    rows = cgm.withColumn("before", F.lag("bg_mgdl").over(w)).withColumn("level", F.explode(F.array(*(F.lit(float(x)) for x in levels))))
    return rows.where((F.col("before") > F.col("level")) & (F.col("bg_mgdl") <= F.col("level"))).select("pump_serial", "seqnum", "timestamp", "level", "before", "bg_mgdl")


def series_breaks(cgm: DataFrame, minutes: int = 15) -> DataFrame:
    """Readings after which a line is broken: the next is further away."""
    w = Window.partitionBy("pump_serial").orderBy("timestamp", "seqnum")
    gap = F.unix_seconds("timestamp") - F.unix_seconds(F.lag("timestamp").over(w))
    return cgm.withColumn("is_break", F.coalesce(gap > minutes * 60, F.lit(False))).withColumn("bg_class", m.bg_class(m.bg_column()))


def trends_digest(windows: DataFrame) -> DataFrame:
    """Trailing windows of time in range as lines of text, shortest first; a dash where there are no readings."""
    line = F.concat(F.col("days").cast("string"), F.lit("-day: "), F.coalesce(F.concat(F.bround("tir_percent", 0).cast("int").cast("string"), F.lit(" %")), F.lit("—")))
    lines = F.array_sort(F.collect_list(F.struct("days", line.alias("line"))))
    return windows.agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("digest"))


def status_digest(signals: DataFrame, now: Column) -> DataFrame:
    """The latest reading, detection and alert of `status_signals` as lines of text with their age, or the alert's delivery."""
    at, minutes = F.col("signal_ts"), (F.unix_seconds(now) - F.unix_seconds("signal_ts")) / 60
    age = F.when(at.isNull(), "none recorded").when(minutes < 0, "just now").otherwise(m.age_label(minutes))
    shown = F.coalesce(F.date_format(at, "yyyy-MM-dd HH:mm 'UTC'"), F.lit("—"))
    names = {"cgm_data": "Latest CGM", "last_detection": "Last detection", "last_alert": "Last alert"}
    text = F.when((F.col("label") == "last_alert") & at.isNull(), F.lit("none recorded")).otherwise(F.concat(shown, F.lit(" ("), F.when(F.col("label") == "last_alert", F.col("detail")).otherwise(age), F.lit(")")))
    order, title = F.lit(None).cast("int"), F.lit(None).cast("string")
    for i, (label, name) in enumerate(names.items(), 1):
        order, title = F.when(F.col("label") == label, i).otherwise(order), F.when(F.col("label") == label, name).otherwise(title)
    lines = F.array_sort(F.collect_list(F.struct(order.alias("o"), F.concat(title, F.lit(": "), text).alias("line"))))
    wanted = signals.where(F.col("label").isin(list(names)))
    return wanted.agg(F.concat(F.lit("Status\n"), F.array_join(F.transform(lines, lambda x: x["line"]), "\n")).alias("digest"))
