"""Registered queries over the driver's tables.  `oracle.py` has the SQL of the same names."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from datetime import date, datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, TimestampType

from ..config import Anomaly, Calibration, Config, MealRise, MealRun, SiteChange, poll_depth
from ..functions import metrics as m
from ..functions.time import between, iso_minute, local, local_date, midnight, overlaps, window_bounds
from ..operators import build, cluster, detect, enrich, features, overlay
from ..operators.agp import hourly, profile
from ..operators.joins import range_join
from ..operators.variability import conga, mage, modd
from ..operators.enrich import original_view
from ..schema import FOOD_CARRYING, TABLES, time_of
from ..shipping import shared_folder, stored
from ..sources import driver_tables as d
from ..sources.storage import ParquetStore, repair_shift
from ..streaming.alerts import due_retries, live_readings, newest
from . import dashboard, sync
from .report import cgm_report

CONFIG = Config()
TZ = CONFIG.timezone
END, DAYS = date(2024, 1, 30), 30
SINCE, UNTIL = window_bounds(END, DAYS, TZ)
#: The generic tables are sparser than a sensor: longer windows and steps, as parameters.
RISE = replace(MealRise(), window_minutes=60, expected_interval_minutes=10, min_coverage=0.5)
ANOMALY = replace(Anomaly(), flatline_consecutive_intervals=3, flatline_tolerance=60.0)
CLUSTERED = ["mean_bg", "sd_bg", "tir", "tdi", "carbs_g"]
RUN = replace(MealRun(), sustained_intervals=2, rise_threshold_per_5min=4.0)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def tidy(df: DataFrame) -> DataFrame:
    """Doubles to four places, instants and dates as text: what both engines print alike."""
    show = {DoubleType: lambda c: F.round(c, 4), TimestampType: lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss"), DateType: lambda c: c.cast("string")}
    return df.select(*(show.get(type(f.dataType), lambda c: c)(F.col(f.name)).alias(f.name) for f in df.schema.fields))


def steady(df: DataFrame, *columns: str) -> DataFrame:
    """Sums of thousandths over hours often end in exactly half of the last place shown; a nudge makes all round them up."""
    return df.withColumns({c: F.col(c) + 1e-9 for c in columns})


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: tidy(f(spark, sf_dir))
    return f


@query
def cgm_report_pooled(s, p):
    return cgm_report(d.cgm(s, p), SINCE, UNTIL, TZ, None)


@query
def cgm_report_by_pump(s, p):
    return cgm_report(d.cgm(s, p), SINCE, UNTIL, TZ)


@query
def cgm_built(s, p):
    raw = d.source(s, p).select("pump_serial", "seqnum", F.col("timestamp").alias("event_ts"), (F.col("k") * 3 + 40).alias("bg"), F.when(F.col("event_type") == "error", 2).otherwise(1).alias("data_type"), (F.unix_seconds("timestamp") - build.SENSOR_EPOCH - 28800 - F.col("k") * 10).alias("egv_seconds"), F.lit(0).alias("ingest_ord"))
    again = raw.where("seqnum % 10 = 0").withColumn("bg", F.lit(399)).withColumn("ingest_ord", F.lit(1))
    return build.build_cgm(raw.unionByName(again), TZ)


@query
def requests_joined(s, p):
    return build.build_requests(*d.request_messages(s, p))


@query
def orphan_messages(s, p):
    one, two, _ = d.request_messages(s, p)
    return build.orphans(two, one).drop("ingest_ord")


@query
def requests_enriched(s, p):
    return enrich.enrich_requests(build.build_requests(*d.request_messages(s, p)))


@query
def basal_built(s, p):
    return build.build_basal(d.basal_raw(s, p))


@query
def alarms_built(s, p):
    """Alarms, alerts and sensor alerts; every seventh has a name of its own, every third no second parameter."""
    k = F.col("k")
    category = F.when(k % 3 == 0, "cgm_alert").when(k % 3 == 1, "alert").otherwise("alarm")
    number = F.when(k % 3 == 0, k % 16).when(k % 3 == 1, k % 60).otherwise(k % 30)
    raw = d.source(s, p).where("event_type = 'error'").select(
        "pump_serial", "seqnum", "timestamp", category.alias("category"), F.when(k % 2 == 0, "activated").otherwise("cleared").alias("action"), number.alias("alarm_id"),
        F.when(k % 7 == 0, "NamedAlarm").alias("raw_name"), F.col("value").alias("param1"), F.when(k % 3 != 0, k * 2).alias("param2"),
    )
    return build.build_alarms(raw)


@query
def pump_events_built(s, p):
    """All nine kinds of events, and one that no mapping takes."""
    k = F.col("k")
    kinds = [*build.EVENT_TYPES, "mystery"]
    kind = F.element_at(F.array(*map(F.lit, kinds)), k % 10 + 1)
    raw = d.source(s, p).where("event_type = 'signup'").select(
        "pump_serial", "seqnum", "timestamp", kind.alias("kind"), F.expr("k div 10 % 6").cast("int").alias("code"), F.expr("k div 10 % 5").cast("int").alias("previous_code"), (k * 3).alias("volume"), (k % 25).alias("prime_size"),
        (k % 3).alias("requested_action"), F.when(k % 2 == 0, k).alias("exercise_time"), (k * 10).alias("commanded_basal_rate"), (k % 4).alias("pump_control_state"), (k % 3).alias("status_user_mode"),
    )
    return build.build_events(raw)


@query
def live_thinning(s, p):
    return build.thin_live(d.cgm(s, p))


@query
def suspensions(s, p):
    return d.suspension(s, p)


@query
def site_changes_forced(s, p):
    return d.frames(s, p)["events"].drop("previous_mode", "details")


@query
def site_issues(s, p):
    return d.frames(s, p)["site_issues"]


@query
def cgm_gaps(s, p):
    return d.frames(s, p)["cgm_gaps"]


@query
def modd_by_pump(s, p):
    return modd(d.cgm(s, p), "pump_serial", TZ)


@query
def conga_1h(s, p):
    return conga(d.cgm(s, p), "pump_serial", 1)


@query
def mage_by_pump(s, p):
    return mage(d.cgm(s, p), "pump_serial")


@query
def agp_hourly(s, p):
    return hourly(d.cgm(s, p), TZ)


@query
def agp_15min_smoothed(s, p):
    return profile(d.cgm(s, p), TZ, 15, 5)


@query
def tir_trend_daily(s, p):
    return dashboard.trends(d.cgm(s, p), TZ)


@query
def tir_windows(s, p):
    return dashboard.tir_windows(d.cgm(s, p), TZ, END)


@query
def heatmap(s, p):
    return dashboard.heatmap(d.cgm(s, p), TZ)


@query
def heatmap_pivot(s, p):
    return dashboard.heatmap_pivot(d.cgm(s, p), TZ, [date(2024, 1, x) for x in (10, 11, 12)])


@query
def insulin_daily(s, p):
    return steady(dashboard.insulin_daily(d.bolus(s, p), d.basal(s, p), TZ, date(2023, 12, 30), END), "basal_units", "total_units")


@query
def insulin_daily_5min(s, p):
    return steady(dashboard.insulin_daily(d.bolus(s, p), d.basal(s, p), TZ, date(2023, 12, 30), END, approximate=True), "basal_units", "total_units")


@query
def day_search(s, p):
    return dashboard.day_search(d.cgm(s, p), d.alarms(s, p), TZ, tir_below=55.0, min_low=1, page=2, page_size=5)


@query
def status_by_pump(s, p):
    return dashboard.status(d.cgm(s, p), d.alarms(s, p), F.lit(datetime(2024, 1, 31, tzinfo=timezone.utc)))


@query
def day_summary(s, p):
    return steady(dashboard.day_summary(d.frames(s, p), TZ), "basal_units", "basal_units_5min")


@query
def compare_days(s, p):
    return dashboard.compare_days(d.cgm(s, p), TZ, date(2024, 1, 10), date(2024, 1, 3))


@query
def bolus_clusters(s, p):
    return dashboard.bolus_clusters(d.bolus(s, p))


@query
def cluster_requests(s, p):
    """Requests within five minutes of a cluster's centre: carbs, and the largest request's category."""
    c = dashboard.bolus_clusters(d.bolus(s, p)).withColumn("ct", F.unix_seconds("centre_ts"))
    r = d.requests(s, p).select("pump_serial", F.unix_seconds("timestamp").alias("rt"), "carbs_g", "total_requested", "bolus_category", "bolus_id")
    near = range_join(c, r, "pump_serial", "ct", "rt", 300, 300)
    return near.groupBy("pump_serial", "centre_ts").agg(F.sum("carbs_g").alias("carbs_g"), F.max_by("bolus_category", F.struct(F.coalesce("total_requested", F.lit(-1.0)), "bolus_id")).alias("top_category"), F.count(F.lit(1)).alias("n_requests"))


@query
def local_peaks(s, p):
    return dashboard.local_peaks(d.cgm(s, p)).drop("backfilled")


@query
def downward_crossings(s, p):
    return dashboard.downward_crossings(d.cgm(s, p))


@query
def day_slice_counts(s, p):
    """Rows of each table on one local day."""
    parts = sync.day_slice(d.frames(s, p), date(2024, 1, 10), TZ)
    return reduce(DataFrame.unionByName, [df.agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n")) for n, df in parts.items()])


@query
def table_bounds(s, p):
    return sync.time_bounds({n: f for n, f in d.frames(s, p).items() if n != "events"})


@query
def series_breaks(s, p):
    return dashboard.series_breaks(d.cgm(s, p)).groupBy("bg_class", "is_break").agg(F.count(F.lit(1)).alias("n"))


@query
def gaps_on_day(s, p):
    return overlay.clipped(d.frames(s, p)["cgm_gaps"], "start_ts", "end_ts", TZ, date(2024, 1, 10))


@query
def suspensions_overlapping(s, p):
    since, until = F.lit(SINCE), F.lit(window_bounds(date(2024, 1, 5), 5, TZ)[1])
    return d.suspension(s, p).where(overlaps("suspend_timestamp", "resume_timestamp", since, until)).select("pump_serial", "suspend_timestamp", "resume_timestamp")


@query
def out_of_range_shading(s, p):
    """Each activation and the first clearing strictly after it."""
    return overlay.first_after(d.alarms(s, p).where("alarm_name = 'cgm_out_of_range'"), F.col("action") == "activated", F.col("action") == "cleared")


@query
def gaps_snapped(s, p):
    """Gaps with the last reading at or before their start and the first at or after their end."""
    return overlay.snapped(d.frames(s, p)["cgm_gaps"].where("not ongoing").select("pump_serial", "start_ts", "end_ts"), d.cgm(s, p))


@query
def day_chart(s, p):
    return overlay.day_chart(d.frames(s, p), date(2024, 1, 10), TZ)


@query
def trends_digest(s, p):
    return dashboard.trends_digest(dashboard.tir_windows(d.cgm(s, p), TZ, END))


@query
def daily_features(s, p):
    return steady(features.daily_features(d.frames(s, p), CONFIG, "2024-01-30"), "basal_units", "tdi")


@query
def anchored_windows(s, p):
    return detect.anchored_windows(d.cgm(s, p), RISE).select("pump_serial", "seqnum", "n_samples", "coverage", F.aggregate("samples", F.lit(0.0), lambda a, x: a + x["v"]).alias("sum_bg"))


@query
def rise_slopes(s, p):
    return detect.rise_slopes(d.cgm(s, p), RISE, TZ).drop("t", "glucose_values")


@query
def meal_rises(s, p):
    return detect.meal_rises(d.cgm(s, p), RISE, TZ).select("pump_serial", "seqnum", "anchor_ts", "start_level", "end_level", "delta", "hour_of_day", F.array_join(F.col("glucose_values").cast("array<string>"), ",").alias("values"))


@query
def meal_rises_without_gaps(s, p):
    return detect.meal_rises(d.cgm(s, p), RISE, TZ, d.frames(s, p)["cgm_gaps"]).select("pump_serial", "seqnum")


@query
def meal_rise_instances(s, p):
    return detect.instances(detect.meal_rises(d.cgm(s, p), RISE, TZ), RISE).select("pump_serial", "seqnum", "anchor_ts", iso_minute(F.col("anchor_ts"), TZ).alias("event_ref"))


def _scored(s, p):
    return detect.score(detect.instances(detect.meal_rises(d.cgm(s, p), RISE, TZ).drop("glucose_values"), RISE), d.requests(s, p), Calibration(), TZ)


@query
def meal_rise_scored(s, p):
    return _scored(s, p).drop("event_ref", "slope")


@query
def meal_rise_summary(s, p):
    got = _scored(s, p)
    n = F.count(F.lit(1))
    count = lambda c, x: F.count_if(F.col(c) == x).alias(x)
    labels = [count("label", x) for x in ("pre_bolused", "late_bolused", "uncovered")]
    resolutions = [F.count_if(F.col("resolution") == x).alias(f"resolved_{x}") for x in ("auto_correction", "user_correction", "none")]
    return got.agg(n.alias("total"), *labels, *resolutions).withColumn("uncovered_rate", F.coalesce(F.try_divide(F.col("uncovered").cast("double"), F.col("total")), F.lit(0.0)))


@query
def meal_rise_by_hour(s, p):
    labels = ["late_bolused", "pre_bolused", "uncovered"]
    return _scored(s, p).groupBy("hour_of_day").pivot("label", labels).agg(F.count(F.lit(1))).fillna(0, labels)


@query
def slope_sweep(s, p):
    return detect.slope_sweep(detect.rise_slopes(d.cgm(s, p), RISE, TZ), [1.0, 1.4, 1.8, 2.2], RISE, d.requests(s, p), Calibration(), TZ)


@query
def anomaly_crossings(s, p):
    return detect.crossings(d.cgm(s, p), ANOMALY)


@query
def anomaly_flatlines(s, p):
    return detect.flatlines(d.cgm(s, p), ANOMALY, max_gap_minutes=30.0)


@query
def meal_runs(s, p):
    return detect.meal_runs(d.cgm(s, p), d.requests(s, p), RUN, 180.0, min_gap=0.5, max_gap=30.0)


@query
def cgm_dates(s, p):
    return d.cgm(s, p).select(local_date("timestamp", TZ).alias("day")).distinct()


@query
def date_bounds(s, p):
    day = local_date("timestamp", TZ)
    return d.cgm(s, p).agg(F.min(day).alias("first_day"), F.max(day).alias("anchor_day"))


@query
def table_extents(s, p):
    f = d.frames(s, p)
    times = {"cgm": "timestamp", "bolus": "timestamp", "basal": "timestamp", "alarms": "timestamp", "suspension": "suspend_timestamp", "cgm_gaps": "start_ts"}
    out = None
    for name, t in times.items():
        one = f[name].agg(F.lit(name).alias("name"), F.min(t).alias("first_ts"), F.max(t).alias("last_ts"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query
def category_counts(s, p):
    return d.requests(s, p).groupBy("bolus_category").agg(F.count(F.lit(1)).alias("n"))


@query
def same_second_stacking(s, p):
    return d.cgm(s, p).groupBy(F.date_trunc("second", "timestamp").alias("bucket")).agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


@query
def pump_is_single(s, p):
    one = F.count_distinct("pump_serial") == 1
    return d.cgm(s, p).groupBy("backfilled").agg(F.when(one, F.min("pump_serial")).alias("pump_serial"), F.count_distinct("pump_serial").alias("n_pumps"))


@query
def bounded_scan(s, p):
    since, until = window_bounds(date(2024, 1, 10), 2, TZ)
    return between(d.cgm(s, p).where("pump_serial = '0'"), "timestamp", since, until)


def _store(s: SparkSession) -> ParquetStore:
    """A store of its own for one query, in the folder that the session's executors share."""
    return ParquetStore(s, f"{shared_folder(s)}/store-{uuid.uuid4().hex}")


@query
def upsert_result(s, p):
    """Live readings are stored; then all readings come as one batch, each twice: stored rows win, then the batch's first."""
    store, c = _store(s), d.cgm(s, p)
    store.upsert("cgm", c.where("not backfilled"))
    twice = F.explode(F.array(F.lit(1), F.lit(2)))
    store.upsert("cgm", c.withColumn("o", twice).withColumn("bg_mgdl", F.col("o")), order="o")
    return store.read_all("cgm").drop("sensor_timestamp")


@query
def delete_range_result(s, p):
    """One local day of one pump is deleted from a stored table."""
    since, until = window_bounds(date(2024, 1, 10), 1, TZ)
    store = _store(s)
    store.upsert("cgm", d.cgm(s, p))
    store.delete_range("cgm", since, until, "0")
    return store.read_all("cgm").groupBy("pump_serial").agg(F.count(F.lit(1)).alias("n"), F.max("seqnum").alias("last"))


@query
def live_latest(s, p):
    """What a live poll gets: each pump's newest readings, from wall-clock times."""
    raw = d.cgm(s, p).select("pump_serial", "seqnum", local("timestamp", TZ).alias("wall_time"), F.col("bg_mgdl").cast("string").alias("bg_mgdl"))
    return newest(live_readings(raw, CONFIG), poll_depth(CONFIG.meal_rise))


@query
def alerts_page(s, p):
    return dashboard.alert_page(d.alerts(s, p).drop("delivery"), 3, 10)


@query
def alert_retries(s, p):
    """By reference: attempts so far, whether one went out, and whether another is due."""
    log = d.alarms(s, p).select(F.concat_ws(":", "alarm_name", "pump_serial", F.date_format("timestamp", "yyyy-MM-dd")).alias("event_ref"), "timestamp", (F.col("action") == "ack").alias("sent"))
    got = log.groupBy("event_ref").agg(F.count(F.lit(1)).alias("attempts"), F.bool_or("sent").alias("delivered"), F.max("timestamp").alias("last_ts"))
    return got.withColumn("retry", ~F.col("delivered") & (F.col("attempts") < 3))


@query
def day_sanity(s, p):
    return steady(dashboard.day_sanity({**d.frames(s, p), "basal": d.basal_named(s, p), "events": d.all_events(s, p)}, date(2024, 1, 10), TZ), "basal_units", "total_units")


@query
def day_digest(s, p):
    """By local day: time in range, mean, readings, bolus units, carbs of meals, alerts sent."""
    f, day = d.frames(s, p), local_date("timestamp", TZ).alias("day")
    c = f["cgm"].groupBy(day).agg(m.time_in_range(m.bg_column(), 70, 180, None).alias("tir_percent"), F.avg(m.bg_column()).alias("mean_bg"), F.count(m.bg_column()).alias("readings"))
    b = f["bolus"].groupBy(day).agg(features.exact_sum(F.col("insulin_units")).alias("bolus_units"))
    food = F.col("bolus_category").isin(FOOD_CARRYING)
    r = f["requests"].groupBy(day).agg(F.coalesce(F.sum(F.when(food, F.col("carbs_g"))), F.lit(0)).cast("long").alias("carbs_g"))
    a = d.alerts(s, p).groupBy(local_date("fired_at", TZ).alias("day")).agg(F.count(F.lit(1)).alias("alerts"))
    return c.join(b, "day", "left").join(r, "day", "left").join(a, "day", "left").fillna({"bolus_units": 0.0, "carbs_g": 0, "alerts": 0})


@query
def status_signals(s, p):
    return dashboard.status_signals(d.cgm(s, p), d.fetch_state(s, p), d.detections(s, p), d.alerts(s, p), F.lit(datetime(2024, 1, 31, tzinfo=timezone.utc)))


@query
def status_digest(s, p):
    now = F.lit(datetime(2024, 1, 31, tzinfo=timezone.utc))
    return dashboard.status_digest(dashboard.status_signals(d.cgm(s, p), d.fetch_state(s, p), d.detections(s, p), d.alerts(s, p), now), now)


def _extent(frames: dict[str, DataFrame]) -> DataFrame:
    """One row for each of the nine tables: rows, first and last instant, a sum over rows that tells wrong ones, intervals with an end."""
    sums = {
        "cgm": F.sum("bg_mgdl"), "bolus": F.sum("bolus_id"), "requests": F.sum(F.length("bolus_category") * (F.col("bolus_id") % 7 + 1)), "basal": F.sum(F.round(F.col("commanded_rate") * 1000)), "suspension": F.sum(F.floor("duration_minutes")),
        "events": F.count_if("forced_by_alarm"), "alarms": F.sum(F.length("alarm_name") * (F.col("seqnum") % 7 + 1)), "site_issues": F.sum(F.col("occlusion_count") * 1000 + F.coalesce(F.floor("resolution_delay_minutes"), F.lit(0))), "cgm_gaps": F.sum(F.floor("duration_minutes")),
    }
    ends = {"suspension": "resume_timestamp", "site_issues": "resolved_by_site_change_ts", "cgm_gaps": "end_ts"}
    one = lambda n: frames[n].agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n"), F.min(time_of(n)).alias("first_ts"), F.max(time_of(n)).alias("last_ts"), sums[n].cast("long").alias("total"), (F.count(ends[n]) if n in ends else F.lit(None).cast("long")).alias("ended"))
    return reduce(DataFrame.unionByName, [one(n) for n in TABLES])


@query
def router_tables(s, p):
    """All nine tables from raw events by the router; the events are read and parsed once, into files by class."""
    return _extent(sync.build_parsed(stored(sync.known(d.raw_events(s, p)), "events", "event_class"), CONFIG))


@query
def router_unhandled(s, p):
    return sync.build_all(d.raw_events(s, p), CONFIG)[1]


@query
def sync_in_steps(s, p):
    """Raw events synced into a store in two steps, cut in the middle: the same tables as from all events at once."""
    store, raw = _store(s), d.raw_events(s, p)
    for day in (15, 31):
        sync.sync(store, raw, CONFIG, datetime(2024, 1, day, 12, tzinfo=timezone.utc))
    return _extent(sync.load_view(store, CONFIG, enriched=True))


@query
def sync_state(s, p):
    """After a sync: each pump's bookmark and what was last seen of it; the store's version, empty tables, stacked readings."""
    store = _store(s)
    sync.sync(store, d.raw_events(s, p), CONFIG, datetime(2024, 1, 20, tzinfo=timezone.utc))
    marks = store.list_fetch_state().select(F.concat(F.lit("pump:"), "source_id").alias("label"), F.concat_ws(" ", F.date_format("last_synced_at", "yyyy-MM-dd"), F.col("actual_min_date").cast("string"), F.col("actual_max_date").cast("string"), F.get_json_object("meta", "$.last_event")).alias("value"))
    found = sync.health(store, sync.VERSION)
    rows = [("version_matches", str(found["version_matches"]).lower()), ("empty_tables", ",".join(found["empty_tables"])), ("stacked_seconds", str(found["stacked_seconds"]))]
    return marks.unionByName(s.createDataFrame(rows, "label string, value string"))


def _alert_refs(s, p):
    """Alerts by kind, pump and local day: an alarm that is activated again on the same day has the same reference."""
    ref = F.concat_ws(":", "alert_kind", "pump_serial", local_date("fired_at", TZ).cast("string"))
    return d.alerts(s, p).select("alert_kind", "pump_serial", ref.alias("event_ref"), "fired_at", F.lit("{}").alias("payload"))


@query
def alerts_claimed(s, p):
    """Alerts are claimed by reference, all of them twice; each reference stands once, with its earliest alarm.  The last ten days of one kind, latest first."""
    store, alerts = _store(s), _alert_refs(s, p)
    store.record_alerts(alerts)
    store.record_alerts(alerts)
    got = store.recent_alerts("OcclusionAlarm", timedelta(days=10), datetime(2024, 1, 31, tzinfo=timezone.utc))
    return got.select("alert_kind", "event_ref", "pump_serial", "fired_at", "delivery")


@query
def detection_log(s, p):
    """Detections are appended to the log in two parts, twice as many rows as kinds of alarms; counts by kind."""
    store, alarms = _store(s), d.alarms(s, p)
    for action in ("activated", "cleared"):
        store.record_results(alarms.where(F.col("action") == action).select(F.col("alarm_name").alias("kind"), F.col("timestamp").alias("anchor_timestamp"), F.col("action").alias("payload")))
    kinds = reduce(DataFrame.unionByName, [store.list_results(k, limit=1_000_000) for k in ("OcclusionAlarm", "LowInsulinAlert")])
    return kinds.groupBy("kind", "payload").agg(F.count(F.lit(1)).alias("n"), F.min("anchor_timestamp").alias("first_ts"), F.max("anchor_timestamp").alias("last_ts"))


@query
def retries_due(s, p):
    """Alerts of the last five days that may be sent again: claimed, never delivered, few failures, none just now."""
    ref = F.concat_ws(":", "alarm_name", "pump_serial", local_date("timestamp", TZ).cast("string"))
    said = F.to_json(F.struct(ref.alias("event_ref"), (F.col("action") == "ack").alias("delivered")))
    # Clearings stand for failed tries, acknowledgements of one kind for deliveries.
    log = d.alarms(s, p).where("action = 'cleared' or action = 'ack' and alarm_name = 'LowInsulinAlert'").select(said.alias("payload"), F.col("timestamp").alias("created_at"))
    first = _alert_refs(s, p).groupBy("event_ref").agg(F.min("fired_at").alias("fired_at"))
    return due_retries(first, log, datetime(2024, 1, 31, tzinfo=timezone.utc), attempts=30, pause_minutes=600, within_hours=120)


@query
def repaired_times(s, p):
    """One pump's readings of three local days are moved by seven hours in a store; days by pump."""
    store = _store(s)
    store.upsert("cgm", d.cgm(s, p))
    since, until = window_bounds(date(2024, 1, 12), 3, TZ)
    repair_shift(store, "cgm", 7, since, until, "0")
    return store.read_all("cgm").groupBy("pump_serial", local_date("timestamp", TZ).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum("seqnum").alias("seqnums"))


@query
def enriched_view(s, p):
    """Tables stored as the pump gave them; the enriched view derives what is missing: categories, forced changes, gaps, issues."""
    store = _store(s)
    for name, df in original_view(d.frames(s, p)).items():
        store.upsert(name, df)
    view = sync.load_view(store, CONFIG, enriched=True)
    counts = lambda df, label: df.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))
    forced = F.concat(F.lit("forced:"), F.col("forced_by_alarm").cast("string"))
    ongoing = F.concat(F.lit("ongoing:"), F.col("ongoing").cast("string"))
    return reduce(DataFrame.unionByName, [counts(view["requests"], F.col("bolus_category")), counts(view["events"], forced), counts(view["cgm_gaps"], ongoing), counts(view["site_issues"], F.lit("site_issues"))])


@query
def bulk_copied(s, p):
    """Tables of one store copied to another that has a part of them already: rows received, inserted and skipped."""
    one, two = _store(s), _store(s)
    for name, df in (("bolus", d.bolus(s, p)), ("alarms", d.alarms(s, p))):
        one.upsert(name, df)
    two.upsert("bolus", d.bolus(s, p).where("insulin_units > 1"))
    report = sync.bulk_copy(one, two, ["bolus", "alarms"])
    rows = [(n, r.received, r.inserted, r.skipped, two.read_all(n).count()) for n, r in report.items()]
    return s.createDataFrame(rows, "name string, received long, inserted long, skipped long, stored long")


@query
def pump_list(s, p):
    """Pumps by their first day, names trimmed; the model is unknown for some."""
    raw = d.source(s, p).groupBy("pump_serial").agg(F.min("timestamp").alias("min_date"), F.when(F.min("k") >= 0, F.max("timestamp")).alias("max_date"), F.count_if(F.col("k") % 2 == 0).alias("even"))
    return sync.pump_metadata(raw.select(F.concat(F.lit(" "), "pump_serial", F.lit(" ")).alias("serial"), F.when(F.col("even") % 2 == 0, "x2").alias("model"), "min_date", "max_date"))


@query
def report_files(s, p):
    """Label counts by hour, as the report's file holds them."""
    path = f"{shared_folder(s)}/report-{uuid.uuid4().hex}"
    sync.score_report(_scored(s, p), path)
    return s.read.schema("hour_of_day int, label string, n long").json(path)


@query
def nearest_day(s, p):
    """Of the days with readings the nearest to one without, and how many pages of ten days there are."""
    days = [r["day"] for r in sync.reading_days(d.cgm(s, p), TZ).collect()]
    return s.createDataFrame([(sync.nearest_date(days, date(2024, 2, 15)), sync.page_count(len(days), 10))], "nearest date, pages long")


@query
def rate_source_counts(s, p):
    return d.basal_named(s, p).groupBy("rate_source").agg(F.count(F.lit(1)).alias("n"))


@query
def report_segments(s, p):
    """Band segments of the pooled report, one row each; negative or missing values count as zero.

    shown: what a reader sees, with a mark for missing values; note: why some figures are left out.
    """
    r = cgm_report(d.cgm(s, p), SINCE, UNTIL, TZ, None)
    bands = ["tbr_level2", "tbr_level1", "tir", "tar_level1", "tar_level2"]
    note = F.when(~F.col("sufficient"), F.concat(F.lit("needs 14 days and 70 % of readings; has "), F.col("n_days").cast("string"), F.lit(" days")))
    shown = lambda b: F.when(F.col(b).isNull(), "—").otherwise(F.concat(F.bround(b, 0).cast("int").cast("string"), F.lit(" %")))
    return r.select(F.inline(F.array(*(F.struct(F.lit(b).alias("band"), F.greatest(F.coalesce(b, F.lit(0.0)), F.lit(0.0)).alias("percent"), shown(b).alias("shown"), note.alias("note")) for b in [*bands, "gmi"]))))


@query
def cluster_days(s, p):
    """Days grouped by features as the features' query shows them."""
    f = QUERIES["daily_features"](s, p).select("pump_serial", "day", *CLUSTERED)
    return cluster.cluster_days(f, CLUSTERED, ["pump_serial", "day"], CONFIG.clustering.n_clusters)[0]
