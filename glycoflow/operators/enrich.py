"""Enrichment: derived columns of requests and events, and the derived tables site_issues and cgm_gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SiteChange
from .joins import with_last
from .sequences import CHUNK, pair, sessions

EPSILON = 0.01


def enrich_requests(requests: DataFrame) -> DataFrame:
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    delta = zero("total_requested") - (zero("food_insulin") + zero("correction_insulin"))
    carbs, food, correction = zero("carbs_g") > 0, zero("food_insulin") > 0, zero("correction_insulin") > 0
    user = F.when(carbs & food & correction, "user_meal_and_correction").when(carbs & food, "user_meal").when(~carbs & correction, "user_correction_only").otherwise("unknown")
    source = F.col("bolus_source")
    category = (
        F.when(source == "auto", "auto_correction")
        .when((source == "override") & (delta > EPSILON), "override_up").when((source == "override") & (delta < -EPSILON), "override_down")
        .when(source.isin("override", "user"), user).otherwise("unknown")
    )
    return requests.withColumn("bolus_category", category).withColumn("override_delta", F.when(source == "override", delta))


def tag_forced(events: DataFrame, alarms: DataFrame, c: SiteChange) -> DataFrame:
    """forced_by_alarm: null but for site changes; true within the window after a battery shutdown, unless the cartridge was filled up.

    The last shutdown up to the event decides: if that one is too far back, so are all others.
    """
    shut = alarms.where("alarm_name = 'BatteryShutdownAlarm' and action = 'activated'").select("pump_serial", "timestamp", F.lit(-1).cast("long").alias("seqnum"), F.col("timestamp").alias("shut"))
    sites = events.where("event_type = 'site_change'").select("pump_serial", "timestamp", "seqnum", F.lit(None).cast("timestamp").alias("shut"))
    line = shut.unionByName(sites)
    near = with_last(line.withColumn("_at", F.unix_seconds("timestamp")), "pump_serial", "_at", CHUNK, ["timestamp", "seqnum"], F.col("shut"), "last").where("shut is null")
    forced = near.select("pump_serial", "seqnum", (F.unix_micros("timestamp") - F.unix_micros("last") <= c.forced_window_minutes * 60_000_000).alias("inside"))
    volume = F.expr("try_cast(get_json_object(details, '$.insulin_volume') as double)")
    filled = (F.col("event_subtype") == "cartridge") & F.coalesce(volume >= c.cartridge_real_fill_threshold, F.lit(False))
    got = events.join(forced, ["pump_serial", "seqnum"], "left")
    return got.withColumn("forced_by_alarm", F.when(F.col("event_type") == "site_change", F.coalesce("inside", F.lit(False)) & ~filled)).drop("inside")


def occlusions(alarms: DataFrame) -> DataFrame:
    return alarms.where("alarm_name = 'OcclusionAlarm' and action = 'activated'")


def occlusion_runs(alarms: DataFrame, c: SiteChange) -> DataFrame:
    """Runs of occlusion alarms that are long enough to count."""
    runs = sessions(occlusions(alarms), "pump_serial", ["timestamp", "seqnum"], F.unix_seconds("timestamp"), c.occlusion_cluster_window_minutes * 60)
    got = runs.groupBy("pump_serial", "session").agg(F.min("timestamp").alias("first_occlusion_ts"), F.max("timestamp").alias("last_occlusion_ts"), F.count(F.lit(1)).alias("occlusion_count"))
    return got.where(F.col("occlusion_count") >= c.min_occlusions_for_cluster).drop("session")


def resolved(runs: DataFrame, events: DataFrame) -> DataFrame:
    """Runs with the first site change after each that no alarm forced.

    A backward sweep over runs' ends and site changes in one order; changes come before ends of the same instant.
    """
    change = events.where("event_type = 'site_change' and not coalesce(forced_by_alarm, false)").select("pump_serial", F.col("timestamp").alias("t"), F.lit(0).alias("o"), F.col("timestamp").alias("change"))
    ends = runs.select("pump_serial", F.col("last_occlusion_ts").alias("t"), F.lit(1).alias("o"), F.lit(None).cast("timestamp").alias("change"), "first_occlusion_ts", "last_occlusion_ts", "occlusion_count")
    back = ends.unionByName(change, allowMissingColumns=True).withColumns({"_t": -F.unix_micros("t"), "_o": -F.col("o")})
    both = with_last(back, "pump_serial", "_t", CHUNK * 1_000_000, ["_t", "_o"], F.col("change"), "resolved").where("o = 1")
    return both.select("pump_serial", "first_occlusion_ts", "last_occlusion_ts", "occlusion_count", F.col("resolved").alias("resolved_by_site_change_ts"), ((F.unix_micros("resolved") - F.unix_micros("last_occlusion_ts")) / 60e6).alias("resolution_delay_minutes"))


def site_issues(alarms: DataFrame, events: DataFrame, c: SiteChange) -> DataFrame:
    """Runs of occlusion alarms, and the first site change after each that no alarm forced."""
    return resolved(occlusion_runs(alarms, c), events)


def cgm_gaps(alarms: DataFrame) -> DataFrame:
    """Out-of-range alarms from activation to the next activation or clearing; acknowledgements don't count.  seqnum is the activation's."""
    rows = pair(alarms.where("alarm_name = 'cgm_out_of_range'"), "pump_serial", ["timestamp", "seqnum"], F.col("action") == "activated", F.col("action") == "cleared")
    return rows.select("pump_serial", F.col("timestamp").alias("start_ts"), "end_ts", ((F.unix_micros("end_ts") - F.unix_micros("timestamp")) / 60e6).alias("duration_minutes"), F.col("end_ts").isNull().alias("ongoing"), "seqnum")


def enrich_all(frames: dict[str, DataFrame], c: SiteChange) -> dict[str, DataFrame]:
    """All nine tables; frames that are missing are left out of what depends on them."""
    out = dict(frames)
    if "requests" in out:
        out["requests"] = enrich_requests(out["requests"])
    if "events" in out and "alarms" in out:
        out["events"] = tag_forced(out["events"], out["alarms"], c)
        out["site_issues"] = site_issues(out["alarms"], out["events"], c)
    if "alarms" in out:
        out["cgm_gaps"] = cgm_gaps(out["alarms"])
    return out


def original_view(frames: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Without what enrichment adds."""
    strip = {"requests": ("bolus_category", "override_delta"), "events": ("forced_by_alarm",)}
    return {k: v.drop(*strip.get(k, ())) for k, v in frames.items() if k not in ("site_issues", "cgm_gaps")}


def backfill(frames: dict[str, DataFrame], c: SiteChange) -> dict[str, DataFrame]:
    """Enriches what lacks its derived columns, or holds rows but none of their values; table by table, others stay.

    A derived table that is missing or empty is derived again.  Emptiness is looked at on single rows.
    """
    out = dict(frames)

    def lacks(name: str, column: str) -> bool:
        df = out.get(name)
        return df is not None and (column not in df.columns or not df.where(F.col(column).isNotNull()).take(1) and bool(df.take(1)))

    if lacks("requests", "bolus_category"):
        out["requests"] = enrich_requests(out["requests"].drop("bolus_category", "override_delta"))
    if "alarms" in out:
        if lacks("events", "forced_by_alarm"):
            out["events"] = tag_forced(out["events"].drop("forced_by_alarm"), out["alarms"], c)
        if "events" in out and ("site_issues" not in out or not out["site_issues"].take(1)):
            out["site_issues"] = site_issues(out["alarms"], out["events"], c)
        if "cgm_gaps" not in out or not out["cgm_gaps"].take(1):
            out["cgm_gaps"] = cgm_gaps(out["alarms"])
    return out
