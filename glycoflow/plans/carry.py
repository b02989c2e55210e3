"""What new raw events change in tables that hold all events before them.

A window's rows alone don't give what all events together would: intervals that began before it may end in it, alarm
runs go on, a bolus's messages are spread over two windows, a backfilled reading lands among old ones.  Each builder
here gets the little of the stored tables that can still matter beside the window's events, and gives rows that
are right for all events; the store then replaces only what differs.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import partial, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config, SiteChange
from ..operators import build, enrich
from ..operators.joins import range_join
from ..sources.storage import ParquetStore

#: Seconds before a window whose readings decide whether its first ones are kept.
LOOK_BACK = 60


@dataclass(frozen=True)
class Window:
    """since: each pump's start (pump_serial, since).  earliest: the first of them, for filters that reach the scan."""

    store: ParquetStore
    since: DataFrame
    earliest: datetime
    config: Config

    def stored(self, name: str, time: str, seconds: int = 0) -> DataFrame:
        """Stored rows before each pump's window, but not more than so many seconds (0: however old)."""
        t, rows = F.col(time), self.store.read_all(name)
        if seconds:
            rows = rows.where(t >= F.lit(self.earliest - timedelta(seconds=seconds)))
        got = rows.join(self.since, "pump_serial").where(t < F.col("since"))
        return (got.where(t >= F.col("since") - F.make_dt_interval(secs=F.lit(seconds))) if seconds else got).drop("since")


def gaps(w: Window, alarms: DataFrame) -> DataFrame:
    """Sensor gaps of the window's alarms; one that was still open before stands for the alarm that opened it."""
    opened = w.stored("cgm_gaps", "start_ts").where("end_ts is null")
    seeds = opened.select("pump_serial", "seqnum", F.col("start_ts").alias("timestamp"), F.lit("activated").alias("action"), F.lit("cgm_out_of_range").alias("alarm_name"))
    return enrich.cgm_gaps(seeds.unionByName(alarms.select(*seeds.columns)))


def suspensions(w: Window, stops_and_goes: DataFrame, alarms: DataFrame) -> DataFrame:
    """Suspensions of the window; an open one from before goes along with the alarm that caused it."""
    opened = w.stored("suspension", "suspend_timestamp").where("resume_timestamp is null")
    seq, at = F.lit(-1).cast("long").alias("seqnum"), F.col("suspend_timestamp").alias("timestamp")
    seeds = opened.select("pump_serial", seq, at, F.lit("suspend").alias("kind"), "suspend_reason", "insulin_at_suspend")
    causes = opened.where("alarm_name is not null").select("pump_serial", seq, at, F.lit("alarm").alias("category"), F.lit("activated").alias("action"), "alarm_id", "alarm_name")
    return build.build_suspension(seeds.unionByName(stops_and_goes), causes.unionByName(alarms.select(*causes.columns)))


def events(w: Window, new: DataFrame, alarms: DataFrame) -> DataFrame:
    """The window's pump events; alarms that may have forced its first site changes are read from the store."""
    c = w.config.site_change
    return enrich.tag_forced(new, w.stored("alarms", "timestamp", c.forced_window_minutes * 60 + 1).unionByName(alarms, allowMissingColumns=True), c)


def issues(w: Window, alarms: DataFrame, new_events: DataFrame) -> DataFrame:
    """Occlusion runs that reach into the window, from their first alarm on, and older ones that nothing had resolved."""
    c: SiteChange = w.config.site_change
    reach = c.occlusion_cluster_window_minutes * 60
    have = w.stored("site_issues", "first_occlusion_ts")
    near = F.col("last_occlusion_ts") >= F.col("since") - F.make_dt_interval(secs=F.lit(reach))
    # The run that may go on, if it is long enough to be stored; a shorter one has fewer alarms than count, each in reach of the next.
    running = have.join(w.since, "pump_serial").where(near).groupBy("pump_serial").agg(F.min("first_occlusion_ts").alias("first"))
    far = F.make_dt_interval(secs=F.lit(reach * c.min_occlusions_for_cluster + 1))
    edge = w.since.join(running, "pump_serial", "left").select("pump_serial", "since", F.least("first", F.col("since") - far).alias("edge"))
    old = enrich.occlusions(w.store.read_all("alarms")).join(edge, "pump_serial").where("timestamp >= edge and timestamp < since").drop("edge", "since")
    runs = enrich.occlusion_runs(old.unionByName(enrich.occlusions(alarms), allowMissingColumns=True), c)
    runs = runs.join(w.since, "pump_serial").where("last_occlusion_ts >= since").drop("since")
    waiting = have.join(w.since, "pump_serial").where("resolved_by_site_change_ts is null and last_occlusion_ts < since").select(*runs.columns)
    waiting = waiting.join(runs.select("pump_serial", "first_occlusion_ts"), ["pump_serial", "first_occlusion_ts"], "left_anti")
    return enrich.resolved(runs.unionByName(waiting), new_events)


def requests(w: Window, messages: list[DataFrame]) -> DataFrame:
    """Bolus requests of which the window has a message; what only earlier messages said is taken from the stored row."""
    key = ["pump_serial", "bolus_id"]
    # All three messages meet in one grouping; of repeated ones the last to arrive counts, so its number comes first.
    last = [F.struct("ingest_ord", *(c for c in m.columns if c not in (*key, "ingest_ord"))).alias(f"_{i}") for i, m in enumerate(messages, 1)]
    told = reduce(partial(DataFrame.unionByName, allowMissingColumns=True), (m.where("pump_serial is not null and bolus_id is not null").select(*key, s) for m, s in zip(messages, last)))
    touched = told.groupBy(*key).agg(*(F.max(f"_{i}").alias(f"_{i}") for i in (1, 2, 3)))
    source = F.when(F.col("_2").isNotNull(), F.struct(build.bolus_source(F.col("_2.options"), F.col("_2.user_override")).alias("bolus_source")))
    fields = ["timestamp", "carbs_g", "bg_mgdl", "iob", "bolus_source", "food_insulin", "correction_insulin", "total_requested"]
    have = w.store.near("requests", told).select(*key, F.struct(*fields).alias("_old"))
    both = touched.withColumn("_2", source).join(have, key, "left")
    # A message of the window stands for all of its fields, nulls too; without one the stored row's hold.
    of = {"timestamp": "_1", "carbs_g": "_1", "bg_mgdl": "_1", "iob": "_1", "bolus_source": "_2", "food_insulin": "_3", "correction_insulin": "_3", "total_requested": "_3"}
    merged = both.where("_1 is not null or _old is not null").select(*key, *(F.when(F.col(m).isNotNull(), F.col(f"{m}.{f}")).otherwise(F.col(f"_old.{f}")).alias(f) for f, m in of.items()))
    return enrich.enrich_requests(merged.withColumn("bolus_source", F.coalesce("bolus_source", F.lit("unknown"))))


def readings(w: Window, mine: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The window's readings that are kept, and keys of stored ones that a backfilled reading now makes too near.

    mine: the window's readings and those of the minute before it, each once; read several times, so better staged.
    """
    key = ["pump_serial", "seqnum"]
    stored = w.store.near("cgm", mine)
    fresh = mine.join(stored.select(*key), key, "left_anti")
    # Live rows meet what lies within a minute: the window's rows, those of the minute before, and backfilled ones stored since then.
    since = F.col("since") - F.make_dt_interval(secs=F.lit(LOOK_BACK))
    back = w.store.read_all("cgm").where(F.col("backfilled") & (F.col("timestamp") >= F.lit(w.earliest - timedelta(seconds=LOOK_BACK)))).join(w.since, "pump_serial").where(F.col("timestamp") >= since).drop("since")
    known = back.join(mine.select(*key), key, "left_anti")
    kept = build.apart(mine.withColumn("_mine", F.lit(True)).unionByName(known.withColumn("_mine", F.lit(False)))).where("_mine").drop("_mine")
    event_time = F.coalesce("sensor_timestamp", "timestamp")
    kept = kept.join(w.since, "pump_serial").where(event_time >= F.col("since")).drop("since")
    # What is stored already stays as it is.
    kept = kept.join(stored.select(*key), key, "left_anti").unionByName(stored.join(kept.select(*key), key, "left_semi"))
    moved = fresh.where("backfilled").select("pump_serial", F.col("timestamp").alias("_ts"), F.col("seqnum").alias("_seq"), F.unix_seconds("timestamp").alias("_t"))
    # Their times bound what is read of the stored readings.
    span = moved.agg(F.min("_ts").alias("lo"), F.max("_ts").alias("hi")).first()
    live = w.store.read_all("cgm").where("not backfilled")
    if span["lo"] is None:
        return kept, live.where("false").select(*key)
    at = F.col("timestamp")
    live = live.where((at >= F.lit(span["lo"])) & (at <= F.lit(span["hi"] + timedelta(seconds=LOOK_BACK)))).select(*key, "timestamp", F.unix_seconds("timestamp").alias("_at"))
    close = range_join(moved, live, "pump_serial", "_t", "_at", 0, LOOK_BACK)
    after = F.struct("timestamp", "seqnum") > F.struct(F.col("_ts").alias("timestamp"), F.col("_seq").alias("seqnum"))
    return kept, close.where(after & (F.unix_micros("timestamp") - F.unix_micros("_ts") < build.STEP)).select(*key).distinct()
