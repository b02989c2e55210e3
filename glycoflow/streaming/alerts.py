"""The live loop: readings stream in, fast rises are detected with state for each pump, alerts are claimed once.

A pump's state is its last window of readings, when it last fired and how many readings came too late.  A timer at the
end of an idle time, by the stream's watermark, clears the state of pumps that fall silent.  A micro-batch may run again
after a failure; claiming by event_ref makes that harmless.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta, timezone
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import Config
from ..functions.time import iso_minute
from ..operators.detect import hour_multiplier
from ..functions.time import local
from ..shipping import ship
from ..sources.storage import ParquetStore

KIND = "meal_rise"
_OUT = "pump_serial string, anchor_ts timestamp, start_level int, end_level int, slope double, needed double"
#: How late readings may be for the watermark, and how long after its last reading a pump's state is kept.
LATE, IDLE_HOURS = "1 hour", 6
#: The state store that timers and state variables need.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def slopes_of(t: np.ndarray, v: np.ndarray, first: np.ndarray, last: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Theil-Sen slopes of many windows of one series at once: number of samples, first value and slope of each.

    Window i holds the readings from first[i] to last[i] for which keep(j, last) holds: those not followed by another
    of their sensor bucket up to last[i].  A window has few samples, so all pairs of all windows are one small array.
    """
    width = int((last - first).max()) + 1 if len(first) else 0
    at = first[:, None] + np.arange(width)
    at = np.minimum(at, last[:, None])
    inside = (first[:, None] + np.arange(width) <= last[:, None]) & ((at == last[:, None]) | keep[at])
    order = np.argsort(~inside, axis=1, kind="stable")
    at, n = np.take_along_axis(at, order, axis=1), inside.sum(axis=1)
    most = int(n.max()) if len(n) else 0
    at, valid = at[:, :most], np.arange(most) < n[:, None]
    i, j = np.triu_indices(most, 1)
    dt = (t[at[:, j]] - t[at[:, i]]).astype(float)
    ok = valid[:, j] & valid[:, i] & (dt > 0)
    slopes = np.where(ok, (v[at[:, j]] - v[at[:, i]]) * 60.0 / np.where(ok, dt, 1.0), np.nan)
    median = np.full(len(n), np.nan)
    some = ok.any(axis=1)
    median[some] = np.nanmedian(slopes[some], axis=1)
    return n, v[at[:, 0]] if most else v[:0], median


class Rises(StatefulProcessor):
    """Fires where a pump's trailing window rises fast enough, at least the refractory time after it last fired."""

    def __init__(self, config: Config, idle_hours: float = IDLE_HOURS):
        self.rise, self.idle = config.meal_rise, idle_hours

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "t array<bigint>, v array<int>, m array<double>")
        self.fired = handle.getValueState("fired", "t bigint")
        self.late = handle.getValueState("late", "n bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        c = self.rise
        width, step = c.window_minutes * 60, c.expected_interval_minutes * 60
        t0, v0, m0 = (np.array(x) for x in self.window.get()) if self.window.exists() else (np.zeros(0),) * 3
        new = pd.concat(list(rows)).sort_values(["t", "seqnum"], kind="stable")
        fresh = new[new["t"] >= t0.max()] if len(t0) else new
        if len(fresh) < len(new):  # late readings are counted, and left to the batch path
            self.late.update(((self.late.get()[0] if self.late.exists() else 0) + len(new) - len(fresh),))
        if not len(fresh):
            return
        t = np.concatenate([t0, fresh["t"]]).astype(np.int64)
        v, m = np.concatenate([v0, fresh["bg_mgdl"]]).astype(float), np.concatenate([m0, fresh["multiplier"]]).astype(float)
        bucket = t // step
        keep = np.append(bucket[1:] != bucket[:-1], True)  # of a bucket the latest counts
        last = np.arange(len(t0), len(t))
        first = np.searchsorted(t, t[last] - width, "left")
        n, start, slope = slopes_of(t, v, first, last, keep)
        needed = c.base_slope_mgdl_per_min * m[last]
        slots = c.window_minutes // c.expected_interval_minutes + 1
        hit = (n >= c.min_samples) & (n / slots >= c.min_coverage) & (start >= c.start_level_min) & (start <= c.start_level_max)
        # A rise that is stale when it arrives isn't sent, and so doesn't begin a pause either.
        hit &= (slope >= needed) & (fresh["seen"].to_numpy() - t[last] <= c.max_reading_age_minutes * 60)
        fired, out = self.fired.get()[0] if self.fired.exists() else -(2**62), []
        for i in np.flatnonzero(hit).tolist():
            if t[last[i]] - fired >= c.refractory_minutes * 60:
                fired = int(t[last[i]])
                out.append((key[0], pd.Timestamp(fired, unit="s"), int(start[i]), int(v[last[i]]), float(slope[i]), float(needed[i])))
        if out:
            self.fired.update((fired,))
        stay = np.flatnonzero((t >= t[-1] - width) & keep)
        self.window.update((t[stay].tolist(), v[stay].astype(int).tolist(), m[stay].tolist()))
        for old in self.handle.listTimers():
            self.handle.deleteTimer(old)
        self.handle.registerTimer(int(t[-1] * 1000 + self.idle * 3_600_000))
        yield pd.DataFrame(out, columns=["pump_serial", "anchor_ts", "start_level", "end_level", "slope", "needed"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        """An idle pump's readings and pause are over by then."""
        self.window.clear()
        self.fired.clear()
        return iter(())

    def close(self) -> None:
        pass


def state_of(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    """A state variable of the loop by pump, read from its checkpoint: `window`, `fired` or `late` (readings too late so far)."""
    got = spark.read.format("statestore").option("stateVarName", name).load(checkpoint)
    return got.select(F.col("key.pump_serial").alias("pump_serial"), "value.*")


def live_readings(raw: DataFrame, config: Config) -> DataFrame:
    """What a live source gives (pump_serial, seqnum, wall_time, bg_mgdl), as readings: the wall clock becomes an instant.

    Values that aren't numbers over zero go.  Works on streams and on tables.
    """
    bg = F.expr("try_cast(bg_mgdl as int)")
    return raw.select("pump_serial", "seqnum", F.to_utc_timestamp("wall_time", config.timezone).alias("timestamp"), bg.alias("bg_mgdl")).where("bg_mgdl > 0 and timestamp is not null")


def newest(readings: DataFrame, n: int) -> DataFrame:
    """Each pump's n newest readings of a table, as one poll asks for."""
    last = Window.partitionBy("pump_serial").orderBy(F.col("timestamp").desc(), F.col("seqnum").desc())
    return readings.withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= n).drop("_n")


def detections(readings: DataFrame, config: Config, seen: Column | None = None) -> DataFrame:
    """Streaming (pump_serial, seqnum, timestamp, bg_mgdl) to rises that fire, at least the refractory time apart.

    seen: when readings arrive, by default the micro-batch's time; rises older than the config allows don't fire.
    Readings behind the watermark are dropped and counted by Spark; those behind their pump's newest, by its state.
    """
    ship(readings.sparkSession)
    readings.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    hour: Column = F.hour(local("timestamp", config.timezone))
    rows = readings.where("bg_mgdl is not null").withWatermark("timestamp", LATE).select("pump_serial", "timestamp", "seqnum", F.unix_seconds("timestamp").alias("t"), "bg_mgdl", hour_multiplier(hour, config.meal_rise).alias("multiplier"), F.unix_seconds(F.current_timestamp() if seen is None else seen).alias("seen"))
    return rows.groupBy("pump_serial").transformWithStateInPandas(Rises(config), _OUT, "Append", "EventTime")


def entry(event_ref: str, delivered: bool, attempt: int, message: str | None = None) -> str:
    """A log entry's payload: what was tried for an alert, the how many-th time, how it went, and the text, so that it can be sent again."""
    return json.dumps({"event_ref": event_ref, "delivered": delivered, "attempt": attempt, "stage": "first" if attempt == 1 else "retry", "message": message, "error": None if delivered else "delivery_failed"})


def claim(store: ParquetStore, config: Config, send: Callable[[Row], bool], now: Callable[[], datetime] = lambda: datetime.now(timezone.utc)) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: claims alerts by event_ref, sends what is new and what is due again, logs, marks the beat.

    An alert that was claimed but never logged, as after a crash, is due like one whose delivery failed.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        at = now()
        per_minute = F.format_number("slope", 1)
        message = F.concat(F.lit("Glucose rises: "), "start_level", F.lit(" to "), "end_level", F.lit(" mg/dL, "), per_minute, F.lit(" a minute"))
        alerts = batch.where(F.col("anchor_ts") >= F.lit(at - timedelta(minutes=config.meal_rise.max_reading_age_minutes))).select(
            F.lit(KIND).alias("alert_kind"), "pump_serial", F.concat(F.lit("meal_rise:"), "pump_serial", F.lit(":"), iso_minute(F.col("anchor_ts"), config.timezone)).alias("event_ref"), F.lit(at).cast("timestamp").alias("fired_at"),
            F.to_json(F.struct("start_level", "end_level", "slope", "needed", message.alias("message"))).alias("payload"),
        )
        due = due_retries(store.alerts().where(F.col("alert_kind") == KIND), store.results().where(F.col("kind") == KIND), at).collect()
        new = store.record_alerts(alerts).collect()  # a micro-batch's new alerts: one a pump and hour at most
        tries = [(r, 1) for r in new] + [(r, r["attempts"] + 1) for r in due]
        log = [(KIND, r["fired_at"], entry(r["event_ref"], send(r), n, json.loads(r["payload"]).get("message"))) for r, n in tries]
        if log:
            store.record_results(batch.sparkSession.createDataFrame(log, "kind string, anchor_timestamp timestamp, payload string"))
        store.set_fetch_state("live_cron", "heartbeat", at)

    return sink


def due_retries(alerts: DataFrame, log: DataFrame, now: datetime, attempts: int = 3, pause_minutes: int = 15, within_hours: int = 24) -> DataFrame:
    """Alerts of the last hours that no log entry says went out, with fewer than `attempts` tries, and none just now.

    Adds attempts, the tries so far: the largest that a log entry names, or as many as failed."""
    p = F.from_json("payload", "event_ref string, delivered boolean, attempt int")
    said = log.select(p.alias("p"), "created_at").where("p.event_ref is not null")
    tried = said.groupBy(F.col("p.event_ref").alias("event_ref")).agg(F.coalesce(F.max("p.attempt"), F.count_if(~F.col("p.delivered")).cast("int")).alias("attempts"), F.bool_or("p.delivered").alias("delivered"), F.max("created_at").alias("last_ts"))
    got = alerts.where(F.col("fired_at") >= F.lit(now - timedelta(hours=within_hours))).join(tried, "event_ref", "left").fillna({"attempts": 0, "delivered": False})
    return got.where(~F.col("delivered") & (F.col("attempts") < attempts) & (F.coalesce("last_ts", "fired_at") <= F.lit(now - timedelta(minutes=pause_minutes)))).select(*alerts.columns, "attempts")


def start(readings: DataFrame, store: ParquetStore, config: Config, send: Callable[[Row], bool], checkpoint: str, now: Callable[[], datetime] = lambda: datetime.now(timezone.utc), available_now: bool = False):
    """Runs the loop: every five minutes, or over all that is there, at one instant."""
    seen = F.lit(now()).cast("timestamp") if available_now else None
    writer = detections(readings, config, seen).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(claim(store, config, send, now))
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="5 minutes")).start()
