"""Builders: raw pump events to normalised tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sequences import pair

#: Codes of the device's event log and their names.
RATE_SOURCES = {0: "suspended", 1: "profile", 2: "temp_rate", 3: "algorithm", 4: "temp_rate_and_algorithm"}
SUSPEND_REASONS = {0: "user", 1: "alarm", 2: "malfunction", 6: "plgs_auto"}
USER_MODES = {0: "normal", 1: "sleeping", 2: "exercising", 3: "eating_soon"}
CONTROL_MODES = {0: "no_control", 1: "open_loop", 2: "pining", 3: "closed_loop"}
ALERT_NAMES = {50: "high_bg_alert", 51: "low_bg_alert"}
CGM_ALERTS = {1: "cgm_urgent_low", 2: "cgm_high", 3: "cgm_low", 6: "cgm_rise_rate", 8: "cgm_fall_rate", 14: "cgm_out_of_range"}
#: Seconds from 1970 to the sensor clock's zero, 2008-01-01.
SENSOR_EPOCH = 1199145600


def named(code: Column, names: dict[int, str], other: Column | None = None) -> Column:
    pairs = [x for k, v in names.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.create_map(*pairs)[code], F.lit("unknown") if other is None else other)


def first_rows(df: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def sensor_time(raw: Column, tz: str) -> Column:
    """Sensor seconds are a wall clock: the zone is attached, nothing converted; null from zero down."""
    return F.when(raw > 0, F.to_utc_timestamp(F.timestamp_seconds(raw + SENSOR_EPOCH), tz))


def read_cgm(raw: DataFrame, tz: str) -> DataFrame:
    """Readings of raw events: backfilled ones with a usable sensor time carry it as their timestamp and keep the pump's
    in sensor_timestamp, which is null in all other rows.  Columns of raw that aren't a reading's own go along."""
    backfilled = F.coalesce(F.col("data_type") == 2, F.lit(False))
    sensor = sensor_time(F.col("egv_seconds"), tz)
    moved = backfilled & sensor.isNotNull()
    own = ("pump_serial", "seqnum", "event_ts", "bg", "data_type", "egv_seconds")
    return raw.select(
        "pump_serial", "seqnum", F.when(moved, sensor).otherwise(F.col("event_ts")).alias("timestamp"),
        F.col("bg").cast("int").alias("bg_mgdl"), backfilled.alias("backfilled"), F.when(moved, F.col("event_ts")).alias("sensor_timestamp"), *(c for c in raw.columns if c not in own),
    )


#: Microseconds that a live reading must be after the one before it.
STEP = 60_000_000


def apart(readings: DataFrame) -> DataFrame:
    """Without live readings under a minute after the row before them, judged in one pass.

    That row may itself have gone: so a live reading goes if any other that comes before it is under a minute away.
    """
    before = F.lag("timestamp").over(Window.partitionBy("pump_serial").orderBy("timestamp", "seqnum"))
    return readings.withColumn("_before", before).where(F.col("_before").isNull() | (F.unix_micros("timestamp") - F.unix_micros("_before") >= STEP) | F.col("backfilled")).drop("_before")


def build_cgm(raw: DataFrame, tz: str) -> DataFrame:
    """pump_serial, seqnum, timestamp, bg_mgdl, backfilled, sensor_timestamp from (pump_serial, seqnum, event_ts, bg, data_type, egv_seconds, ingest_ord).

    Of a repeated key the first row in order of arrival stays; then rows too near to the one before them go.
    """
    return apart(read_cgm(first_rows(raw, ["pump_serial", "seqnum"], ["ingest_ord"]), tz).drop("ingest_ord"))


def bolus_source(options: Column, override: Column) -> Column:
    return F.when(options.isNull() | (options < 0) | (options > 7), "unknown").when(options.isin(3, 6), "auto").when(override == 1, "override").otherwise("user")


def build_requests(msg1: DataFrame, msg2: DataFrame, msg3: DataFrame) -> DataFrame:
    """Message 1 with what the last messages 2 and 3 of the same bolus say."""
    key = ["pump_serial", "bolus_id"]
    last = lambda df: first_rows(df, key, [F.col("ingest_ord").desc()]).drop("ingest_ord")
    second = last(msg2).select(*key, bolus_source(F.col("options"), F.col("user_override")).alias("bolus_source"))
    joined = last(msg1).join(second, key, "left").join(last(msg3), key, "left")
    return joined.withColumn("bolus_source", F.coalesce("bolus_source", F.lit("unknown")))


def orphans(messages: DataFrame, msg1: DataFrame) -> DataFrame:
    """Messages 2 or 3 whose bolus has no message 1."""
    return messages.join(msg1.select("pump_serial", "bolus_id"), ["pump_serial", "bolus_id"], "left_anti")


def build_basal(raw: DataFrame) -> DataFrame:
    return raw.select("pump_serial", "timestamp", (F.col("commanded_rate_milli") / 1000.0).alias("commanded_rate"), named(F.col("rate_source_code"), RATE_SOURCES).alias("rate_source"))


def build_suspension(raw: DataFrame, alarms: DataFrame) -> DataFrame:
    """Suspensions paired with the next suspend or resume; of the pump alarms activated at the same instant the one with
    the lowest seqnum is the cause.

    A second suspend closes the first and makes it suspect; so does a length of over a day.
    """
    paired = pair(raw, "pump_serial", ["timestamp", "seqnum"], F.col("kind") == "suspend", F.col("kind") == "resume")
    minutes = (F.unix_micros("end_ts") - F.unix_micros("timestamp")) / 60e6
    fired = alarms.where("category = 'alarm' and action = 'activated'")
    cause = fired.groupBy("pump_serial", "timestamp").agg(F.min_by(F.struct("alarm_id", "alarm_name"), "seqnum").alias("cause"))
    rows = paired.join(cause, ["pump_serial", "timestamp"], "left")
    by_alarm = F.col("suspend_reason") == "alarm"
    return rows.select(
        "pump_serial", F.col("timestamp").alias("suspend_timestamp"), F.col("end_ts").alias("resume_timestamp"), minutes.alias("duration_minutes"), "suspend_reason", "insulin_at_suspend",
        F.coalesce(F.col("end_open") | (minutes > 1440), F.lit(False)).alias("pairing_suspect"),
        F.when(by_alarm, F.col("cause.alarm_id")).alias("alarm_id"), F.when(by_alarm, F.col("cause.alarm_name")).alias("alarm_name"),
    )


#: Kinds of raw events, and the type and subtype they become; null where the event's code decides.
EVENT_TYPES = {
    "cartridge_filled": ("site_change", "cartridge"), "cannula_filled": ("site_change", "cannula"), "tubing_filled": ("site_change", "tubing"),
    "session_join": ("cgm_session", "join"), "session_stop": ("cgm_session", "stop"), "user_mode": ("mode_change", None), "pcm": ("pcm_change", None),
    "new_day": ("daily_marker", "new_day"), "daily_status": ("daily_marker", "daily_status"),
}
#: What the details of each kind hold, as (name in details, column).
EVENT_DETAILS = {
    "cartridge_filled": [("insulin_volume", "volume")], "cannula_filled": [("prime_size", "prime_size")], "tubing_filled": [("prime_size", "prime_size")],
    "user_mode": [("requested_action", "requested_action"), ("exercise_time", "exercise_time")], "pcm": [("previous_pcm", "previous_code")],
    "new_day": [("commanded_basal_rate", "commanded_basal_rate")], "daily_status": [("pump_control_state", "pump_control_state"), ("user_mode", "status_user_mode")],
}


def build_events(raw: DataFrame) -> DataFrame:
    """Pump events: nine kinds with their payload to (type, subtype, previous mode, details as JSON); other kinds go.

    raw: pump_serial, seqnum, timestamp, kind, code, previous_code and the payload columns of EVENT_DETAILS.
    """
    kind, code, before = F.col("kind"), F.col("code"), F.col("previous_code")
    unknown = lambda c: F.concat(F.lit("unknown_"), c.cast("string"))
    subtype, event_type = F.when(kind == "user_mode", named(code, USER_MODES, unknown(code))).when(kind == "pcm", named(code, CONTROL_MODES, unknown(code))), F.lit(None).cast("string")
    details = F.lit("{}")
    for name, (type_, sub) in EVENT_TYPES.items():
        event_type = F.when(kind == name, type_).otherwise(event_type)
        subtype = subtype if sub is None else subtype.when(kind == name, sub)
    for name, pairs in EVENT_DETAILS.items():
        details = F.when(kind == name, F.to_json(F.struct(*(F.col(c).alias(n) for n, c in pairs)), {"ignoreNullFields": "false"})).otherwise(details)
    mode = F.when(kind == "user_mode", named(before, USER_MODES, unknown(before)))
    return raw.where(kind.isin(list(EVENT_TYPES))).select("pump_serial", "seqnum", "timestamp", event_type.alias("event_type"), subtype.alias("event_subtype"), mode.alias("previous_mode"), details.alias("details"))


def build_alarms(raw: DataFrame) -> DataFrame:
    """Three categories; names of some ids are fixed, others come from the event; without one, category and id.

    A sensor alert that nothing names is unknown_<id>.  param1 and param2 are the event's, null where it has none.
    """
    i, category, raw_name = F.col("alarm_id"), F.col("category"), F.col("raw_name")
    or_id = lambda prefix: F.coalesce(raw_name, F.concat(F.lit(prefix), i.cast("string")))
    name = F.when(category == "alert", named(i, ALERT_NAMES, or_id("alert_"))).when(category == "cgm_alert", named(i, CGM_ALERTS, or_id("unknown_"))).otherwise(or_id("alarm_"))
    params = (F.col(c).cast("double").alias(c) for c in ("param1", "param2"))
    return raw.select("pump_serial", "seqnum", "timestamp", "category", "action", "alarm_id", name.alias("alarm_name"), *params)


def thin_live(readings: DataFrame, interval_minutes: int = 5) -> DataFrame:
    """One reading for each UTC bucket: the latest."""
    last = F.max_by(F.struct("timestamp", "bg_mgdl"), F.struct("timestamp", "seqnum"))
    return readings.groupBy("pump_serial", F.window("timestamp", f"{interval_minutes} minutes").start.alias("bucket")).agg(last.alias("r")).select("pump_serial", "bucket", "r.timestamp", "r.bg_mgdl")


def unhandled(raw: DataFrame, known: list[str]) -> DataFrame:
    return raw.where(~F.col("event_class").isin(known)).groupBy("event_class").agg(F.count(F.lit(1)).alias("n"))
