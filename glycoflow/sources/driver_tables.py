"""Domain tables derived from the generic `events` table by fixed expressions, lazily and per column.

Timestamps are cut to whole seconds and held as instants in UTC; a pump stands for 75 users.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.time import use_utc
from ..operators.build import build_basal, build_requests, build_suspension
from ..operators.enrich import cgm_gaps, enrich_requests, site_issues, tag_forced
from ..config import SiteChange


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    use_utc(spark)
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").alias("seqnum"), F.date_trunc("second", F.col("ts").cast("timestamp")).alias("timestamp"), F.expr("cast(user_id div 75 as string)").alias("pump_serial"),
        "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def cgm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source(spark, sf_dir).select("pump_serial", "seqnum", "timestamp", F.floor(F.least(F.lit(400.0), 40 + 2 * F.col("value"))).cast("int").alias("bg_mgdl"), (F.col("event_type") == "error").alias("backfilled"))


def bolus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source(spark, sf_dir).where("event_type = 'purchase'").select("pump_serial", F.col("seqnum").alias("bolus_id"), "timestamp", (F.col("value") / 20).alias("insulin_units"))


def request_messages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three messages per bolus request; some lack the second or third, and error rows leave messages without a first."""
    e = source(spark, sf_dir).withColumnRenamed("seqnum", "bolus_id")
    own = e.where("event_type in ('purchase', 'signup')")
    one = own.select("pump_serial", "bolus_id", "timestamp", F.col("k").alias("carbs_g"), F.floor(F.least(F.lit(400.0), 40 + 2 * F.col("value"))).cast("int").alias("bg_mgdl"), (F.col("value") / 100).alias("iob"), F.lit(0).alias("ingest_ord"))
    two = e.where("event_type in ('purchase', 'signup', 'error') and k % 7 <> 0").select("pump_serial", "bolus_id", (F.col("k") % 9).alias("options"), (F.col("k") % 2).alias("user_override"), F.lit(0).alias("ingest_ord"))
    food, fix = F.col("value") / 25, F.when(F.col("k") % 3 == 0, F.col("value") / 50).otherwise(0.0)
    extra = F.when(F.col("k") % 4 == 1, 0.5).when(F.col("k") % 4 == 2, -0.25).otherwise(0.0)
    food = F.when(F.col("k") % 5 == 0, 0.0).otherwise(food)
    three = own.where("k % 11 <> 0").select("pump_serial", "bolus_id", food.alias("food_insulin"), fix.alias("correction_insulin"), (food + fix + extra).alias("total_requested"), F.lit(0).alias("ingest_ord"))
    return one, two, three


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich_requests(build_requests(*request_messages(spark, sf_dir)))


def basal_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source(spark, sf_dir).where("event_type = 'view'").select("pump_serial", "seqnum", "timestamp", F.floor(F.col("value") * 20).cast("long").alias("commanded_rate_milli"), (F.col("k") % 6).alias("rate_source_code"))


def basal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return basal_raw(spark, sf_dir).select("pump_serial", "seqnum", "timestamp", (F.col("commanded_rate_milli") / 1000.0).alias("commanded_rate"), "rate_source_code")


def alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    name = F.when(k % 4 == 0, "OcclusionAlarm").when(k % 4 == 1, "cgm_out_of_range").when(k % 4 == 2, "BatteryShutdownAlarm").otherwise("LowInsulinAlert")
    return source(spark, sf_dir).where("event_type in ('error', 'click')").select("pump_serial", "seqnum", "timestamp", F.when(k % 4 == 1, "cgm_alert").when(k % 4 == 3, "alert").otherwise("alarm").alias("category"), F.when(k % 3 == 0, "activated").when(k % 3 == 1, "cleared").otherwise("ack").alias("action"), k.alias("alarm_id"), name.alias("alarm_name"))


def suspension_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    return source(spark, sf_dir).where("event_type = 'click'").select("pump_serial", "seqnum", "timestamp", F.when(k % 2 == 0, "suspend").otherwise("resume").alias("kind"), F.when(k % 4 == 0, "alarm").otherwise("user").alias("suspend_reason"), F.floor("value").cast("int").alias("insulin_at_suspend"))


def suspension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_suspension(suspension_raw(spark, sf_dir), alarms(spark, sf_dir))


def pump_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    subtype = F.when(k % 3 == 0, "cartridge").when(k % 3 == 1, "cannula").otherwise("tubing")
    return source(spark, sf_dir).where("event_type = 'signup'").select("pump_serial", "seqnum", "timestamp", F.lit("site_change").alias("event_type"), subtype.alias("event_subtype"), F.lit(None).cast("string").alias("previous_mode"), F.to_json(F.struct((k * 3).alias("insulin_volume"))).alias("details"))


def basal_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_basal(basal_raw(spark, sf_dir))


def all_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Site changes, and user mode changes from purchases."""
    modes = source(spark, sf_dir).where("event_type = 'purchase' and k % 5 = 0").select("pump_serial", "seqnum", "timestamp", F.lit("mode_change").alias("event_type"))
    return pump_events(spark, sf_dir).unionByName(modes, allowMissingColumns=True)


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts sent: one for each activated alarm."""
    delivery = F.when(F.col("alarm_id") % 2 == 0, "sent").when(F.col("alarm_id") % 5 == 0, "failed").otherwise("pending")
    return alarms(spark, sf_dir).where("action = 'activated'").select(F.col("seqnum").alias("id"), F.col("timestamp").alias("fired_at"), "pump_serial", F.col("alarm_name").alias("alert_kind"), delivery.alias("delivery"))


def fetch_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bookmark for each pump, and the live loop's heartbeat."""
    e = source(spark, sf_dir)
    pumps = e.groupBy(F.col("pump_serial").alias("source_id")).agg(F.lit("pump").alias("source_kind"), F.max("timestamp").alias("last_synced_at"))
    live = e.where("event_type = 'click'").agg(F.lit("live_cron").alias("source_id"), F.lit("heartbeat").alias("source_kind"), F.max("timestamp").alias("last_synced_at"))
    return pumps.unionByName(live)


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source(spark, sf_dir).where("event_type = 'view'").select(F.lit("meal_rise").alias("kind"), F.col("timestamp").alias("created_at"))


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same tables as raw events with JSON payloads, from one scan; and some of a class that no builder takes."""
    k, kind = F.col("k"), F.col("event_type")
    own = kind.isin("purchase", "signup")
    food, fix = F.when(k % 5 == 0, 0.0).otherwise(F.col("value") / 25), F.when(k % 3 == 0, F.col("value") / 50).otherwise(0.0)
    extra = F.when(k % 4 == 1, 0.5).when(k % 4 == 2, -0.25).otherwise(0.0)
    bg = F.floor(F.least(F.lit(400.0), 40 + 2 * F.col("value"))).cast("int")
    category = F.when(k % 4 == 1, "cgm_alert").when(k % 4 == 3, "alert").otherwise("alarm")
    name = F.when(k % 4 == 0, "OcclusionAlarm").when(k % 4 == 2, "BatteryShutdownAlarm").when(k % 4 == 3, "LowInsulinAlert")
    number, action = F.when(k % 4 == 1, 14).otherwise(7), F.when(k % 3 == 0, "activated").when(k % 3 == 1, "cleared").otherwise("ack")
    filled = F.when(k % 3 == 0, "cartridge_filled").when(k % 3 == 1, "cannula_filled").otherwise("tubing_filled")
    classes = {
        "cgm": (F.lit(True), [bg.alias("bg"), F.when(kind == "error", 2).otherwise(1).alias("data_type"), F.lit(0).alias("egv_seconds")]),
        "bolus": (kind == "purchase", [F.col("seqnum").alias("bolus_id"), (F.col("value") / 20).alias("insulin_units")]),
        "request1": (own, [F.col("seqnum").alias("bolus_id"), k.alias("carbs_g"), bg.alias("bg_mgdl"), (F.col("value") / 100).alias("iob")]),
        "request2": ((own | (kind == "error")) & (k % 7 != 0), [F.col("seqnum").alias("bolus_id"), (k % 9).alias("options"), (k % 2).alias("user_override")]),
        "request3": (own & (k % 11 != 0), [F.col("seqnum").alias("bolus_id"), food.alias("food_insulin"), fix.alias("correction_insulin"), (food + fix + extra).alias("total_requested")]),
        "basal": (kind == "view", [F.floor(F.col("value") * 20).cast("long").alias("commanded_rate_milli"), (k % 6).alias("rate_source_code")]),
        "suspend": ((kind == "click") & (k % 2 == 0), [F.when(k % 4 == 0, 1).otherwise(0).alias("reason"), F.floor("value").cast("int").alias("insulin")]),
        "resume": ((kind == "click") & (k % 2 == 1), [k.alias("reason")]),
        "alarm": (kind.isin("error", "click"), [category.alias("category"), action.alias("action"), number.alias("alarm_id"), name.alias("raw_name")]),
        "event": (kind == "signup", [filled.alias("kind"), (k * 3).alias("volume"), (k % 25).alias("prime_size")]),
        "heartbeat": ((kind == "view") & (k % 10 == 9), [k.alias("beat")]),
    }
    # Payloads are written behind the explode, so scans that don't need them don't write them.
    each = F.array(*(F.when(holds, F.lit(c)) for c, (holds, _) in classes.items()))
    rows = source(spark, sf_dir).withColumn("event_class", F.explode(each)).where("event_class is not null")
    payload = F.coalesce(*(F.when(F.col("event_class") == c, F.to_json(F.struct(*fields))) for c, (_, fields) in classes.items()))
    return rows.select("event_class", "timestamp", "seqnum", "pump_serial", F.col("seqnum").alias("ingest_ord"), payload.alias("payload"))


def frames(spark: SparkSession, sf_dir: str, c: SiteChange | None = None) -> dict[str, DataFrame]:
    """All nine enriched tables."""
    c = c or SiteChange()
    a = alarms(spark, sf_dir)
    events = tag_forced(pump_events(spark, sf_dir), a, c)
    return {
        "cgm": cgm(spark, sf_dir), "bolus": bolus(spark, sf_dir), "requests": requests(spark, sf_dir), "basal": basal(spark, sf_dir), "suspension": suspension(spark, sf_dir),
        "events": events, "alarms": a, "site_issues": site_issues(a, events, c), "cgm_gaps": cgm_gaps(a).drop("seqnum"),
    }
