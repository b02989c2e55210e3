import json
from dataclasses import replace
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from glycoflow.config import Config, MealRise
from glycoflow.sources.storage import ParquetStore
from glycoflow.streaming.alerts import claim, due_retries, live_readings, newest, slopes_of, start, state_of

T = datetime(2026, 5, 13, 20, tzinfo=timezone.utc)
DDL = "pump_serial string, seqnum long, timestamp timestamp, bg_mgdl int"


def test_alerts_once(spark, tmp_path):
    config = replace(Config(), meal_rise=MealRise(meal_windows=(), off_hours_multiplier=1.0))
    source, store, sent = str(tmp_path / "in"), ParquetStore(spark, str(tmp_path / "store")), []

    def feed(first, values):
        spark.createDataFrame([("p", first + i, T + timedelta(minutes=5 * (first + i)), v) for i, v in enumerate(values)], DDL).coalesce(1).write.mode("append").parquet(source)

    def run(minutes):
        stream = spark.readStream.schema(DDL).parquet(source)
        start(stream, store, config, lambda r: sent.append(r["event_ref"]) or True, str(tmp_path / "check"), now=lambda: T + timedelta(minutes=minutes), available_now=True).awaitTermination()

    feed(0, [100 + 12 * i for i in range(4)])
    run(20)
    assert sent == []  # too little of a window
    feed(4, [148, 160, 172])
    run(32)
    assert len(sent) == 1 and sent[0].startswith("meal_rise:p:2026-05-13T13:")
    feed(7, [184, 196])
    run(45)
    assert len(sent) == 1  # refractory, across restarts
    assert store.get_fetch_state("live_cron") is not None
    feed(30, [100 + 12 * i for i in range(7)])
    run(2000)
    assert len(sent) == 1  # stale by now
    assert store.list_results("meal_rise").count() == 1


def test_a_stale_rise_starts_no_pause(spark, tmp_path):
    """Readings that arrive late would fire, but are too old: the next rise, within the pause of the first, is sent."""
    config = replace(Config(), meal_rise=MealRise(meal_windows=(), off_hours_multiplier=1.0))
    source, store, sent = str(tmp_path / "in"), ParquetStore(spark, str(tmp_path / "store")), []
    for first, values, minutes in ((0, [100, 112, 124, 136, 148, 160, 172], 60), (7, [184, 196], 41)):
        spark.createDataFrame([("p", first + i, T + timedelta(minutes=5 * (first + i)), v) for i, v in enumerate(values)], DDL).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(DDL).parquet(source)
        start(stream, store, config, lambda r: sent.append(r["event_ref"]) or True, str(tmp_path / "check"), now=lambda m=minutes: T + timedelta(minutes=m), available_now=True).awaitTermination()
    assert len(sent) == 1


def test_claimed_but_never_logged(spark, tmp_path):
    """An alert that was claimed before a crash is sent by the next micro-batch after the pause."""
    store, sent = ParquetStore(spark, str(tmp_path / "store")), []
    row = ("meal_rise", "p", "meal_rise:p:x", T, "{}")
    store.record_alerts(spark.createDataFrame([row], "alert_kind string, pump_serial string, event_ref string, fired_at timestamp, payload string"))
    empty = spark.createDataFrame([], "pump_serial string, anchor_ts timestamp, start_level int, end_level int, slope double, needed double")
    sink = lambda minutes: claim(store, Config(), lambda r: sent.append(r["event_ref"]) or True, lambda: T + timedelta(minutes=minutes))(empty, 0)
    sink(5)
    assert sent == []
    sink(20)
    sink(25)
    assert sent == ["meal_rise:p:x"]


def test_live_readings(spark):
    raw = spark.createDataFrame([("p", i, f"2026-05-13 06:{i:02d}:00", v) for i, v in enumerate(["100", "x", "0", "110", None, "120"])], "pump_serial string, seqnum long, wall_time string, bg_mgdl string")
    got = newest(live_readings(raw.withColumn("wall_time", raw["wall_time"].cast("timestamp")), Config()), 2).orderBy("seqnum").collect()
    assert [(r["seqnum"], r["bg_mgdl"], r["timestamp"].astimezone(timezone.utc).hour) for r in got] == [(3, 110, 13), (5, 120, 13)]


def test_retries(spark):
    row = lambda ref, delivered, minutes, attempt=None: ("meal_rise", T, json.dumps({"event_ref": ref, "delivered": delivered, "attempt": attempt}), T - timedelta(minutes=minutes))
    log = [row("a", False, 60, 1), row("b", False, 60, 1), row("b", True, 30, 2), row("c", False, 5, 1), *[row("d", False, 100 + i) for i in range(3)], row("e", False, 2000), row("h", False, 50, 3), ("meal_rise", T, "no json", T)]
    log = spark.createDataFrame(log, "kind string, anchor_timestamp timestamp, payload string, created_at timestamp")
    alerts = spark.createDataFrame([(x, T - timedelta(minutes=2000 if x == "e" else 300 if x != "g" else 5)) for x in "abcdefgh"], "event_ref string, fired_at timestamp")
    assert sorted((r["event_ref"], r["attempts"]) for r in due_retries(alerts, log, T).collect()) == [("a", 1), ("f", 0)]


def test_a_failed_alert_is_sent_again_with_its_text(spark, tmp_path):
    """Three tries in all, each logged with its number and the message."""
    store, clock, sent = ParquetStore(spark, str(tmp_path / "store")), {"at": T}, []
    batch = spark.createDataFrame([("p", T, 100, 172, 2.4, 1.8)], "pump_serial string, anchor_ts timestamp, start_level int, end_level int, slope double, needed double")
    sink = claim(store, Config(), lambda r: sent.append(json.loads(r["payload"])["message"]) or False, lambda: clock["at"])
    sink(batch, 0)
    for i in range(1, 4):
        # The log's own time is the wall clock's: look from far enough ahead.
        clock["at"] = datetime.now(timezone.utc) + timedelta(minutes=20 * i)
        store._replace("alerts", store.staged(store.alerts().withColumn("fired_at", F.lit(clock["at"] - timedelta(hours=1))), "alerts"))
        sink(batch.where("false"), i)
    assert sent == ["Glucose rises: 100 to 172 mg/dL, 2.4 a minute"] * 3
    log = [json.loads(r["payload"]) for r in store.list_results("meal_rise").collect()]
    assert sorted((x["attempt"], x["stage"], x["delivered"], x["error"], x["message"] == sent[0]) for x in log) == [(1, "first", False, "delivery_failed", True), (2, "retry", False, "delivery_failed", True), (3, "retry", False, "delivery_failed", True)]


def test_late_rows_are_counted_and_idle_state_expires(spark, tmp_path):
    """Restarted for each step: late readings change nothing but a count; a pump silent for hours loses its state, others keep theirs."""
    config = replace(Config(), meal_rise=MealRise(meal_windows=(), off_hours_multiplier=1.0))
    source, checkpoint, store, sent = str(tmp_path / "in"), str(tmp_path / "check"), ParquetStore(spark, str(tmp_path / "store")), []

    def feed(pump, minutes):
        rows = [(pump, m, T + timedelta(minutes=m), 100 + 2 * (m % 60)) for m in minutes]
        spark.createDataFrame(rows, DDL).coalesce(1).write.mode("append").parquet(source)

    def run(minutes):
        stream = spark.readStream.schema(DDL).parquet(source)
        start(stream, store, config, lambda r: sent.append(r["event_ref"]) or True, checkpoint, now=lambda: T + timedelta(minutes=minutes), available_now=True).awaitTermination()

    late = lambda: {r["pump_serial"]: r["n"] for r in state_of(spark, checkpoint, "late").collect()}
    held = lambda: {r["pump_serial"]: r["t"] for r in state_of(spark, checkpoint, "window").collect()}
    feed("p", [0, 5, 10, 15, 20])
    feed("q", [0, 5])
    run(20)
    assert len(sent) == 1 and late() == {} and {p: len(t) for p, t in held().items()} == {"p": 5, "q": 2}
    before = held()["p"]
    feed("p", [12, 14])  # behind the newest of the pump
    run(21)
    assert late() == {"p": 2} and held()["p"] == before and len(sent) == 1
    feed("q", [450])
    run(451)
    feed("q", [455])
    run(456)
    assert set(held()) == {"q"} and len(held()["q"]) == 2  # p has been silent for more than six hours
    feed("p", [420, 425, 430, 435, 440])
    run(441)
    assert len(held()["p"]) == 5 and len(sent) == 2  # as a pump that is new


def test_slopes_of_many_windows(spark):
    """As one window at a time gives, with repeated instants, several readings of a bucket and gaps."""
    import numpy as np

    rng = np.random.default_rng(3)
    t = np.sort(rng.integers(0, 20_000, 300))
    v = rng.integers(60, 250, 300).astype(float)
    bucket = t // 300
    keep = np.append(bucket[1:] != bucket[:-1], True)
    last = np.arange(40, 300)
    first = np.searchsorted(t, t[last] - 1800)
    n, begin, slope = slopes_of(t, v, first, last, keep)
    for i, (a, b) in enumerate(zip(first, last)):
        rows = [j for j in range(a, b + 1) if j == b or keep[j]]
        pairs = [(v[y] - v[x]) * 60 / (t[y] - t[x]) for k, x in enumerate(rows) for y in rows[k + 1 :] if t[y] > t[x]]
        assert n[i] == len(rows) and begin[i] == v[rows[0]] and (abs(slope[i] - np.median(pairs)) < 1e-9 if pairs else np.isnan(slope[i]))
