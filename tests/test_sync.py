import json
import random
from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from glycoflow.config import Config, MealRise
from glycoflow.operators.cluster import DayModel, cluster_days
from glycoflow.operators.detect import slope_sweep
from glycoflow.operators.enrich import backfill, original_view
from glycoflow.plans import sync
from glycoflow.plans.queries import QUERIES
from glycoflow.schema import conform
from glycoflow.sources.storage import ParquetStore

T = datetime(2026, 5, 13, 12, tzinfo=timezone.utc)


def raw(spark):
    rows, n = [], 0

    def add(event_class, minute, **payload):
        nonlocal n
        n += 1
        rows.append((event_class, T + timedelta(minutes=minute), n, "a", n, json.dumps(payload)))

    for i in range(30):
        add("cgm", 5 * i, bg=100 + i, data_type=1, egv_seconds=0)
    add("bolus", 1, bolus_id=1, insulin_units=2.5)
    add("request1", 1, bolus_id=1, carbs_g=30, bg_mgdl=120, iob=0.5)
    add("request2", 1, bolus_id=1, options=0, user_override=0)
    add("request2", 1, bolus_id=9, options=0, user_override=0)
    add("request3", 1, bolus_id=1, food_insulin=2.0, correction_insulin=0.0, total_requested=2.0)
    add("request1", 9, bolus_id=2, carbs_g=0, bg_mgdl=120, iob=0.5)
    add("basal", 0, commanded_rate_milli=800, rate_source_code=1)
    add("basal", 5, commanded_rate_milli=800, rate_source_code=99)
    add("alarm", 10, category="alarm", action="activated", alarm_id=5, raw_name="OcclusionAlarm")
    add("alarm", 20, category="alarm", action="activated", alarm_id=5, raw_name="OcclusionAlarm")
    add("alarm", 30, category="cgm_alert", action="activated", alarm_id=14, raw_name=None)
    add("suspend", 10, reason=1, insulin=100)
    add("resume", 40)
    add("event", 60, kind="cartridge_filled", code=None, previous_code=None, volume=240)
    add("event", 70, kind="user_mode", code=7, previous_code=0, volume=None, requested_action=1)
    add("event", 75, kind="pcm", code=3, previous_code=1)
    add("event", 76, kind="session_join")
    add("event", 77, kind="daily_status", pump_control_state=2, status_user_mode=0)
    add("event", 78, kind="something_else")
    add("mystery", 80)
    return spark.createDataFrame(rows, sync.RAW)


def test_router(spark):
    frames, unknown = sync.build_all(raw(spark), Config())
    assert {r["event_class"]: r["n"] for r in unknown.collect()} == {"mystery": 1}
    assert frames["cgm"].count() == 30 and sorted(r["rate_source"] for r in frames["basal"].collect()) == ["profile", "unknown"]
    assert {r["bolus_id"]: (r["bolus_source"], r["bolus_category"]) for r in frames["requests"].collect()} == {1: ("user", "user_meal"), 2: ("unknown", "unknown")}
    s = frames["suspension"].first()
    assert (s["suspend_reason"], s["alarm_name"], s["duration_minutes"], s["pairing_suspect"]) == ("alarm", "OcclusionAlarm", 30.0, False)
    i = frames["site_issues"].first()
    assert (i["occlusion_count"], i["resolution_delay_minutes"]) == (2, 40.0)
    assert frames["cgm_gaps"].first()["ongoing"]
    assert sorted((r["event_subtype"], r["previous_mode"], r["forced_by_alarm"]) for r in frames["events"].collect()) == [("cartridge", None, False), ("closed_loop", None, None), ("daily_status", None, None), ("join", None, None), ("unknown_7", "normal", None)]
    assert {r["event_subtype"]: json.loads(r["details"]) for r in frames["events"].collect()} == {
        "cartridge": {"insulin_volume": 240}, "closed_loop": {"previous_pcm": 1}, "daily_status": {"pump_control_state": 2, "user_mode": 0}, "join": {}, "unknown_7": {"requested_action": 1, "exercise_time": None}
    }
    plain = original_view(frames)
    assert "bolus_category" not in plain["requests"].columns and "cgm_gaps" not in plain
    filled = backfill(plain, Config().site_change)
    assert set(filled) == set(frames) and filled["events"].where("forced_by_alarm is not null").count() == 1
    again = backfill(frames, Config().site_change)
    assert all(again[n] is frames[n] for n in frames)
    partly = backfill({**frames, "events": frames["events"].drop("forced_by_alarm")}, Config().site_change)
    assert partly["requests"] is frames["requests"] and "forced_by_alarm" in partly["events"].columns


def test_sync_twice(spark, tmp_path):
    store, other = ParquetStore(spark, str(tmp_path / "a")), ParquetStore(spark, str(tmp_path / "b"))
    events = raw(spark)
    second = events.where("event_class = 'cgm'").withColumn("pump_serial", F.lit("b"))
    first = sync.sync(store, events.unionByName(second), Config(), T + timedelta(hours=5), ["a", "b", "absent"])
    assert first["cgm"].inserted == 60 and [r["source_id"] for r in store.list_fetch_state().collect()] == ["a", "b"]
    assert store.read_all("cgm_gaps").first()["ongoing"]
    close = spark.createDataFrame([("alarm", T + timedelta(minutes=200), 99, "a", 99, json.dumps({"category": "cgm_alert", "action": "cleared", "alarm_id": 14}))], sync.RAW)
    again = sync.sync(store, events.unionByName(close), Config(), T + timedelta(hours=6), ["a"])
    assert again["cgm"].inserted == 0 and again["alarms"].inserted == 1
    assert again["cgm"].received == 30 and store.get_fetch_state("b")["last_synced_at"] < store.get_fetch_state("a")["last_synced_at"]
    view = sync.load_view(store, Config(), enriched=True)
    assert set(view) == set(sync.TABLES) and "forced_by_alarm" in view["events"].columns and "bolus_category" not in sync.load_view(store, Config())["requests"].columns
    gap = store.read_all("cgm_gaps").collect()
    assert len(gap) == 1 and not gap[0]["ongoing"] and gap[0]["duration_minutes"] == 170
    assert str(store.get_fetch_state("a")["actual_max_date"]) == "2026-05-13"
    assert sync.bulk_copy(store, other, dry_run=True)["cgm"] == 60 and sync.bulk_copy(store, other)["cgm"].inserted == 60 and other.read_all("cgm").count() == 60
    got = sync.health(store, sync.VERSION)
    assert got["version_matches"] and got["empty_tables"] == [] and got["stacked_seconds"] == 0
    meta = json.loads(store.get_fetch_state("a")["meta"])
    assert meta == {"last_good_chunk_end": "2026-05-13T18:00:00Z", "last_event": "2026-05-13T15:20:00Z"}


def random_stream(spark, seed, days=6, n=420):
    """Events of all classes in order of arrival: long gaps, suspensions and alarm runs, messages hours apart, backfilled readings days late."""
    rng, rows = random.Random(seed), []
    zone = timedelta(hours=-7)  # the pump's wall clock in May
    at = {p: sorted(rng.uniform(0, days * 1440) for _ in range(n)) for p in "ab"}
    for pump, minutes in at.items():
        bolus, waiting = 0, []
        for i, m in enumerate(minutes):
            t = T + timedelta(seconds=round(m * 60))

            def add(event_class, **payload):
                rows.append((event_class, t, len(rows), pump, len(rows), json.dumps(payload)))  # noqa: B023

            roll = rng.random()
            if roll < 0.3:
                for _ in range(rng.choice([1, 1, 2, 3])):  # some under a minute apart
                    add("cgm", bg=rng.randint(60, 250), data_type=1, egv_seconds=0)
                    t += timedelta(seconds=rng.choice([20, 40, 70]))
            elif roll < 0.42:
                late = t - timedelta(minutes=rng.choice([10, 60, 1500, 4000]), seconds=rng.randint(0, 59))
                near = [r for r in rows if r[0] == "cgm" and r[3] == pump and json.loads(r[5])["data_type"] == 1]
                if near and rng.random() < 0.7:  # just before a reading that may be stored already
                    late = rng.choice(near)[1] - timedelta(seconds=rng.choice([5, 30, 59, 60, 90]))
                add("cgm", bg=rng.randint(60, 250), data_type=2, egv_seconds=int((late + zone).timestamp()) - 1199145600)
            elif roll < 0.5:
                bolus += 1
                add("request1", bolus_id=bolus, carbs_g=rng.choice([0, 30]), bg_mgdl=120, iob=0.5)
                waiting += [("request2", dict(bolus_id=bolus, options=rng.randint(0, 8), user_override=rng.randint(0, 1))), ("request3", dict(bolus_id=bolus, food_insulin=2.0, correction_insulin=rng.choice([0.0, 1.0]), total_requested=3.0))]
            elif roll < 0.56 and waiting:
                kind, payload = waiting.pop(0)
                add(kind, **payload)
            elif roll < 0.6:
                add("bolus", bolus_id=bolus, insulin_units=1.5)
            elif roll < 0.66:
                add("basal", commanded_rate_milli=rng.randint(0, 900), rate_source_code=rng.randint(0, 5))
            elif roll < 0.7:
                add("alarm", category="cgm_alert", action=rng.choice(["activated", "cleared", "ack"]), alarm_id=14)
            elif roll < 0.8:
                add("alarm", category="alarm", action="activated", alarm_id=3, raw_name="OcclusionAlarm")
            elif roll < 0.84:
                add("alarm", category="alarm", action="activated", alarm_id=4, raw_name="BatteryShutdownAlarm")
                add("suspend", reason=1, insulin=50)
            elif roll < 0.88:
                add("suspend", reason=rng.choice([0, 1]), insulin=100)
            elif roll < 0.9:
                add("resume")
            elif roll < 0.94:
                add("event", kind=rng.choice(["cartridge_filled", "cannula_filled"]), volume=rng.choice([100, 240]), prime_size=1)
            else:
                add("event", kind="user_mode", code=rng.randint(0, 3), previous_code=0)
    return spark.createDataFrame(rows, sync.RAW)


def everything(store):
    return {n: sorted(map(str, store.read_all(n).collect())) for n in sync.TABLES}


@pytest.mark.parametrize("seed, cuts, overlap", [(1, [900, 4400], 0), (2, [2600], 1)])
def test_incremental_sync_equals_a_rebuild(spark, tmp_path, seed, cuts, overlap):
    """However the stream is cut, all nine tables are what one sync of everything gives."""
    whole, parts = ParquetStore(spark, str(tmp_path / "whole")), ParquetStore(spark, str(tmp_path / "parts"))
    stream = random_stream(spark, seed).cache()
    end = T + timedelta(days=9)
    sync.sync(whole, stream, Config(), end)
    for minute in cuts:
        sync.sync(parts, stream, Config(), T + timedelta(minutes=minute), overlap_days=overlap)
    sync.sync(parts, stream, Config(), end, overlap_days=overlap)
    want, got = everything(whole), everything(parts)
    assert {n: len(rows) > 1 for n, rows in want.items()} == {n: True for n in sync.TABLES}
    for n in sync.TABLES:
        assert got[n] == want[n], n
    if not overlap:
        return
    direct, _ = sync.build_all(stream, Config())
    for n in sync.TABLES:
        assert sorted(map(str, conform(direct[n], n).collect())) == want[n], n
    # Nothing new: nothing is written.  And one pump's news leaves the other's rows alone.
    before = {n: parts._batches(n) for n in sync.TABLES}
    assert not any(r.inserted for r in sync.sync(parts, stream, Config(), end, overlap_days=1).values()) and {n: parts._batches(n) for n in sync.TABLES} == before
    close = spark.createDataFrame([("alarm", end - timedelta(hours=1), 10_000, "a", 10_000, json.dumps({"category": "cgm_alert", "action": "activated", "alarm_id": 14}))], sync.RAW)
    sync.sync(parts, stream.unionByName(close), Config(), end, overlap_days=1)
    old, new = before["cgm_gaps"], parts._batches("cgm_gaps")
    assert len(new) > len(old) and [("b" in b["without"], b["batch"]) for b in new[: len(old)]] == [("b" in b["without"], b["batch"]) for b in old]


def test_small_things(spark, tmp_path):
    meta = spark.createDataFrame([(" b ", None, "2026-01-02", "2026-02-01"), ("a", "x2", "2025-01-02", "2026-02-01"), ("c", "x2", None, None)], "serial string, model string, min_date string, max_date string")
    assert [(r["pump_serial"], r["model"]) for r in sync.pump_metadata(meta).collect()] == [("a", "x2"), ("b", "unknown")]
    assert sync.page_count(0, 30) == 1 and sync.page_count(61, 30) == 3
    assert sync.nearest_date([date(2026, 1, 1), date(2026, 1, 5)], date(2026, 1, 3)) == date(2026, 1, 1) and sync.nearest_date([], date(2026, 1, 1)) is None
    scored = spark.createDataFrame([(1, "uncovered"), (1, "uncovered"), (2, "late_bolused")], "hour_of_day int, label string")
    sync.score_report(scored, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).agg(F.sum("n")).first()[0] == 3
    text = [r[0] for r in spark.read.text(str(tmp_path / "r.md")).collect()]
    assert text[0] == "# Fast rises" and text[-2:] == ["| 1 | 0 | 0 | 2 |", "| 2 | 0 | 1 | 0 |"]
    days = spark.createDataFrame([(float(i), None if i % 3 else float(i % 2), "d") for i in range(20)], "a double, b double, day string")
    got, model = cluster_days(days, ["a", "b"], ["day", "a"], k=2)
    model.save(spark, str(tmp_path / "model"))
    later = spark.createDataFrame([(3.0, None, "x"), (15.0, None, "y")], "a double, b double, day string")
    one, two = (sorted((r["day"], r["cluster_id"], round(r["distance"], 6)) for r in m.assign(later).collect()) for m in (model, DayModel.load(spark, str(tmp_path / "model"))))
    assert one == two and got.count() == 20


def test_gaps_that_begin_in_one_second(spark, tmp_path):
    """Two alarms of one second are two gaps, the first without length; a sync in steps keeps both."""
    def alarm(n, minute, action):
        return ("alarm", T + timedelta(minutes=minute), n, "a", n, json.dumps({"category": "cgm_alert", "action": action, "alarm_id": 14}))

    stream = spark.createDataFrame([alarm(1, 0, "activated"), alarm(2, 0, "activated"), alarm(3, 3000, "cleared"), alarm(4, 3010, "activated"), alarm(5, 3010, "activated"), alarm(6, 3020, "cleared")], sync.RAW)
    store = ParquetStore(spark, str(tmp_path / "store"))
    for minute in (10, 2900, 4000):
        sync.sync(store, stream, Config(), T + timedelta(minutes=minute))
    direct = sync.build_all(stream, Config())[0]["cgm_gaps"]
    assert sorted(map(str, store.read_all("cgm_gaps").collect())) == sorted(map(str, conform(direct, "cgm_gaps").collect()))
    assert sorted(r["duration_minutes"] for r in store.read_all("cgm_gaps").collect()) == [0, 0, 10, 3000]


def counted(df):
    """df, and how many of its rows have been worked out so far."""
    rows = df.sparkSession.sparkContext.accumulator(0)

    def add(batches):
        for batch in batches:
            rows.add(batch.num_rows)
            yield batch

    return df.mapInArrow(add, df.schema), rows


def test_days_are_worked_out_once(spark):
    days, rows = counted(spark.createDataFrame([(float(i), float(i % 2), "d") for i in range(20)], "a double, b double, day string"))
    got, _ = cluster_days(days, ["a", "b"], ["day", "a"], k=2)
    assert len(got.collect()) == 20 and rows.value == 20


def test_scores_are_worked_out_once(spark, tmp_path):
    scored, rows = counted(spark.createDataFrame([(1, "uncovered"), (1, "uncovered"), (2, "late_bolused")], "hour_of_day int, label string"))
    sync.score_report(scored, str(tmp_path / "r"))
    assert rows.value == 3 and spark.read.text(str(tmp_path / "r.md")).count() == 6


def test_slopes_are_worked_out_once(spark):
    slopes, rows = counted(spark.createDataFrame([("a", i, 600 * i, float(i % 3), 1.0, [100]) for i in range(30)], "pump_serial string, seqnum long, t long, slope double, multiplier double, glucose_values array<int>"))
    got = {r["base"]: (r["firings"], r["instances"]) for r in slope_sweep(slopes, [1.0, 2.0], MealRise(refractory_minutes=60)).collect()}
    assert got == {1.0: (20, 5), 2.0: (10, 5)} and rows.value == 30


def test_router_reads_its_events_once(spark):
    """The tables' plan reads the parsed events by class, not the raw ones again for each table."""
    plan = QUERIES["router_tables"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "events.parquet" not in plan and "event_class" in plan


def test_sync_reads_raw_events_twice(spark, tmp_path):
    """Once for each pump's first event and chunks, once into files by class."""
    events, rows = counted(raw(spark))
    n, store = raw(spark).count(), ParquetStore(spark, str(tmp_path))
    out = sync.sync(store, events, Config(), T + timedelta(days=1))
    assert out["cgm"].inserted == 30 and rows.value == 2 * n
    assert store.get_fetch_state("a")["actual_min_date"] == T.date()


def test_messages_of_one_bolus(spark, tmp_path):
    """Of repeated messages the last to arrive counts, its nulls too, whatever its values; fields of other classes don't disturb a payload."""
    said = [("request1", 1, {"bolus_id": 1, "carbs_g": 90, "iob": 9.5, "volume": "?"}), ("request3", 2, {"bolus_id": 1, "food_insulin": 8.0}), ("request1", 3, {"bolus_id": 1, "carbs_g": 30}), ("request2", 4, {"bolus_id": 1, "options": 0, "user_override": 0}), ("request3", 5, {"bolus_id": 1, "food_insulin": 2.0}), ("request2", 6, {"bolus_id": 2, "options": 3}), ("request1", 7, {"carbs_g": 5})]
    events = spark.createDataFrame([(c, T + timedelta(minutes=i), i, "a", i, json.dumps(p)) for c, i, p in said], sync.RAW)
    store = ParquetStore(spark, str(tmp_path))
    sync.sync(store, events, Config(), T + timedelta(days=1))
    got = [(r["bolus_id"], r["timestamp"].minute, r["carbs_g"], r["iob"], r["bolus_source"], r["food_insulin"]) for r in store.read_all("requests").collect()]
    assert got == [(1, 3, 30, None, "user", 2.0)]
