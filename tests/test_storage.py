from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from glycoflow.config import Config, clamp, one_of, parse, parse_date, poll_depth
from glycoflow.schema import TABLES, key_of, table, time_of
from glycoflow.sources.storage import ParquetStore, fetch_window, repair_shift, shift_times

T = datetime(2026, 5, 13, tzinfo=timezone.utc)


@pytest.fixture()
def store(spark, tmp_path):
    return ParquetStore(spark, str(tmp_path / "store"))


def cgm(spark, rows):
    return spark.createDataFrame([(p, s, T + timedelta(minutes=m), b, False, None) for p, s, m, b in rows], table("cgm"))


def test_upsert_read_delete(spark, store):
    assert store.read_all("cgm").count() == 0 and store.read_all("cgm").columns == [f.name for f in table("cgm")]
    r = store.upsert("cgm", cgm(spark, [("a", 1, 0, 100), ("a", 2, 5, 110), ("a", 2, 5, 999), ("b", 1, 10, 120)]).coalesce(1))
    assert (r.received, r.inserted, r.skipped) == (4, 3, 1)
    r = store.upsert("cgm", cgm(spark, [("a", 1, 0, 555), ("a", 3, 15, 130)]))
    assert (r.inserted, r.skipped) == (1, 1)
    assert sorted((x["pump_serial"], x["seqnum"], x["bg_mgdl"]) for x in store.read_all("cgm").collect()) == [("a", 1, 100), ("a", 2, 110), ("a", 3, 130), ("b", 1, 120)]
    assert store.read("cgm", T, T + timedelta(minutes=10)).count() == 2  # half open
    one = store.read("cgm", T, T + timedelta(days=1), "b")
    assert one.count() == 1
    plan = one._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(timestamp)" in plan and "PartitionFilters: [isnotnull(pump_serial" in plan
    with pytest.raises(ValueError):
        store.read("cgm", datetime(2026, 5, 13), T)
    with pytest.raises(ValueError):
        store.delete_range("cgm")
    assert store.delete_range("cgm", until=T + timedelta(minutes=6), pump_serial="a") == 2
    assert store.delete_range("cgm", since=T) == 2 and store.read_all("cgm").count() == 0
    with pytest.raises(ValueError, match="there are cgm"):
        store.read_all("nope")


def test_bookmarks_version_clean(spark, store):
    assert store.get_fetch_state("x") is None and store.get_pipeline_version() is None
    store.set_fetch_state("x", "pump", T)
    store.set_fetch_state("y", "cgm", T)
    store.set_fetch_state("x", "pump", T + timedelta(days=1), meta={"n": 1})
    assert [r["source_id"] for r in store.list_fetch_state().collect()] == ["x", "y"] and store.get_fetch_state("x")["meta"] == '{"n": 1}'
    store.set_pipeline_version(4)
    assert store.get_pipeline_version() == 4
    store.clean_all()
    assert store.get_pipeline_version() is None and store.list_fetch_state().count() == 0


def test_a_crash_before_the_list_moves_leaves_the_old_table(spark, store, monkeypatch):
    store.upsert("cgm", cgm(spark, [("a", 1, 0, 100)]))

    class Broken:
        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            return getattr(self.fs, name)

        def rename(self, *_):
            raise OSError("killed here")

    whole = store._fs
    store._fs = Broken(whole)
    with pytest.raises(OSError):
        store.upsert("cgm", cgm(spark, [("a", 2, 5, 110)]))
    store._fs = whole
    assert [r["seqnum"] for r in store.read_all("cgm").collect()] == [1]
    store.upsert("cgm", cgm(spark, [("a", 2, 5, 110)]))
    assert store.read_all("cgm").count() == 2
    assert store.vacuum("cgm", keep=1) == 1 and store.read_all("cgm").count() == 2  # the batch that no list names


def test_batches(spark, store):
    """An upsert adds a batch; deletes and repairs of one pump write that pump alone; compaction keeps all rows."""
    for i in range(3):
        store.upsert("cgm", cgm(spark, [(p, i, 5 * i, 100 + i) for p in "ab"]))
    assert len(store._batches("cgm")) == 3
    assert store.upsert("cgm", cgm(spark, [("a", 1, 5, 0)])).inserted == 0 and len(store._batches("cgm")) == 3
    assert store.delete_range("cgm", since=T + timedelta(minutes=10), pump_serial="a") == 1
    assert repair_shift(store, "cgm", 3, T, T + timedelta(hours=1), "b") == 3
    want = [("a", 0, 0), ("a", 1, 5), ("b", 0, 180), ("b", 1, 185), ("b", 2, 190)]
    rows = lambda: sorted((r["pump_serial"], r["seqnum"], (r["timestamp"].timestamp() - T.timestamp()) // 60) for r in store.read_all("cgm").collect())
    assert rows() == want
    store.compact("cgm")
    assert len(store._batches("cgm")) == 1 and rows() == want and store.vacuum("cgm", keep=1) >= 3 and rows() == want


def test_merge(spark, store):
    """New rows are added, changed ones replaced, keys deleted; pumps without a change aren't written again."""
    store.upsert("cgm", cgm(spark, [(p, i, 5 * i, 100 + i) for p in "abc" for i in range(3)]))
    r = store.merge("cgm", cgm(spark, [("a", 0, 0, 100), ("a", 1, 5, 555), ("b", 7, 35, 1)]), spark.createDataFrame([("a", 2)], "pump_serial string, seqnum long"))
    assert (r.received, r.inserted, r.skipped) == (3, 2, 1)
    want = [("a", 0, 100), ("a", 1, 555), ("b", 0, 100), ("b", 1, 101), ("b", 2, 102), ("b", 7, 1), ("c", 0, 100), ("c", 1, 101), ("c", 2, 102)]
    rows = lambda: sorted((x["pump_serial"], x["seqnum"], x["bg_mgdl"]) for x in store.read_all("cgm").collect())
    assert rows() == want and [b["without"] for b in store._batches("cgm")] == [["a"], [], []]
    assert store.merge("cgm", store.read_all("cgm")).inserted == 0 and len(store._batches("cgm")) == 3
    store.merge("cgm", cgm(spark, []), spark.createDataFrame([("c", 1)], "pump_serial string, seqnum long"))
    assert rows() == [x for x in want if x != ("c", 1, 101)]


def test_many_pumps_have_no_folders_of_their_own(spark, store, tmp_path):
    """Files follow rows, not pumps; batches of many and of few pumps are read, merged and deleted together."""
    many = cgm(spark, [(f"p{i}", 1, i, 100) for i in range(150)])
    assert store.upsert("cgm", many).inserted == 150 and store.upsert("cgm", many).inserted == 0
    assert len(list((tmp_path / "store" / "cgm").rglob("*.parquet"))) < 20
    assert store.upsert("cgm", cgm(spark, [("p7", 2, 0, 101), ("q", 1, 0, 102)])).inserted == 2
    assert store.merge("cgm", cgm(spark, [("p7", 1, 7, 555), ("p8", 1, 8, 100)])).inserted == 1
    assert store.delete_range("cgm", pump_serial="p9") == 1
    rows = lambda: sorted((r["pump_serial"], r["seqnum"], r["bg_mgdl"]) for r in store.read_all("cgm").collect())
    want = sorted([(f"p{i}", 1, 555 if i == 7 else 100) for i in range(150) if i != 9] + [("p7", 2, 101), ("q", 1, 102)])
    assert rows() == want
    assert store.merge("cgm", many.withColumn("bg_mgdl", F.lit(1))).inserted == 150
    assert len(list((tmp_path / "store" / "cgm").rglob("*.parquet"))) < 40
    store.compact("cgm")
    assert store.vacuum("cgm", keep=1) >= 3 and [r[2] for r in rows()].count(1) == 150 and len(rows()) == 152


def test_repeats_in_a_batch(spark, store):
    """The first by the order given; without one the smallest row, however the batch is partitioned."""
    rows = spark.createDataFrame([("a", 1, 9, 300), ("a", 1, 2, 200), ("a", 1, 5, 100)], "pump_serial string, seqnum long, o int, bg_mgdl int").withColumn("timestamp", F.lit(T))
    store.upsert("cgm", rows.repartition(3), order="o")
    store.upsert("cgm", rows.withColumn("seqnum", F.lit(2)).repartition(3))
    assert sorted((r["seqnum"], r["bg_mgdl"]) for r in store.read_all("cgm").collect()) == [(1, 200), (2, 100)]


def scanned(df):
    """Rows that the scans of a plan without shuffles hand on: what is left after folders, files, row groups and pages are pruned."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_an_upsert_reads_what_the_batch_needs(spark, store):
    """What the upsert of a day reads of the stored keys doesn't grow with the days that are stored."""
    day = lambda first, days: spark.range(288 * days).select(F.lit("a").alias("pump_serial"), (F.col("id") + 288 * first).alias("seqnum"), (F.lit(T) + F.make_dt_interval(mins=(F.col("id") + 288 * first) * 5)).alias("timestamp"), F.lit(100).alias("bg_mgdl"))
    for i in range(4):
        store.upsert("cgm", day(400 * i, 400))
    batch = store.staged(day(1599, 2), "batch")
    near = store.near("cgm", batch)
    assert near.count() == 288
    few, every = scanned(near.select("seqnum")), scanned(store.read_all("cgm").select("seqnum"))
    short = ParquetStore(spark, store.root + "-short")
    short.upsert("cgm", day(1200, 400))
    # Four times the years: not a row more is read.
    assert every == 1600 * 288 and 288 <= few == scanned(short.near("cgm", batch).select("seqnum")) < 0.1 * every
    assert store.upsert("cgm", batch).inserted == 288


def test_first_merge_and_stored_batches(spark, store):
    """A merge into an empty table keeps one row of a key; a batch that is stored already isn't staged again, nor deleted."""
    r = store.merge("cgm", cgm(spark, [("a", 1, 0, 100), ("a", 1, 0, 90), ("b", 1, 10, 120)]))
    assert (r.received, r.inserted) == (2, 2) and {x["bg_mgdl"] for x in store.read_all("cgm").collect()} == {90, 120}
    batch = store.staged(cgm(spark, [("a", 1, 0, 555), ("a", 3, 15, 130)]), "batch")
    r = store.upsert("cgm", batch, staged=True)
    assert (r.received, r.inserted) == (2, 1) and batch.count() == 2 and {x["bg_mgdl"] for x in store.read_all("cgm").collect()} == {90, 120, 130}
    empty = ParquetStore(spark, store.root + "2").read_all("cgm")
    assert "Join" not in batch.join(empty, ["pump_serial", "seqnum"], "left_anti")._jdf.queryExecution().optimizedPlan().toString()


def test_second_writer_fails(spark, store, monkeypatch):
    store.upsert("cgm", cgm(spark, [("a", 1, 0, 100)]))
    first = store._lists("cgm")
    monkeypatch.setattr(store, "_lists", lambda name: first[:-1])  # as if the other writer's list came in between
    with pytest.raises(OSError, match="another writer"):
        store._publish("cgm", [])


def test_alerts_and_log(spark, store):
    rows = spark.createDataFrame([("rise", "a", "r1", T, "{}"), ("rise", "a", "r1", T, "{}"), ("rise", "a", None, T, "{}"), ("rise", "a", None, T, "{}")], "alert_kind string, pump_serial string, event_ref string, fired_at timestamp, payload string")
    assert store.record_alerts(rows).count() == 3
    assert store.record_alerts(rows.where("event_ref is not null")).count() == 0
    got, new = store.insert_or_get_alert("rise", "r2", "b", T)
    again, second = store.insert_or_get_alert("rise", "r2", "c", T)
    assert new and not second and got["id"] == again["id"] and again["pump_serial"] == "b"
    with pytest.raises(ValueError):
        store.insert_or_get_alert("rise", "r3", "b", datetime(2026, 5, 13))
    assert store.find_alert("rise", "r1")["pump_serial"] == "a" and store.find_alert("rise", "zz") is None
    assert store.recent_alerts("rise", timedelta(minutes=60), T + timedelta(minutes=60)).count() == 4
    assert store.recent_alerts("rise", timedelta(minutes=59), T + timedelta(minutes=60)).count() == 0
    store.record_results(spark.createDataFrame([("rise", T, "x"), ("rise", T, "x"), ("other", T, "y")], "kind string, anchor_timestamp timestamp, payload string"))
    assert store.list_results("rise").count() == 2 and store.list_results(limit=1).count() == 1


def test_windows_and_config(spark):
    first = T - timedelta(days=90)
    assert fetch_window(T, None, first)[0] == first and fetch_window(T, T - timedelta(days=2), first)[0] == T - timedelta(days=3)
    assert fetch_window(T, T, first, override=T - timedelta(hours=1))[0] == T - timedelta(hours=1)
    assert one_of("14", ((7, 14, 30), 14)) == 14 and one_of("9", ((7, 14, 30), 14)) == 14 and one_of(None, ((7,), 7)) == 7
    assert clamp("500", 1, 100, 30) == 100 and clamp("x", 1, 100, 30) == 30 and parse_date("2026-02-30") is None
    assert poll_depth(Config().meal_rise) == 12
    raw = {"ingestion": {"timezone": "UTC"}, "bg_targets": {"low": 70, "high": 180}, "meal_rise": {"meal_windows": [{"start_hour": 6, "end_hour": 10, "multiplier": 0.7}]}, "site_change_detection": {}, "anomaly_detection": {}, "meal_detection": {"meal_windows": [[6, 10]]}, "clustering": {"n_clusters": 4}}
    assert parse(raw).clustering.n_clusters == 4 and parse(raw).calibration.late_bolus_lookahead_minutes == 45
    wrong = [
        {"bg_targets": {"low": 70, "high": 180, "target": 190}}, {"anomaly_detection": {"spike_threshold": 60}}, {"anomaly_detection": {"flatline_consecutive_intervals": 1}}, {"clustering": {"n_clusters": 1}},
        {"meal_detection": {"meal_windows": [[10, 6]]}}, {"meal_rise": {"meal_windows": [{"start_hour": 6, "end_hour": 25, "multiplier": 1}]}}, {"meal_rise": {"min_coverage": 0}}, {"meal_rise": {"refractory_minutes": 0}},
        {"meal_rise_calibration": {"correction_lookahead_minutes": 0}}, {"meal_rise": {"meal_windows": [[6, 10]]}},
    ]
    for block in wrong:
        with pytest.raises(ValueError):
            parse(raw | block)
    with pytest.raises(KeyError):
        parse(raw | {"ingestion": {}})
    assert parse(raw).meal_rise.meal_windows == ((6, 10, 0.7),)
    with pytest.raises(KeyError):
        parse({k: v for k, v in raw.items() if k != "meal_rise"})
    with pytest.raises(ValueError):
        parse(raw | {"bg_targets": {"low": 200, "high": 180}})
    moved = shift_times(cgm(spark, [("a", 1, 0, 1), ("b", 1, 0, 1)]), "timestamp", 3, T, T + timedelta(hours=1), "a")
    assert sorted(r["n"] for r in moved.groupBy("timestamp").count().withColumnRenamed("count", "n").collect()) == [1, 1]
    assert key_of("basal") == ["pump_serial", "timestamp"] and time_of("suspension") == "suspend_timestamp"
    assert set(TABLES) == {"cgm", "bolus", "requests", "basal", "suspension", "events", "alarms", "site_issues", "cgm_gaps"}
