import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from glycoflow.config import MealRise
from glycoflow.operators import detect, variability
from glycoflow.operators.build import build_suspension
from glycoflow.operators.joins import range_join, with_last
from glycoflow.operators.sequences import pair, sessions, thin

START = datetime(2026, 5, 1, 15, tzinfo=timezone.utc)


def test_thin(spark):
    df = spark.createDataFrame([("a", x) for x in (0, 30, 60, 100, 121, 181)], "s string, x long")
    assert sorted(r["x"] for r in thin(df, "s", "x", 60).collect()) == [0, 60, 121, 181]
    rng = random.Random(2)
    xs = sorted({rng.randint(0, 5000) for _ in range(300)})
    kept = []
    for x in xs:
        if not kept or x - kept[-1] >= 37:
            kept.append(x)
    two = spark.createDataFrame([(s, x - 2500, i % 3) for s in "ab" for x in xs for i in range(1 + (x % 5 == 0))], "s string, x long, other int").repartition(3)
    for span in (1, 3, 168):
        got = thin(two, "s", "x", 37, span)
        assert got.columns == two.columns and sorted((r["s"], r["x"]) for r in got.select("s", "x").distinct().collect()) == sorted((s, x - 2500) for s in "ab" for x in kept)
        assert got.count() == 2 * sum(1 + (x % 5 == 0) for x in kept)
    assert thin(two.where("false"), "s", "x", 37).count() == 0


def test_thinning_a_dense_series_takes_linear_time(spark):
    """Half a million rows without a gap: one run, shared among tasks."""
    df = spark.range(500_000).select(F.lit("a").alias("s"), F.col("id").alias("x"))
    assert thin(df, "s", "x", 12).agg(F.count("x"), F.max("x")).first()[:] == (41_667, 499_992)


def test_swings_are_conga_and_mage_of_any_chunks(spark):
    """Flat stretches, repeated instants, chunks of one reading or none: as the window pipelines over whole series give."""
    rng = random.Random(6)
    rows, n = [], 0
    for pump, spread in (("a", 3), ("b", 60), ("c", 0), ("d", 40)):
        t = 0
        for _ in range(400 if pump != "d" else 2):
            t += rng.choice([0, 300, 300, 300, 299, 900, 9000])
            rows.append((pump, n, START + timedelta(seconds=t), 100 + rng.randint(-spread, spread)))
            n += 1
    cgm = spark.createDataFrame(rows, "pump_serial string, seqnum long, timestamp timestamp, bg_mgdl int").repartition(5)
    stats = cgm.groupBy("pump_serial").agg(F.stddev_samp("bg_mgdl").alias("sd"), F.count("bg_mgdl").alias("n"))
    shown = lambda df: {r["pump_serial"]: [x if x is None else round(x, 9) for x in (r["conga"], r["mage"])] for r in df.collect()}
    want = shown(variability.conga(cgm, "pump_serial").join(variability.mage(cgm, "pump_serial"), "pump_serial"))
    for chunk in (301, 3600, 40_000, 10**7):
        got = variability.swings(cgm, "pump_serial", chunk).join(stats, "pump_serial").withColumn("mage", variability.mage_of(F.col("sd"), F.col("n")))
        assert shown(got) == want and len(want) == 4, chunk


def test_pairing_like_a_state_machine(spark):
    rng = random.Random(3)
    rows = [("p", i, START + timedelta(minutes=rng.randint(1, 900) + 900 * i), rng.choice(["suspend", "resume"]), "user", i) for i in range(200)]
    want, open_at = [], None
    for _, i, t, kind, _, _ in rows:
        if kind == "suspend":
            if open_at:
                want.append((open_at, t, True))
            open_at = t
        elif open_at:
            want.append((open_at, t, (t - open_at) > timedelta(minutes=1440)))
            open_at = None
    if open_at:
        want.append((open_at, None, False))
    raw = spark.createDataFrame(rows, "pump_serial string, seqnum long, timestamp timestamp, kind string, suspend_reason string, insulin_at_suspend int")
    alarms = spark.createDataFrame([], "pump_serial string, timestamp timestamp, seqnum long, alarm_id int, alarm_name string, category string, action string")
    got = build_suspension(raw, alarms).select(F.unix_seconds("suspend_timestamp"), F.unix_seconds("resume_timestamp"), "pairing_suspect").collect()
    assert sorted(map(tuple, got)) == sorted((int(a.timestamp()), int(b.timestamp()) if b else None, s) for a, b, s in want)


def test_sessions_keep_equal_gaps(spark):
    df = spark.createDataFrame([("p", t) for t in (0, 100, 200, 301, 302)], "pump_serial string, t long")
    for chunk in (1, 150, 10_000):
        assert sorted((r["t"], r["session"]) for r in sessions(df, "pump_serial", ["t"], F.col("t"), 100, chunk).collect()) == [(0, 0), (100, 0), (200, 0), (301, 301), (302, 301)]


def test_carried_values_and_pairs_in_any_chunks(spark):
    """As windows over whole series give, with ties, long stretches without a value and chunks of a single row."""
    from pyspark.sql import Window

    rng = random.Random(4)
    rows = [(p, i, START + timedelta(seconds=rng.randint(0, 40) * 500), rng.choice([None, None, None, i]), rng.choice("oc-")) for p in "ab" for i in range(120)]
    df = spark.createDataFrame(rows, "p string, seqnum long, timestamp timestamp, v long, kind string").withColumn("t", F.unix_seconds("timestamp")).repartition(4)
    w = Window.partitionBy("p").orderBy("timestamp", "seqnum")
    want = df.withColumn("last", F.last("v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    only = df.where("kind <> '-'")
    ends = only.withColumn("end_ts", F.lead("timestamp").over(w)).withColumn("end_open", F.lead(F.col("kind") == "o").over(w)).where("kind = 'o'")
    shown = lambda x, *c: sorted(str([r["p"], r["seqnum"], *(r[k] for k in c)]) for r in x.collect())
    for chunk in (400, 3000, 10**6):
        got = with_last(df, "p", "t", chunk, ["timestamp", "seqnum"], F.col("v"), "last")
        assert got.columns == want.columns and shown(got, "last") == shown(want, "last")
        assert shown(pair(df, "p", ["timestamp", "seqnum"], F.col("kind") == "o", F.col("kind") == "c", chunk=chunk), "end_ts", "end_open") == shown(ends, "end_ts", "end_open")


def test_range_join_is_exact_and_hashed(spark):
    rng = random.Random(5)
    a, b = ([("p", rng.randint(-500, 500)) for _ in range(80)] for _ in range(2))
    left, right = spark.createDataFrame([(*x, i) for i, x in enumerate(a)], "k string, x long, i int"), spark.createDataFrame([(*x, i) for i, x in enumerate(b)], "k string, y long, j int")
    joined = range_join(left, right, "k", "x", "y", 30, 45)
    assert sorted((r["i"], r["j"]) for r in joined.collect()) == sorted((i, j) for i, (_, x) in enumerate(a) for j, (_, y) in enumerate(b) if x - 30 <= y <= x + 45)
    plan = joined._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def rises(spark, values, step=5, gaps=None, **change):
    c = MealRise(meal_windows=(), off_hours_multiplier=1.0, **change)
    rows = [("p", i, START + timedelta(minutes=step * i), v, False) for i, v in enumerate(values)]
    cgm = spark.createDataFrame(rows, "pump_serial string, seqnum long, timestamp timestamp, bg_mgdl int, backfilled boolean")
    return detect.meal_rises(cgm, c, "UTC", gaps).orderBy("seqnum").collect()


def test_meal_rises(spark):
    assert rises(spark, [100] * 7) == []
    steep = rises(spark, [100 + 10 * i for i in range(7)])
    assert [r["slope"] for r in steep if r["seqnum"] == 6] == [2.0] and steep[-1]["glucose_values"] == [100, 110, 120, 130, 140, 150, 160]
    assert rises(spark, [40 + 10 * i for i in range(7)]) == []  # starts too low
    assert rises(spark, [100, 120, 140, 160], step=20) == []  # too few in the window
    outlier = rises(spark, [100, 110, 120, 300, 140, 150, 160])
    assert [round(r["slope"], 2) for r in outlier if r["seqnum"] == 6] == [2.0]


def test_meal_rises_respect_gaps(spark):
    gap = spark.createDataFrame([("p", START + timedelta(minutes=5), START + timedelta(minutes=9))], "pump_serial string, start_ts timestamp, end_ts timestamp")
    assert rises(spark, [100 + 10 * i for i in range(7)], gaps=gap) == []
    long_ago = spark.createDataFrame([("p", START - timedelta(hours=13), None)], "pump_serial string, start_ts timestamp, end_ts timestamp")
    assert rises(spark, [100 + 10 * i for i in range(7)], gaps=long_ago) != []


def test_windows_across_chunks(spark):
    rows = [("p", i, START + timedelta(minutes=7 * i), 100 + i % 50) for i in range(400)]
    cgm = spark.createDataFrame(rows, "pump_serial string, seqnum long, timestamp timestamp, bg_mgdl int")
    few, many = (sorted((r["seqnum"], r["n_samples"]) for r in detect.anchored_windows(cgm, MealRise(), chunk=c).collect()) for c in (10**7, 1800))
    assert few == many and len(few) == 400
