import random
from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from glycoflow.plans.report import cgm_report
from glycoflow.functions import metrics as m
from glycoflow.functions.time import expected_readings, iso_minute, midnight, window_bounds
from glycoflow.operators.agp import profile
from glycoflow.operators.variability import conga, mage, modd

LA = "America/Los_Angeles"
UTC = timezone.utc


def readings(spark, rows, pump="p"):
    return spark.createDataFrame([(pump, i, t, v) for i, (t, v) in enumerate(rows)], "pump_serial string, seqnum long, timestamp timestamp, bg_mgdl int")


def one(spark, bgs, **columns):
    df = spark.createDataFrame([(b,) for b in bgs], "bg_mgdl int")
    return df.agg(*(c.alias(k) for k, c in columns.items())).first()


def test_bands(spark):
    r = one(spark, [53, 54, 69, 70, 140, 180, 181, 250, 251], **m.time_in_bands())
    assert [round(r[k] * 9 / 100) for k in ("tbr_level2", "tbr_level1", "tir", "tar_level1", "tar_level2")] == [1, 2, 3, 2, 1]
    assert one(spark, [70, 140, 141, 180], **m.time_in_bands())["titr"] == 50
    r = one(spark, [], a=m.time_in_range(m.bg_column(), 70, 180), b=m.time_in_range(m.bg_column(), 70, 180, None), c=m.lbgi())
    assert (r["a"], r["b"], r["c"]) == (0.0, None, 0.0)


def test_formulas(spark):
    r = spark.range(1).select(m.gmi(F.lit(150.0)), m.ea1c(F.lit(150.0)), m.gri(F.lit(2.0), F.lit(5.0), F.lit(10.0), F.lit(3.0)), m.j_index(F.lit(120.0), F.lit(30.0)), m.cv_percent(F.lit(0.0), F.lit(1.0))).first()
    assert [round(x, 4) for x in r[:4]] == [6.898, 6.8537, 30.8, 22.5]
    assert r[4] is None


def test_properties(spark):
    rng = random.Random(1)
    lists = [[rng.randint(10, 600) for _ in range(rng.randint(1, 80))] for _ in range(60)]
    df = spark.createDataFrame([(i, b) for i, x in enumerate(lists) for b in x], "g int, bg_mgdl int")
    bands = m.time_in_bands()
    for r in df.groupBy("g").agg(*(c.alias(k) for k, c in bands.items()), m.lbgi().alias("l"), m.hbgi().alias("h")).collect():
        assert abs(sum(r[k] for k in ("tbr_level2", "tbr_level1", "tir", "tar_level1", "tar_level2")) - 100) < 1e-9
        assert r["l"] >= 0 and r["h"] >= 0 and all(0 <= r[k] <= 100 for k in bands)


@pytest.mark.parametrize("day, hours", [(date(2026, 3, 8), 23), (date(2026, 6, 16), 24), (date(2026, 11, 1), 25)])
def test_daylight_saving(spark, day, hours):
    since, until = window_bounds(day, 1, LA)
    assert (until - since) == timedelta(hours=hours) and expected_readings(since, until) == hours * 12
    r = spark.range(1).select(midnight(F.lit(day), LA).alias("a"), midnight(F.lit(day + timedelta(days=1)), LA).alias("b")).select(F.unix_seconds("a"), F.unix_seconds("b")).first()
    assert tuple(r) == (since.timestamp(), until.timestamp())


def test_iso_minute(spark):
    r = spark.range(1).select(iso_minute(F.lit(datetime(2026, 7, 1, 12, 5, tzinfo=UTC)), LA), iso_minute(F.lit(datetime(2026, 1, 1, 12, 5, tzinfo=UTC)), "Asia/Kolkata")).first()
    assert tuple(r) == ("2026-07-01T05:05-07:00", "2026-01-01T17:35+05:30")


def test_variability(spark):
    start = datetime(2026, 5, 1, 8, tzinfo=UTC)
    two = [(start + timedelta(days=d, hours=2 * h), 100 + 20 * d) for d in range(2) for h in range(8)]
    assert modd(readings(spark, two), "pump_serial", LA).first()["modd"] == 20
    assert modd(readings(spark, two[:8]), "pump_serial", "UTC").first()["modd"] is None
    flat = [(start + timedelta(minutes=5 * i), 120) for i in range(48)]
    assert conga(readings(spark, flat), "pump_serial").first()["conga"] == 0
    assert conga(readings(spark, flat[:3]), "pump_serial", 2).first()["conga"] is None
    assert mage(readings(spark, [(start + timedelta(minutes=5 * i), v) for i, v in enumerate([120, 120, 220, 120, 120])]), "pump_serial").first()["mage"] == 100
    assert mage(readings(spark, flat), "pump_serial").first()["mage"] == 0
    assert mage(readings(spark, flat[:2]), "pump_serial").first()["mage"] is None


def test_mage_by_hand(spark):
    """Swings of a published definition: turning points of the moving series, amplitudes over one deviation."""
    import statistics

    rng = random.Random(4)
    v = [rng.choice([100, 130, 160, 160, 220]) for _ in range(120)]
    turns, last = [v[0]], 0
    for a, b in zip(v, v[1:]):
        step = (b > a) - (b < a)
        if step and last and step != last:
            turns.append(a)
        last = step or last
    turns.append(v[-1])
    big = [abs(b - a) for a, b in zip(turns, turns[1:]) if abs(b - a) > statistics.stdev(v)]
    start = datetime(2026, 5, 1, tzinfo=UTC)
    assert abs(mage(readings(spark, [(start + timedelta(minutes=5 * i), x) for i, x in enumerate(v)]), "pump_serial").first()["mage"] - sum(big) / len(big)) < 1e-9


def test_agp(spark):
    day = datetime(2026, 6, 10, tzinfo=UTC)
    rows = [(day + timedelta(days=d, hours=6), 100 + 10 * d) for d in range(3)] + [(day + timedelta(days=d, hours=12, minutes=30), 150) for d in range(3)]
    got = {r["minute"]: r for r in profile(readings(spark, rows), "UTC", 60, 1).collect()}
    assert sorted(got) == [360, 720] and [round(got[360][p], 6) for p in ("p05", "p50", "p95")] == [101, 110, 119] and got[360]["n"] == 3
    flat = [(day + timedelta(minutes=15 * i), 400 if i == 95 else 100) for i in range(96)]
    got = {r["minute"]: r["p50"] for r in profile(readings(spark, flat), "UTC", 15, 3).collect()}
    assert got[0] > 100 and got[720] == 100 and len(got) == 96


def test_report_ignores_readings_that_are_no_numbers(spark):
    """NaN and null readings count as rows, not as readings; the configured range is null without any."""
    start = datetime(2026, 5, 1, 8, tzinfo=UTC)
    rows = [("p", i, start + timedelta(minutes=5 * i), v) for i, v in enumerate([100.0, float("nan"), 200.0, None])]
    df = spark.createDataFrame(rows, "pump_serial string, seqnum long, timestamp timestamp, bg_mgdl double")
    r = cgm_report(df, start, start + timedelta(days=1), "UTC", None, low=90, high=250).first()
    assert (r["n_readings"], r["n_rows"], r["mean_bg"], r["tir_config"], r["tir"], r["gri_hypo"]) == (2, 4, 150.0, 100.0, 50.0, None)
    assert cgm_report(df.where("bg_mgdl is null"), start, start + timedelta(days=1), "UTC", None).first()["tir_config"] is None
