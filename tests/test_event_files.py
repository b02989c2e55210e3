import json
from datetime import date, datetime, timedelta, timezone

from glycoflow.config import Config
from glycoflow.plans import sync
from glycoflow.sources.event_files import chunks, fetched, register
from glycoflow.sources.storage import ParquetStore

DAY = date(2026, 3, 1)


def leave(folder, pump, day, n=2, broken=False):
    """One day's file: readings an hour apart."""
    at = folder / day.isoformat()
    at.mkdir(parents=True, exist_ok=True)
    first = (day - DAY).days * 10
    lines = [json.dumps({"event_class": "cgm", "timestamp": f"{day}T{i:02d}:00:00+00:00", "seqnum": first + i, "payload": {"bg": 100 + i, "data_type": 1, "egv_seconds": 0}}) for i in range(n)]
    (at / f"{pump}.jsonl").write_text("\n".join([*lines, "{not json"] if broken else lines))


def test_chunks():
    assert chunks(DAY, DAY) == [] and chunks(DAY, DAY + timedelta(days=65)) == [(DAY, DAY + timedelta(days=30)), (DAY + timedelta(days=30), DAY + timedelta(days=60)), (DAY + timedelta(days=60), DAY + timedelta(days=65))]


def test_a_failed_chunk_stops_no_other(spark, tmp_path):
    register(spark)
    for i in range(70):
        leave(tmp_path, "a", DAY + timedelta(days=i), broken=i == 35)
        if i < 3:
            leave(tmp_path, "b", DAY + timedelta(days=i))
    raw = spark.read.format("event_files").load(str(tmp_path))
    got = {(r["pump_serial"], r["event_class"]): r["count"] for r in raw.groupBy("pump_serial", "event_class").count().collect()}
    assert got == {("a", "cgm"): 80, ("a", "chunk"): 3, ("b", "cgm"): 6, ("b", "chunk"): 1}
    told = {r["pump_serial"]: (str(r["last_good_end"]), r["failed_from"] and str(r["failed_from"])) for r in fetched(raw).collect()}
    assert told == {"a": ("2026-05-10", "2026-03-31"), "b": ("2026-03-04", None)}
    some = spark.read.format("event_files").option("pumps", "b").option("since", "2026-03-02").option("until", "2026-03-03").load(str(tmp_path))
    assert [(r["event_class"], r["timestamp"].astimezone(timezone.utc).day) for r in some.orderBy("seqnum").collect() if r["seqnum"] is not None] == [("cgm", 2), ("cgm", 2)]
    # A sync keeps what could be read, and goes back to the failed days once their file is whole.
    store, now = ParquetStore(spark, str(tmp_path / "store")), datetime(2026, 5, 12, tzinfo=timezone.utc)
    assert sync.sync(store, raw, Config(), now)["cgm"].inserted == 86
    assert store.get_fetch_state("a")["last_synced_at"].date() == date(2026, 3, 31) and store.get_fetch_state("b")["last_synced_at"].date() == date(2026, 5, 12)
    leave(tmp_path, "a", DAY + timedelta(days=35))
    assert sync.sync(store, spark.read.format("event_files").load(str(tmp_path)), Config(), now)["cgm"].inserted == 60
    assert store.read_all("cgm").count() == 146 and json.loads(store.get_fetch_state("a")["meta"])["last_good_chunk_end"] == "2026-05-10"


def test_stream(spark, tmp_path):
    """Files are handed on once, across restarts; a broken one is reported and passed by."""
    register(spark)
    folder = tmp_path / "in"

    def run():
        stream = spark.readStream.format("event_files").load(str(folder))
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
        rows = spark.read.parquet(str(tmp_path / "out")).collect()
        return sorted((r["pump_serial"], r["seqnum"]) for r in rows if r["event_class"] == "cgm"), sum(r["event_class"] == "chunk" for r in rows)

    leave(folder, "a", DAY)
    leave(folder, "b", DAY, broken=True)
    assert run() == ([("a", 0), ("a", 1)], 2)
    assert run() == ([("a", 0), ("a", 1)], 2)
    leave(folder, "a", DAY + timedelta(days=1))
    leave(folder, "b", DAY + timedelta(days=1))
    assert run() == ([("a", 0), ("a", 1), ("a", 10), ("a", 11), ("b", 10), ("b", 11)], 4)
