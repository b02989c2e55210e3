"""Ingest and upkeep: the router from raw events to all nine tables, incremental sync, bulk copy, health, report files."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.time import between, local_date, overlaps, window_bounds
from ..operators import build
from ..operators.enrich import backfill, enrich_all, original_view
from ..schema import TABLES, time_of
from ..sources.event_files import seen
from ..sources.storage import ParquetStore, UpsertResult
from . import carry

#: Event classes that a builder takes; all others are counted and left.
KNOWN = ["cgm", "bolus", "request1", "request2", "request3", "basal", "suspend", "resume", "event", "alarm"]
#: Columns of a raw event: its class, when and where it came from, and a JSON payload.
RAW = "event_class string, timestamp timestamp, seqnum long, pump_serial string, ingest_ord long, payload string"
#: Fields of payloads by class; a name means the same wherever it stands.
PAYLOADS = {
    "cgm": "bg int, data_type int, egv_seconds long", "bolus": "bolus_id long, insulin_units double", "request1": "bolus_id long, carbs_g int, bg_mgdl int, iob double", "request2": "bolus_id long, options int, user_override int",
    "request3": "bolus_id long, food_insulin double, correction_insulin double, total_requested double", "basal": "commanded_rate_milli long, rate_source_code int", "suspend": "reason int, insulin int", "resume": "",
    "event": "kind string, code int, previous_code int, volume int, prime_size int, requested_action int, exercise_time int, commanded_basal_rate double, pump_control_state int, status_user_mode int",
    "alarm": "category string, action string, alarm_id int, raw_name string, param1 double, param2 double",
}
#: Class of readings of the minute before a window, which only decide about the window's first ones.
BEFORE = "cgm_before"
_FIELDS = {x.split()[0]: x for p in PAYLOADS.values() for x in p.split(", ") if x}
_HEAD = ["pump_serial", "seqnum", "timestamp", "ingest_ord"]


def parsed(raw: DataFrame) -> DataFrame:
    """Raw events with the fields of all classes as columns, from one parse of each payload for its own class's fields alone."""
    own = {c: F.when(F.col("event_class") == c, F.from_json("payload", p)) for c, p in PAYLOADS.items() if p}
    of = {f: [c for c, p in PAYLOADS.items() if f in (x.split(" ")[0] for x in p.split(", "))] for f in _FIELDS}
    return raw.withColumns({f"_{c}": p for c, p in own.items()}).select("event_class", *_HEAD, *(F.coalesce(*(F.col(f"_{c}.{f}") for c in classes)).alias(f) for f, classes in of.items()))


def of_class(events: DataFrame, name: str, key: list[str] | None = None) -> DataFrame:
    """One class's events, parsed already or not; with a key, of repeated ones the first to arrive, without its number."""
    rows, fields = events.where(F.col("event_class") == name), [f.split()[0] for f in PAYLOADS[name].split(", ") if f]
    if fields and "payload" in events.columns:
        rows = rows.withColumn("_p", F.from_json("payload", PAYLOADS[name])).select(*_HEAD, "_p.*")
    rows = rows.select(*_HEAD, *fields)
    return rows if key is None else build.first_rows(rows, key, ["ingest_ord"]).drop("ingest_ord")


def _messages(events: DataFrame) -> list[DataFrame]:
    return [of_class(events, f"request{i}").drop(*(["seqnum"] if i == 1 else ["seqnum", "timestamp"])) for i in (1, 2, 3)]


def _stops_and_goes(events: DataFrame) -> DataFrame:
    stops = of_class(events, "suspend").select("pump_serial", "seqnum", "timestamp", F.lit("suspend").alias("kind"), build.named(F.col("reason"), build.SUSPEND_REASONS).alias("suspend_reason"), F.col("insulin").alias("insulin_at_suspend"))
    goes = of_class(events, "resume").select("pump_serial", "seqnum", "timestamp", F.lit("resume").alias("kind"))
    return stops.unionByName(goes, allowMissingColumns=True)


def _simple(events: DataFrame) -> dict[str, DataFrame]:
    """Tables whose rows depend on one event each."""
    numbered = ["pump_serial", "seqnum"]
    return {
        "bolus": of_class(events, "bolus", ["pump_serial", "bolus_id"]).select("pump_serial", "bolus_id", "timestamp", "insulin_units"), "basal": build.build_basal(of_class(events, "basal", ["pump_serial", "timestamp"])),
        "alarms": build.build_alarms(of_class(events, "alarm", numbered)), "events": build.build_events(of_class(events, "event", numbered)),
    }


def known(raw: DataFrame) -> DataFrame:
    """Parsed events of the classes that a builder takes."""
    return parsed(raw.where(F.col("event_class").isin(KNOWN)))


def build_all(raw: DataFrame, config: Config) -> tuple[dict[str, DataFrame], DataFrame]:
    """All nine tables, lazily, and counts of the event classes that no builder takes."""
    return build_parsed(parsed(raw), config), build.unhandled(raw, KNOWN)


def build_parsed(events: DataFrame, config: Config) -> dict[str, DataFrame]:
    """All nine tables from parsed events.  Each builder reads its own classes, so events had better be stored by class."""
    frames = _simple(events)
    frames |= {
        "cgm": build.build_cgm(of_class(events, "cgm").withColumnRenamed("timestamp", "event_ts"), config.timezone),
        "requests": build.build_requests(*_messages(events)), "suspension": build.build_suspension(_stops_and_goes(events), frames["alarms"]),
    }
    return enrich_all(frames, config.site_change)


def time_bounds(frames: dict[str, DataFrame]) -> DataFrame:
    """First and last instant over all tables, in one job."""
    parts = [df.agg(F.min(time_of(n)).alias("a"), F.max(time_of(n)).alias("b")) for n, df in frames.items()]
    return reduce(DataFrame.unionByName, parts).agg(F.min("a").alias("first_ts"), F.max("b").alias("last_ts"))


def together(calls: dict[str, Callable]) -> dict:
    """Results of calls that don't depend on one another, their Spark jobs side by side."""
    with ThreadPoolExecutor(len(calls)) as pool:
        return {name: done.result() for name, done in [(n, pool.submit(call)) for n, call in calls.items()]}


#: Version of the tables that sync writes.
VERSION = 6


def sync(store: ParquetStore, raw: DataFrame, config: Config, now: datetime, pumps: list[str] | None = None, override: datetime | None = None, overlap_days: int = 1) -> dict[str, UpsertResult]:
    """Events of all pumps since their bookmarks, built and merged in one plan for each table; bookmarks move on.

    A pump's window begins with `override`; or a day before its bookmark, but not before its first event; or with its
    first event.  Raw events are read twice: for each pump's first event and chunks, and into files by class.  Each builder
    reads and parses its own class, once.
    Tables then hold what all events so far would give (see `carry`), however they were cut into windows, if events
    come in order and a bolus's first message comes before the others.  Rows of class `chunk`, which the event files'
    source leaves, tell which days couldn't be read: bookmarks stop there.  Results are by table, over all pumps.
    """
    mine = raw if pumps is None else raw.where(F.col("pump_serial").isin(pumps))
    first = seen(mine).where("events > 0")
    state = store.fetch_states().select(F.col("source_id").alias("pump_serial"), "last_synced_at", "actual_min_date", "actual_max_date")
    back = F.greatest(F.col("first"), F.col("last_synced_at") - F.expr(f"interval {overlap_days} days"))
    start = F.lit(override).cast("timestamp") if override else F.when(F.col("last_synced_at").isNull(), F.col("first")).otherwise(back)
    marks = store.staged(first.join(state, "pump_serial", "left").select("pump_serial", start.alias("since"), "actual_min_date", "actual_max_date", "last_good_end", "failed_from"), "marks")
    since = marks.select("pump_serial", "since")
    earliest = since.agg(F.min("since")).first()[0]
    if earliest is None:
        store.unstage(marks)
        return {n: UpsertResult(0, 0, 0) for n in TABLES}
    t, reach = F.col("timestamp"), timedelta(seconds=carry.LOOK_BACK)
    recent = mine.where((t >= F.lit(earliest - reach)) & (t < F.lit(now)) & F.col("event_class").isin(KNOWN))
    own, near = t >= F.col("since"), t >= F.col("since") - F.make_dt_interval(secs=F.lit(carry.LOOK_BACK))
    inside = recent.join(since, "pump_serial").where(own | near & (F.col("event_class") == "cgm"))
    staged = store.staged(inside.select(F.when(own, F.col("event_class")).otherwise(BEFORE).alias("event_class"), *_HEAD, "payload"), "raw", "event_class")
    w, numbered = carry.Window(store, since, earliest, config), ["pump_serial", "seqnum"]
    both = of_class(staged.where(F.col("event_class").isin("cgm", BEFORE)).withColumn("event_class", F.lit("cgm")), "cgm", numbered)
    readings = build.read_cgm(both.withColumnRenamed("timestamp", "event_ts"), config.timezone)
    new = together({n: lambda n=n, df=df: store.staged(df, n) for n, df in {**_simple(staged), "cgm": readings}.items()})
    # What depends on stored alarms and events is read before those of the window join them.
    tagged = store.staged(carry.events(w, new["events"], new["alarms"]), "tagged")
    derived = {"cgm_gaps": carry.gaps(w, new["alarms"]), "suspension": carry.suspensions(w, _stops_and_goes(staged), new["alarms"]), "site_issues": carry.issues(w, new["alarms"], tagged), "requests": carry.requests(w, _messages(staged))}
    kept, close = carry.readings(w, new["cgm"])
    writes = {"cgm": lambda: store.merge("cgm", kept, close), "events": lambda: store.upsert("events", tagged, staged=True)}
    writes |= {name: lambda name=name, rows=rows: store.merge(name, rows) for name, rows in derived.items()}
    writes |= {name: lambda name=name: store.upsert(name, new[name], staged=True) for name in ("bolus", "basal", "alarms")}
    out = together(writes)
    received = staged.where(F.col("event_class") != BEFORE)
    days = received.groupBy("pump_serial").agg(F.to_date(F.min("timestamp")).alias("a"), F.to_date(F.max("timestamp")).alias("b"), F.max("timestamp").alias("last_event"))
    moved = marks.join(days, "pump_serial", "left")
    # Where a chunk couldn't be read, the next sync begins with it; a pump all of whose chunks failed keeps its bookmark.
    until = F.least(F.lit(now).cast("timestamp"), F.col("failed_from").cast("timestamp"))
    shown = F.coalesce(F.date_format("last_good_end", "yyyy-MM-dd"), F.date_format(until, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    store.set_fetch_states(moved.select(
        F.col("pump_serial").alias("source_id"), F.lit("pump").alias("source_kind"), until.alias("last_synced_at"), F.least("actual_min_date", "a").alias("actual_min_date"), F.greatest("actual_max_date", "b").alias("actual_max_date"),
        F.to_json(F.struct(shown.alias("last_good_chunk_end"), F.date_format("last_event", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("last_event"))).alias("meta"),
    ))
    if any(r.inserted for r in out.values()):
        store.set_pipeline_version(VERSION)
    store.unstage(marks, staged, tagged, *new.values())
    return {n: out[n] for n in TABLES}


def load_view(store: ParquetStore, config: Config, enriched: bool = False) -> dict[str, DataFrame]:
    """All nine tables of a store: as the pump gave them, or with everything that enrichment adds."""
    frames = {n: store.read_all(n) for n in TABLES}
    return backfill(frames, config.site_change) if enriched else original_view(frames)


def bulk_copy(source: ParquetStore, target: ParquetStore, only: list[str] | None = None, dry_run: bool = False) -> dict[str, UpsertResult | int | str]:
    """Upserts whole tables from one store to another; a table that fails is reported, the others go on."""
    report: dict[str, UpsertResult | int | str] = {}
    for name in only or list(TABLES):
        try:
            df = source.read_all(name)
            report[name] = df.count() if dry_run else target.upsert(name, df)
        except Exception as error:  # reported, not hidden: one bad table must not stop the copy
            report[name] = f"{type(error).__name__}: {error}"[:300]
    return report


def health(store: ParquetStore, version: int) -> dict[str, object]:
    """Version, tables without rows, and instants at which three readings or more share a second."""
    empty = [n for n in TABLES if not store.read_all(n).take(1)]
    stacked = store.read_all("cgm").groupBy(F.date_trunc("second", "timestamp").alias("s")).agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    worst = stacked.agg(F.count(F.lit(1)).alias("buckets"), F.max("n").alias("worst")).first()
    return {"version_matches": store.get_pipeline_version() == version, "empty_tables": empty, "stacked_seconds": worst["buckets"], "worst_stack": worst["worst"]}


def pump_metadata(raw: DataFrame) -> DataFrame:
    """Pumps with their range of dates, oldest first; names trimmed, pumps without a range left out."""
    named = raw.select(F.trim("serial").alias("pump_serial"), F.coalesce("model", F.lit("unknown")).alias("model"), F.to_date("min_date").alias("first_day"), F.to_date("max_date").alias("last_day"))
    return named.where("first_day is not null and last_day is not null").orderBy("first_day", "pump_serial")


def day_slice(frames: dict[str, DataFrame], day: date, tz: str) -> dict[str, DataFrame]:
    """All tables of one local day: points by instant, intervals by overlap."""
    since, until = window_bounds(day, 1, tz)
    ends = {"suspension": ("suspend_timestamp", "resume_timestamp"), "cgm_gaps": ("start_ts", "end_ts"), "site_issues": ("first_occlusion_ts", "resolved_by_site_change_ts")}
    return {n: df.where(overlaps(*ends[n], F.lit(since), F.lit(until))) if n in ends else between(df, time_of(n), since, until) for n, df in frames.items()}


def score_report(scored: DataFrame, path: str, title: str = "Fast rises") -> None:
    """Label counts by hour, as JSON lines and as a markdown table beside them."""
    labels = ["pre_bolused", "late_bolused", "uncovered"]
    counts = scored.groupBy("hour_of_day", "label").agg(F.count(F.lit(1)).alias("n"))
    counts.coalesce(1).write.mode("overwrite").json(path)
    counts = scored.sparkSession.read.schema("hour_of_day int, label string, n long").json(path)  # not scored again
    wide = counts.groupBy("hour_of_day").pivot("label", labels).agg(F.first("n")).fillna(0, labels)
    row = F.concat(F.lit("| "), F.concat_ws(" | ", F.col("hour_of_day").cast("string"), *(F.col(x).cast("string") for x in labels)), F.lit(" |"))
    head = [f"# {title}", "", f"| Hour | {' | '.join(labels)} |", "|---|---|---|---|"]
    lines = scored.sparkSession.createDataFrame(list(enumerate(head, -len(head))), "o int, value string").unionByName(wide.select(F.col("hour_of_day").alias("o"), row.alias("value")))
    lines.coalesce(1).sortWithinPartitions("o").select("value").write.mode("overwrite").text(f"{path}.md")


def page_count(total: int, page_size: int) -> int:
    return max(1, -(-total // page_size))


def nearest_date(days: list[date], wanted: date) -> date | None:
    """The closest day there is; of two, the earlier."""
    return min(sorted(days), key=lambda d: abs(d - wanted), default=None)


def shifted(day: date, by: int) -> date:
    return day + timedelta(days=by)


def reading_days(cgm: DataFrame, tz: str) -> DataFrame:
    return cgm.select(local_date("timestamp", tz).alias("day")).distinct().orderBy("day")
