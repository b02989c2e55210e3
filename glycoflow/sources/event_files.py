"""Raw events from a landing folder, as a Spark data source for tables and streams.

A gateway leaves one file of JSON lines a day and pump, `<folder>/<yyyy-mm-dd>/<pump>.jsonl`, in a folder that the driver and
all executors mount; each line has event_class, timestamp, seqnum and payload.  A table is read in chunks of days of one
pump, each a task.  A chunk that fails gives none of its events and doesn't stop the others; every chunk leaves a
row of class `chunk` that says how it went, so a sync can go back to where the first failed one began.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..shipping import ship

SCHEMA = "event_class string, timestamp timestamp, seqnum long, pump_serial string, ingest_ord long, payload string"
CHUNK_DAYS = 30


@dataclass
class Chunk(InputPartition):
    """Files of one pump's days from start up to, and not with, end."""

    pump: str
    start: str
    end: str
    files: list[str]


def _days(folder: str) -> list[str]:
    return sorted(d for d in os.listdir(folder) if os.path.isdir(os.path.join(folder, d)))


def _files(folder: str) -> list[tuple[str, str]]:
    """(day, pump) of all files, by day and pump."""
    return [(d, f.removesuffix(".jsonl")) for d in _days(folder) for f in sorted(os.listdir(os.path.join(folder, d))) if f.endswith(".jsonl")]


def chunks(start: date, end: date, days: int = CHUNK_DAYS) -> list[tuple[date, date]]:
    """[start, end) in parts of so many days."""
    return [(start + timedelta(days=i), min(start + timedelta(days=i + days), end)) for i in range(0, (end - start).days, days)]


def _event(line: str, day: str, number: int, pump: str) -> tuple:
    e = json.loads(line)
    payload = e.get("payload")
    order = date.fromisoformat(day).toordinal() * 10_000_000 + number
    return (e["event_class"], datetime.fromisoformat(e["timestamp"]).astimezone(timezone.utc), e["seqnum"], pump, order, payload if isinstance(payload, str) else json.dumps(payload or {}))


def _read(folder: str, chunk: Chunk) -> Iterator[tuple]:
    """A chunk's events, if all of its files can be read; then a row about it."""
    error, rows = None, []
    try:
        for day in chunk.files:
            with open(os.path.join(folder, day, f"{chunk.pump}.jsonl"), encoding="utf-8") as f:
                rows += [_event(line, day, i, chunk.pump) for i, line in enumerate(f) if line.strip()]
    except Exception as failure:  # reported in the chunk's row; other chunks go on
        error, rows = f"{type(failure).__name__}: {failure}"[:300], []
    yield from rows
    about = {"start": chunk.start, "end": chunk.end, "ok": error is None, "events": len(rows), "error": error}
    yield ("chunk", datetime.fromisoformat(chunk.start).replace(tzinfo=timezone.utc), None, chunk.pump, None, json.dumps(about))


class _TableReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.options = options["path"], options

    def partitions(self) -> list[Chunk]:
        files = _files(self.folder)
        pumps = self.options.get("pumps")
        wanted = set(pumps.split(",")) if pumps else {p for _, p in files}
        out = []
        for pump in sorted(wanted):
            days = [d for d, p in files if p == pump]
            if days:
                start = date.fromisoformat(self.options.get("since") or days[0])
                end = date.fromisoformat(self.options.get("until") or days[-1]) + timedelta(days=0 if self.options.get("until") else 1)
                for a, b in chunks(start, end, int(self.options.get("chunk_days", CHUNK_DAYS))):
                    out.append(Chunk(pump, a.isoformat(), b.isoformat(), [d for d in days if a.isoformat() <= d < b.isoformat()]))
        return out

    def read(self, partition: Chunk) -> Iterator[tuple]:
        return _read(self.folder, partition)


class _StreamReader(DataSourceStreamReader):
    """Offsets are the last file, by day and pump, that was handed on; a file that appears must sort behind it."""

    def __init__(self, options: dict):
        self.folder = options["path"]

    def initialOffset(self) -> dict:
        return {"day": "", "pump": ""}

    def latestOffset(self) -> dict:
        files = _files(self.folder)
        return dict(zip(("day", "pump"), files[-1])) if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Chunk]:
        a, b = ((x["day"], x["pump"]) for x in (start, end))
        return [Chunk(pump, day, (date.fromisoformat(day) + timedelta(days=1)).isoformat(), [day]) for day, pump in _files(self.folder) if a < (day, pump) <= b]

    def read(self, partition: Chunk) -> Iterator[tuple]:
        return _read(self.folder, partition)


class EventFiles(DataSource):
    """Format `event_files`.  Options: path; for tables also since, until (not included), pumps (comma-joined), chunk_days."""

    @classmethod
    def name(cls) -> str:
        return "event_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _TableReader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(self.options)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(EventFiles)


def seen(raw: DataFrame) -> DataFrame:
    """By pump, from one pass: events, their number; first, the time of the first; and what `fetched` tells of its chunks."""
    chunk = F.col("event_class") == "chunk"
    p = F.from_json(F.when(chunk, F.col("payload")), "start date, end date, ok boolean")
    about = raw.select("pump_serial", (~chunk).alias("event"), F.when(~chunk, F.col("timestamp")).alias("t"), p.alias("p"))
    return about.groupBy("pump_serial").agg(
        F.count_if("event").alias("events"), F.min("t").alias("first"),
        F.max(F.when(F.col("p.ok"), F.col("p.end"))).alias("last_good_end"), F.min(F.when(~F.col("p.ok"), F.col("p.start"))).alias("failed_from"),
    )


def fetched(raw: DataFrame) -> DataFrame:
    """By pump: last_good_end, the end of its last chunk that could be read; failed_from, the start of the first that couldn't."""
    return seen(raw.where("event_class = 'chunk'")).drop("events", "first")
