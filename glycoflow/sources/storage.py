"""Storage contract over parquet: bounded reads, insert-only upserts, deletes, bookmarks, alerts, detection log.

A table is a list of batches, folders of parquet files that are never changed.  The list is a small numbered file; the
newest complete one holds.  A write adds batches first and then the next list, under a new name, by one rename: readers
see the old table or the new one, and a crash in between leaves the old one.  So an upsert writes its new rows alone,
and reads of the stored keys only those that the batch's pumps and key ranges leave.

One writer at a time is assumed, as in the alert loop: a second one that takes the same number fails where the file
system's rename refuses an existing target (HDFS does), but object stores' renames neither refuse nor are atomic, so
there the rule must be kept from outside.  The names of the methods are the storage contract's.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from functools import reduce
from operator import or_
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from ..schema import TABLES, conform, key_of, table, time_of

_STATE = "source_id string, source_kind string, last_synced_at timestamp, actual_min_date date, actual_max_date date, meta string, updated_at timestamp, ord long"
_ALERTS = "id string, alert_kind string, pump_serial string, event_ref string, fired_at timestamp, payload string, delivery string"
#: Pumps of a batch whose key ranges are told apart, and that have folders of their own in it.
PUMPS = 100
_RESULTS = "id string, kind string, anchor_timestamp timestamp, payload string, created_at timestamp"


@dataclass(frozen=True)
class UpsertResult:
    received: int
    inserted: int
    skipped: int


class ParquetStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # -- lists of batches -------------------------------------------------------------------------------------

    def _lists(self, name: str) -> list[str]:
        found = self._fs.globStatus(self._path(f"{self.root}/{name}/list-*.json"))
        return sorted(s.getPath().toString() for s in found) if found else []

    def _batches(self, name: str) -> list[dict[str, Any]]:
        """Batches of the newest list: {"batch": folder, "without": pumps whose rows in it don't count, "flat": whether pumps have no folders}."""
        lists = self._lists(name)
        return json.loads("".join(r[0] for r in self.spark.read.text(lists[-1]).collect())) if lists else []

    def _publish(self, name: str, batches: list[dict[str, Any]]) -> None:
        lists = self._lists(name)
        number = int(lists[-1].rsplit("-", 1)[1].split(".")[0]) + 1 if lists else 0
        tmp = self._path(f"{self.root}/{name}/next-{uuid.uuid4().hex}")
        out = self._fs.create(tmp, True)
        out.write(bytearray(json.dumps(batches).encode()))
        out.close()
        target = self._path(f"{self.root}/{name}/list-{number:012d}.json")
        if self._fs.exists(target) or not self._fs.rename(tmp, target):
            raise OSError(f"couldn't publish {name}, list {number}: another writer may have taken it")

    def _add(self, name: str, df: DataFrame, partition_by: str | None = None) -> tuple[dict[str, Any], int]:
        """Writes a batch; its entry in the list, and its number of rows."""
        batch = f"b{uuid.uuid4().hex}"
        path = f"{self.root}/{name}/{'data' if partition_by else 'flat'}/batch={batch}"
        (df.write.partitionBy(partition_by) if partition_by else df.write).parquet(path)
        return {"batch": batch, "without": [], "flat": not partition_by}, self.spark.read.schema(df.schema).parquet(path).count()  # from the files' footers

    def _add_rows(self, name: str, df: DataFrame, pumps: int) -> tuple[dict[str, Any], int]:
        """Writes a batch of a table's rows by ranges of pump and time.

        Few pumps get folders of their own.  Of many, each would be one more file to commit, list and open, however small;
        their rows go to files of usual size, and the files' statistics tell pumps and times apart.
        """
        return self._add(name, self._spread(df, name), "pump_serial" if pumps <= PUMPS else None)

    def _pumps(self, df: DataFrame) -> int:
        """Pumps of df, but no more than one above PUMPS."""
        return df.select("pump_serial").distinct().limit(PUMPS + 1).count()

    def _read(self, name: str, schema: StructType) -> DataFrame:
        batches = self._batches(name)
        if not batches:
            return self.spark.createDataFrame([], schema).where("false")  # so Spark sees that it's empty, and drops joins with it
        columns, parts = [f.name for f in schema.fields], []
        typed = StructType([*schema.fields]).add("batch", StringType())
        for flat in (False, True):
            mine, base = [b for b in batches if b.get("flat", False) == flat], f"{self.root}/{name}/{'flat' if flat else 'data'}"
            if mine:
                df = self.spark.read.schema(typed).option("basePath", base).parquet(*(f"{base}/batch={b['batch']}" for b in mine))
                for b in mine:
                    if b["without"]:
                        df = df.where(~((F.col("batch") == b["batch"]) & F.col("pump_serial").isin(b["without"])))
                parts.append(df.select(columns))
        return reduce(DataFrame.unionByName, parts)

    def _replace(self, name: str, df: DataFrame, partition_by: str | None = None) -> None:
        self._publish(name, [self._add(name, df, partition_by)[0]])

    def vacuum(self, name: str, keep: int = 5) -> int:
        """Deletes lists but the newest `keep`, and batches that none of those names; the number of batches deleted."""
        lists = self._lists(name)
        named = {b["batch"] for at in lists[-keep:] for b in json.loads("".join(r[0] for r in self.spark.read.text(at).collect()))}
        for at in lists[:-keep]:
            self._fs.delete(self._path(at), False)
        found = self._fs.globStatus(self._path(f"{self.root}/{name}/{{data,flat}}/batch=*")) or []
        old = [s.getPath() for s in found if s.getPath().getName().removeprefix("batch=") not in named]
        for path in old:
            self._fs.delete(path, True)
        return len(old)

    def compact(self, name: str) -> None:
        """Puts all batches of a table into one."""
        have = self.read_all(name)
        self._publish(name, [self._add_rows(name, have, self._pumps(have))[0]])

    # -- tables -----------------------------------------------------------------------------------------------

    def _spread(self, df: DataFrame, name: str) -> DataFrame:
        """Dealt by ranges of pump and time, so that no pump is one task's and each file's statistics cover a short time."""
        t = time_of(name)
        return df.repartitionByRange("pump_serial", t).sortWithinPartitions("pump_serial", t)

    def read_all(self, name: str) -> DataFrame:
        return self._read(name, table(name))

    def read(self, name: str, since: datetime, until: datetime, pump_serial: str | None = None) -> DataFrame:
        """Rows in [since, until); bounds must carry a zone.  Filters reach the scan."""
        if since.tzinfo is None or until.tzinfo is None:
            raise ValueError("bounds must be time-zone aware")
        t = F.col(time_of(name))
        df = self.read_all(name).where((t >= F.lit(since)) & (t < F.lit(until)))
        return df if pump_serial is None else df.where(F.col("pump_serial") == pump_serial)

    def staged(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        """df as files of its own, so that plans over it don't work it out again; `unstage` deletes them."""
        path = f"{self.root}/staging/{name}-{uuid.uuid4().hex}"
        (df.write.partitionBy(partition_by) if partition_by else df.write).parquet(path)
        got = self.spark.read.schema(df.schema).parquet(path)
        got.staged_path = path
        return got

    def unstage(self, *frames: DataFrame) -> None:
        for df in frames:
            self._fs.delete(self._path(df.staged_path), True)

    def near(self, name: str, batch: DataFrame) -> DataFrame:
        """Stored rows among which any with a key of the batch must be: of its pumps, with keys in each pump's range.

        Pumps choose folders and key ranges choose row groups by their statistics, so what is read follows the batch,
        not the years that are stored.  For many pumps one range holds for all.
        """
        return self._near(name, batch)[0] if self._lists(name) else self.read_all(name)

    def _near(self, name: str, batch: DataFrame) -> tuple[DataFrame, int]:
        """`near`, and the batch's pumps, counted up to one above PUMPS."""
        key, have = key_of(name)[1], self.read_all(name)
        per = batch.groupBy("pump_serial").agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
        rows = per.limit(PUMPS + 1).collect()
        if not rows:
            return have.where("false"), 0
        if len(rows) > PUMPS:
            edge = batch.agg(F.min(key).alias("lo"), F.max(key).alias("hi")).first()
            return have.where(F.col(key).between(F.lit(edge["lo"]), F.lit(edge["hi"]))), len(rows)
        lo, hi = min(r["lo"] for r in rows), max(r["hi"] for r in rows)
        mine = reduce(or_, ((F.col("pump_serial") == r["pump_serial"]) & F.col(key).between(F.lit(r["lo"]), F.lit(r["hi"])) for r in rows))
        return have.where(F.col("pump_serial").isin([r["pump_serial"] for r in rows]) & F.col(key).between(F.lit(lo), F.lit(hi)) & mine), len(rows)

    def upsert(self, name: str, df: DataFrame, order: str | None = None, staged: bool = False) -> UpsertResult:
        """Inserts rows with new keys; stored rows win, of a batch's repeats the first by `order`.  Writes the new rows alone.

        Without an order the smallest row stays, so results don't depend on how the batch is partitioned.  The batch is
        worked out once.  Stored keys meet it in a semi join, for which Spark can build a Bloom filter at run time.
        staged: df is stored already and has each key once, so it is neither staged nor searched for repeats.
        """
        key, columns = key_of(name), [f.name for f in table(name).fields]
        batch = conform(df, name, [order] if order else [])
        batch = batch if staged else self.staged(batch, name)
        received = batch.count()  # from the files' footers
        rank = F.row_number().over(Window.partitionBy(*key).orderBy(*([f"_{order}"] if order else columns)))
        fresh, pumps = batch, None
        if self._lists(name):
            have, pumps = self._near(name, batch)
            fresh = batch.join(have.select(*key).join(batch.select(*key), key, "left_semi"), key, "left_anti")
        fresh = fresh if staged else fresh.withColumn("_n", rank).where("_n = 1")
        added, inserted = self._add_rows(name, fresh.select(columns), self._pumps(batch) if pumps is None else pumps)
        if inserted:
            self._publish(name, [*self._batches(name), added])
        if not staged:
            self.unstage(batch)
        return UpsertResult(received, inserted, received - inserted)

    def merge(self, name: str, rows: DataFrame, gone: DataFrame | None = None) -> UpsertResult:
        """Rows with new keys are added, those with stored keys replace them where any value differs, keys in `gone` are deleted.

        Of rows with one key the smallest counts.  inserted counts what was added or replaced.  Only pumps with a replaced or deleted row are written anew.
        """
        key, columns = key_of(name), [f.name for f in table(name).fields]
        smallest = F.row_number().over(Window.partitionBy(*key).orderBy(*columns))
        batch = self.staged(conform(rows, name).withColumn("_n", smallest).where("_n = 1").drop("_n"), name)
        received = batch.count()
        if not self._lists(name):  # nothing to compare with, replace or delete
            added, n = self._add_rows(name, batch, self._pumps(batch))
            if n:
                self._publish(name, [added])
            self.unstage(batch)
            return UpsertResult(received, n, received - n)
        have, pumps = self._near(name, batch)
        other = [c for c in columns if c not in key]
        side = have.select(*key, F.struct(*other).alias("_old"))
        state = F.when(F.col("_old").isNull(), "new").when(~F.struct(*other).eqNullSafe(F.col("_old")), "changed")
        marked = self.staged(batch.join(side, key, "left").withColumn("_state", state).where("_state is not null").select(*columns, "_state"), name)
        changed = marked.where("_state = 'changed'").select(columns)
        drop = changed.select(*key) if gone is None else changed.select(*key).unionByName(gone.select(*key).distinct())
        touched = [r["pump_serial"] for r in drop.select("pump_serial").distinct().collect()]
        batches = self._batches(name)
        if touched:
            mine = self.read_all(name).where(F.col("pump_serial").isin(touched))
            rest = mine.join(drop, key, "left_anti").select(columns).unionByName(changed)
            batches = [{**b, "without": sorted({*b["without"], *touched})} for b in batches] + [self._add_rows(name, rest, len(touched))[0]]
        added, n = self._add_rows(name, marked.where("_state = 'new'").select(columns), pumps)
        if n:
            batches = [*batches, added]
        if n or touched:
            self._publish(name, batches)
        n += changed.count()
        self.unstage(batch, marked)
        return UpsertResult(received, n, received - n)

    def delete_range(self, name: str, since: datetime | None = None, until: datetime | None = None, pump_serial: str | None = None) -> int:
        """Deletes rows in [since, until) of one pump or of all; with a pump given, only that pump's rows are written anew."""
        if since is None and until is None and pump_serial is None:
            raise ValueError("give since, until or pump_serial")
        t, hit = F.col(time_of(name)), F.lit(True)
        for value, condition in ((since, t >= F.lit(since)), (until, t < F.lit(until))):
            if value is not None:
                hit = hit & condition
        have = self.read_all(name)
        mine = have if pump_serial is None else have.where(F.col("pump_serial") == pump_serial)
        n = mine.where(hit).count()
        if n:
            left = mine.where(~F.coalesce(hit, F.lit(False)))
            rest, _ = self._add_rows(name, left, self._pumps(left) if pump_serial is None else 1)
            before = [] if pump_serial is None else [{**b, "without": [*b["without"], pump_serial]} for b in self._batches(name)]
            self._publish(name, [*before, rest])
        return n

    def clean_all(self) -> None:
        for name in (*TABLES, "fetch_state", "alerts", "detection_results", "pipeline_version"):
            self._fs.delete(self._path(f"{self.root}/{name}"), True)

    # -- bookmarks and version --------------------------------------------------------------------------------

    def set_fetch_states(self, states: DataFrame) -> None:
        """Sets bookmarks (source_id, source_kind, last_synced_at, actual_min_date, actual_max_date and, if given, meta) of many sources at once."""
        have = self.fetch_states()
        last = have.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("last"))
        rank = F.row_number().over(Window.orderBy("source_id"))  # one row a source: small
        new = states.join(have.select("source_id", F.col("ord").alias("old")), "source_id", "left").withColumn("ord", F.coalesce("old", last.scalar() + rank))
        rows = new.select("source_id", "source_kind", "last_synced_at", "actual_min_date", "actual_max_date", (F.col("meta") if "meta" in states.columns else F.lit("{}")).alias("meta"), F.current_timestamp().alias("updated_at"), F.col("ord").cast("long"))
        self._replace("fetch_state", have.join(states.select("source_id"), "source_id", "left_anti").select(have.columns).unionByName(rows).coalesce(1))

    def set_fetch_state(self, source_id: str, source_kind: str, last_synced_at: datetime | None = None, actual_min_date=None, actual_max_date=None, meta: dict | None = None) -> None:
        have = self.fetch_states()
        old = have.where(F.col("source_id") == source_id).first()
        order = old["ord"] if old else have.count()
        row = (source_id, source_kind, last_synced_at, actual_min_date, actual_max_date, json.dumps(meta or {}), datetime.now(timezone.utc), order)
        self._replace("fetch_state", have.where(F.col("source_id") != source_id).unionByName(self.spark.createDataFrame([row], _STATE)).coalesce(1))

    def fetch_states(self) -> DataFrame:
        return self._read("fetch_state", StructType.fromDDL(_STATE))

    def get_fetch_state(self, source_id: str):
        return self.fetch_states().where(F.col("source_id") == source_id).first()

    def list_fetch_state(self) -> DataFrame:
        return self.fetch_states().orderBy("ord").drop("ord")

    def set_pipeline_version(self, version: int) -> None:
        self._replace("pipeline_version", self.spark.createDataFrame([(version,)], "version int"))

    def get_pipeline_version(self) -> int | None:
        row = self._read("pipeline_version", StructType.fromDDL("version int")).first()
        return row["version"] if row else None

    # -- alerts and detection log -----------------------------------------------------------------------------

    def alerts(self) -> DataFrame:
        return self._read("alerts", StructType.fromDDL(_ALERTS))

    def record_alerts(self, alerts: DataFrame) -> DataFrame:
        """Inserts alerts whose (kind, event_ref) is new, or whose event_ref is null; returns the inserted ones.  Of several with one reference the earliest counts.

        alerts: alert_kind, pump_serial, event_ref, fired_at (instants), payload.  Running it again inserts nothing.
        """
        if dict(alerts.dtypes)["fired_at"] != "timestamp":
            raise ValueError("fired_at must be an instant (timestamp with a zone)")
        known = self.alerts().where("event_ref is not null").select("alert_kind", "event_ref")
        first = Window.partitionBy("alert_kind", "event_ref").orderBy("fired_at", "pump_serial", "payload")
        once = alerts.withColumn("_n", F.when(F.col("event_ref").isNull(), 1).otherwise(F.row_number().over(first))).where("_n = 1").drop("_n")
        new = once.join(known, ["alert_kind", "event_ref"], "left_anti").select(F.uuid().alias("id"), "alert_kind", "pump_serial", "event_ref", "fired_at", "payload", F.lit("pending").alias("delivery"))
        added, n = self._add("alerts", new.coalesce(1))
        if n:
            self._publish("alerts", [*self._batches("alerts"), added])
        return self.spark.read.schema(_ALERTS).parquet(f"{self.root}/alerts/flat/batch={added['batch']}") if n else self.spark.createDataFrame([], _ALERTS)

    def insert_or_get_alert(self, kind: str, event_ref: str, pump_serial: str, fired_at: datetime, payload: str = "{}") -> tuple[Any, bool]:
        """The alert with this kind and reference, and whether it was inserted just now."""
        if fired_at.tzinfo is None:
            raise ValueError("fired_at must be time-zone aware")
        row = self.spark.createDataFrame([(kind, pump_serial, event_ref, fired_at, payload)], "alert_kind string, pump_serial string, event_ref string, fired_at timestamp, payload string")
        new = self.record_alerts(row).first()
        return (new, True) if new else (self.find_alert(kind, event_ref), False)

    def find_alert(self, kind: str, event_ref: str):
        return self.alerts().where((F.col("alert_kind") == kind) & (F.col("event_ref") == event_ref)).orderBy(F.col("fired_at").desc()).limit(1).first()

    def recent_alerts(self, kind: str, within: timedelta, now: datetime | None = None) -> DataFrame:
        since = (now or datetime.now(timezone.utc)) - within
        return self.alerts().where((F.col("alert_kind") == kind) & (F.col("fired_at") >= F.lit(since))).orderBy(F.col("fired_at").desc())

    def record_results(self, results: DataFrame) -> None:
        """Appends (kind, anchor_timestamp, payload) to the detection log."""
        rows = results.select(F.uuid().alias("id"), "kind", "anchor_timestamp", "payload", F.current_timestamp().alias("created_at"))
        rows.write.mode("append").parquet(f"{self.root}/detection_results/log")

    def results(self) -> DataFrame:
        at = f"{self.root}/detection_results/log"
        return self.spark.read.schema(_RESULTS).parquet(at) if self._fs.exists(self._path(at)) else self.spark.createDataFrame([], _RESULTS)

    def list_results(self, kind: str | None = None, since: datetime | None = None, limit: int = 100) -> DataFrame:
        df = self.results()
        df = df if kind is None else df.where(F.col("kind") == kind)
        df = df if since is None else df.where(F.col("created_at") >= F.lit(since))
        return df.orderBy(F.col("created_at").desc(), "id").limit(limit)


def fetch_window(now: datetime, last_synced: datetime | None, first_available: datetime, override: datetime | None = None, overlap: timedelta = timedelta(days=1)) -> tuple[datetime, datetime]:
    """Override first; all there is without a bookmark; else from the bookmark less an overlap."""
    return (override or (first_available if last_synced is None else max(first_available, last_synced - overlap)), now)


def shift_times(df: DataFrame, column: str, hours: int, since: datetime, until: datetime, pump_serial: str) -> DataFrame:
    """Moves one pump's timestamps of a range by so many hours; the table is rewritten at once, so keys can't clash."""
    hit = (F.col("pump_serial") == pump_serial) & (F.col(column) >= F.lit(since)) & (F.col(column) < F.lit(until))
    return df.withColumn(column, F.when(hit, F.col(column) + F.expr(f"interval {hours} hours")).otherwise(F.col(column)))


def repair_shift(store: ParquetStore, name: str, hours: int, since: datetime, until: datetime, pump_serial: str, column: str | None = None) -> int:
    """Moves a stored pump's timestamps of a range; the number of rows moved."""
    column = column or time_of(name)
    have = store.read_all(name).where(F.col("pump_serial") == pump_serial)
    n = have.where((F.col(column) >= F.lit(since)) & (F.col(column) < F.lit(until))).count()
    if n:
        moved, _ = store._add_rows(name, shift_times(have, column, hours, since, until, pump_serial), 1)
        store._publish(name, [*({**b, "without": [*b["without"], pump_serial]} for b in store._batches(name)), moved])
    return n
