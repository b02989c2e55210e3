"""Vector code compression: product quantisation in exact integers, nearest entries found by exponion search."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, prepare, stored
from .vectors import floored, rows_of, usable

#: Integers of this size at most: squared distances of parts then stay far inside 64 bits.
LIMIT = 1 << 27
_ROWS = "vec_id long, label binary, x binary, code binary, error long, slot int, total long"


def nearest(x: np.ndarray, entries: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each row and the squared distance; of equally near ones the lowest index.

    Exponion search: with u the squared distance to the entry a that a row starts from, an entry as near as that is at
    most twice the root of u away from a, so only entries within squared distance 4 u of a can win.  Each entry has its
    neighbours sorted by distance, and rows go along the list of theirs until it leaves that radius.  All in integers:
    any start gives the same result.
    """
    k = len(entries)
    gap = entries[:, None, :] - entries[None, :, :]
    apart = (gap * gap).sum(axis=2)
    np.fill_diagonal(apart, -1)  # an entry comes first in its own list, which begins behind it
    order = np.argsort(apart, axis=1, kind="stable")[:, 1:]
    apart = np.take_along_axis(apart, order, axis=1)
    gap = x - entries[start]
    best, error = start.astype(np.int64), (gap * gap).sum(axis=1)
    radius, active = 4 * error, np.arange(len(x))
    for rank in range(k - 1):
        active = active[apart[start[active], rank] <= radius[active]]
        if not len(active):
            break
        rival = order[start[active], rank]
        gap = x[active] - entries[rival]
        far = (gap * gap).sum(axis=1)
        wins = (far < error[active]) | (far == error[active]) & (rival < best[active])
        won = active[wins]
        best[won], error[won] = rival[wins], far[wins]
    return best, error


@dataclass(frozen=True)
class Codebooks:
    """Entries by part, entry and position within the part; scale: vectors' entries become floor(scale * entry)."""

    entries: np.ndarray
    scale: int

    def assign(self, x: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of integer vectors (rows x parts), each searched from its previous code, and squared distances."""
        parts, width = self.entries.shape[0], self.entries.shape[2]
        got = [nearest(np.ascontiguousarray(x[:, p * width : (p + 1) * width]), self.entries[p], code[:, p]) for p in range(parts)]
        return np.stack([g[0] for g in got], axis=1), np.sum([g[1] for g in got], axis=0)

    def updated(self, totals: dict[int, int]) -> Codebooks:
        """Entries replaced by floor(sum / count) of their parts; those that no part has stay.  totals: by slot, see `_slots`."""
        parts, k, width = self.entries.shape
        t = np.array([totals.get(i, 0) for i in range(parts * k * (width + 1))], np.int64).reshape(parts, k, width + 1)
        count = t[:, :, width:]
        return Codebooks(np.where(count > 0, t[:, :, :width] // np.maximum(count, 1), self.entries), self.scale)

    def text(self) -> str:
        """All entries' integers in order, comma-joined."""
        return ",".join(map(str, self.entries.reshape(-1).tolist()))

    def decode(self, code: np.ndarray) -> np.ndarray:
        """Vectors that codes stand for: the middle of what rounds down to each integer."""
        return (np.concatenate([self.entries[p][code[:, p]] for p in range(len(self.entries))], axis=1) + 0.5) / self.scale


def _slots(x: np.ndarray, code: np.ndarray, shape: tuple[int, int, int]) -> np.ndarray:
    """Sums and, behind them, counts by part and entry."""
    parts, k, width = shape
    out = np.zeros((parts, k, width + 1), np.int64)
    for p in range(parts):
        # Doubles hold a batch's sums exactly: at most 2 ** 27 times its rows.
        member = (code[:, p] == np.arange(k)[:, None]).astype(float)
        out[p, :, :width], out[p, :, width] = member @ x[:, p * width : (p + 1) * width], member.sum(axis=1)
    return out


def _batch(ids: pa.Array, labels: pa.Array, x: list, code: list, error: np.ndarray) -> pa.RecordBatch:
    n = len(ids)
    columns = [ids, labels, pa.array(x, pa.binary()), pa.array(code, pa.binary()), pa.array(error, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "x", "code", "error", "slot", "total"])


def _pass(rows: DataFrame, books: Codebooks, first: bool) -> DataFrame:
    """Assigns every part to its codebook's nearest entry.

    A row of the result is a vector with its codes; or, last in each task, a slot and its total over the task's
    vectors (slot not null).  So one pass gives codes and sums, and what is read of the sums are two columns.
    """
    parts, k, width = books.entries.shape
    size = parts * width

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((parts, k, width + 1), np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            if first:
                x, before = rows_of(batch.column("v"), size, np.int64), np.zeros((n, parts), np.int64)
                if np.abs(x).max() > LIMIT:
                    raise ValueError(f"entries times {books.scale} must stay within {LIMIT}")
            else:
                x = np.frombuffer(b"".join(batch.column("x").to_pylist()), "<i4").reshape(n, size).astype(np.int64)
                before = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(n, parts)
            code, error = books.assign(x, before.astype(np.int64))
            totals += _slots(x, code, (parts, k, width))
            packed, small = x.astype("<i4").tobytes(), code.astype(np.uint8).tobytes()
            yield _batch(batch.column("vec_id"), batch.column("label"), [packed[4 * size * i : 4 * size * (i + 1)] for i in range(n)], [small[parts * i : parts * (i + 1)] for i in range(n)], error)
        flat = totals.reshape(-1)
        used = np.flatnonzero(flat)
        none = pa.nulls(len(used), pa.binary())
        sums = [pa.nulls(len(used), pa.int64()), none, none, none, pa.nulls(len(used), pa.int64()), pa.array(used, pa.int32()), pa.array(flat[used])]
        yield pa.RecordBatch.from_arrays(sums, ["vec_id", "label", "x", "code", "error", "slot", "total"])

    return rows.mapInArrow(assign, _ROWS)


def _totals(assigned: DataFrame) -> dict[int, int]:
    """Sums and counts of all entries: as many rows as the codebooks have integers, whatever the input."""
    got = assigned.where("slot is not null").groupBy("slot").agg(F.sum("total").alias("total"))
    return {r["slot"]: r["total"] for r in got.collect()}


def train(df: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = None) -> tuple[Codebooks, DataFrame] | None:
    """Codebooks and the table (vec_id, label, code, error) of all usable vectors; None without any.

    Codebooks start as the parts of the vectors with the smallest ids (null ids last, equal ids by vector).  Each round
    is one pass over a stored table, from which codes of the round before are taken as starts; the table before it is
    then deleted, so at most two are there.  A lost executor repeats its tasks of one pass.
    """
    spark = df.sparkSession
    prepare(spark)
    label = F.col(label_col) if label_col else F.lit(None).cast("string")
    # A label goes along as the bytes of its text, whatever its type is.
    good, width = usable(df.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("string").cast("binary").alias("label"), F.col(vector_col).alias("raw")), "raw")
    if not width:
        return None
    if width % parts:
        raise ValueError(f"vectors of {width} entries can't be cut into {parts} equal parts")
    if entries > 256:
        raise ValueError("a code is one byte: 256 entries at most")
    rows = good.select("vec_id", "label", floored(F.col("raw"), scale).alias("v"))
    seeds = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    start = np.array([r["v"] for r in seeds], np.int64).reshape(len(seeds), parts, width // parts)
    books, table = Codebooks(np.ascontiguousarray(start.transpose(1, 0, 2)), scale), None
    for i in range(rounds + 1):
        before = table
        table = stored(_pass(rows if before is None else before.where("slot is null"), books, before is None), f"codes-{i}")
        if before is not None:
            discard(before)
        if i < rounds:
            books = books.updated(_totals(table))
    return books, table.where("slot is null").select("vec_id", F.col("label").cast("string").alias("label"), "code", "error")


#: A label with more than one row in so many is hot: there are fewer than so many hot labels.
HOT = 64


def _with_label_errors(rows: DataFrame) -> DataFrame:
    """Adds label_error: the sum of error over rows with the same label, nulls together.

    Sums of hot labels, of which there are fewer than 64, go to all tasks; the others are joined by a shuffle.
    """
    sums = stored(rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_n")), "label-errors")
    total = sums.agg(F.sum("_n")).first()[0]
    hot = sums.where(F.col("_n") * HOT > total).select(F.col("label").alias("_label"), "label_error", F.lit(True).alias("_hot"))
    marked = rows.join(F.broadcast(hot), F.col("label").eqNullSafe(F.col("_label")), "left").drop("_label")
    if sums.where(F.col("_n") * HOT <= total).isEmpty():
        return marked.drop("_hot")
    rest = sums.where(F.col("_n") * HOT <= total).select(F.col("label").alias("_label"), F.col("label_error").alias("_sum"))
    # A null label of few rows has a sum of its own among the rest.
    others = marked.where("_hot is null").drop("label_error", "_hot")
    joined = others.join(rest, F.col("label").eqNullSafe(F.col("_label"))).withColumnRenamed("_sum", "label_error").drop("_label")
    return marked.where("_hot").drop("_hot").unionByName(joined)


def compress_vectors(df: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Each usable vector as one byte a part: vec_id, label (as text), code (binary), error, label_error, codebooks (text).

    Entries become integers floor(scale * entry) and all that follows is exact: rounds of assigning parts to their
    nearest codebook entries (ties to the lower index) and replacing entries by floored means, then a last assignment.
    error is the squared distance summed over parts; label_error its sum over equal labels, nulls together.

    Rows whose vector is null, holds nulls, NaN or infinities, is empty or has another length than most are left out.
    Ids may be null or repeated: rows are coded one by one.  Fewer vectors than entries make smaller codebooks.
    Integers beyond 2 ** 27 and lengths that parts don't divide are errors.  An empty table gives an empty result;
    other columns are ignored, whatever their names.
    """
    got = train(df, parts, entries, rounds, scale, id_col, vector_col, label_col)
    if got is None:
        return df.sparkSession.createDataFrame([], "vec_id long, label string, code binary, error long, label_error long, codebooks string")
    books, rows = got
    return _with_label_errors(rows).withColumn("codebooks", F.lit(books.text()))
