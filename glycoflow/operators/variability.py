"""Variability: MODD, CONGA, MAGE over groups of readings, each a window pipeline; or CONGA and MAGE in one pass."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import local, second_of_day
from ..shipping import ship
from .joins import range_join, with_halo, with_neighbours


def modd(cgm: DataFrame, group: str, tz: str) -> DataFrame:
    """Mean absolute difference of readings at the same second of consecutive present local days; null under two days."""
    wall = local("timestamp", tz)
    rows = cgm.select(group, second_of_day(wall).alias("tod"), F.to_date(wall).alias("day"), "seqnum", F.col("bg_mgdl").cast("double").alias("bg"))
    before = F.lag("bg").over(Window.partitionBy(group, "tod").orderBy("day", "seqnum"))
    got = rows.withColumn("diff", F.abs(F.col("bg") - before)).groupBy(group).agg(F.avg("diff").alias("modd"), F.count_distinct("day").alias("days"))
    return got.select(group, F.when(F.col("days") >= 2, F.col("modd")).alias("modd"))


def conga(cgm: DataFrame, group: str, hours: int = 1, tolerance: int = 150) -> DataFrame:
    """Sample deviation of g(t) - g(t - hours), the earlier reading being the nearest within the tolerance.

    Of two equally near ones the earlier wins; of repeated instants the last row before, the first row after.
    """
    rows = cgm.select(group, "seqnum", F.unix_seconds("timestamp").alias("t"), F.col("bg_mgdl").cast("double").alias("bg"))
    left = rows.withColumn("want", F.col("t") - hours * 3600)
    right = rows.select(group, F.col("seqnum").alias("seq2"), F.col("t").alias("t2"), F.col("bg").alias("bg2"))
    pairs = range_join(left, right, group, "want", "t2", tolerance, tolerance)
    far, back = F.abs(F.col("t2") - F.col("want")), F.col("t2") <= F.col("want")
    order = F.struct(far, F.when(back, 0).otherwise(1), F.when(back, -F.col("seq2")).otherwise(F.col("seq2")))
    best = pairs.groupBy(group, "t", "seqnum").agg(F.min_by(F.col("bg") - F.col("bg2"), order).alias("diff"))
    got = best.groupBy(group).agg(F.stddev_samp("diff").alias("conga"))
    return cgm.select(group).distinct().join(got, group, "left")


def mage(cgm: DataFrame, group: str, chunk: int = 7 * 86400) -> DataFrame:
    """Mean amplitude over one deviation between turning points; null under three readings, 0 where none qualifies.

    Turning points are the first and last reading and those where a rise becomes a fall or the other way round; of equal
    readings in a row the last counts.  Rows are looked at in chunks of a week, so one long series is no single task.
    """
    order = ["timestamp", "seqnum"]
    rows = cgm.select(group, *order, F.unix_seconds("timestamp").alias("_t"), F.col("bg_mgdl").cast("double").alias("bg"))
    beside = lambda df, value: with_neighbours(df, group, "_t", chunk, order, value)
    all_rows = beside(rows, "bg").withColumn("end", F.col("before_").isNull() | F.col("after_").isNull()).withColumn("sign", F.signum(F.col("after_.v") - F.col("bg")))
    moving = all_rows.where("end or sign <> 0").withColumn("sign", F.nullif("sign", F.lit(0.0))).drop("before_", "after_")
    turns = beside(moving, "sign").where("end or sign <> before_.v").drop("before_", "after_")
    steps = beside(turns, "bg").select(group, F.abs(F.col("bg") - F.col("before_.v")).alias("a"))
    stats = rows.groupBy(group).agg(F.stddev_samp("bg").alias("sd"), F.count("bg").alias("n"))
    amplitude = steps.join(stats, group).where("a > sd").groupBy(group).agg(F.avg("a").alias("a"))
    return stats.join(amplitude, group, "left").select(group, F.when(F.col("n") >= 3, F.coalesce("a", F.lit(0.0))).alias("mage"))


def turning(v: np.ndarray) -> np.ndarray:
    """The first value, those where a rise becomes a fall or the other way round, and the last; runs of equal ones count once."""
    v = v[np.concatenate([[True], v[1:] != v[:-1]])] if len(v) else v
    up = v[1:] > v[:-1]
    return np.concatenate([v[:1], v[1:-1][up[1:] != up[:-1]], v[-1:]]) if len(v) > 1 else v


def _lagged(t: np.ndarray, v: np.ndarray, own: np.ndarray, lag: int, tolerance: int) -> np.ndarray:
    """v less the value nearest to `lag` seconds before, where one is near enough; of two equally near ones the earlier."""
    want = t[own] - lag
    back = np.searchsorted(t, want, "right") - 1
    ahead = np.minimum(back + 1, len(t) - 1)
    before = np.where(back >= 0, want - t[back], tolerance + 1)
    after = np.where(t[ahead] > want, t[ahead] - want, tolerance + 1)
    at = np.where(before <= after, back, ahead)
    return (v[own] - v[at])[np.minimum(before, after) <= tolerance]


_PART = "chunk long, n long, total double, squares double, amplitude array<double>, times array<long>, ends array<double>"


def swings(cgm: DataFrame, group: str, chunk: int = 7 * 86400, hours: int = 1, tolerance: int = 150) -> DataFrame:
    """By group: conga, and all amplitudes between turning points with how often each occurs (arrays amplitude, times).

    Readings are dealt once, by group and chunk of time with the hours before it.  A chunk gives count, sum and
    squares of its lagged differences; its inner amplitudes, counted; and four values: its first and last reading
    and its first and last turning point.  Then a group is a few numbers a chunk, whatever its readings are: what lies
    between one chunk's last turning point and the next one's first is looked at again.
    """
    ship(cgm.sparkSession)
    kind = cgm.schema[group].dataType.simpleString()
    rows = cgm.select(group, "seqnum", F.unix_seconds("timestamp").alias("t"), F.unix_micros("timestamp").alias("u"), F.col("bg_mgdl").cast("double").alias("v"))
    dealt = with_halo(rows, "t", chunk, hours * 3600 + tolerance)

    def part(table: pa.Table) -> pa.Table:
        t, u, v, seq, own = (table[c].to_numpy() for c in ("t", "u", "v", "seqnum", "_own"))
        order = np.lexsort((seq, u))
        t, v, own = t[order], v[order], own[order].astype(bool)
        if not own.any():
            return pa.table({group: table[group][:0], **{f.name: pa.array([], f.type) for f in _PART_SCHEMA}})
        d, turns = _lagged(t, v, np.flatnonzero(own), hours * 3600, tolerance), turning(v[own])
        # The first and last of `turns` are ends of the chunk, no turning points of the series.
        sizes, times = np.unique(np.abs(np.diff(turns[1:-1])), return_counts=True)
        ends = turns if len(turns) <= 4 else turns[[0, 1, -2, -1]]
        cells = [table["chunk"][0].as_py(), len(d), float(d.sum()), float((d * d).sum()), sizes.tolist(), times.tolist(), ends.tolist()]
        if len(turns) <= 4:
            cells[4:6] = [], []
        return pa.table({group: table[group][:1], **{f.name: pa.array([x], f.type) for f, x in zip(_PART_SCHEMA, cells)}})

    def whole(table: pa.Table) -> pa.Table:
        order = np.argsort(table["chunk"].to_numpy())
        n, total, squares = (table[c].to_numpy().sum() for c in ("n", "total", "squares"))
        ends = [table["ends"][int(i)].as_py() for i in order]
        inner = [table["amplitude"][int(i)].as_py() for i in order]
        counts: dict[float, int] = {}

        def add(size: float, times: int) -> None:
            counts[size] = counts.get(size, 0) + times

        for sizes, times in zip(inner, table["times"].take(pa.array(order)).to_pylist()):
            for size, k in zip(sizes, times):
                add(size, k)
        # Stretches between chunks' inner parts: each begins at a turning point or the series' start and ends at one or at its end.
        stretch: list[float] = []
        for e, x in zip(ends, inner):
            if x:
                stretch += e[:2]
                for size in np.abs(np.diff(turning(np.array(stretch)))).tolist():
                    add(size, 1)
                stretch = e[2:]
            else:
                stretch += e
        for size in np.abs(np.diff(turning(np.array(stretch)))).tolist():
            add(size, 1)
        conga = float(np.sqrt(max(squares - total * total / n, 0.0) / (n - 1))) if n > 1 else None
        return pa.table({group: table[group][:1], "conga": pa.array([conga], pa.float64()), "amplitude": pa.array([list(counts)], pa.list_(pa.float64())), "times": pa.array([list(counts.values())], pa.list_(pa.int64()))})

    parts = dealt.groupBy(group, "chunk").applyInArrow(part, f"`{group}` {kind}, {_PART}")
    return parts.groupBy(group).applyInArrow(whole, f"`{group}` {kind}, conga double, amplitude array<double>, times array<long>")


_PART_SCHEMA = pa.schema([("chunk", pa.int64()), ("n", pa.int64()), ("total", pa.float64()), ("squares", pa.float64()), ("amplitude", pa.list_(pa.float64())), ("times", pa.list_(pa.int64())), ("ends", pa.list_(pa.float64()))])


def mage_of(sd: Column, n: Column) -> Column:
    """MAGE from swings' amplitudes: the mean of those over one deviation; null under three readings, 0 where none is."""
    big = F.filter(F.arrays_zip("amplitude", "times"), lambda x: x["amplitude"] > sd)
    total = F.aggregate(big, F.lit(0.0), lambda s, x: s + x["amplitude"] * x["times"])
    times = F.aggregate(big, F.lit(0).cast("long"), lambda s, x: s + x["times"])
    return F.when(n >= 3, F.coalesce(F.try_divide(total, times), F.lit(0.0)))
