"""Sequential operators without state machines: pairing, sessions, thinning."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .joins import with_last, with_neighbours


#: Seconds of a series that one task looks at.
CHUNK = 28 * 86400


def pair(df: DataFrame, by: str, order: list[str], opens: Column, closes: Column, t: str = "timestamp", chunk: int = CHUNK) -> DataFrame:
    """Opening rows with end_ts and end_open: the next opening or closing row decides, others are ignored.

    Null end: still open.  end_open: another opening came first.  Closing rows that nothing precedes go.  A series is
    looked at in chunks of time; t comes first in the order.
    """
    only = df.withColumn("_open", opens).where(opens | closes).withColumns({"_at": F.unix_seconds(t), "_self": F.struct(F.col(t).alias("t"), F.col("_open").alias("open"))})
    got = with_neighbours(only, by, "_at", chunk, order, "_self").where("_open")
    return got.withColumns({"end_ts": F.col("after_.v.t"), "end_open": F.col("after_.v.open")}).drop("_open", "_at", "_self", "before_", "after_")


def sessions(df: DataFrame, by: str, order: list[str], t: Column, gap_seconds: int, chunk: int = CHUNK) -> DataFrame:
    """Adds `session`, the time at which the row's session began: where the row before is more than the gap away.

    t, in seconds, comes first in the order; a series is looked at in chunks of it.
    """
    near = with_neighbours(df.withColumn("_at", t), by, "_at", chunk, order, "_at")
    begin = F.when(F.coalesce(F.col("_at") - F.col("before_.v") <= gap_seconds, F.lit(False)), None).otherwise(F.col("_at"))
    return with_last(near.withColumn("_begin", begin).drop("before_", "after_"), by, "_at", chunk, order, F.col("_begin"), "session").drop("_at", "_begin")


#: Gaps that one chunk of a series spans when it is thinned.
SPAN = 168


def _kept(positions: np.ndarray, gap: int) -> np.ndarray:
    """For each of the ascending positions the place of the last one that stays if thinning starts there: pointers to the
    first position a gap or more beyond, doubled until all have come to an end."""
    ahead = np.searchsorted(positions, positions + gap)
    last = np.where(ahead < len(positions), ahead, np.arange(len(positions)))
    while True:
        beyond = last[last]
        if (beyond == last).all():
            return last
        last = beyond


def thin(df: DataFrame, by: str, position: str, gap: int, span: int = SPAN) -> DataFrame:
    """Greedy thinning by position: the first of each series stays, then each one `gap` or more after the last that stayed.

    A chunk of `span` gaps maps where thinning may start in it (only positions in its first gap and one beyond can) to
    where it then stands at its end.  These maps, a few numbers a chunk, are followed along a series; each chunk is then
    thinned from its own start.  So a series is shared among tasks and takes time in line with its rows, however
    dense it is.  Both passes over the rows take them from one shuffle.  Rows at a position that stays all stay.
    """
    ship(df.sparkSession)
    kind, width = df.schema[by].dataType.simpleString(), gap * span
    dealt = df.withColumn("_chunk", F.floor(F.col(position) / width).cast("long"))

    def reach(table: pa.Table) -> pa.Table:
        p, chunk = np.unique(table[position].to_numpy()), table["_chunk"][0].as_py()
        starts = p[: np.searchsorted(p, chunk * width + gap) + 1]
        ends = p[_kept(p, gap)[: len(starts)]]
        return pa.table({by: table[by][:1], "_chunk": table["_chunk"][:1], "starts": pa.array([starts.tolist()], pa.list_(pa.int64())), "ends": pa.array([ends.tolist()], pa.list_(pa.int64()))})

    def follow(table: pa.Table) -> pa.Table:
        rows, free = [], None
        for chunk, starts, ends in sorted(zip(*(table[c].to_pylist() for c in ("_chunk", "starts", "ends")))):
            i = 0 if free is None else bisect_left(starts, free)
            if i < len(starts):
                rows.append((chunk, starts[i]))
                free = ends[i] + gap
        one = table[by].take(pa.array([0] * len(rows), pa.int64()))
        return pa.table({by: one, "_chunk": pa.array([c for c, _ in rows], pa.int64()), "_start": pa.array([s for _, s in rows], pa.int64())})

    def stay(rows: pa.Table, start: pa.Table) -> pa.Table:
        if not start.num_rows or not rows.num_rows:
            return rows.slice(0, 0).drop_columns(["_chunk"])
        at, free, kept = rows[position].to_numpy(), start["_start"][0].as_py(), []
        p = np.unique(at)
        i = int(np.searchsorted(p, free))
        while i < len(p):
            kept.append(p[i])
            i = int(np.searchsorted(p, p[i] + gap))
        return rows.filter(pa.array(np.isin(at, kept))).drop_columns(["_chunk"])

    maps = dealt.groupBy(by, "_chunk").applyInArrow(reach, f"`{by}` {kind}, _chunk long, starts array<long>, ends array<long>")
    starts = maps.groupBy(by).applyInArrow(follow, f"`{by}` {kind}, _chunk long, _start long")
    return dealt.groupBy(by, "_chunk").cogroup(starts.groupBy(by, "_chunk")).applyInArrow(stay, df.schema)
