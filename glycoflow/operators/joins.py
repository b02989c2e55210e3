"""Range and as-of joins as equi-joins on time buckets, and halo partitions for windows over long series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def range_join(left: DataFrame, right: DataFrame, by: str, left_t: str, right_t: str, before: int, after: int) -> DataFrame:
    """Pairs with right_t in [left_t - before, left_t + after] (whole seconds, closed) and the same `by`.

    The left row is repeated for each time bucket that its interval touches, three at most, so the join is a hash or merge join on
    (by, bucket) that Spark can shuffle and split by, never a product of two series.
    """
    width = max(before + after, 1)
    bucket = lambda t: F.floor(t / width)
    lo, hi = bucket(F.col(left_t) - before), bucket(F.col(left_t) + after)
    spread = left.withColumn("_bucket", F.explode(F.sequence(lo, hi)))
    r_side = right.withColumn("_bucket", bucket(F.col(right_t)))
    near = (F.col(right_t) >= F.col(left_t) - before) & (F.col(right_t) <= F.col(left_t) + after)
    return spread.join(r_side, [by, "_bucket"]).where(near).drop("_bucket")


def best_matches(left: DataFrame, right: DataFrame, by: str, key: list[str], left_t: str, right_t: str, before: int, after: int, take: dict[str, tuple[Column, Column, Column]]) -> DataFrame:
    """Left rows with, for each name in `take`, the value of the best right row in range; null if none.

    take: name to (condition, order, value).  The left side is read once: its rows go along through one outer join on
    time buckets, and one grouping picks all the bests.
    """
    width = max(before + after, 1)
    bucket = lambda t: F.floor(t / width)
    mine = left.select(by, *key, F.col(left_t).alias("_t"), F.struct(*(c for c in left.columns if c not in (by, *key))).alias("_left"))
    spread = mine.withColumn("_bucket", F.explode(F.sequence(bucket(F.col("_t") - before), bucket(F.col("_t") + after))))
    side = right.withColumnsRenamed({c: f"_r_{c}" for c in right.columns if c != by}).withColumn("_bucket", bucket(F.col(f"_r_{right_t}")))
    near = (F.col(f"_r_{right_t}") >= F.col("_t") - before) & (F.col(f"_r_{right_t}") <= F.col("_t") + after)
    pairs = spread.join(side, [by, "_bucket"], "left")
    picks = [F.min_by(value, F.when(near & condition, order)).alias(name) for name, (condition, order, value) in take.items()]
    return pairs.groupBy(by, *key).agg(F.first("_left").alias("_left"), *picks).select(by, *key, "_left.*", *take)


def with_halo(df: DataFrame, t: str, chunk: int, before: int) -> DataFrame:
    """Rows with a chunk number; those that later anchors may look back on also go to the chunks there (_own is false).

    Windows partitioned by (series, chunk) then see all they need, and a long series is shared among many tasks.
    """
    first = F.floor(F.col(t) / chunk)
    last = F.floor((F.col(t) + before) / chunk)
    return df.withColumn("chunk", F.explode(F.sequence(first, last))).withColumn("_own", F.col("chunk") == first)


def with_neighbours(df: DataFrame, by: str, t: str, chunk: int, order: list[str], value: str) -> DataFrame:
    """Adds before_ and after_, one-field structs with the value of the rows before and after in a series; null at its ends.

    Windows are over (series, chunk of time), so a long series is shared among tasks.  Only the first and last row of each
    chunk then meet in a window over the series: two rows a chunk.
    """
    inside = Window.partitionBy(by, "_chunk").orderBy(*order)
    rows = df.withColumn("_chunk", F.floor(F.col(t) / chunk)).withColumn("_value", F.struct(F.col(value).alias("v")))
    rows = rows.withColumns({"before_": F.lag("_value").over(inside), "after_": F.lead("_value").over(inside)})
    rows = rows.withColumn("_among", F.when(F.col("before_").isNull() | F.col("after_").isNull(), F.lit(-(2**60))).otherwise(F.col("_chunk")))
    edges = Window.partitionBy(by, "_among").orderBy(*order)
    # Among edges alone, what is before a chunk's first row is the last row of the chunk before it; likewise after its last.
    found = {"before_": F.coalesce("before_", F.lag("_value").over(edges)), "after_": F.coalesce("after_", F.lead("_value").over(edges))}
    return rows.withColumns(found).drop("_chunk", "_value", "_among")


def with_last(df: DataFrame, by: str, t: str, chunk: int, order: list[str], value: Column, name: str) -> DataFrame:
    """Adds the last non-null value up to and with each row of a series.

    Within (series, chunk of t) by a window.  What a chunk takes over from those before it is found among the first and
    last rows of chunks alone, and then handed from its first row to the others; so no task gets a whole series.
    """
    inside = Window.partitionBy(by, "_chunk").orderBy(*order)
    rows = df.withColumn("_chunk", F.floor(F.col(t) / chunk)).withColumn("_value", value)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_here": F.last("_value", ignorenulls=True).over(upto), "_first": F.lag(F.lit(True), 1, False).over(inside) == F.lit(False), "_end": F.lead(F.lit(True), 1, False).over(inside) == F.lit(False)})
    rows = rows.withColumn("_among", F.when(F.col("_first") | F.col("_end"), F.lit(-(2**60))).otherwise(F.col("_chunk")))
    before = Window.partitionBy(by, "_among").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_carry", F.when(F.col("_first"), F.last(F.when(F.col("_end"), F.col("_here")), ignorenulls=True).over(before)))
    taken = F.first("_carry", ignorenulls=True).over(upto)
    return rows.withColumn(name, F.coalesce("_here", taken)).drop("_chunk", "_value", "_here", "_first", "_end", "_among", "_carry")
