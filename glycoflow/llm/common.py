"""What the operators share on the Spark side: sizing, settings, tables that cut lineage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import shared_folder, ship
from .kernels import pack_ints, text_bytes, unpack_ints

TEXT_MB = 8  # of text in a block that one group holds


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches, so that long texts don't fill a Python worker; the package's sources for the workers."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def prime(n: int) -> int:
    """The first prime from n on: ids with a common step still spread over so many blocks."""
    n = max(2, int(n))
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def size_of(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """Bytes of text and number of rows."""
    row = docs.agg(F.sum(F.octet_length(text_col)).alias("b"), F.count(F.lit(1)).alias("n")).first()
    return int(row["b"] or 0), int(row["n"])


def partitions_for(n_bytes: int) -> int:
    """Shuffle partitions for so many bytes: about 8 MB each while they are few, 64 MB each beyond that."""
    return max(8, min(64, n_bytes // 8_000_000), n_bytes // 64_000_000)


def blocks_for(n_bytes: int, mb: float = TEXT_MB, least: int = 61) -> int:
    """How many blocks of about `mb` MB; it grows with the input, so a block doesn't."""
    return prime(max(least, n_bytes / (mb * 1e6)))


#: Rows of a stored table that one file holds at least, where their number is known.
FILE_ROWS = 20_000


def under_own_names(docs: DataFrame, columns: list[str], apply: Callable[..., DataFrame], new: list[str]) -> DataFrame:
    """apply(docs, *columns) on docs whose columns have numbers for names, so that no name can clash with one used inside.

    apply gives docs' columns in their order and the new ones behind them; docs' get their own names back.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    have = [c.lower() for c in docs.columns]
    return apply(docs.toDF(*names), *(names[have.index(c.lower())] for c in columns)).toDF(*docs.columns, *new)


def stored(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Writes df as a table in the shared folder and returns the table: lineage ends there, lost executors don't matter.

    rows: about how many there are at most; small tables then come in a few files instead of one for each partition.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    (df if rows is None else df.coalesce(max(4, -(-rows // FILE_ROWS)))).write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables from which nothing is read any more."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.stored_path)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def slices(batches: Iterator[pa.RecordBatch], text_col: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Batches in parts of at most so many bytes of text, or of one row: arrays made of a part stay that small."""
    for batch in batches:
        off, at = text_bytes(batch.column(text_col))[1], 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def summed(parts: DataFrame, dtype: type) -> dict[int, np.ndarray]:
    """Adds up packed arrays (key int, part int, sums binary) of equal length by key.

    First in tasks that take a key's arrays of a share of the parts, then by key alone.  Tasks add as they read, so
    they hold one array a key, and the driver gets one array a key, whatever the number of parts.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, packed in zip(batch.column("key").to_pylist(), batch.column("sums")):
                got = unpack_ints(packed.as_py(), dtype)
                total[key] = total[key] + got if key in total else got
        sums = [pack_ints(x) for x in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([0] * len(total), pa.int32()), pa.array(sums, pa.binary())], ["key", "part", "sums"])

    ddl = "key int, part int, sums binary"
    some = parts.repartition("key", F.pmod("part", F.lit(64))).mapInArrow(add, ddl)
    return {r["key"]: unpack_ints(r["sums"], dtype) for r in some.repartition("key").mapInArrow(add, ddl).collect()}
