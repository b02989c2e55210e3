"""Tables of vectors: which rows can be used, and their entries as exact integers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """True for a vector that isn't null and holds neither nulls nor NaN nor infinities."""
    inf = float("inf")
    return vector.isNotNull() & F.forall(vector, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < inf))


def floored(vector: Column, scale: int) -> Column:
    """floor(scale * entry) of each entry as a long, taken in double precision."""
    return F.transform(vector, lambda e: F.floor(e.cast("double") * scale))


def usable(df: DataFrame, vector_col: str) -> tuple[DataFrame, int]:
    """Rows with a finite vector of the usual length, and that length: the commonest one, of equally common ones the longest."""
    good = df.where(finite(F.col(vector_col)) & (F.size(vector_col) > 0))
    usual = good.groupBy(F.size(vector_col).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    width = int(usual["size"]) if usual else 0
    return good.where(F.size(vector_col) == width), width


def rows_of(column: pa.Array, width: int, dtype: type) -> np.ndarray:
    """A list column without nulls, all lists of one length, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(column), width)
