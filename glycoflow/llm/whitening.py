"""Embedding whitening: covariance of exactly centred vectors from MLlib's row matrix, eigenvectors on the driver, projection in tasks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, prepare, stored
from .vectors import floored, usable

#: Entries become floor(SCALE * entry) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Whitening:
    """Number and per-dimension sums of the vectors that it was fitted on; components by falling eigenvalue.

    axes: a column for each component, over the root of its eigenvalue; a component without variance has none (NaN).
    """

    n: int
    sums: np.ndarray
    axes: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float | None = None

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n * x - sums as integers, and that over n in double precision."""
        whole = self.n * x - self.sums
        return whole, whole / self.n


def _quantised(vector: Column) -> Column:
    return F.transform(floored(vector, SCALE), lambda e: e + OFFSET)


def _sums(fit: DataFrame, width: int) -> tuple[int, np.ndarray]:
    """Rows, and exact sums of each entry: added up in tasks, one array a task, then by Spark."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = 0, np.zeros(width, np.int64)
        for batch in batches:
            if len(batch):
                x = np.stack(batch["x"].to_numpy())
                n, total = n + len(x), total + x.sum(axis=0)
        yield pd.DataFrame({"slot": np.arange(-1, width), "total": np.concatenate([[n], total])})

    rows = fit.mapInPandas(add, "slot int, total long").groupBy("slot").agg(F.sum("total").alias("total")).orderBy("slot").collect()
    return int(rows[0]["total"]), np.array([r["total"] for r in rows[1:]], np.int64)


def _gramian(vectors: DataFrame, n: int, width: int) -> np.ndarray:
    """Sum of outer products of an array column's rows, by MLlib."""
    rows = MLUtils.convertVectorColumnsFromML(vectors.select(array_to_vector(vectors.columns[0]).alias("v")), "v")
    return RowMatrix(rows, n, width).computeGramianMatrix().toArray()


def fit_whitening(fit: DataFrame, width: int, components: int = 16) -> Whitening:
    """fit: column x (array of longs of this length), each vector once; at least one row.

    Covariances have divisor n and are taken of n * x - sums over n, whose integers are exact.  identity_error is
    measured: the covariance of the fitted vectors as whitened, less the identity, its largest absolute entry.
    """
    spark = fit.sparkSession
    n, sums = _sums(fit, width)
    centred = F.zip_with("x", F.lit(sums.tolist()), lambda x, s: (x * F.lit(n).cast("long") - s).cast("double") / float(n))
    covariance = _gramian(fit.select(centred.alias("c")), n, width) / n
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(values)[::-1][:components]
    values, vectors = np.maximum(values[order], 0.0), vectors[:, order]
    # One sign for all: each component's entry of largest size is positive.
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))])
    real = values > values.max() * width * np.finfo(float).eps
    trace = float(np.trace(covariance))
    axes = np.full_like(vectors, np.nan)
    axes[:, real] = vectors[:, real] / np.sqrt(values[real])
    got = Whitening(n, sums, axes, values, values / trace if trace > 0 else np.full(len(values), np.nan))
    if not real.any():
        return got
    shared = spark.sparkContext.broadcast(got)
    keep = np.flatnonzero(real)

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = shared.value
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"y": list(w.centred(np.stack(batch["x"].to_numpy()))[1] @ w.axes[:, keep])})

    white = stored(fit.mapInPandas(project, "y array<double>"), "whitened-fit", n)
    mean = white.select(Summarizer.mean(array_to_vector("y")).alias("m")).first()["m"].toArray()
    again = _gramian(white.select(F.zip_with("y", F.lit(mean.tolist()), lambda y, m: y - m).alias("c")), n, len(keep)) / n
    discard(white)
    return Whitening(n, sums, axes, values, got.explained, float(np.abs(again - np.eye(len(keep))).max()))


def whiten(df: DataFrame, components: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each usable vector and component: its projection over the root of the component's variance.

    Entries are quantised to x = floor(64 * entry) + 1000000.  The fit is over distinct x vectors: Spark's partial
    aggregation folds copies in each task, so a vector that a third of all rows hold is shuffled once a task.  The
    driver gets a matrix of width x width and sums, the tasks one broadcast of width x components.

    Rows whose vector is null, holds nulls, NaN or infinities, is empty or has another length than most are left out.
    Ids may be null or repeated: rows are projected one by one.  Components are at most the vector's length; one
    without variance has no projection (whitened null).  deviation, the sum over dimensions of (n * x - sum) ** 2, is exact, and null
    where it exceeds a long.  An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    spark = df.sparkSession
    prepare(spark)
    good, width = usable(df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")), "v")
    if not width:
        return spark.createDataFrame([], _OUT)
    rows = good.select("vec_id", _quantised(F.col("v")).alias("x"))
    fit = stored(rows.select("x").distinct(), "whitening-fit")
    shared = spark.sparkContext.broadcast(fit_whitening(fit, width, components))
    discard(fit)

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = shared.value
        k = w.axes.shape[1]
        for batch in batches:
            if not len(batch):
                continue
            whole, centred = w.centred(np.stack(batch["x"].to_numpy()))
            fits = (whole.astype(float) ** 2).sum(axis=1) < 2.0**62
            deviation = pd.array(np.where(fits, (whole * whole).sum(axis=1), 0), "Int64")
            deviation[~fits] = pd.NA
            y = centred @ w.axes
            yield pd.DataFrame({
                "vec_id": batch["vec_id"].repeat(k).to_numpy(), "component": np.tile(np.arange(1, k + 1), len(y)), "n": w.n, "deviation": deviation.repeat(k), "whitened": y.reshape(-1),
                "explained": np.tile(w.explained, len(y)), "identity_error": w.identity_error,
            })

    got = rows.mapInPandas(project, _OUT)
    blank = {c: F.when(~F.isnan(c), F.col(c)) for c in ("whitened", "explained")}
    return got.withColumns(blank)
