"""Groups of similar days: median imputation, population z-scores, k-means from fixed seeds in fixed rounds; the model keeps its own medians and scales."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import shared_folder, stored

_SCALE = "place int, name string, median double, mean double, deviation double"
_CENTRES = "cluster_id int, centre array<double>"


def _nearest(x: Column, centres: list[list[float]]) -> Column:
    """Struct of the squared distance to the nearest centre and its number; of equally near ones the lowest."""
    apart = lambda c: F.aggregate(F.zip_with(x, F.lit(c), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, y: s + y)
    return F.array_min(F.array(*(F.struct(apart(c).alias("d"), F.lit(i).alias("k")) for i, c in enumerate(centres))))


@dataclass(frozen=True)
class DayModel:
    """Medians, means and deviations of the days it was fitted on, and the clusters' centres; days still to come use the same."""

    scale: list[tuple[str, float, float, float]]
    centres: list[list[float]]

    def prepared(self, days: DataFrame) -> DataFrame:
        """Adds _x: nulls become the fitted median; then (x - mean) / deviation, 0 for what was constant."""
        return days.withColumn("_x", F.array(*((F.coalesce(F.col(c).cast("double"), F.lit(median)) - mean) / (sd or 1.0) for c, median, mean, sd in self.scale)))

    def assign(self, days: DataFrame) -> DataFrame:
        """Adds cluster_id and the distance from its centre."""
        got = self.prepared(days).withColumn("_n", _nearest(F.col("_x"), self.centres))
        return got.withColumns({"cluster_id": F.col("_n.k"), "distance": F.sqrt("_n.d")}).drop("_x", "_n")

    def save(self, spark: SparkSession, path: str) -> None:
        for name, rows, ddl in (("clusters", list(enumerate(self.centres)), _CENTRES), ("scale", [(i, *row) for i, row in enumerate(self.scale)], _SCALE)):
            spark.createDataFrame(rows, ddl).coalesce(1).write.mode("overwrite").json(f"{path}/{name}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> DayModel:
        rows = spark.read.schema(_SCALE).json(f"{path}/scale").orderBy("place").collect()
        centres = spark.read.schema(_CENTRES).json(f"{path}/clusters").orderBy("cluster_id").collect()
        return DayModel([(r["name"], r["median"], r["mean"], r["deviation"]) for r in rows], [r["centre"] for r in centres])


def fit_days(features: DataFrame, columns: list[str], key: list[str], k: int = 5, rounds: int = 10) -> DayModel:
    """Medians (0 where all are null), means and population deviations after filling, then k-means; the same on every run.

    The first centre is the day with the smallest key, each next one the day farthest from all so far (of equally far
    ones the smallest key).  Each round assigns all days and takes the means of what each centre got; one without days
    stays.  Days are stored once as numbers; each step is one aggregate, of which the driver gets a row a cluster.
    """
    medians = features.agg(*(F.coalesce(F.median(c), F.lit(0.0)).alias(c) for c in columns)).first()
    filled = [F.coalesce(F.col(c).cast("double"), F.lit(float(medians[c]))) for c in columns]
    s = features.agg(*(F.avg(x).alias(f"m{i}") for i, x in enumerate(filled)), *(F.stddev_pop(x).alias(f"s{i}") for i, x in enumerate(filled))).first()
    scale = [(c, float(medians[c]), s[f"m{i}"] or 0.0, s[f"s{i}"] or 0.0) for i, c in enumerate(columns)]
    spark, path = features.sparkSession, f"{shared_folder(features.sparkSession)}/days-{uuid.uuid4().hex}"
    DayModel(scale, []).prepared(features).select(F.struct(*key).alias("key"), "_x").write.parquet(path)
    days, centres = spark.read.parquet(path), []
    while len(centres) < k:
        far = _nearest(F.col("_x"), centres)["d"] if centres else F.lit(0.0)
        got = days.agg(F.min_by("_x", F.struct(-far, "key")).alias("x"), F.max(far).alias("far")).first()
        if got["x"] is None or centres and got["far"] == 0:
            break  # no more different days
        centres.append(list(got["x"]))
    for _ in range(rounds if centres else 0):
        means = days.groupBy(_nearest(F.col("_x"), centres)["k"].alias("k")).agg(F.array(*(F.avg(F.col("_x")[i]) for i in range(len(columns)))).alias("c"))
        for r in means.collect():
            centres[r["k"]] = list(r["c"])
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(fs_path, True)
    return DayModel(scale, centres)


def cluster_days(features: DataFrame, columns: list[str], key: list[str], k: int = 5, model: DayModel | None = None) -> tuple[DataFrame, DayModel]:
    """Days with cluster_id and distance, without the columns that they were clustered by; and the model."""
    if model is None:
        features = stored(features, "features")  # fitting reads them three times, assigning once more
        model = fit_days(features, columns, key, k)
    return model.assign(features).drop(*columns), model
