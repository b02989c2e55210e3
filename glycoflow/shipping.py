"""Makes the package importable on executors that were started without it on their path."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Adds the package's sources to the session's Python files, once for each application."""
    _ship(spark.sparkContext.applicationId, spark)


@functools.lru_cache(maxsize=1)
def _archive() -> str:
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="glycoflow-")) / "glycoflow-sources.zip"
    with zipfile.ZipFile(target, "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    return str(target)


_shipped: set[str] = set()


def _ship(application: str, spark: SparkSession) -> None:
    if application not in _shipped:
        spark.sparkContext.addPyFile(_archive())
        _shipped.add(application)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; where none is set, one of its own, if all runs on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_folder(spark.sparkContext.applicationId)


def stored(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """df as files in the shared folder: plans over it don't work it out again.  They stay, as plans run later."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(partition_by) if partition_by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@functools.cache
def _own_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"glycoflow-{application}-")
