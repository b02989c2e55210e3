"""A corpus pipeline from raw documents to packed sequences; every stage works on all that the one before it kept.

Stages take tables with null and repeated ids, null and empty texts, no rows, and extra columns of any name: rules and
line dedup treat each as their operators do, near dedup keeps the smallest id of each group (rows that share an id stay
or go together), and all but the last return the columns they were given.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glycoflow.llm.common import stored
from glycoflow.llm.decontamination import decontaminate
from glycoflow.llm.line_dedup import dedup_lines
from glycoflow.llm.minhash import near_duplicates
from glycoflow.llm.packing import pack
from glycoflow.llm.quality_rules import quality_rules


def _shielded(docs: DataFrame, apply: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Applies an operator and returns the columns of docs, whatever their names are; doc_id and text as it leaves them."""
    names = {c: c if c in ("doc_id", "text") else f"column_{i}__" for i, c in enumerate(docs.columns)}
    got = apply(docs.withColumnsRenamed(names))
    return got.select(*(F.col(new).alias(old) for old, new in names.items()))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return _shielded(docs, lambda d: quality_rules(d).where("kept"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share go; n_chars, where there is one, follows the text."""
    kept = _shielded(docs, dedup_lines)
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in kept.columns else kept


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id stays."""
    first = near_duplicates(docs.select("doc_id", "text")).where("doc_id <=> class_id").select("doc_id")
    return docs.join(first.distinct(), docs["doc_id"].eqNullSafe(first["doc_id"]), "left_semi")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _shielded(docs, lambda d: decontaminate(d, benchmark).where("n_hit_ = 0"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences of 4096 tokens."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", rules),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", packing),
]

#: Suffix arrays, weighted sampling and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
