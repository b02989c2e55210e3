"""The numbered queries: each operator over its whole table, with production parameters, as digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontamination import decontaminate
from .line_dedup import dedup_lines
from .minhash import near_duplicates
from .oracle import ORACLE_SQL
from .packing import pack
from .pii import find_pii
from .quality_classifier import quality_scores
from .quality_rules import quality_rules
from .secrets import scan_secrets
from .substring_dedup import dedup_substrings
from .token_counts import count_tokens
from .url_filter import filter_urls
from .vector_codes import compress_vectors
from .whitening import whiten

__all__ = ["ORACLE_SQL", "QUERIES"]

#: Rules of op3: the longest that fits a url decides.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "text")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(_documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(_documents(spark, sf_dir)).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "n_added")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    scored = quality_scores(_documents(spark, sf_dir), _table(spark, sf_dir, "labels"), train_on=~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_documents(spark, sf_dir)).drop("text", "longest_repeat")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_documents(spark, sf_dir))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(_documents(spark, sf_dir)).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_random")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(_documents(spark, sf_dir)).select("doc_id", F.col("line_count_").alias("n_lines"), F.col("line_dropped_").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = decontaminate(_documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"))
    return marked.select("doc_id", F.col("n_words_").alias("n_words"), F.col("n_hit_").alias("n_hit"), F.col("n_items_").alias("n_items"), F.sha2(F.array_join("items_", ","), 256).alias("items_sha256"), (F.col("n_hit_") > 0).alias("contaminated"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_documents(spark, sf_dir))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(_table(spark, sf_dir, "embeddings"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = compress_vectors(_table(spark, sf_dir, "embeddings"))
    # Two digits an index, in part order: the code's bytes in hex.
    return got.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.sha2("codebooks", 256).alias("codebooks_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_substring_dedup, op2_pii, op3_url_filter, op4_quality_classifier, op5_quality_rules, op6_packing, op7_secrets, op8_line_dedup, op9_minhash, op10_decontamination, op11_token_counts, op12_whitening, op13_vector_codes)
}
