"""URL filters: host and path rules, and logistic regression on hashed character n-grams for all other pages."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare
from .kernels import owner, rolling, text_bytes

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DIM, GRAMS = 1 << 14, (3, 4, 5)
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[0x30:0x3A] = 0x30


def split_url(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased: after the first :// up to /, ?, # or the end; path: then up to ?, # or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(rest)), r"\A[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule, as in `example.net/en/`, that fits the host or its subdomains and starts the path."""
    fits = []
    for _, rule in sorted(rules, key=lambda r: -len(r[1])):
        top, slash, rest = rule.partition("/")
        fits.append(F.when(((host == top) | host.endswith(f".{top}")) & path.startswith(slash + rest), F.lit(rule)))
    return F.coalesce(*fits, F.lit(None).cast("string"))


def labelled_urls() -> list[tuple[str, int]]:
    """The small labelled URL table beside this file: 1 for link farms, scams, gambling, adult pages and the like."""
    rows = [line.split("\t") for line in Path(__file__).with_name("labelled_urls.tsv").read_text(encoding="utf-8").splitlines()]
    return [(url, int(label)) for label, url in rows]


def training_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(labelled_urls(), "url string, bad int")


def _grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hashed feature) of every character n-gram, over UTF-8 bytes; digits are all one: numbers in paths say nothing."""
    buf, off = text_bytes(column)
    of, values = owner(off), _SHAPE[buf].astype(np.uint64) + np.uint64(1)
    rows, features = [], []
    for k in GRAMS:
        h = rolling(values, k)
        at = np.flatnonzero(np.repeat(off[1:], np.diff(off))[: len(h)] - np.arange(len(h)) >= k)
        rows.append(of[at])
        features.append((h[at] % np.uint64(DIM)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(features)


def _score(weights: np.ndarray, column: pa.Array) -> np.ndarray:
    row, feature = _grams(column)
    n = np.maximum(np.bincount(row, minlength=len(column)), 1)
    z = np.bincount(row, weights[feature], minlength=len(column)) / np.sqrt(n) + weights[-1]
    return 1 / (1 + np.exp(-z))


def fit(keys: list[str], labels: np.ndarray, steps: int = 300, rate: float = 0.5, ridge: float = 1e-3) -> np.ndarray:
    row, feature = _grams(pa.array(keys, pa.string()))
    n = np.sqrt(np.maximum(np.bincount(row, minlength=len(keys)), 1))
    w, g = np.zeros(DIM + 1), np.full(DIM + 1, 1e-6)
    for _ in range(steps):
        z = np.bincount(row, w[feature], minlength=len(keys)) / n + w[-1]
        miss = (1 / (1 + np.exp(-z)) - labels) / len(keys)
        down = np.append(np.bincount(feature, (miss / n)[row], minlength=DIM), miss.sum()) + ridge * np.append(w[:-1], 0) / len(keys)
        g += down**2
        w -= rate * down / np.sqrt(g)
    return w


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], labelled: DataFrame | None = None, cut: float = 0.6, max_labelled: int = 20_000, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """host, path, rule, verdict and score of every url; one pass, no shuffle.

    rules are (allow or block, rule) pairs; the longest that fits gives the verdict.  Elsewhere it is block where the
    logistic regression scores `cut` or more.  It is fitted on at most `max_labelled` rows (url, bad) of a labelled
    table, by default the small one in this package; its weights (130 kB) are broadcast.

    A null url and one without :// have empty host and path and are allowed unless the model says otherwise.  Ids may be null or
    repeated: urls are judged one by one.  An empty table gives an empty result; other columns are ignored.
    """
    spark = pages.sparkSession
    prepare(spark)
    labelled = training_table(spark) if labelled is None else labelled
    host, path = split_url(F.col("url"))
    rows = labelled.limit(max_labelled).select(F.concat(*split_url(F.col("url"))).alias("key"), F.col("bad").cast("double").alias("bad")).where("bad is not null").collect()
    weights = spark.sparkContext.broadcast(fit([r["key"] for r in rows], np.array([r["bad"] for r in rows])))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            import pyarrow.compute as pc

            key = pc.binary_join_element_wise(b.column("host"), b.column("path"), "")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_score(weights.value, key))], [*b.schema.names, "score"])

    parsed = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url")).select("page_id", host.alias("host"), path.alias("path")).withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
    scored = parsed.mapInArrow(score, "page_id long, host string, path string, rule string, score double")
    says = F.coalesce(*(F.when(F.col("rule") == rule, F.lit(what)) for what, rule in rules), F.when(F.col("score") >= cut, "block").otherwise("allow")) if rules else F.when(F.col("score") >= cut, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", says.alias("verdict"), "score")
