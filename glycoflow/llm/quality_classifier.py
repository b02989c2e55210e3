"""Quality classifier: a Gaussian kernel by random Fourier features, ridge regression, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, slices, stored, summed
from .kernels import PLAIN, mix, owner, pack_ints, per_text, span_hashes, text_bytes, words
from .line_dedup import lines
from .spans import byte_kind

N_FEATURES, FOLDS, BINS = 256, 5, 512
#: Labelled rows of which one task sums the normal equations; such sums are added up by PIECES pieces of the triangle.
PER_TASK, PIECES = 50_000, 32
_SALT = np.uint64(0x9E3779B97F4A7C15)
_UPPER, _DIGIT = byte_kind("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), byte_kind("0123456789")
_SYMBOL, _MARK = byte_kind("#*$%&|<>!@^~=+_{}[]\\"), byte_kind(".,;:?'\"()-")
STATS = ["log_words", "mean_word", "sd_word", "upper", "digit", "symbol", "mark", "wide", "distinct", "repeat_lines", "log_line", "short_lines", "top_word", "ends"]


def statistics(column: pa.Array) -> np.ndarray:
    """One row of document statistics for each text; an empty text has zeros."""
    buf, off = text_bytes(column)
    n = len(off) - 1
    starts, ends, of = words(buf, off)
    share = lambda kind: np.diff(np.concatenate([[0], np.cumsum(kind[buf])])[off]) / np.maximum(np.diff(off), 1)
    text, size, n_words = owner(of), (ends - starts).astype(float), np.diff(of)
    some = np.maximum(n_words, 1)
    mean = np.bincount(text, size, minlength=n) / some
    h = span_hashes(buf, starts, ends)
    key = mix(h + text.astype(np.uint64) * _SALT)
    _, first, count = np.unique(key, return_index=True, return_counts=True)
    top = np.zeros(n)
    np.maximum.at(top, text[first], count)
    s, e, line_of = lines(buf, off)
    solid = np.concatenate([[0], np.cumsum(PLAIN[buf])])
    full = solid[e] > solid[s]
    line_text = owner(line_of)
    lkey = mix(span_hashes(buf, s[full], e[full]) + line_text[full].astype(np.uint64) * _SALT)
    lfirst = np.zeros(len(lkey), bool)
    lfirst[np.unique(lkey, return_index=True)[1]] = True
    n_lines = np.maximum(np.bincount(line_text[full], minlength=n), 1)
    ended = np.zeros(len(buf) + 1, bool)
    ended[1:] = buf == 0x2E
    return np.stack([
        np.log1p(n_words), mean, np.sqrt(np.maximum(np.bincount(text, size**2, minlength=n) / some - mean**2, 0)),
        share(_UPPER), share(_DIGIT), share(_SYMBOL), share(_MARK), share(np.arange(256) >= 0x80),
        np.bincount(text[first], minlength=n) / some, np.bincount(line_text[full][~lfirst], minlength=n) / n_lines,
        np.log1p(n_words / n_lines), np.bincount(line_text[full][(e - s)[full] < 20], minlength=n) / n_lines, top / some,
        np.bincount(line_text[full][ended[e[full]]], minlength=n) / n_lines,
    ], 1)


def _fourier(x: np.ndarray, scale: tuple[np.ndarray, np.ndarray], width: float, d: int) -> np.ndarray:
    """cos(w.x + b) for Gaussian w: inner products approximate exp(-|x - y|**2 / (2 width**2)); a constant is added."""
    r = np.random.default_rng(11)
    w, b = r.standard_normal((x.shape[1], d)) / width, r.uniform(0, 2 * np.pi, d)
    z = np.clip((x - scale[0]) / scale[1], -5, 5)
    return np.concatenate([np.sqrt(2 / d) * np.cos(z @ w + b), np.ones((len(x), 1))], 1)


def _isotonic(good: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Pool adjacent violators over bins in order of score."""
    stack: list[list[float]] = []
    for g, k in zip(good.tolist(), n.tolist()):
        stack.append([g, k, 1])
        while len(stack) > 1 and stack[-2][0] * stack[-1][1] >= stack[-1][0] * stack[-2][1]:
            a = stack.pop()
            stack[-1] = [x + y for x, y in zip(stack[-1], a)]
    return np.concatenate([np.full(int(m), g / k) for g, k, m in stack]) if stack else np.zeros(0)


def _features(batch: pa.RecordBatch, scale: tuple[np.ndarray, np.ndarray], width: float) -> np.ndarray:
    return _fourier(np.stack([batch.column(s).to_numpy() for s in STATS], 1), scale, width, N_FEATURES)


def _normal_sums(train: DataFrame, n_rows: int, scale: tuple[np.ndarray, np.ndarray], width: float, base: float) -> np.ndarray:
    """Sums of z z' over the labelled rows of each fold, z being the features and the centred label.

    A task sums its rows and emits the upper triangle in pieces; Spark adds these up in two steps, so what reaches
    the driver is FOLDS triangles, 1.4 MB at any size and number of partitions.
    """
    d = N_FEATURES + 2
    upper = np.triu_indices(d)
    cuts = np.linspace(0, len(upper[0]), PIECES + 1).astype(int)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, part = np.zeros((FOLDS, d, d)), TaskContext.get().partitionId()
        for b in batches:
            z = np.concatenate([_features(b, scale, width), (b.column("y").to_numpy() - base)[:, None]], 1)
            fold = b.column("fold").to_numpy()
            for k in np.unique(fold):
                mine = z[fold == k]
                sums[k] += mine.T @ mine
        some = [(k, i) for k in range(FOLDS) if sums[k].any() for i in range(PIECES)]
        packed = [pack_ints(sums[k][upper][cuts[i] : cuts[i + 1]]) for k, i in some]
        yield pa.RecordBatch.from_arrays([pa.array([k * PIECES + i for k, i in some], pa.int32()), pa.array([part] * len(some), pa.int32()), pa.array(packed, pa.binary())], ["key", "part", "sums"])

    parts = train.coalesce(max(8, -(-n_rows // PER_TASK))).mapInArrow(local, "key int, part int, sums binary")
    out = np.zeros((FOLDS, d, d))
    flat = np.zeros((FOLDS, len(upper[0])))
    for key, total in summed(parts, np.float64).items():
        k, i = divmod(key, PIECES)
        flat[k, cuts[i] : cuts[i + 1]] = total
    out[:, upper[0], upper[1]] = flat
    out[:, upper[1], upper[0]] = flat
    return out


def _ridge(sums: np.ndarray, ridge: float) -> np.ndarray:
    """Weights from sums of z z': the last column holds the products with the label, the last but one those with 1."""
    n, d = sums[-2, -2], len(sums) - 1
    return np.linalg.solve(sums[:-1, :-1] + (ridge * n / (d - 1) + 1e-12) * np.eye(d), sums[:-1, -1])


def quality_scores(docs: DataFrame, labels: DataFrame, train_on=None, width: float = 3.0, ridge: float = 1e-3, cut: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Scores every whole text from 0 to 1, higher where label 1 is likelier; the score depends on the text alone.

    Statistics are computed in one pass and stored.  Labelled rows that the condition `train_on` keeps are joined on
    the id, stored, and fall into five folds by a hash of the id.  Their random Fourier features are summed into
    normal equations by task, fold and piece, and added up in Spark.  Ridge regression on all folds gives the raw
    scores.  Isotonic regression makes probabilities of them; it is fitted on the labelled rows' raw scores from the
    other four folds, over 512 quantile bins, so that no row calibrates a score that it has trained.

    Returns id, score, predicted (1 if score >= cut).  A null or empty text is scored by its zero statistics.  Null
    labels and ids don't train; documents with several labels train with each; repeated ids are scored row by row.
    Without labels every score is 0.5.  An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    prepare(spark)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            x = statistics(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c) for c in x.T)], ["doc_id", *STATS])

    made = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(measure, "doc_id long, " + ", ".join(f"{s} double" for s in STATS))
    table = stored(made, "stats")
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y")).where("y is not null")
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold")
    train = stored(table.join(known.where(train_on) if train_on is not None else known, "doc_id").select("y", fold, *STATS), "train")
    got = train.agg(*(F.avg(s) for s in STATS), *(F.stddev_pop(s) for s in STATS), F.avg("y"), F.count(F.lit(1))).first()
    if not got[-1]:
        return table.select("doc_id", F.lit(0.5).alias("score"), F.lit(int(cut <= 0.5)).alias("predicted"))
    k = len(STATS)
    scale, base = (np.array(got[:k]), np.maximum(np.array(got[k : 2 * k]), 1e-9)), float(got[-2])
    sums = _normal_sums(train, int(got[-1]), scale, width, base)
    weights = _ridge(sums.sum(0), ridge)
    others = np.stack([_ridge(sums.sum(0) - s, ridge) for s in sums])

    def unseen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = base + (_features(b, scale, width) * others[b.column("fold").to_numpy()]).sum(1)
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(raw)], ["y", "raw"])

    seen = stored(train.mapInArrow(unseen, "y double, raw double"), "unseen", int(got[-1]))
    edges = np.unique(seen.select(F.percentile_approx("raw", [i / BINS for i in range(1, BINS)], 10_000)).first()[0])
    by = seen.mapInArrow(lambda x: _binned(x, edges), "bin int, good double, n long").groupBy("bin").agg(F.sum("good").alias("good"), F.sum("n").alias("n")).orderBy("bin").collect()
    levels = _isotonic(np.array([r["good"] for r in by]), np.array([r["n"] for r in by]))
    steps = np.array([r["bin"] for r in by])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = base + _features(b, scale, width) @ weights
            p = levels[np.clip(np.searchsorted(steps, np.searchsorted(edges, x, "right"), "right") - 1, 0, len(levels) - 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.clip(p, 0, 1)), pa.array((p >= cut).astype(np.int32))], ["doc_id", "score", "predicted"])

    return table.mapInArrow(score, "doc_id long, score double, predicted int")


def _binned(batches: Iterator[pa.RecordBatch], edges: np.ndarray) -> Iterator[pa.RecordBatch]:
    good, n = np.zeros(len(edges) + 1), np.zeros(len(edges) + 1, np.int64)
    for b in batches:
        at = np.searchsorted(edges, b.column("raw").to_numpy(), "right")
        good += np.bincount(at, b.column("y").to_numpy(), minlength=len(good))
        n += np.bincount(at, minlength=len(n))
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(good[at]), pa.array(n[at])], ["bin", "good", "n"])
