"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted across all documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .exchange import Rule, apply_answers
from .kernels import covered, doc_ids, owner, span_hashes, text_bytes, windows, words


def _later(run: np.ndarray, ids: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """All but the earliest entry of a run; a repeated row, with the same id and position, is no later entry."""
    return (ids != ids[run]) | (pos != pos[run])


def window_rule(width: int) -> Rule:
    def extract(buf: np.ndarray, off: np.ndarray) -> tuple:
        starts, ends, of = words(buf, off)
        at, h = windows(span_hashes(buf, starts, ends), of, width)
        doc = owner(of)[at]
        return doc, at - of[doc], h

    def local(run: np.ndarray, ids: np.ndarray, pos: np.ndarray) -> tuple:
        return run == np.arange(len(run)), _later(run, ids, pos)

    return Rule(extract, local, _later)


def dedup_substrings(docs: DataFrame, width: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Removes every word that a repeated window of `width` words covers, but for the window's first occurrence.

    Words are runs of anything but ASCII white space.  A window is repeated where its word sequence starts earlier
    too: in a document with a smaller id, or earlier in the same one.  Repeated windows merge into maximal removal
    intervals.  Windows are judged on the input, not on what is left of it.

    Returns id, n_words, n_removed, kept_text (kept words joined by one space), removed (array of
    [first, end) word intervals).  A null or empty text has no words; a text shorter than the window loses none;
    a null id sorts before all others; rows that repeat an id count as one document, so exact repeats of a row are
    kept alike.  An empty table gives an empty result.  Other columns of docs are ignored, whatever their names.
    """
    keep = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))

    def apply(table: pa.Table, found: dict) -> pa.Table:
        rows: dict[str, list] = {"n_words": [], "n_removed": [], "kept_text": [], "removed": []}
        ids = doc_ids(table["doc_id"])
        buf, off = text_bytes(table["text"])
        whole = memoryview(buf)
        for i, key in enumerate(ids.tolist()):
            tokens = bytes(whole[off[i] : off[i + 1]]).split()
            gone = covered(_fit(found.get(key, _NONE), len(tokens) - width), width, len(tokens))
            edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
            rows["n_words"].append(len(tokens))
            rows["n_removed"].append(int(gone.sum()))
            rows["kept_text"].append(b" ".join(t for t, g in zip(tokens, gone.tolist()) if not g) if len(edge) else b" ".join(tokens))
            rows["removed"].append(edge.reshape(-1, 2).tolist())
        return pa.table({"doc_id": table["doc_id"], "n_words": pa.array(rows["n_words"], pa.int64()), "n_removed": pa.array(rows["n_removed"], pa.int64()), "kept_text": pa.array(rows["kept_text"], pa.binary()).cast(pa.string()), "removed": pa.array(rows["removed"], pa.list_(pa.list_(pa.int64())))})

    return apply_answers(keep, window_rule(width), apply, "doc_id long, n_words long, n_removed long, kept_text string, removed array<array<long>>")


_NONE = np.zeros(0, np.int64)


def _fit(pos: np.ndarray, last: int) -> np.ndarray:
    """Positions that this text has; only rows that share an id but not a text have others."""
    return pos[: np.searchsorted(pos, last, "right")]
