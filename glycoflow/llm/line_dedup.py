"""Line dedup: normalised lines are hashed and counted by distinct document; lines over a threshold go."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import under_own_names
from .exchange import Rule, apply_answers
from .kernels import LOWER, PLAIN, doc_ids, mix, owner, per_text, span_hashes, text_bytes

_SALT = np.uint64(0x9E3779B97F4A7C15)


def lines(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all lines, without their breaks, and offsets of each text's lines; every text has one at least."""
    breaks = np.flatnonzero(buf == 0x0A)
    of = owner_of(breaks, off)
    count = np.bincount(of, minlength=len(off) - 1) + 1
    offsets = np.concatenate([[0], np.cumsum(count)])
    starts, ends = np.empty(offsets[-1], np.int64), np.empty(offsets[-1], np.int64)
    inner = np.ones(offsets[-1], bool)
    inner[offsets[:-1]] = False
    starts[offsets[:-1]], starts[inner] = off[:-1], breaks + 1
    inner[:] = True
    inner[offsets[1:] - 1] = False
    ends[offsets[1:] - 1], ends[inner] = off[1:], breaks
    return starts, ends, offsets


def owner_of(at: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The text that holds each byte position."""
    return np.searchsorted(off, at, "right") - 1


def line_keys(buf: np.ndarray, off: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets of each text's lines; line numbers of the keys of `least` code points or more; hashes of these."""
    starts, ends, offsets = lines(buf, off)
    solid = np.flatnonzero(PLAIN[buf])
    a, b = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    full = a < b
    s, e = solid[a[full]], solid[b[full] - 1] + 1  # stripped at both ends
    points = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    long = points[e] - points[s] >= least
    at = np.flatnonzero(full)[long]
    return offsets, at, span_hashes(LOWER[buf], s[long], e[long])


def line_rule(threshold: int, least: int) -> Rule:
    def extract(buf: np.ndarray, off: np.ndarray) -> tuple:
        offsets, at, h = line_keys(buf, off, least)
        doc = owner(offsets)[at]
        order = np.lexsort((at, h, doc))  # one entry for each key of a document: its first line
        first = np.ones(len(order), bool)
        first[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
        at, doc, h = at[order][first], doc[order][first], h[order][first]
        return doc, at - offsets[doc], h

    def ranks(run: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many larger distinct ids the run has after each entry; how many the run has in all."""
        new = np.ones(len(run), bool)
        new[1:] = (ids[1:] != ids[:-1]) | (run[1:] != run[:-1])
        nth = np.cumsum(new)
        begin = np.flatnonzero(run == np.arange(len(run)))
        length = np.diff([*begin, len(run)])
        top = np.repeat(nth[np.append(begin[1:], len(run)) - 1], length) if len(run) else nth
        return top - nth, top - (nth[run] - 1)

    def local(run: np.ndarray, ids: np.ndarray, pos: np.ndarray) -> tuple:
        above, _ = ranks(run, ids)
        return above < threshold, above >= threshold  # `threshold` larger ids hold it: surely dropped here

    def final(run: np.ndarray, ids: np.ndarray, pos: np.ndarray) -> np.ndarray:
        above, count = ranks(run, ids)
        return (above > 0) & (count >= threshold)

    return Rule(extract, local, final)


def dedup_lines(docs: DataFrame, threshold: int = 3, least: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Drops lines whose key at least `threshold` documents hold, but for the document with the largest id.

    A key is the line stripped of ASCII white space, A-Z lower-cased; keys under `least` code points never count.
    Lines are counted by distinct document, all lines with a dropped key go, and the others are put together again in
    their order.

    Returns docs' columns, the text without the dropped lines, and line_count_, line_dropped_ (long).  A null or
    empty text is one empty line; a null text stays null.  Rows that repeat an id count as one document.  A null id
    sorts before all others.  An empty table gives an empty result.  Other columns pass through; earlier columns with
    the two new names are replaced.
    """
    new = ["line_count_", "line_dropped_"]
    return under_own_names(docs.drop(*new), [id_col, text_col], lambda d, i, t: _dedup(d, threshold, least, i, t), new)


def _dedup(docs: DataFrame, threshold: int, least: int, id_col: str, text_col: str) -> DataFrame:
    rule = line_rule(threshold, least)

    def apply(table: pa.Table, found: dict) -> pa.Table:
        column = table[text_col]
        buf, off = text_bytes(column)
        offsets, at, h = line_keys(buf, off, least)
        starts, ends, _ = lines(buf, off)
        gone = np.zeros(offsets[-1], bool)
        hit = [(i, found[k]) for i, k in enumerate(doc_ids(table[id_col]).tolist()) if k in found]
        if hit:
            first = np.concatenate([p[: np.searchsorted(p, offsets[i + 1] - offsets[i])] + offsets[i] for i, p in hit])
            place = np.searchsorted(at, first)
            ok = (place < len(at)) & (at[np.minimum(place, max(len(at) - 1, 0))] == first) if len(at) else np.zeros(len(first), bool)
            keys = mix(h + owner(offsets)[at].astype(np.uint64) * _SALT)
            gone[at[np.isin(keys, keys[place[ok]])]] = True  # within a document, all lines with an answered line's key go
        dropped = per_text(gone, offsets)
        texts, raw = column.to_pylist(), memoryview(buf)
        for i in np.flatnonzero(dropped).tolist():
            kept = [bytes(raw[starts[k] : ends[k]]) for k in range(offsets[i], offsets[i + 1]) if not gone[k]]
            texts[i] = b"\n".join(kept).decode()
        place = table.column_names.index(text_col)
        table = table.set_column(place, text_col, pa.array(texts, pa.string()))
        return table.append_column("line_count_", pa.array(np.diff(offsets), pa.int64())).append_column("line_dropped_", pa.array(dropped, pa.int64()))

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", line_count_ long, line_dropped_ long"
    return apply_answers(docs, rule, apply, ddl, id_col, text_col, entries_per_mb=12_000)
