"""Quality rules: suffix-array repetition limits beside simple counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, slices, under_own_names
from .kernels import PLAIN, covered, mix, owner, per_text, powers, span_hashes, text_bytes, words
from .line_dedup import lines

_SALT = np.uint64(0x9E3779B97F4A7C15)
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


def _common(h: np.ndarray, end: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Longest common prefixes, one or more, of the suffixes at i and j: steps that double while they match, then halve.

    A step compares Rabin-Karp hashes from prefix sums: (P[a + s] - P[a]) * B**b == (P[b + s] - P[b]) * B**a.
    """
    common, top = np.ones(len(i), np.int64), np.zeros(len(i), np.int64)
    power = powers(len(h))[0]
    total = np.concatenate([[np.uint64(0)], np.cumsum(h * power[:-1], dtype=np.uint64)])

    def step(at: np.ndarray, level: int) -> np.ndarray:
        a, b, s = i[at] + common[at], j[at] + common[at], 1 << level
        fits = np.flatnonzero((a + s <= end[i[at]]) & (b + s <= end[j[at]]))
        a, b = a[fits], b[fits]
        fits = fits[(total[a + s] - total[a]) * power[b] == (total[b + s] - total[b]) * power[a]]
        common[at[fits]] += s
        return at[fits]

    active, level = np.arange(len(i)), 0
    while len(active):
        active = step(active, level)
        level += 1
        top[active] = level
    for level in range(level - 2, -1, -1):
        step(np.flatnonzero(top > level), level)
    return common


def longest_repeats(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each word, the length of the longest word string that starts there and is found elsewhere in its text.

    A suffix array of every text of the batch at once, by prefix doubling in which only suffixes that still tie are
    sorted again; then the longest common prefixes of neighbours.  Memory is a dozen integers a word, however much
    a text repeats itself.
    """
    n = len(h)
    if not n:
        return np.zeros(0, np.int64)
    text = owner(offsets)
    end = offsets[1:][text]
    key = mix(h + text.astype(np.uint64) * _SALT)  # words of other texts are other letters
    order = np.argsort(key)
    begin = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
    size = np.diff(np.append(begin, n))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(begin, size)
    active, step = order[np.repeat(size > 1, size)], 1
    del key, order
    while len(active):
        after = np.where(active + step < end[active], rank[np.minimum(active + step, n - 1)], -1)
        by = rank[active] * (n + 1) + after + 1
        place = np.argsort(by)
        active, by = active[place], by[place]
        group = rank[active]
        start = np.maximum.accumulate(np.where(np.concatenate([[True], group[1:] != group[:-1]]), np.arange(len(by)), 0))
        begin = np.flatnonzero(np.concatenate([[True], by[1:] != by[:-1]]))
        size = np.diff(np.append(begin, len(by)))
        rank[active] = group + np.repeat(begin, size) - start
        active = active[np.repeat(size > 1, size)]
        step *= 2
    suffix = np.empty(n, np.int64)
    suffix[rank] = np.arange(n)
    del rank
    pair = np.flatnonzero(h[suffix[1:]] == h[suffix[:-1]])
    pair = pair[text[suffix[pair]] == text[suffix[pair + 1]]]
    i, j = suffix[pair], suffix[pair + 1]
    common = _common(h, end, i, j)
    out = np.zeros(n, np.int64)
    np.maximum.at(out, i, common)
    np.maximum.at(out, j, common)
    return out


def rule_counts(column: pa.Array, least_repeat: int = 5) -> dict[str, np.ndarray]:
    buf, off = text_bytes(column)
    starts, ends, of = words(buf, off)
    count = np.diff(of)
    points = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    symbols = np.concatenate([[0], np.cumsum(SYMBOLS[buf])])
    repeat = longest_repeats(span_hashes(buf, starts, ends), of)
    at = np.flatnonzero(repeat >= least_repeat)
    longest = np.zeros(len(count), np.int64)
    np.maximum.at(longest, owner(of)[at], repeat[at])
    s, e, line_of = lines(buf, off)
    solid = np.concatenate([[0], np.cumsum(PLAIN[buf])])
    full = solid[e] > solid[s]
    text = owner(line_of)[full]
    key = mix(span_hashes(buf, s[full], e[full]) + text.astype(np.uint64) * _SALT)
    first = np.zeros(len(key), bool)
    first[np.unique(key, return_index=True)[1]] = True
    return {
        "n_words": count,
        "word_chars": per_text(points[ends] - points[starts], of),
        "n_symbols": symbols[off[1:]] - symbols[off[:-1]],
        "n_dup_lines": np.bincount(text[~first], minlength=len(count)).astype(np.int64),
        "n_repeat_words": per_text(covered(at, repeat[at], len(repeat)), of),
        "longest_repeat": longest,
    }


def quality_rules(docs: DataFrame, text_col: str = "text", min_words: int = 10, max_repeat_percent: int = 20, max_longest: int = 100) -> DataFrame:
    """Counts and verdicts beside docs' columns; one pass over the texts, no shuffle.

    Words are runs of anything but ASCII white space.  Longest-common-prefix intervals of a suffix array over words
    give the maximal repeated substrings; those of five words or more are united to n_repeat_words.
    base_failed: under `min_words` words, or repeats cover more than `max_repeat_percent` of the words.  kept is
    false for these and where one repeated string is longer than `max_longest` words.

    A null text has no words and fails; so does an empty one.  Any id, null or repeated, passes through, as do other
    columns; earlier columns with the new names are replaced.  An empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "longest_repeat", "base_failed", "kept"]
    return under_own_names(docs.drop(*new), [text_col], lambda d, t: _counted(d, t, min_words, max_repeat_percent, max_longest, new), new)


def _counted(docs: DataFrame, text_col: str, min_words: int, max_repeat_percent: int, max_longest: int, new: list[str]) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            got = rule_counts(batch.column(text_col))
            got["base_failed"] = (got["n_words"] < min_words) | (100 * got["n_repeat_words"] > max_repeat_percent * got["n_words"])
            got["kept"] = ~got["base_failed"] & (got["longest_repeat"] <= max_longest)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(got[k]) for k in new)], [*batch.schema.names, *new])

    ddl = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + [f"{k} long" for k in new[:6]] + [f"{k} boolean" for k in new[6:]]
    return docs.mapInArrow(count, ", ".join(ddl))
