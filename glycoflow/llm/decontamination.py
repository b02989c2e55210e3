"""Benchmark decontamination: a prefix-filtered containment join of documents and benchmark windows.

A benchmark item is the set of its windows.  A window is contained in a document if all its shingles are, in place.
So one shingle of each window is enough to find it: its rarest one over all documents.  These prefix shingles are
joined with the documents' shingles; the place of the shingle in the window bounds where the window must lie, the
document's length bounds whether it can lie there at all, and whole windows are then compared word by word, by 64-bit
hashes of the words.

Rarity comes from a table of 4 million slots, of which only those that the benchmark uses are counted: its size is
fixed, and a slot that several shingles share only makes the choice of a prefix less sharp, never a result wrong.
Windows are cut and their prefixes chosen in tasks.  If the benchmark's text is small, measured, its arrays are
broadcast and a document is judged where it is read; else prefixes and occurrences meet in a shuffled join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, slices, stored, summed, under_own_names
from .kernels import ALNUM, LOWER, covered, owner, pack_ints, per_text, rolling, span_hashes, text_bytes, words

WINDOW, SHINGLE = 10, 3
#: Slots of the table of rarity; ranges of it that are added up on their own.
SLOTS, RANGES = 1 << 22, 64


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    buf, off = text_bytes(column)
    buf = LOWER[buf]
    starts, ends, of = words(buf, off, ALNUM)
    return span_hashes(buf, starts, ends), of


def _shingles(h: np.ndarray, of: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    rolled = rolling(h, k)
    left = np.repeat(of[1:], np.diff(of))[: len(rolled)] - np.arange(len(rolled))
    at = np.flatnonzero(left >= k)
    return at, rolled[at]


def _slot(h: np.ndarray, k: int) -> np.ndarray:
    return ((h + np.uint64(k)) & np.uint64(SLOTS - 1)).astype(np.int64)


_SUMS = "key int, part int, sums binary"


def _packed(n: np.ndarray, more: np.ndarray | None = None) -> pa.RecordBatch:
    """A task's counts by slot, in ranges, without empty ones; and counts of another kind."""
    wide, part = SLOTS // RANGES, TaskContext.get().partitionId()
    some = [r for r in range(RANGES) if n[r * wide : (r + 1) * wide].any()]
    sums = [pack_ints(n[r * wide : (r + 1) * wide]) for r in some] + ([] if more is None else [pack_ints(more)])
    keys = some if more is None else [*some, RANGES]
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([part] * len(keys), pa.int32()), pa.array(sums, pa.binary())], ["key", "part", "sums"])


def _added_up(parts: DataFrame) -> tuple[np.ndarray, np.ndarray | None]:
    wide, got, out = SLOTS // RANGES, summed(parts, np.int64), np.zeros(SLOTS, np.int64)
    more = got.pop(RANGES, None)
    for r, n in got.items():
        out[r * wide : (r + 1) * wide] = n
    return out, more


def _prefix_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = np.zeros(SLOTS, np.int64)
    for batch in batches:
        slot = (batch.column("hash").to_numpy().view(np.uint64) + batch.column("k").to_numpy().astype(np.uint64)) & np.uint64(SLOTS - 1)
        n[slot.astype(np.int64)] = 1
    yield _packed(n)


def _table(texts: DataFrame, text_col: str, shingle: int, used: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """How many shingles fall into each slot, and how many there are of each length; fixed in size.

    Without `used`, of items: shingles as long as each item's windows have.  With it, the slots and lengths of the items,
    of documents: shingles of those lengths in those slots.
    """
    mask = texts.sparkSession.sparkContext.broadcast((np.packbits(used[0] > 0), np.flatnonzero(used[1]).tolist())) if used is not None else None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, of_length = np.zeros(SLOTS, np.int64), np.zeros(shingle + 1, np.int64)
        bits, lengths = (np.unpackbits(mask.value[0]).astype(bool), mask.value[1]) if mask else (None, range(1, shingle + 1))
        for batch in slices(batches, text_col):
            h, of = _words(batch.column(0))
            own = np.minimum(np.diff(of), shingle)
            for k in lengths:
                at, key = _shingles(h, of, k)
                slot = _slot(key, k)
                slot = slot[bits[slot]] if mask else slot[own[owner(of)[at]] == k]
                of_length[k] += len(slot)
                np.add.at(n, slot, 1)
        yield _packed(n, of_length)

    out, of_length = _added_up(texts.select(text_col).mapInArrow(count, _SUMS))
    return out, np.zeros(shingle + 1, np.int64) if of_length is None else of_length


class Windows:
    """Windows of some items, each with one prefix shingle: the rarest over all documents, by a table of slots."""

    def __init__(self, h: np.ndarray, of: np.ndarray, window: int, shingle: int, rarity: np.ndarray):
        n = np.diff(of)
        width = np.minimum(n, window)
        count = np.where(n > 0, n - width + 1, 0)
        self.item = np.repeat(np.arange(len(n)), count)
        self.at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + of[:-1][self.item]
        self.width = width[self.item]
        self.k = np.minimum(self.width, shingle)
        self.h, self.offset, self.hash, seen = h, np.zeros(len(self.at), np.int64), np.zeros(len(self.at), np.uint64), np.zeros(len(self.at), np.int64)
        for k in np.unique(self.k).tolist():
            mine = np.flatnonzero(self.k == k)
            rolled = rolling(h, k)
            place = np.arange(window - k + 1)
            inside = place <= (self.width[mine] - k)[:, None]
            start = np.where(inside, self.at[mine][:, None] + place, self.at[mine][:, None])
            rare = np.where(inside, rarity[_slot(rolled[start], k)], np.iinfo(np.int64).max)
            self.offset[mine] = best = rare.argmin(1)
            seen[mine] = rare[np.arange(len(mine)), best]
            self.hash[mine] = rolled[self.at[mine] + best]
        self._keep(seen > 0)  # a shingle that no document holds: its window occurs nowhere

    def _keep(self, which: np.ndarray) -> None:
        self.item, self.at, self.width, self.k, self.offset, self.hash = (x[which] for x in (self.item, self.at, self.width, self.k, self.offset, self.hash))

    def ready(self) -> Windows:
        """Sorted by prefix, with a bit table for each shingle length."""
        self._keep(np.argsort(self.hash, kind="stable"))
        self.bits = {}
        for k in np.unique(self.k).tolist():
            self.bits[k] = np.zeros(SLOTS, bool)
            self.bits[k][_slot(self.hash[self.k == k], k)] = True
        return self

    def hits(self, h: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window) of all occurrences in a batch of documents."""
        ends, begins = np.repeat(of[1:], np.diff(of)), np.repeat(of[:-1], np.diff(of))
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for k, bits in self.bits.items():
            at, key = _shingles(h, of, k)
            some = bits[_slot(key, k)]
            at, key = at[some], key[some]
            a, b = np.searchsorted(self.hash, key), np.searchsorted(self.hash, key, "right")
            n = b - a
            at = np.repeat(at, n)
            w = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
            first = at - self.offset[w]
            fits = (self.k[w] == k) & (first >= begins[at]) & (first + self.width[w] <= ends[at])  # position and length
            first, w = first[fits], w[fits]
            same = np.ones(len(w), bool)
            for j in range(int(self.width[w].max()) if len(w) else 0):  # whole windows, word by word
                inner = np.minimum(j, self.width[w] - 1)
                same &= h[first + inner] == self.h[self.at[w] + inner]
            found.append((first[same], w[same]))
        return tuple(np.concatenate(x) for x in zip(*found))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, item_col: str = "item_id", text_col: str = "text", broadcast_mb: float = 8.0) -> DataFrame:
    """Marks document words inside any occurrence of a benchmark window.

    A-Z are lower-cased and words are runs of digits, letters and characters beyond ASCII.  A window is `window`
    consecutive words of an item; an item of fewer words, but not none, is one window.  A benchmark of up to
    `broadcast_mb` MB, measured first (texts, ids and 64 bytes an item), is broadcast as arrays of about eight times that size; a larger one is
    joined by shuffles, with the same results.

    Returns docs' columns, n_words_, n_hit_, n_items_ (long), items_ (sorted array of item ids as strings).  A null
    or empty text has no words and no hits; null or empty items have no windows; a null item id counts as the text
    'null'; rows that repeat an item id count once.  Repeated or null document ids are judged row by row.  An empty
    benchmark hits nothing; an empty table gives an empty result.  Earlier columns with the new names are replaced.
    """
    spark = docs.sparkSession
    prepare(spark)
    new = ["n_words_", "n_hit_", "n_items_", "items_"]
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("i"), F.col(text_col).alias("t")).where("length(t) > 0")
    rarity = spark.sparkContext.broadcast(_table(docs, text_col, shingle, _table(items, "t", shingle))[0])
    size = items.agg(F.sum(F.octet_length("t") + F.octet_length("i") + 64)).first()[0] or 0
    way = _judged_in_place if size <= broadcast_mb * 1e6 else _joined
    return under_own_names(docs.drop(*new), [text_col], lambda d, t: way(d, items, rarity, window, shingle, t, new), new)


def _judged_in_place(docs: DataFrame, items: DataFrame, rarity, window: int, shingle: int, text_col: str, new: list[str]) -> DataFrame:
    texts = items.toArrow()
    names, rank = np.unique(np.array(texts["i"].to_pylist(), object), return_inverse=True)
    part = Windows(*_words(texts["t"]), window, shingle, rarity.value).ready()
    part.item = rank.reshape(-1)[part.item]
    shared = docs.sparkSession.sparkContext.broadcast((part, pa.array(names.tolist(), pa.string())))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        win, ids = shared.value
        for batch in slices(batches, text_col):
            h, of = _words(batch.column(text_col))
            first, w = win.hits(h, of)
            pairs = np.unique(owner(of)[first] * max(len(ids), 1) + win.item[w])
            text, item = np.divmod(pairs, max(len(ids), 1))
            count = np.bincount(text, minlength=batch.num_rows)
            found = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), ids.take(pa.array(item)))
            n_hit = per_text(covered(first, win.width[w], len(h)), of)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.diff(of)), pa.array(n_hit), pa.array(count), found], [*batch.schema.names, *new])

    return docs.mapInArrow(mark, f"{ddl}, n_words_ long, n_hit_ long, n_items_ long, items_ array<string>")


def _joined(docs: DataFrame, items: DataFrame, rarity, window: int, shingle: int, text_col: str, new: list[str]) -> DataFrame:
    """Prefixes and the documents' occurrences of them meet by hash; what is around each decides; rows are put together."""
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            n = np.diff(_words(batch.column(text_col))[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n), pa.array(np.arange(row, row + len(n)))], [*batch.schema.names, new[0], "row__"])
            row += len(n)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t", 1 << 20):
            w = Windows(*_words(batch.column("t")), window, shingle, rarity.value)
            inside = [w.h[a : a + n].tobytes() for a, n in zip(w.at.tolist(), w.width.tolist())]
            cols = [batch.column("i").take(pa.array(w.item)), pa.array(w.hash.view(np.int64)), pa.array(w.k), pa.array(w.offset), pa.array(inside, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["item", "hash", "k", "lead", "win"])

    wanted = stored(items.mapInArrow(prefixes, "item string, hash long, k long, lead long, win binary").groupBy("item", "hash", "k", "lead", "win").agg(F.count(F.lit(1)).alias("n")), "prefixes")
    texts = stored(docs.mapInArrow(numbered, f"{ddl}, n_words_ long, row__ long"), "numbered")
    bits = docs.sparkSession.sparkContext.broadcast(np.packbits(_added_up(wanted.select("hash", "k").mapInArrow(_prefix_slots, _SUMS))[0] > 0))

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.unpackbits(bits.value).astype(bool)
        for batch in slices(batches, text_col, 1 << 20):
            h, of = _words(batch.column(text_col))
            of_word = owner(of)
            for k in range(1, shingle + 1):
                at, key = _shingles(h, of, k)
                some = mask[_slot(key, k)]
                at, key = at[some], key[some]
                a, b = np.maximum(at - window, of[:-1][of_word[at]]), np.minimum(at + window, of[1:][of_word[at]])
                around = [h[x:y].tobytes() for x, y in zip(a.tolist(), b.tolist())]
                cols = [batch.column("row__").take(pa.array(of_word[at])), pa.array(key.view(np.int64)), pa.array(np.full(len(at), k)), pa.array(at - of[:-1][of_word[at]]), pa.array(at - a), pa.array(around, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["row__", "hash", "k", "at", "before", "around"])

    seen = texts.select("row__", text_col).mapInArrow(occurrences, "row__ long, hash long, k long, at long, before long, around binary")
    # Where the window would begin in what is around, if it doesn't begin before it; the bytes there must be the window's.
    inside = F.expr("before >= lead and substring(around, cast(8 * (before - lead) + 1 as int), length(win)) = win")
    met = seen.join(wanted, ["hash", "k"]).where(inside)
    span = F.struct((F.col("at") - F.col("lead")).alias("a"), (F.col("at") - F.col("lead") + F.length("win") / 8).cast("long").alias("b"))
    found = met.select("row__", span.alias("span"), "item").groupBy("row__").agg(F.sort_array(F.collect_set("span")).alias("spans"), F.sort_array(F.collect_set("item")).alias("items_"))
    union = F.expr("aggregate(spans, named_struct('e', 0L, 'n', 0L), (s, x) -> named_struct('e', greatest(s.e, x.b), 'n', s.n + greatest(0L, x.b - greatest(s.e, x.a))), s -> s.n)")
    got = texts.join(found.select("row__", union.alias("n_hit_"), "items_"), "row__", "left")
    names = F.coalesce("items_", F.array().cast("array<string>"))
    return got.select(*docs.columns, new[0], F.coalesce("n_hit_", F.lit(0)).alias(new[1]), F.size(names).cast("long").alias(new[2]), names.alias(new[3]))
