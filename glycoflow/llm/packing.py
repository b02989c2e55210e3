"""Best-fit packing: tokenised documents into sequences of fixed length, by the sum-of-squares rule."""

from __future__ import annotations

import functools
import itertools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, slices, stored
from .kernels import owner, span_hashes, text_bytes, words
from .spans import byte_kind

#: Distinct words that a worker's cache holds at most (under 100 MB); beyond, it starts anew.
CACHE = 1_500_000
#: Sequences that one packing group fills, about.  Groups grow in number with the input, not in size.
GROUP = 4000


_LETTER = byte_kind("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")


def _wide_letter(buf: np.ndarray) -> np.ndarray:
    """Bytes of the letters U+00C0 to U+00FF: 0xC3 and what follows it, but for the signs of multiplication and division."""
    out = np.zeros(len(buf), bool)
    lead = np.flatnonzero(buf[:-1] == 0xC3)
    lead = lead[(buf[lead + 1] != 0x97) & (buf[lead + 1] != 0xB7)]
    out[lead] = out[lead + 1] = True
    return out


class WordIds:
    """Token ids of white-space-delimited words, each distinct word that a worker remembers tokenised once.

    This vocabulary's tokenizer drops white space and no token or merge crosses it, so a text's ids are those of its
    words in order.
    """

    def __init__(self, path: str | None):
        import public_tokenizers as P
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path or P.path("word_bpe_49k.json"))
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        self.keys, self.start, self.n, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _tokenise(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and numbers of ids of distinct words.

        Words of Latin letters, with a full stop or comma behind them or not, are tokenised many at a time: each is
        one run of letters, or two runs, and each run's last id is one that ends a word.  The others go one by one.
        """
        raw = buf.tobytes()
        size = ends - starts
        letters = np.concatenate([[0], np.cumsum(_LETTER[buf] | _wide_letter(buf))])
        tail = ((buf[ends - 1] == 0x2E) | (buf[ends - 1] == 0x2C)) & (size > 1)
        plain = letters[ends - tail] - letters[starts] == size - tail
        n = np.zeros(len(starts), np.int64)
        simple, others = np.flatnonzero(plain), np.flatnonzero(~plain)
        spans = list(zip(starts[simple].tolist(), ends[simple].tolist()))
        lines = [b" ".join(raw[a:b] for a, b in spans[i : i + 256]).decode() for i in range(0, len(spans), 256)]
        ids = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)]
        joined = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        stops = np.flatnonzero(self.closes[joined])
        if len(stops) != len(simple) + tail[simple].sum():
            raise ValueError("this vocabulary doesn't mark the ends of words as expected")
        word_end = stops[np.cumsum(1 + tail[simple]) - 1] + 1
        n[simple] = np.diff(word_end, prepend=0)
        single = [e.ids for e in self.tokenizer.encode_batch_fast([raw[a:b].decode() for a, b in zip(starts[others].tolist(), ends[others].tolist())], add_special_tokens=False)]
        n[others] = np.fromiter(map(len, single), np.int64, len(single))
        flat, at = np.empty(n.sum(), np.uint32), np.repeat(plain, n)
        flat[at] = joined
        flat[~at] = np.fromiter(itertools.chain.from_iterable(single), np.uint32, int(n[others].sum()))
        return flat, n

    def encode(self, buf: np.ndarray, off: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a batch, each document closed by end_id; n + 1 offsets."""
        starts, ends, of = words(buf, off)
        keys, first, inverse = np.unique(span_hashes(buf, starts, ends), return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, keys)
        new = np.flatnonzero(self.keys[np.minimum(place, len(self.keys) - 1)] != keys if len(self.keys) else np.ones(len(keys), bool))
        if len(new):
            if len(self.keys) + len(new) > CACHE:
                self._clear()
                new = np.arange(len(keys))
            new = new[np.argsort(first[new])]
            flat, n = self._tokenise(buf, starts[first[new]], ends[first[new]])
            all_keys = np.concatenate([self.keys, keys[new]])
            start = np.concatenate([self.start, len(self.ids) + np.cumsum(n) - n])
            order = np.argsort(all_keys)
            self.keys, self.start, self.n = all_keys[order], start[order], np.concatenate([self.n, n])[order]
            self.ids = np.concatenate([self.ids, flat])
            place = np.searchsorted(self.keys, keys)
        # Words and, after each document's last word, the closing id.
        word = place[inverse.reshape(-1)]
        n_docs = len(off) - 1
        slot = np.arange(len(word)) + owner(of)
        closing = of[1:] + np.arange(n_docs)
        start, n = np.empty(len(word) + n_docs, np.int64), np.ones(len(word) + n_docs, np.int64)
        start[slot], n[slot] = self.start[word], self.n[word]
        start[closing] = len(self.ids)
        ends_at = np.cumsum(n)
        gather = np.arange(ends_at[-1] if len(n) else 0) - np.repeat(ends_at - n, n) + np.repeat(start, n)
        return np.append(self.ids, np.uint32(end_id))[gather], np.concatenate([[0], ends_at[closing]]).astype(np.int64)


@functools.cache
def _word_ids(path: str | None) -> WordIds:
    """One for each worker process, so that words met in one task needn't be tokenised again in the next."""
    return WordIds(path)


def pieces(docs: DataFrame, capacity: int = 4096, end_id: int = 1, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, row and, if asked for, ids: every document's ids, cut only if over capacity.

    row is a number of its own for each piece (task and place in it).
    """
    prepare(docs.sparkSession)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "row", *["ids"] * with_ids]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, row = _word_ids(tokenizer), TaskContext.get().partitionId() << 36
        for batch in slices(batches, "text"):
            ids, off = cache.encode(*text_bytes(batch.column(1)), end_id)
            length = np.diff(off)
            n = -(-length // capacity)
            doc = np.repeat(np.arange(len(n)), n)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            size = np.minimum(length[doc] - start, capacity)
            a, raw = off[doc] + start, memoryview(ids.astype("<u4").view(np.uint8))
            crc = [zlib.crc32(raw[4 * x : 4 * (x + k)]) for x, k in zip(a.tolist(), size.tolist())]
            cols = [batch.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(size), pa.array(crc, pa.int64()), pa.array(np.arange(row, row + len(doc)))]
            row += len(doc)
            if with_ids:
                cols.append(pa.ListArray.from_arrays(pa.array(np.append(a, len(ids)), pa.int32()), pa.array(ids.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(cols, names)

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long, row long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, ddl)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece, longest first.

    With N[g] open bins of residual gap g, a piece goes where the sum of N[g]**2 becomes smallest: into an open bin that
    takes it or into a new one.  Among equals an open bin comes before a new one, and a smaller gap before a larger.
    """
    order = np.argsort(-lengths, kind="stable")
    count = np.zeros(capacity + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, n_bins = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for i in order.tolist():
        size = int(lengths[i])
        have = np.flatnonzero(count[size:]) + size
        # From gap g to g - size: count[g] loses one bin and count[g - size] gains one, unless the bin closes.
        change = 1 - 2 * count[have] + np.where(have > size, 2 * count[have - size] + 1, 0)
        opened = 2 * count[capacity - size] + 1 if size < capacity else 0
        if len(have) and change.min() <= opened:
            gap = int(have[change.argmin()])
            count[gap] -= 1
            at = stacks[gap].pop()
        else:
            gap, at, n_bins = capacity, n_bins, n_bins + 1
        bins[i], offsets[i] = at, capacity - gap
        if gap > size:
            count[gap - size] += 1
            stacks[gap - size].append(at)
    return bins, offsets


def pack(docs: DataFrame, capacity: int = 4096, end_id: int = 1, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs all documents' tokens into sequences of at most `capacity`; only longer documents are cut.

    Returns per piece: doc_id, piece, start, length, ids_crc32 (of the little-endian unsigned 32-bit ids),
    sequence_id, offset.  Texts are read once; only the pieces' lengths are shuffled, dealt by piece number to groups
    that fill about 4000 sequences each (a few hundred kB of lengths), so groups grow in number with the input, and equal rows fall into all of them.

    A null or empty text is its closing id alone.  Null and repeated ids pass through, each row on its own.  An empty
    table gives an empty result; other columns are ignored, whatever their names.
    """
    table = stored(pieces(docs, capacity, end_id, tokenizer, id_col, text_col), "pieces")
    total = table.agg(F.sum("length")).first()[0] or 0
    n_groups = max(1, round(total / capacity / GROUP))

    def place(t: pa.Table) -> pa.Table:
        bins, offsets = sum_of_squares(t["length"].to_numpy(), capacity)
        group = t["group"][0].as_py()
        return t.drop_columns(["group"]).append_column("sequence_id", pa.array(bins * n_groups + group)).append_column("offset", pa.array(offsets))

    grouped = table.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(n_groups)).cast("int")).drop("row")
    return grouped.groupBy("group").applyInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
