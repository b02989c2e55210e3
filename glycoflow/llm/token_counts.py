"""Token counts: whole texts split at safe boundaries and encoded in batches of even size, of which only lengths are kept."""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, slices
from .kernels import text_bytes
from .spans import byte_kind

#: Bytes of text that one call of the library encodes, about.
BATCH = 1 << 18
#: A worker remembers the numbers of tokens of so many short stretches at most, and starts anew beyond that.
CACHE, SHORT = 1_000_000, 64
#: First bytes of characters between which a space may be a boundary: ASCII letters and digits; or all that can't begin white space.
ALNUM = byte_kind("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
SOLID = np.zeros(256, bool)
SOLID[[*range(0x21, 0x7F), *range(0xC3, 0xE0), *range(0xE4, 0xF5)]] = True


@dataclass(frozen=True)
class Counter:
    """count(texts) gives each text's number of tokens.

    beside: first bytes of the characters before and after a single space in front of which any text may be split
    without changing the total; None if texts must stay whole.  drops_space: that space is then left out.
    """

    count: Callable[[list[str]], list[int]]
    beside: np.ndarray | None
    drops_space: bool = False
    known: dict[bytes, int] = field(default_factory=dict)

    def totals(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Tokens of each text of a batch.  Stretches that were met before are looked up by their bytes."""
        starts, of = (off[:-1], np.arange(len(off) - 1)) if self.beside is None else stretches(buf, off, self.beside)
        raw = buf.tobytes()
        ends = np.append(starts[1:], len(raw)) if len(starts) else starts
        skip = np.zeros(len(starts), np.int64)
        if self.drops_space:
            skip[1:] = of[1:] == of[:-1]
        parts = [raw[a:b] for a, b in zip((starts + skip).tolist(), ends.tolist())]
        known = self.known
        n = np.fromiter((known.get(x, -1) for x in parts), np.int64, len(parts))
        new = {parts[i]: -1 for i in np.flatnonzero(n < 0).tolist()}
        if len(known) + len(new) > CACHE:
            known.clear()
        batch, size = [], 0
        for i, x in enumerate(new):
            batch.append(x)
            size += len(x)
            if size >= BATCH or i == len(new) - 1:
                new.update(zip(batch, self.count([y.decode() for y in batch])))
                batch, size = [], 0
        known.update((x, k) for x, k in new.items() if len(x) <= SHORT)
        for i in np.flatnonzero(n < 0).tolist():
            n[i] = new[parts[i]]
        return np.bincount(of, n, len(off) - 1).astype(np.int64)


def stretches(buf: np.ndarray, off: np.ndarray, beside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where texts and, in them, what begins at a safe boundary's space start; and the text of each."""
    lead = (buf & 0xC0) != 0x80
    kind = beside[buf] & lead
    # The character before a space: the kind of the last first byte up to the byte before.
    before = kind[np.maximum.accumulate(np.where(lead, np.arange(len(buf)), 0))] if len(buf) else kind
    gaps = np.flatnonzero(buf[1:-1] == 0x20) + 1 if len(buf) > 2 else np.zeros(0, np.int64)
    gaps = gaps[before[gaps - 1] & kind[gaps + 1]]
    owner = np.searchsorted(off, gaps, "right") - 1
    inside = (gaps > off[owner]) & (gaps + 1 < off[owner + 1])
    # Of texts that begin at one place all but the last are empty; each text has a start of its own.
    of = np.concatenate([np.arange(len(off) - 1), owner[inside]])
    starts = np.concatenate([off[:-1], gaps[inside]])
    order = np.lexsort((starts, of))
    return starts[order], of[order]


def _json_counter(path: str) -> Counter:
    """A `tokenizers` file.

    A byte-level pre-tokenizer's pattern takes a space only in front of what follows it, and looks at most one
    character ahead and none back; so between two characters that aren't white space, the pieces on both sides of a
    space are those of the whole text.  No added token with a space inside, or that takes spaces beside it, may be
    there.  With Unicode normalisation only ASCII is sure to stay apart.  Files of other kinds are used on whole texts.
    """
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    plain = all(" " not in t["content"] and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in spec.get("added_tokens") or [])
    splits = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and plain
    splits = splits and (norm is None or norm["type"] in ("NFC", "NFD", "NFKC", "NFKD"))
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return Counter(lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)], (SOLID if norm is None else ALNUM) if splits else None)


def _model_counter(path: str) -> Counter:
    """A `sentencepiece` file.

    Where no piece holds a word mark behind another character, merges don't cross words; where a text gets a mark of
    its own in front as well, the two sides of a gap without its space give the ids of the whole.
    """
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    inner = any("▁" in model.id_to_piece(i).lstrip("▁") for i in range(model.get_piece_size()))
    probes = [("a", "b"), ("x1", "Y"), ("9", "z")]
    splits = not inner and all(model.encode(f"{a} {b}") == model.encode(a) + model.encode(b) for a, b in probes)
    return Counter(lambda texts: [len(x) for x in model.encode(texts, num_threads=1)], ALNUM if splits else None, drops_space=True)


@functools.lru_cache(maxsize=4)
def counter(path: str | None) -> Counter:
    """The counter of a .json or .model file, once for each worker process; by default of the byte-level BPE with 50k ids."""
    if path is None:
        import public_tokenizers as P

        path = P.path("byte_bpe_50k.json")
    kinds = {".json": _json_counter, ".model": _model_counter}
    kind = os.path.splitext(path)[1]
    if kind not in kinds:
        raise ValueError(f"{path}: neither a .json file of tokenizers nor a .model file of sentencepiece")
    return kinds[kind](path)


def count_tokens(docs: DataFrame, limit: int = 512, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text as the tokenizer's library gives them, without any that it would add; no shuffle.

    Texts are split where that provably changes nothing: before a single space between words.  What a worker hasn't met
    yet is put together into batches of about 256 KB, whatever the lengths of texts are, and only lengths leave the
    library.  Strings that look like special tokens are what the library takes them for by default.

    Returns id, n_bytes (of UTF-8), n_tokens (long), over_limit (n_tokens > limit).  A null or empty text has none of
    either.  Ids may be null or repeated: rows are judged one by one.  An empty table gives an empty result; other
    columns are ignored, whatever their names.  tokenizer: path of a .json or .model file.
    """
    prepare(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(tokenizer)
        for batch in slices(batches, "text"):
            buf, off = text_bytes(batch.column(1))
            total = c.totals(buf, off)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(off)), pa.array(total), pa.array(total > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    ddl = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(count, ddl)
