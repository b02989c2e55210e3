"""Secret scans: patterns, and strings that a tokenizer's vocabulary spells with few characters per token."""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare
from .kernels import text_bytes
from .spans import Span, byte_kind, joined, texts_with, texts_with_run

KINDS = ["assign", "access", "hex", "random"]
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
#: What a token-efficiency test looks at: long strings of the alphabets that keys are written in.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
#: Lengths of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512 digests in hex.
DIGESTS = {32, 40, 56, 64, 96, 128}
_RUN = byte_kind("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")


@functools.cache
def encoder(path: str | None):
    """The tiktoken encoding of a rank file; by default the byte-level BPE with 50k ranks."""
    import public_tokenizers as P
    import tiktoken

    with open(path or P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def identifier(text: str) -> bool:
    """A UUID or a digest of a known length.  Names put together of words need no rule: tokens spell them efficiently."""
    return bool(UUID.fullmatch(text) or len(text) in DIGESTS and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text))


def secret_spans(text: str, path: str | None, ratio: float) -> list[Span]:
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base = list(found)
    for m in CANDIDATE.finditer(text):
        if not identifier(m[0]) and not any(s < m.end() and m.start() < e for s, _, e in base):
            if len(m[0]) < ratio * len(encoder(path).encode_ordinary(m[0])):
                found.append((m.start(), 3, m.end()))
    return found


def scan_secrets(docs: DataFrame, ratio: float = 2.0, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of secrets in whole texts; one pass, no shuffle.

    Base kinds: assign (a key word, a colon or equals sign, a value of six characters or more), access (AKIA and
    upper-case characters, 20 or more), hex (24 digits or more).  Kind random is added where a string of 20 characters
    or more takes a token for less than `ratio` characters on average under the tiktoken vocabulary, unless it is a
    digest of a known length, a UUID, or overlaps a base span.  Random strings of any alphabet measure 1.3 to 1.7,
    words and names put together 2.2 or more.  A vocabulary is the path of a rank file.

    Returns id, n_assign, n_access, n_hex, n_random (long), base, spans (kind:start:end in code points, by start and
    kind).  A null or empty text has no spans; ids may be null or repeated: rows are judged one by one.  An empty
    table gives an empty result; other columns are ignored, whatever their names.
    """
    prepare(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = text_bytes(batch.column(1))
            look = texts_with(buf, off, [b"passw", b"secret", b"token", b"apikey", b"api_key"], fold=True) | texts_with(buf, off, [b"AKIA"])
            look |= texts_with_run(buf, off, _RUN, 20)
            rows: list[tuple] = [(0, 0, 0, 0, "", "")] * batch.num_rows
            for i in np.flatnonzero(look).tolist():
                spans = secret_spans(batch.column(1)[i].as_py(), vocabulary, ratio)
                if spans:
                    n = [sum(k == x for _, k, _ in spans) for x in range(4)]
                    rows[i] = (*n, joined([s for s in spans if s[1] < 3], KINDS), joined(spans, KINDS))
            n = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 6, [pa.int64()] * 4 + [pa.string()] * 2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *n], ["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scan, "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base string, spans string")
