"""Vectorised text kernels: words, hashes and rolling windows over one Arrow batch of texts."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: `[^\x20\x09-\x0D]+`: every byte but ASCII white space.
PLAIN = np.ones(256, bool)
PLAIN[[0x20, *range(0x09, 0x0E)]] = False
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` once A-Z are lower-cased: digits, letters, everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_BLOCK = 1 << 20
_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_ROLL = 0xD6E8FEB86659FD93 | 1
_M64 = (1 << 64) - 1


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse, modulo 2**64."""

    def grow(base: int) -> np.ndarray:
        out = np.empty(n + 1, np.uint64)
        out[0], filled = 1, 1
        while filled <= n:
            step = np.uint64(pow(base, filled, 1 << 64))
            take = min(filled, n + 1 - filled)
            out[filled : filled + take] = out[:take] * step
            filled += take
        return out

    return grow(_BASE), grow(pow(_BASE, -1, 1 << 64))


_powers = functools.lru_cache(maxsize=2)(powers)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that each bit of a polynomial hash can pick a bucket."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, one after the other, and n + 1 offsets.  A null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def words(buf: np.ndarray, off: np.ndarray, kind: np.ndarray = PLAIN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes in `kind`, cut at text ends; offsets of each text's words."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = kind[buf]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    at = off[:-1][off[:-1] < len(buf)]
    first[at] = inside[at]
    at = off[1:][off[1:] > 0] - 1
    last[at] = inside[at]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans in ascending order: polynomial prefix sums, bounded blocks at a time."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _BLOCK, "right")))
        a, b = int(starts[i]), int(ends[j - 1])
        power, inverse = _powers(max(_BLOCK, 1 << (b - a).bit_length()))
        total = np.empty(b - a + 1, np.uint64)
        total[0] = 0
        np.cumsum(_TABLE[buf[a:b]] * power[: b - a], out=total[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = (total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64)
        i = j
    return mix(out)


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Rabin-Karp hash of every k consecutive values: sum of h[i + j] * B ** (k - 1 - j) modulo 2**64.

    The polynomial for k is put together from those for powers of two.
    """
    if len(h) < k:
        return np.zeros(0, np.uint64)
    have, width, power = None, 0, h
    span = 1
    while True:
        if k & span:
            have = power if have is None else have[: len(h) - width - span + 1] * np.uint64(pow(_ROLL, span, 1 << 64)) + power[width : width + len(h) - width - span + 1]
            width += span
        if width == k:
            return mix(have)
        power = power[: len(power) - span] * np.uint64(pow(_ROLL, span, 1 << 64)) + power[span:]
        span *= 2


def windows(h: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the first words of all k-word windows inside one text, and the windows' hashes."""
    rolled = rolling(h, k)
    left = np.repeat(offsets[1:], np.diff(offsets))[: len(rolled)] - np.arange(len(rolled))
    at = np.flatnonzero(left >= k)
    return at, rolled[at]


def owner(offsets: np.ndarray) -> np.ndarray:
    """For each item, the index of the text that holds it."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def covered(at: np.ndarray, width: int | np.ndarray, n: int) -> np.ndarray:
    """Marks the items 0..n-1 that lie in any [at, at + width)."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, np.minimum(at + width, n), -1)
    return np.cumsum(edge[:n]) > 0


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of flags over each text's items."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def doc_ids(column: pa.Array) -> np.ndarray:
    """Document ids as int64; a null id sorts before all others."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.int64()), NULL_ID).to_numpy(zero_copy_only=False)


#: Stands for a null document id inside tasks.
NULL_ID = -(2**63)


def pack_ints(values: np.ndarray) -> bytes:
    """Integers as byte planes, compressed: sorted or small values leave planes of zeros."""
    import zstandard

    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack_ints(blob: bytes, dtype: type) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob, max_output_size=1 << 31), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(dtype)
