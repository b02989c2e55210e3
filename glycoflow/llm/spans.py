"""Spans of text as `kind:start:end`, in code points; which texts of a batch are worth a closer look."""

from __future__ import annotations

import hashlib

import numpy as np

from .kernels import LOWER, words

Span = tuple[int, int, int]  # start, kind number, end


def joined(spans: list[Span], kinds: list[str]) -> str:
    return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in sorted(spans))


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def texts_with_run(buf: np.ndarray, off: np.ndarray, kind: np.ndarray, least: int) -> np.ndarray:
    """Marks the texts with a run of at least so many bytes of a kind."""
    starts, ends, of = words(buf, off, kind)
    total = np.concatenate([[0], np.cumsum(ends - starts >= least)])
    return total[of[1:]] > total[of[:-1]]


def texts_with(buf: np.ndarray, off: np.ndarray, needles: list[bytes], fold: bool = False) -> np.ndarray:
    """Marks the texts that hold one of the needles, A-Z lower-cased first if fold."""
    raw, out = (LOWER[buf] if fold else buf).tobytes(), np.zeros(len(off) - 1, bool)
    for needle in needles:
        at = raw.find(needle)
        while at >= 0:
            i = int(np.searchsorted(off, at, "right")) - 1
            if at + len(needle) <= off[i + 1]:
                out[i] = True
                at = raw.find(needle, int(off[i + 1]))
            else:
                at = raw.find(needle, at + 1)
    return out


def byte_kind(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out
