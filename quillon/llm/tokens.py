"""Tokens, shingles and windows of texts as 64-bit hashes, computed for whole batches with numpy."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Characters handled at once; a longer text is still handled whole.
CHUNK_CHARS = 400_000
_ODD = 0x9E3779B97F4A7C15 | 1
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


@lru_cache(2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_ODD, -1, 1 << 64)
    with np.errstate(over="ignore"):
        ones = np.ones(size + 1, _U)
        up, down = ones * _U(_ODD), ones * _U(inverse)
        up[0] = down[0] = 1
        return np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U)


@lru_cache(2)
def character_mask(kind: str) -> np.ndarray:
    """Which code points belong to tokens: ``ascii`` a-z and 0-9, ``word`` Unicode letters and digits."""
    if kind == "ascii":
        mask = np.zeros(sys.maxunicode + 2, bool)
        mask[ord("a") : ord("z") + 1] = mask[ord("0") : ord("9") + 1] = True
        return mask
    return np.array([unicodedata.category(chr(c))[0] == "L" or unicodedata.category(chr(c)) == "Nd" for c in range(sys.maxunicode + 1)] + [False])


def chunks(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """(number of the first, texts) in runs of about CHUNK_CHARS characters; nulls become empty."""
    first, run, size = 0, [], 0
    for i, t in enumerate(texts):
        t = t or ""
        if run and size + len(t) > CHUNK_CHARS:
            yield first, run
            first, run, size = i, [], 0
        run.append(t)
        size += len(t)
    if run:
        yield first, run


def token_hashes(texts: list[str], kind: str = "ascii") -> tuple[np.ndarray, np.ndarray]:
    """(hash, number of its text) of every token of the lower-cased texts, in order."""
    joined = "\0".join(t.replace("\0", " ") for t in texts).lower()
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.concatenate(([False], character_mask(kind)[cp], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    room = 1 << max(16, int(len(cp)).bit_length())
    up, down = _powers(room)
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, _U), np.cumsum((cp.astype(_U) + _U(1)) * up[: len(cp)], dtype=_U)))
        h = mix((total[end] - total[start]) * down[start] + (end - start).astype(_U))
    doc = np.searchsorted(np.flatnonzero(cp == 0), start)
    return h, doc


def windows(h: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the ``size`` tokens from here, whether they lie in one text) for each token that has as many after it."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, _U), np.zeros(0, bool)
    with np.errstate(over="ignore"):
        out = np.zeros(n, _U)
        for k in range(size):
            out *= _U(_ODD)
            out += h[k : k + n]
    return mix(out), doc[:n] == doc[size - 1 :]


def shingle_sets(texts: list[str], size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, number of its text), the distinct ones of each text, ordered by text and shingle."""
    h, doc = token_hashes(texts)
    w, whole = windows(h, doc, size)
    w, d = w[whole], doc[: len(w)][whole]
    order = np.lexsort((w, d))
    w, d = w[order], d[order]
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1]) | (d[1:] != d[:-1])
    return w[new], d[new]


def groups(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(value, first place) of each run of equal values."""
    if not len(d):
        return d, np.zeros(0, np.int64)
    first = np.concatenate(([0], np.flatnonzero(d[1:] != d[:-1]) + 1))
    return d[first], first
