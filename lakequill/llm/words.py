"""Hashes of all words of a text without a Python step for each word."""

from __future__ import annotations

import numpy as np

from .common import mix

_BASE = 0x9E3779B97F4A7C15 | 1
_PIECE = 1 << 20
#: White space of ASCII; a word is a run of other bytes.
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        n = max(n, 2 * len(_powers), 1 << 16)
        for name, base in (("_powers", _BASE), ("_inverses", pow(_BASE, -1, 1 << 64))):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            globals()[name] = np.multiply.accumulate(x)


def word_hashes(text: bytes, space: np.ndarray = SPACE) -> np.ndarray:
    """A 64-bit hash of each word in turn: the bytes as digits of a number, scrambled. Long texts go in pieces that end between words."""
    if len(text) <= _PIECE:
        return _hashes(np.frombuffer(text, np.uint8), space)
    b, out, at = np.frombuffer(text, np.uint8), [], 0
    gaps = np.flatnonzero(space[b])
    while at < len(b):
        i = np.searchsorted(gaps, at + _PIECE)
        end = int(gaps[i]) + 1 if i < len(gaps) else len(b)
        out.append(_hashes(b[at:end], space))
        at = end
    return np.concatenate(out)


def _hashes(b: np.ndarray, space: np.ndarray) -> np.ndarray:
    n = len(b)
    if n == 0:
        return np.empty(0, np.uint64)
    _grow(n)
    gap = space[b]
    inside = ~gap
    first = inside.copy()
    first[1:] &= gap[:-1]
    starts = np.flatnonzero(first)
    if len(starts) == 0:
        return np.empty(0, np.uint64)
    digits = b.astype(np.uint64)
    digits += np.uint64(1)
    digits *= _powers[:n]
    digits *= inside
    return mix(np.add.reduceat(digits, starts) * _inverses[starts])
