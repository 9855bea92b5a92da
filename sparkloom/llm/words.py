"""Vectorised word spans and word hashes over the UTF-8 bytes of many texts at once."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes that belong to words: ASCII letters and digits, and every byte of a non-ASCII character.
WORD_BYTES = np.array([chr(i).isalnum() or i >= 128 for i in range(256)])
#: Bytes that do not separate words at ASCII white space.
NON_SPACE_BYTES = np.array([i != 0x20 and not 0x09 <= i <= 0x0D for i in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of member bytes, and the text that each is in."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = member[data]
    starts = np.zeros(len(data) + 1, bool)
    ends = np.zeros(len(data) + 1, bool)
    starts[1:-1] = inside[1:] & ~inside[:-1]
    starts[0] = inside[0]
    ends[1:-1] = inside[:-1] & ~inside[1:]
    ends[-1] = inside[-1]
    cut = offsets[1:-1]  # texts lie side by side, so a run may go on in the next one
    cut = cut[(cut > 0) & (cut < len(data))]
    both = cut[inside[cut] & inside[cut - 1]]
    starts[both] = True
    ends[both] = True
    at, to = np.flatnonzero(starts), np.flatnonzero(ends)
    return at, to, np.searchsorted(offsets, at, side="right") - 1


def hashes(data: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; independent of where the span lies."""
    n = len(data)
    power, back = _powers(n + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
        return mix((sums[to] - sums[at]) * back[at])


_CACHE: list[np.ndarray] = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_CACHE[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _CACHE[k] = np.multiply.accumulate(x)
    return _CACHE


def shingle_hashes(word: np.ndarray, text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each run of size words inside one text, and the index of its first word."""
    n = len(word) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for k in range(size):
            out = out * np.uint64(0xD6E8FEB86659FD93) + word[k : k + n]
        out = mix(out)
    first = np.flatnonzero(text[:n] == text[size - 1 : size - 1 + n])
    return out[first], first
