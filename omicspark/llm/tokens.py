"""Words and k-grams of many texts at once, as numpy arrays over their UTF-8 bytes."""

from __future__ import annotations

import functools

import numpy as np

#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: After LOWER: the bytes of [0-9a-z] and of all characters beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
#: All but space and 0x09-0x0D.
NON_SPACE = np.ones(256, bool)
NON_SPACE[[32, 9, 10, 11, 12, 13]] = False
_BASE = 0x9E3779B97F4A7C15
_STEP = np.uint64(0xD6E8FEB86659FD93)


@functools.lru_cache(maxsize=2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    inverse = pow(_BASE, -1, 1 << 64)
    one = np.ones(1, np.uint64)
    return tuple(np.concatenate([one, np.cumprod(np.full((1 << bits) - 1, x, np.uint64))]) for x in (_BASE, inverse))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _STEP
    return x ^ (x >> np.uint64(29))


def bounds(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = ALNUM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of lower-cased data: start, end and text number of each word (a longest run of kind within a text)."""
    n = len(data)
    inside = kind[data]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = offsets[(offsets > 0) & (offsets < n)]
    starts[edge] |= inside[edge]
    ends[edge - 1] |= inside[edge - 1]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = ALNUM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """bounds(), and the 64-bit hash of each word."""
    start, end, text = bounds(data, offsets, kind)
    return start, end, text, span_hashes(data, start, end)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= _STEP
        out += hashes[j : j + n]
    return mixed(out)


def window_minima(values: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive values."""
    n = len(values) - w + 1
    if n <= 0:
        return values[:0]
    out = values[:n].copy()
    for j in range(1, w):
        np.minimum(out, values[j : j + n], out=out)
    return out


def cut(start: np.ndarray, end: np.ndarray, text: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of more than `most` bytes as consecutive parts of at most that many; the others as they are."""
    parts = -(-(end - start) // most)
    at = np.repeat(np.arange(len(start)), parts)
    no = np.arange(len(at)) - np.repeat(np.cumsum(parts) - parts, parts)
    first = start[at] + no * most
    return first, np.minimum(first + most, end[at]), text[at]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, most: int = 1 << 21) -> np.ndarray:
    """The 64-bit hash of each span of bytes, equal for equal bytes; spans are in order and don't overlap. Worked in
    parts of about `most` bytes, as each byte takes several numbers of 8."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(start, start[i] + most)))
        low, high = int(start[i]), int(end[j - 1])
        up, down = _powers(max(16, (high - low).bit_length()))
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * up[: high - low], out=sums[1:])
        out[i:j] = mixed((sums[end[i:j] - low] - sums[start[i:j] - low]) * down[start[i:j] - low])
        i = j
    return out
