"""Vectorised words and hashes over the bytes of many texts laid end to end."""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)  # odd, so that its powers can be undone
_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: The contract's word bytes: digits, letters (lower-cased before) and all of non-ASCII.
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[0x30:0x3A] = WORD_BYTES[0x61:0x7B] = WORD_BYTES[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
        x = (x ^ (x >> U(29))) * U(0xC2B2AE3D27D4EB4F)
        return x ^ (x >> U(32))


#: A random value for each byte.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse; kept for the size that most slices have."""
    size = 1 << max(16, int(n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        ups = np.full(size, _BASE)
        downs = np.full(size, _INVERSE)
        ups[0] = downs[0] = 1
        with np.errstate(over="ignore"):
            _powers[size] = np.multiply.accumulate(ups), np.multiply.accumulate(downs)
    up, down = _powers[size]
    return up[:n], down[:n]


def sums_of(values: np.ndarray) -> np.ndarray:
    """Running sums of value times power, with a zero in front, for ``ranges``."""
    up, _ = powers(len(values))
    out = np.zeros(len(values) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(values * up, out=out[1:])
    return out


def ranges(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the ranges [start, end): equal ranges have equal hashes wherever they stand."""
    _, down = powers(len(sums))
    with np.errstate(over="ignore"):
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


class Words:
    """The lower-case words of texts laid end to end: places, hashes, and the text of each."""

    def __init__(self, raw: np.ndarray, ends: np.ndarray):
        self.raw = LOWER[raw]
        inside = WORD_BYTES[self.raw]
        n = len(raw)
        edge = np.zeros(n + 1, bool)
        edge[1:n] = inside[1:] != inside[:-1]
        edge[0] = edge[n] = True
        edge[ends] = True
        cuts = np.flatnonzero(edge)
        cuts = cuts[: len(cuts)] if n else np.zeros(1, np.int64)
        is_word = inside[cuts[:-1]] if n else np.zeros(0, bool)
        self.starts, self.ends = cuts[:-1][is_word], cuts[1:][is_word]
        self.hashes = ranges(sums_of(BYTE_VALUES[self.raw]), self.starts, self.ends) if n else np.zeros(0, np.uint64)
        #: Words before each text, and of all texts behind the last.
        self.first = np.searchsorted(self.starts, ends)

    def shingles(self, size: int) -> np.ndarray:
        """Hashes of ``size`` consecutive words from each word; those that would run over the end are left out."""
        n = len(self.hashes) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        at = np.arange(n)
        return ranges(sums_of(self.hashes), at, at + size)

    def words(self, start: int, size: int) -> bytes:
        """Consecutive words, a space between them."""
        data = self.raw
        return b" ".join(
            data[a:b].tobytes() for a, b in zip(self.starts[start : start + size], self.ends[start : start + size], strict=True)
        )


def expand(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers start, start+1, ... of each range, one range after the other."""
    total = int(counts.sum())
    before = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(before - starts, counts)


def union_length(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of ranges that overlap or touch; the ranges come sorted by start."""
    if not len(starts):
        return starts, ends
    reach = np.maximum.accumulate(ends)
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > reach[:-1]
    heads = np.flatnonzero(new)
    return starts[heads], np.append(reach[heads[1:] - 1], reach[-1])
