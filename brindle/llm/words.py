"""Words of many texts at once, as numpy arrays: where each word lies and a 64-bit hash of its bytes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np

#: ASCII capitals to small letters, byte by byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


#: Bytes to hash at a time: the tables of powers then stay at 8 MiB each.
PART = (1 << 20) - (1 << 16)


@cache
def _tables(seed: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    values = rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
    step = int(rng.integers(2**62, 2**63)) | 1
    back = pow(step, -1, 1 << 64)
    ups, downs = np.empty(length, np.uint64), np.empty(length, np.uint64)
    with np.errstate(over="ignore"):
        ups[:] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(length - 1, step, np.uint64)]), dtype=np.uint64)
        downs[:] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(length - 1, back, np.uint64)]), dtype=np.uint64)
    return values, ups, downs


def runs(inside: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, cut also at ``edges`` (positions where a new text begins)."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = inside.copy()
    new[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = edges[(edges > 0) & (edges < n)]
    new[edges] |= inside[edges]
    last[edges - 1] |= inside[edges - 1]
    return np.flatnonzero(new), np.flatnonzero(last) + 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each piece of ``data``: a polynomial over random byte values, mixed. Equal bytes, equal hash."""
    room = 1 << max(20, int(len(data) - 1).bit_length())
    values, ups, downs = _tables(seed, room)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        part = values[data]
        part *= ups[: len(data)]
        np.cumsum(part, out=total[1:])
        h = total[ends]
        h -= total[starts]
        h *= downs[starts]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h += (ends - starts).astype(np.uint64)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


def long_text(data: np.ndarray, inside: np.ndarray, part: int = PART) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """One text of any length in blocks of ``part`` bytes at most, cut between words: each block's bytes and its words' hashes.

    ``inside`` tells the word bytes after lower-casing. A word longer than a block has one hash too, folded from those of its pieces."""
    at = 0
    while at < len(data):
        low = LOWER[data[at : at + part]]
        word = inside[low]
        if at + len(low) < len(data) and word[-1]:
            gaps = np.flatnonzero(~word)
            if not len(gaps):  # within one word
                yield from _long_word(data, at, inside, part)
                at = _word_end(data, at, inside, part)
                continue
            low, word = low[: gaps[-1] + 1], word[: gaps[-1] + 1]
        yield data[at : at + len(low)], hashes(low, *runs(word, np.zeros(0, np.int64)))
        at += len(low)


def _word_end(data: np.ndarray, at: int, inside: np.ndarray, part: int) -> int:
    for lo in range(at, len(data), part):
        gaps = np.flatnonzero(~inside[LOWER[data[lo : lo + part]]])
        if len(gaps):
            return lo + int(gaps[0])
    return len(data)


def _long_word(data: np.ndarray, at: int, inside: np.ndarray, part: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The blocks of one word longer than a block; the last has the hash of the whole."""
    end, folded = _word_end(data, at, inside, part), np.zeros(1, np.uint64)
    for lo in range(at, end, part):
        low = LOWER[data[lo : min(lo + part, end)]]
        one = hashes(low, np.zeros(1, np.int64), np.array([len(low)]))
        with np.errstate(over="ignore"):
            folded = (folded ^ one) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(len(low))
        yield data[lo : lo + len(low)], folded if lo + part >= end else folded[:0]


def owners(offsets: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """Which text each byte position lies in (positions ascend)."""
    return np.searchsorted(offsets, positions, side="right") - 1
