"""Sets of five-word shingles as 64-bit hashes, computed over whole batches of texts at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

WIDTH = 5
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _byte_values() -> np.ndarray:
    """A fixed odd 64-bit value for each byte, those of A-Z the same as of a-z."""
    values, state = [], 0x243F6A8885A308D3
    for _ in range(256):
        state = (state * 6364136223846793005 + 1442695040888963407) & _MASK
        values.append((state ^ (state >> 29)) | 1)
    for upper in range(65, 91):
        values[upper] = values[upper + 32]
    return np.array(values, dtype=np.uint64)


_VALUES = _byte_values()
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (the finalizer of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1), modulo 2**64."""
    out = np.ones(max(n, 1), dtype=np.uint64)
    have = 1
    while have < n:
        step = np.uint64(pow(base, have, 1 << 64))
        more = min(have, n - have)
        out[have : have + more] = out[:more] * step
        have += more
    return out[:n]


@dataclass
class Shingles:
    """``hashes`` of all texts, sorted and distinct inside each; ``bounds`` has where each text's begin."""

    hashes: np.ndarray
    bounds: np.ndarray

    def of(self, i: int) -> np.ndarray:
        return self.hashes[self.bounds[i] : self.bounds[i + 1]]


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts that stand one behind the other in ``data``, text i from bounds[i] to
    bounds[i + 1], and the number of words of each text. A-Z count as a-z."""
    n = len(data)
    if not n:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(bounds) - 1, dtype=np.int64)
    word = ~_BLANK[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = bounds[(bounds > 0) & (bounds < n)]
    first[inner] = word[inner]
    last = word.copy()
    last[:-1] &= ~word[1:]
    last[inner - 1] = word[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    powers = _powers(_BASE, n)
    upto = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_VALUES[data] * powers, out=upto[1:])
    back = _powers(_INVERSE, n)
    hashes = mixed((upto[ends] - upto[starts]) * back[starts] + (ends - starts).astype(np.uint64))
    counts = np.diff(np.searchsorted(starts, bounds))
    return hashes, counts


def shingle_sets(data: np.ndarray, bounds: np.ndarray, width: int = WIDTH) -> Shingles:
    """A text with fewer words than ``width`` has its whole sequence as one shingle; one without words
    has none. Equal sequences have equal hashes; others differ but for 64-bit accidents."""
    words, counts = word_hashes(data, bounds)
    texts = len(counts)
    starts = np.concatenate([[0], np.cumsum(counts)])
    sizes = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    where = np.concatenate([[0], np.cumsum(sizes)])
    text = np.repeat(np.arange(texts), sizes)
    at = starts[text] + (np.arange(where[-1]) - where[text])
    length = np.minimum(counts, width)[text]
    hashes = np.zeros(where[-1], dtype=np.uint64)
    for i in range(width):
        here = i < length
        hashes[here] = hashes[here] * np.uint64(0xD6E8FEB86659FD93) + words[at[here] + i]
    hashes = mixed(hashes + length.astype(np.uint64))
    kept, bounds_out = [], [0]
    for i in range(texts):
        own = np.sort(hashes[where[i] : where[i + 1]])
        if len(own) > 1:
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        kept.append(own)
        bounds_out.append(bounds_out[-1] + len(own))
    return Shingles(np.concatenate([np.zeros(0, dtype=np.uint64), *kept]), np.array(bounds_out))
