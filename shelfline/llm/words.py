"""Words ``[^\\x20\\x09-\\x0D]+`` of whole texts as 64-bit hashes, a block at a time.

Everything is array arithmetic on UTF-8 bytes; two words count as equal if their
hashes are (for n different words, n * n / 2**65 pairs are confused).
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from shelfline.llm.common import Block

U = np.uint64
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def seeds(n: int, seed: int = 0) -> np.ndarray:
    """n fixed odd numbers."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U) * U(BASE) + U(seed)) | U(1)


LETTER = seeds(256, 7)
#: The same with A-Z as a-z.
LOWERED = LETTER.copy()
LOWERED[65:91] = LETTER[97:123]
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n, kept for the worker's next blocks."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            factors = np.full(size, base, U)
            factors[0] = 1
            _powers[k] = np.cumprod(factors)
    return _powers[0][:n], _powers[1][:n]


class Words(NamedTuple):
    starts: np.ndarray  # byte positions in the block
    ends: np.ndarray
    bounds: np.ndarray  # words of text i: bounds[i] to bounds[i + 1]


def is_word(data: np.ndarray) -> np.ndarray:
    return (data != 0x20) & (data - np.uint8(0x09) > np.uint8(4))


def spans(block: Block, inside: np.ndarray | None = None) -> Words:
    """The runs of bytes ``inside`` (by default, those that are not white space), cut between texts."""
    inside = is_word(block.data) if inside is None else inside
    n = len(inside)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = np.zeros(n + 1, bool)
    last[1:] = inside
    last[1:n] &= ~inside[1:]
    cuts = block.offsets[(block.offsets > 0) & (block.offsets < n)]
    first[cuts] = inside[cuts]
    last[cuts] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    return Words(starts, ends, np.searchsorted(starts, block.offsets))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, letters: np.ndarray = LETTER) -> np.ndarray:
    """Hash of each span of bytes; equal bytes have equal hashes wherever they lie.

    With ``letters=LOWERED``, A-Z count as a-z.
    """
    if not len(starts):
        return np.zeros(0, U)
    powers, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(letters[data] * powers[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def shingles(hashes: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every ``width`` consecutive words of each text, and their bounds.

    A text of fewer words has one shingle of all of them, one without words none.
    """
    odds = seeds(width, 11)
    n = np.diff(bounds)
    counts = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    out_bounds = np.concatenate(([0], np.cumsum(counts)))
    from_ = np.repeat(bounds[:-1] - out_bounds[:-1], counts) + np.arange(out_bounds[-1])
    padded = np.concatenate((hashes, np.zeros(width, U)))
    short = np.repeat(n < width, counts)
    out = np.full(len(from_), width, U)
    out[short] = np.repeat(n, counts)[short].astype(U)
    for i, odd in enumerate(odds):
        part = padded[from_ + i] * odd
        part[short & (i >= np.repeat(n, counts))] = 0
        out += part
    return mix(out), out_bounds


def sorted_sets(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each text in ascending order, and their bounds."""
    values = values.copy()
    for i in range(len(bounds) - 1):
        values[bounds[i] : bounds[i + 1]].sort()
    fresh = np.ones(len(values), bool)
    fresh[1:] = values[1:] != values[:-1]
    fresh[bounds[:-1][np.diff(bounds) > 0]] = True
    return values[fresh], np.concatenate(([0], np.cumsum(fresh)))[bounds]
