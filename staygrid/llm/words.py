"""Words and their 64-bit hashes for whole Arrow batches, computed on the bytes in place.

A word is a run of bytes other than space and 0x09 to 0x0D, with A-Z lower-cased unless ``SAME`` is asked for. Its hash is a polynomial over its bytes
modulo 2^64, read off a running sum, then mixed with its length. Two different words agree with probability about 2^-64.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from staygrid.llm.shared import flat_bytes

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)


def powers(of: int, n: int) -> np.ndarray:
    """of^0 .. of^(n-1) modulo 2^64, kept for the next batch."""
    have = _powers.get(of)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, of, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[of] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """Words of a batch: ``starts`` and ``ends`` in ``data`` (lower-cased), and the first word of each document."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # one more than documents

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        n = len(self.data)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * powers(BASE, n), out=total[1:])
        h = (total[self.ends] - total[self.starts]) * powers(INVERSE, n)[self.starts] if n else np.zeros(0, np.uint64)
        return mix(h + (self.ends - self.starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def words_of(column: pa.Array, letters: np.ndarray = LOWER) -> Words:
    raw, offsets = flat_bytes(column)
    data = letters[raw]
    solid = ~SPACE[data]
    n = len(data)
    begin, end = solid.copy(), solid.copy()
    if n:
        begin[1:] &= ~solid[:-1]
        end[:-1] &= ~solid[1:]
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < n)]
        begin[inner] = solid[inner]
        end[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets))
