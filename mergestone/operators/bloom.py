"""Blocked Bloom filters: 512-bit blocks, all bits of a key in one block, whole batches at a time."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

BLOCK_BITS = 512
#: A key's bits come from 63 bits of its second hash, nine for each.
MAX_HASHES = 7


def optimal_bits(n: int, p: float) -> int:
    """Textbook size of a Bloom filter in bits: ceil(-n ln p / ln(2)^2)."""
    return math.ceil(-n * math.log(p) / math.log(2) ** 2) if n > 0 else 0


def optimal_hashes(n: int, p: float) -> int:
    """Textbook number of hash functions: ceil(m / n ln 2)."""
    return math.ceil(optimal_bits(n, p) / n * math.log(2)) if n > 0 else 0


def blocked_rate(bits: float, hashes: int) -> float:
    """The false-positive rate of a blocked filter with so many bits a key: blocks hold a Poisson number of keys each."""
    load = BLOCK_BITS / bits
    chance, total, j = math.exp(-load), 0.0, 0
    while j < 10 * load + 50:
        total += chance * (1 - (1 - 1 / BLOCK_BITS) ** (hashes * j)) ** hashes
        j += 1
        chance *= load / j
    return total


@lru_cache(maxsize=64)
def blocked_bits(target: float, hashes: int) -> float:
    """Bits a key for a blocked filter of the false-positive rate ``target``."""
    low, high = 1.0, 512.0
    for _ in range(40):
        middle = (low + high) / 2
        low, high = (middle, high) if blocked_rate(middle, hashes) > target else (low, middle)
    return high


@dataclass(frozen=True)
class Geometry:
    """Blocks and hashes of a filter for ``keys`` keys at the false-positive rate ``target``."""

    blocks: int
    hashes: int

    @classmethod
    def of(cls, keys: int, target: float) -> Geometry:
        if not 0 < target < 1:
            raise ValueError("the target rate lies between 0 and 1")
        hashes = max(1, min(MAX_HASHES, round(-math.log2(target))))
        return cls(max(1, math.ceil(max(1, keys) * blocked_bits(target, hashes) / BLOCK_BITS)), hashes)

    @property
    def bytes(self) -> int:
        return self.blocks * BLOCK_BITS // 8


class BlockedBloom:
    """The filter of one bucket. Keys come as two 64-bit hashes each, in NumPy arrays."""

    def __init__(self, geometry: Geometry) -> None:
        import numpy as np

        self.geometry = geometry
        self.words = np.zeros(geometry.blocks * 8, dtype=np.uint64)

    def _bits(self, h1, h2):
        import numpy as np

        u1, u2 = h1.view(np.uint64), h2.view(np.uint64)
        block = ((u1 >> np.uint64(32)) * np.uint64(self.geometry.blocks)) >> np.uint64(32)
        for i in range(self.geometry.hashes):
            bit = (u2 >> np.uint64(9 * i)) & np.uint64(BLOCK_BITS - 1)
            yield (block * np.uint64(8) + (bit >> np.uint64(6))).astype(np.int64), np.uint64(1) << (bit & np.uint64(63))

    def contains(self, h1, h2):
        import numpy as np

        found = np.ones(len(h1), dtype=bool)
        for word, mask in self._bits(h1, h2):
            found &= (self.words[word] & mask) != 0
        return found

    def add(self, h1, h2) -> None:
        import numpy as np

        for word, mask in self._bits(h1, h2):
            np.bitwise_or.at(self.words, word, mask)

    def query_then_add(self, h1, h2):
        """For each key in turn: was it there already, in the filter or earlier in this batch? Then adds it."""
        import numpy as np

        found = self.contains(h1, h2)
        _, first = np.unique(h1 ^ ((h2 << np.int64(1)) | (h2.view(np.uint64) >> np.uint64(63)).astype(np.int64)), return_index=True)
        again = np.ones(len(h1), dtype=bool)
        again[first] = False
        self.add(h1, h2)
        return found | again
