"""Words, word hashes and window hashes, shared by the operators on word sequences."""

from __future__ import annotations

import numpy as np
import xxhash

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: A-Z in lower case, all other bytes as they are.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def words(text: str | None, lower: bool = False) -> list[bytes]:
    """Maximal runs of other characters than blank, tab, line feed, vertical tab, form feed and carriage
    return: just what bytes.split() parts."""
    data = (text or "").encode()
    return (data.translate(LOWER) if lower else data).split()


class WordHashes(dict):
    """64-bit hash of each word, remembered for up to ``limit`` words."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, found: list[bytes]) -> np.ndarray:
        if len(self) > self.limit:
            self.clear()
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of ``x``; one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the step and of its inverse, as far as any sequence here was long."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1024)
            self.up, self.down = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, x)))) for x in (_STEP, _BACK))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of every ``width`` consecutive items; equal windows have equal hashes wherever they stand."""
    n = len(hashes) - width + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    up, down = _POWERS.to(len(hashes))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * up)))
    return mixed((sums[width:] - sums[:-width]) * down[:n])
