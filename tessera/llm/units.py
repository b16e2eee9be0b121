"""Units of many texts at once: hashes of words in bytes, and a table of units in arrays."""

from __future__ import annotations

import numpy as np

_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: Powers of the bases, by a byte's place in its word; they come round again in longer words.
_PLACES = 1 << 16
_powers: list[np.ndarray] = []


class Table:
    """Slots of units by two 64-bit hashes: open addresses in arrays, for at most ``size`` units."""

    def __init__(self, size: int):
        self.bits = (3 * size // 2 + 256).bit_length()  # a third stays free
        self.clear()

    def clear(self) -> None:
        n = 1 << self.bits
        self.first, self.second, self.slot = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros(n, np.int32)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each unit, -1 where it is not there."""
        out, left = np.full(len(a), -1, np.int32), np.arange(len(a))
        i, mask = (a >> np.uint64(64 - self.bits)).astype(np.int64), (1 << self.bits) - 1
        while len(left):
            k = self.first[i]
            hit = (k == a) & (self.second[i] == b)
            out[left[hit]] = self.slot[i[hit]]
            on = np.flatnonzero(~hit & (k != 0))
            left, i, a, b = left[on], (i[on] + 1) & mask, a[on], b[on]
        return out

    def add(self, a: np.ndarray, b: np.ndarray, slots: np.ndarray) -> None:
        """Enter units that are distinct, not there and have slots of their own."""
        i, mask = (a >> np.uint64(64 - self.bits)).astype(np.int64), (1 << self.bits) - 1
        while len(a):
            free = np.flatnonzero(self.first[i] == 0)
            self.slot[i[free]] = slots[free]  # of several that want a place the last gets it
            won = free[self.slot[i[free]] == slots[free]]
            self.first[i[won]], self.second[i[won]] = a[won], b[won]
            rest = np.ones(len(a), bool)
            rest[won] = False
            a, b, slots, i = a[rest], b[rest], slots[rest], (i[rest] + 1) & mask


def mixed(h: np.ndarray, by: int) -> np.ndarray:
    """Polynomial hashes with their high bits spread, never 0; ``h`` is changed."""
    h ^= h >> np.uint64(29)
    h *= np.uint64(by)
    h[h == 0] = 1
    return h


def words(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The joined texts, A-Z in lower case, and of each word its start and stop there, its text, and two hashes.

    A word is a run of bytes other than space and 0x09 to 0x0D.
    """
    if not _powers:
        _powers[:] = [np.multiply.accumulate(np.r_[np.uint64(1), np.full(_PLACES - 1, b, np.uint64)]) for b in _BASES]
    data = b"\n".join(texts).lower() + b"\n"
    c = np.frombuffer(data, np.uint8)
    space = _SPACE[c]
    change = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        change = np.r_[0, change]
    start, stop = change[::2], change[1::2]
    of = np.searchsorted(np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))), start, "right")
    if not len(start):
        return data, start, stop, of, *(np.zeros(0, np.uint64) for _ in range(2))
    inside = np.flatnonzero(~space)
    length = stop - start
    first = np.cumsum(length) - length  # of each word among the bytes inside words
    place = (np.arange(len(inside)) - np.repeat(first, length)) & (_PLACES - 1)
    value = c[inside].astype(np.uint64) + np.uint64(1)
    hashes = [mixed(np.add.reduceat(value * p[place], first), b) for p, b in zip(_powers, _BASES[::-1], strict=True)]
    return data, start, stop, of, *hashes
