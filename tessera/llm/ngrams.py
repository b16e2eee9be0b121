"""Presence of hashed byte n-grams in whole texts, vectorised over batches of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text and of flags handled at a time.
TEXT_BYTES, FLAG_BYTES = 1 << 20, 1 << 23

_MIX = np.uint32(0x9E3779B1)


def codes(text: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The hash of each n-gram of a byte array, below 2**bits; orders get codes of their own."""
    h = np.full(max(0, len(text) - n + 1), n * 0x01000193, np.uint32)
    for j in range(n):
        h ^= text[j : len(text) - n + 1 + j]
        h *= _MIX
        h ^= h >> np.uint32(15)
    return h >> np.uint32(32 - bits)


def flags(texts: list[bytes], orders: tuple[int, ...], bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """Blocks (index of the first text, uint8 array of texts x 2**bits) that mark the n-grams of each text.

    N-grams do not cross texts; a long text is marked piece by piece into its row.
    """
    d, at = 1 << bits, 0
    while at < len(texts):
        end, total = at, 0
        while end < len(texts) and end - at < max(1, FLAG_BYTES >> bits) and (end == at or total + len(texts[end]) <= TEXT_BYTES):
            total += len(texts[end])
            end += 1
        out = np.zeros((end - at) * d, np.uint8)
        part = texts[at:end]
        if total > TEXT_BYTES:  # one long text
            t = np.frombuffer(part[0], np.uint8)
            for n in orders:
                for k in range(0, len(t) - n + 1, TEXT_BYTES):
                    out[codes(t[k : k + TEXT_BYTES + n - 1], n, bits)] = 1
        else:
            t = np.frombuffer(b"".join(part), np.uint8)
            size = np.array([len(x) for x in part])
            row = np.repeat(np.arange(len(part), dtype=np.int64) * d, size)
            left = np.repeat(np.cumsum(size), size) - np.arange(len(t))  # bytes to the end of the text
            for n in orders:
                if len(t) >= n:
                    m = len(t) - n + 1
                    place = row[:m] + codes(t, n, bits)
                    out[place[left[:m] >= n] if len(part) > 1 else place] = 1
        yield at, out.reshape(-1, d)
        at = end
