"""Benchmark decontamination.

A document is contaminated by an item if some window of as many words as the item has (the whole document
if it is shorter) has a weighted Jaccard similarity of at least 0.8 with it over five-word shingles,
repeats counted. Words are lower-cased and lose punctuation at their ends.

1. Every window of every item's size gets a SimHash of its shingles, by running counts of all 64 bits: the
   counts lie in bit planes, one 64-bit word a place, so one more shingle is a few vector operations.
2. Four blocks of sixteen bits index the items' fingerprints of a size. Within ``RADIUS`` = 15 bits some
   block differs in at most 3, and the table of that block names every item within 3 of each value; so all
   fingerprints within the radius are found, and 4.2 % of unrelated pairs are looked at.
3. The exact weighted similarity decides. At 0.8 fingerprints differ in some 10 bits with a deviation of 3;
   tests measure how many similar windows lie within the radius.

Documents are only mapped over: nothing is shuffled, and no group can grow hot. The items go to the
executors in blocks of at most ``BLOCK_WORDS`` words (one item at least); each block is one pass.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import n_words

#: Words in a shingle.
SHINGLE = 5
#: Least similarity.
SIMILARITY = 0.8
#: Fingerprint bits that may differ, and blocks of the index.
RADIUS, BLOCKS = 15, 4
#: Words of items sent to the executors at a time.
BLOCK_WORDS = 200_000
#: Characters of documents handled together, and windows whose counts are kept at a time.
TOGETHER, CHUNK = 1 << 20, 1 << 15
#: Fingerprints of a size up to which marked windows are compared with all of them.
FEW = 24

_BASE = 0x9E3779B97F4A7C15
_MULTIPLIERS = np.random.default_rng(12).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def normal(word: str) -> str:
    """Lower case, without what isn't a letter or digit at its ends."""
    w = word.lower()
    if w.isalnum():
        return w
    a, b = 0, len(w)
    while a < b and not w[a].isalnum():
        a += 1
    while b > a and not w[b - 1].isalnum():
        b -= 1
    return w[a:b]


def normal_words(text: str | None) -> list[str]:
    """The words of a text; those of punctuation alone are left out."""
    return [w for w in map(normal, (text or "").split()) if w]


class _Letters:
    """Of every character of the basic plane: its lower case, whether that is a letter or digit, and whether it is white space.

    Characters whose lower case is not one character by itself are ``odd``.
    """

    def __init__(self) -> None:
        every = [chr(c) for c in range(1 << 16)]
        low = [c.lower() for c in every]
        odd = [len(x) != 1 or c in "\u03a3" for c, x in zip(every, low, strict=True)]
        self.low = np.array([ord(c) if o else ord(x) for c, x, o in zip(every, low, odd, strict=True)], np.uint32)
        self.kind = np.array([1 if c.isspace() else 2 if x[0].isalnum() else 0 for c, x in zip(every, low, strict=True)], np.uint8)
        self.odd = re.compile("[" + "".join(map(re.escape, (c for c, o in zip(every, odd, strict=True) if o))) + "\U00010000-\U0010ffff]")


_letters: list[_Letters] = []
_powers: list[np.ndarray] = []


def _tables(n: int) -> tuple[_Letters, np.ndarray, np.ndarray]:
    """The characters' table, made once in a worker, and n powers of the base and of its inverse modulo 2**64."""
    if not _letters:
        _letters.append(_Letters())
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        _powers[:] = [np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)]) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _letters[0], _powers[0], _powers[1]


def hashed_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word's normal form in all texts one after another, and how many words each text has.

    A word's hash is a polynomial of its characters, mixed. All steps are over the characters at once; a text
    with odd characters is put into normal form first.
    """
    letters, power, inverse = _tables(sum(map(len, texts)) + len(texts))
    texts = [" ".join(normal_words(t)) if not t.isascii() and letters.odd.search(t) else t for t in texts]
    c = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
    if len(c) > len(power):
        letters, power, inverse = _tables(len(c))
    known = c if not len(c) or c.max() < 1 << 16 else np.where(c < 1 << 16, c, 0)
    kind, low = letters.kind[known], letters.low[known]
    if known is not c:  # beyond the basic plane: in normal form already, so no matter but at the ends of a word, which are letters
        kind, low = np.where(c < 1 << 16, kind, 2), np.where(c < 1 << 16, low, c)
    sums = np.empty(len(c) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((low + np.uint32(1)) * power[: len(c)], out=sums[1:])
    gaps = np.cumsum(kind == 1, dtype=np.int32)
    at = np.flatnonzero(kind == 2)
    word = gaps[at]
    change = np.flatnonzero(word[1:] != word[:-1]) if len(at) else np.zeros(0, np.int64)
    first, last = at[np.r_[0, change + 1]] if len(at) else at, at[np.r_[change, len(at) - 1]] if len(at) else at
    h = (sums[last + 1] - sums[first]) * inverse[first]
    ends = np.cumsum([len(t) + 1 for t in texts])
    return mixed(h), np.diff(np.searchsorted(first, np.r_[0, ends]))


def mixed(h: np.ndarray) -> np.ndarray:
    """Hashes whose bits depend on all bits of ``h``, which is changed."""
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (29, 0xC4CEB9FE1A85EC53)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    h ^= h >> np.uint64(32)
    return h


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of n words, given the words' hashes."""
    m = max(0, len(words) - n + 1)
    h = np.zeros(m, np.uint64)
    for j in range(n):
        h += words[j : m + j] * _MULTIPLIERS[j % len(_MULTIPLIERS)]
    return mixed(h)


class RunningCounts:
    """How many of the shingles from each place on have each bit set, for windows that grow by one.

    Plane k holds, for all 64 bits of a place at once, bit k of the counts.
    """

    def __init__(self, hashes: np.ndarray, places: int):
        self.hashes, self.places, self.size, self.planes = hashes, places, 0, []
        self.carry, self.spare = np.empty(places, np.uint64), np.empty(places, np.uint64)

    def grow(self) -> None:
        """Windows of one shingle more; those that run over the end count no more."""
        n = max(0, min(self.places, len(self.hashes) - self.size))
        carry, spare = self.carry[:n], self.spare[:n]
        carry[:] = self.hashes[self.size : self.size + n]
        self.size += 1
        if self.size.bit_length() > len(self.planes):
            self.planes.append(np.zeros(self.places, np.uint64))
        for p in self.planes:
            q = p[:n]
            np.bitwise_and(q, carry, out=spare)
            np.bitwise_xor(q, carry, out=q)
            carry, spare = spare, carry

    def majority(self, at: np.ndarray | None = None) -> np.ndarray:
        """Fingerprints of the windows (at some places): the bits set in over half of the shingles."""
        half, planes = self.size // 2, self.planes if at is None else [p[at] for p in self.planes]
        above, equal = np.zeros_like(planes[0]), np.full_like(planes[0], ~np.uint64(0))
        for k in range(len(planes) - 1, -1, -1):
            if half >> k & 1:
                equal &= planes[k]
            else:
                above |= equal & planes[k]
                equal &= ~planes[k]
        return above


def fingerprint(hashes: np.ndarray) -> int:
    """The fingerprint of all the shingles together."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<u8")[0])


class BlockIndex:
    """Fingerprints by blocks of sixteen bits; finds all within a Hamming radius, exactly.

    The table of a block lists, sorted by value, every fingerprint under each value that differs from its
    own in at most ``radius // BLOCKS`` bits; a bit map tells which values have an entry.
    """

    def __init__(self, fps: np.ndarray, radius: int = RADIUS):
        self.fps, self.radius = np.ascontiguousarray(fps, np.uint64), radius
        values = np.arange(1 << 16, dtype=np.uint16)
        masks = values[np.bitwise_count(values) <= radius // BLOCKS]
        self.tables = []
        for block in np.ascontiguousarray(self.fps, "<u8").view("<u2").reshape(-1, BLOCKS).T:
            keys = (block[:, None] ^ masks).ravel()
            order = np.argsort(keys, kind="stable")
            there = np.zeros(1 << 16, bool)
            there[keys] = True
            self.tables.append((np.packbits(there, bitorder="little"), keys[order], np.repeat(np.arange(len(self.fps)), len(masks))[order]))

    def marked(self, queries: np.ndarray) -> np.ndarray:
        """The queries for which some block's table has an entry."""
        n, width = len(queries), 64 // BLOCKS
        byte, some, low = np.empty(n, np.int64), np.zeros(n, np.uint8), queries.view(np.uint8).reshape(-1, 8)
        for b, (marks, *_) in enumerate(self.tables):
            np.right_shift(queries.view(np.int64), width * b + 3, out=byte)
            np.bitwise_and(byte, (1 << width - 3) - 1, out=byte)
            some |= marks.take(byte, mode="wrap") >> (low[:, b * width // 8] & np.uint8(7))
        some &= 1
        return some.view(bool).nonzero()[0]

    def listed(self, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each block, the pairs (query, fingerprint) that its table names."""
        at = self.marked(queries)
        near, width = queries[at], 64 // BLOCKS
        for b, (_, keys, members) in enumerate(self.tables):
            value = (near >> np.uint64(width * b)).astype(np.uint16)
            first = np.searchsorted(keys, value, "left")
            n = np.searchsorted(keys, value, "right") - first
            yield np.repeat(at, n), members[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]

    def within(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs (query, fingerprint) at a distance of at most the radius.

        Where there are but ``FEW`` fingerprints, a marked query is compared with each of them, which costs less
        than to look up which ones the tables name; the pairs are the same.
        """
        found, k = [], max(1, len(self.fps))
        near = lambda x, y: (np.bitwise_count(x ^ y) <= self.radius).nonzero()[0]
        if len(self.fps) <= FEW:
            at = self.marked(queries)
            some = queries[at]
            found = [at[near(some, fp)] * k + f for f, fp in enumerate(self.fps)]
        else:
            for q, f in self.listed(queries):
                ok = near(queries[q], self.fps[f])
                found.append(q[ok] * k + f[ok])
        return tuple(np.divmod(np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64), k))


class Matcher:
    """The items of one block, ready to be looked for in texts."""

    def __init__(self, items: list[tuple[int, str | None]], k: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS):
        self.k, self.similarity = k, similarity
        self.items = [(i, w) for i, t in items if (w := normal_words(t))]
        members: dict[tuple[int, int], list] = defaultdict(list)  # by words of a shingle and shingles of the item
        self.counts, self.own = [], []
        for at, (_, words) in enumerate(self.items):
            n = min(k, len(words))
            self.counts.append(Counter(zip(*(words[i : len(words) - n + 1 + i] for i in range(n)), strict=True)))
            self.own.append(shingles(hashed_words([" ".join(words)])[0], n))
            members[n, len(words) - n + 1].append(at)
        self.index = {key: (m, BlockIndex(np.array([fingerprint(self.own[x]) for x in m], np.uint64), radius)) for key, m in sorted(members.items())}
        self.own = [frozenset(x.tolist()) for x in self.own]

    def matches(self, text: str | None) -> list[tuple[int, float, int]]:
        """For each matched item: its id, the best similarity and the first window (in words) that has it."""
        return self.matches_of([text])[0]

    def matches_of(self, texts: list[str | None]) -> list[list[tuple[int, float, int]]]:
        """``matches`` of each text."""
        out, held, total = [], [], 0
        for t in texts:
            held.append(t or "")
            total += len(held[-1])
            if total >= TOGETHER:
                out += self._search(held)
                held, total = [], 0
        return out + self._search(held) if held else out

    def _search(self, raw: list[str]) -> list[list[tuple[int, float, int]]]:
        best: list[dict] = [{} for _ in raw]
        stream, size = hashed_words(raw)
        for n in sorted({n for n, _ in self.index}):
            at_all = shingles(stream, n)
            count = np.maximum(size - n + 1, 0)  # of shingles in each text
            first, left = np.cumsum(count) - count, np.repeat(np.cumsum(count), count) - np.arange(int(count.sum()))
            doc = np.repeat(np.arange(len(raw)), count)
            h = at_all[np.repeat((np.cumsum(size) - size) - first, count) + np.arange(len(left))] if len(left) else at_all[:0]
            self._windows(n, h, left, first, doc, raw, best)
        return [[(self.items[m][0], s, p) for m, (s, p) in sorted(b.items())] for b in best]

    def _windows(self, n: int, h: np.ndarray, left: np.ndarray, first: np.ndarray, doc: np.ndarray, raw: list, best: list) -> None:
        """All windows over the stream ``h`` of shingles; ``left`` is how many remain in the text from a place on."""
        sizes = sorted(m for k, m in self.index if k == n)
        for a in range(0, len(h), CHUNK):
            here = left[a : a + CHUNK]
            counts = RunningCounts(h[a : a + CHUNK + sizes[-1] - 1], len(here))
            begins = np.flatnonzero(first[doc[a : a + CHUNK]] == np.arange(a, a + len(here)))
            short = {}  # texts shorter than an item are one window
            if n == self.k:
                for p, m in zip(begins.tolist(), here[begins].tolist(), strict=True):
                    if m < sizes[-1]:
                        short.setdefault(m, []).append(p)
            for m in range(1, sizes[-1] + 1):
                counts.grow()
                if (n, m) in self.index:
                    self._verify(n, m, m, h, a, None, counts.majority(), here, first, doc, raw, best)
                if m in short:
                    at = np.array(short[m])
                    fps = counts.majority(at)
                    for longer in sizes:
                        if m < longer and m >= self.similarity * longer:
                            self._verify(n, longer, m, h, a, at, fps, here, first, doc, raw, best)

    def _verify(self, n: int, m: int, width: int, h: np.ndarray, a: int, at: np.ndarray | None, fps: np.ndarray, here: np.ndarray, first: np.ndarray, doc: np.ndarray, raw: list, best: list) -> None:
        """Compare the windows of ``width`` shingles at some places (all) exactly where fingerprints are near."""
        members, index = self.index[n, m]
        q, f = index.within(fps)
        q = q if at is None else at[q]
        inside = here[q] >= width  # others run into the next text
        for q, f in zip(q[inside].tolist(), f[inside].tolist(), strict=True):
            place, item = a + q, members[f]
            if self.own[item].isdisjoint(h[place : place + width].tolist()):
                continue
            d = int(doc[place])
            start = place - int(first[d])
            w = self._normal(raw, d)[start : start + width + n - 1]
            window = Counter(zip(*(w[i : width + i] for i in range(n)), strict=True))
            both = sum(min(x, window[s]) for s, x in self.counts[item].items() if s in window)
            s = both / (m + width - both)
            if s >= self.similarity and (item not in best[d] or (s, -start) > (best[d][item][0], -best[d][item][1])):
                best[d][item] = (s, start)

    def _normal(self, raw: list, d: int) -> list[str]:
        """The normal words of one of the texts at hand; the latest are kept."""
        if getattr(self, "_last", (None, None))[0] is not raw or self._last[1] != d:
            self._last = (raw, d, normal_words(raw[d]))
        return self._last[2]


def matchers(items: DataFrame, *, id_col: str = "item_id", text_col: str = "text", k: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS) -> list:
    """The distinct items in blocks of bounded size, each broadcast with how often every item occurs."""
    rows = items.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).groupBy("i", "t").agg(F.count("*").alias("times"))
    total = rows.agg(F.sum(n_words(F.col("t")))).first()[0] or 0
    n, sc = -(-total // BLOCK_WORDS), items.sparkSession.sparkContext
    out = []
    for b in range(n):
        block = sorted((rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b) if n > 1 else rows).collect(), key=str)
        out.append(sc.broadcast((uuid.uuid4().hex, [tuple(r) for r in block], k, similarity, radius)))
    return out


_built: dict = {}


def _matcher(shared) -> Matcher:
    """This worker's matcher of a broadcast block, whose items are its rows; only the latest is kept."""
    name, rows, *rest = shared.value
    if name not in _built:
        _built.clear()
        _built[name] = Matcher([(r, t) for r, (_, t, _) in enumerate(rows)], *rest)
    return _built[name]


def matches(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, item_id, similarity and window for each document and item that it holds.

    Clean documents give no row, nor do null or empty texts or items; repeated documents or items match
    each; null keys are kept; texts are searched whole, however long; ties in similarity go to the first
    window found; empty tables give no rows; further columns are ignored.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def search(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m, ids = _matcher(shared), [(i, times) for i, _, times in shared.value[1]]
            for b in batches:
                found = zip(b.column(0).to_pylist(), m.matches_of(b.column(1).to_pylist()), strict=True)
                rows = [(doc, ids[r][0], s, p) for doc, own in found for r, s, p in own for _ in range(ids[r][1])]
                cols = list(zip(*rows, strict=True)) or [[]] * 4
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "similarity", "window"])

        return run

    out = None
    for shared in matchers(items, **options):
        one = d.mapInArrow(search(shared), "doc_id long, item_id long, similarity double, window long")
        out = one if out is None else out.unionByName(one)
    if out is None:
        out = d.limit(0).selectExpr("doc_id", "doc_id AS item_id", "CAST(0 AS DOUBLE) AS similarity", "doc_id AS window")
    return out


def clean(docs: DataFrame, items: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the contaminated ones; columns and all other rows stay as they are.

    Null and empty texts stay, as do rows with null keys; repeated rows stay or go alike; texts are searched
    whole; without items all rows stay; an empty table gives no rows.
    """

    def found(shared):
        @F.pandas_udf("boolean")
        def contaminated(texts: pd.Series) -> pd.Series:
            return pd.Series([bool(x) for x in _matcher(shared).matches_of(texts.tolist())], dtype=bool)

        return contaminated

    for shared in matchers(items, **options):
        docs = docs.filter(~found(shared)(F.coalesce(F.col(text_col), F.lit(""))))
    return docs
