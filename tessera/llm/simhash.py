"""SimHash near-duplicates by anchor-point covering.

A fingerprint has a bit set where over half of a text's shingle hashes have it. Two texts link when their
fingerprints differ in at most three of the 64 bits, so in one of the two 32-bit halves they differ in at
most one. Each half is covered by the code "perfect Hamming code on 31 bits, times one free bit": every
half lies within covering radius 1 of an anchor, and a fingerprint goes to every anchor within radius plus
threshold, 1 + 1 = 2, of each half: 17 anchors at most. Of a linking pair, the one's nearest anchor is
among the other's, so they meet; per anchor the whole 64 bits are compared.

Equal fingerprints are folded into one before anything is replicated, so copies cost nothing. An anchor's
fingerprints arrive sorted and are read as a stream. Small sets are compared by pairs; larger ones by
growing their components, which yields one link per fingerprint, never all pairs of a set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import checkpointed
from tessera.llm.components import components

#: Differing bits at which fingerprints still link.
RADIUS = 3
#: Words in a shingle.
SHINGLE = 3
#: Shingle hashes whose bits are counted at a time.
CHUNK = 1 << 17
#: Sets up to this size are compared by pairs.
PAIRWISE = 6


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes have each bit set."""
    bits = np.unpackbits(np.ascontiguousarray(hashes, "<u8").view(np.uint8), bitorder="little").view(np.uint64).reshape(-1, 8)
    sums = np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0)  # eight counters to a word, none overflows
    return np.ascontiguousarray(sums).view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)


def majority(counts: np.ndarray, n: int) -> int:
    """The fingerprint of bit counts over n hashes."""
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def shingle_hashes(words: list[bytes], k: int) -> list[int]:
    """XXH64 with seed 42 of each shingle, repeats included; of the whole sequence if it is shorter."""
    from xxhash import xxh64_intdigest as h

    if not words:
        return []
    if len(words) <= k:
        return [h(b" ".join(words), 42)]
    return [h(b" ".join(x), 42) for x in zip(*(words[i:] for i in range(k)), strict=False)]


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    """Fingerprint of a text; 0 if it has no words. Long texts are counted in chunks."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    counts, n = np.zeros(64, np.int64), 0
    for at in range(0, max(1, len(words) - k + 1), CHUNK):
        h = np.array(shingle_hashes(words[at : at + CHUNK + k - 1], k), "<u8")
        counts, n = counts + bit_counts(h), n + len(h)
    return majority(counts, n)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, kind: str = "long") -> DataFrame:
    """doc_id (the key as ``kind``) and fp (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), k) for t in b.column(1)), "<u8", len(b))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view("<i8"))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast(kind).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def _code() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low and high 16 bits, and per syndrome the 17 masks that lead to an anchor.

    The last mask repeats the nearest anchor where fewer than 17 lie within 2.
    """
    x = np.arange(1 << 16, dtype=np.uint32)
    low, high = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
    for i in range(16):
        low ^= np.where(x >> i & 1, i + 1, 0).astype(np.uint8)
        high ^= np.where(x >> i & 1, i + 17 if i < 15 else 0, 0).astype(np.uint8)  # bit 31 is free
    masks = np.zeros((32, 17), np.uint32)
    for s in range(32):
        near = 1 << s - 1 if s else 0
        pairs = [1 << a - 1 | 1 << (a ^ s) - 1 for a in range(1, 32) if s and a < a ^ s]
        masks[s] = [near, near ^ 1 << 31, *pairs, *[near] * (15 - len(pairs))]
    return low, high, masks


LOW, HIGH, MASKS = _code()


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each fingerprint (uint64) the ids of its 34 anchors, and which of them are its nearest."""
    out = []
    for half in (0, 1):
        x = (fp >> np.uint64(32 * half)).astype(np.uint32)
        s = LOW[x & np.uint32(0xFFFF)] ^ HIGH[x >> np.uint32(16)]
        out.append((x[:, None] ^ MASKS[s]).astype(np.int64) | half << 32)
    home = np.zeros((len(fp), 34), bool)
    home[:, [0, 17]] = True
    return np.concatenate(out, axis=1), home


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        a, home = anchors(fp.view(np.uint64))
        again = (a == a[:, :1]) & ~home
        again[:, 17:] = (a[:, 17:] == a[:, 17:18]) & ~home[:, 17:]
        keep = ~again
        yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(np.repeat(fp, keep.sum(axis=1))), pa.array(home[keep])], names=["anchor", "fp", "home"])


def links_of_set(fp: np.ndarray, radius: int = RADIUS, chunk: int = 1 << 16) -> list[tuple[int, int]]:
    """Links (root, member) that connect whatever is connected in one anchor's set of distinct uint64."""
    rest, out = np.arange(len(fp)), []
    while len(rest):
        root, front, rest = rest[0], rest[:1], rest[1:]
        while len(front) and len(rest):
            near = np.zeros(len(rest), bool)
            for f in np.array_split(front, -(-len(front) // 64)):
                for at in range(0, len(rest), chunk):
                    part = rest[at : at + chunk]
                    near[at : at + chunk] |= (np.bitwise_count(fp[f][:, None] ^ fp[part][None, :]) <= radius).any(axis=0)
            front, rest = rest[near], rest[~near]
            out += [(root, x) for x in front]
    return out


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each anchor's set; the input is sorted by anchor."""

    def work(a: np.ndarray, fp: np.ndarray, home: np.ndarray):
        first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
        size = np.diff(np.r_[first, len(a)])
        small = np.repeat(size <= PAIRWISE, size)
        left, right = [], []
        u = fp.view(np.uint64)
        for k in range(1, PAIRWISE):
            if k >= len(a):
                break
            i = np.flatnonzero((a[k:] == a[:-k]) & small[k:] & (home[k:] | home[:-k]))
            i = i[np.bitwise_count(u[i] ^ u[i + k]) <= RADIUS]
            left.append(fp[i])
            right.append(fp[i + k])
        for at, n in zip(first[size > PAIRWISE], size[size > PAIRWISE], strict=True):
            if pairs := links_of_set(u[at : at + n]):
                p = np.array(pairs) + at
                left.append(fp[p[:, 0]])
                right.append(fp[p[:, 1]])
        x, y = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (left, right))
        x, y = np.minimum(x, y), np.maximum(x, y)
        pairs = np.unique(np.stack([x, y], axis=1)[x != y], axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)]
    for b in batches:
        now = [np.concatenate([h, c.to_numpy(zero_copy_only=False)]) for h, c in zip(held, b.columns, strict=True)]
        cut = np.searchsorted(now[0], now[0][-1]) if len(now[0]) else 0  # the last set may go on
        if cut:
            yield work(*(x[:cut] for x in now))
        held = [x[cut:] for x in now]
    if len(held[0]):
        yield work(*held)


def links(fps: DataFrame) -> DataFrame:
    """Links a < b between distinct fingerprints (column fp), enough to connect all that is connected."""
    placed = fps.select("fp").mapInArrow(_replicate, "anchor long, fp long, home boolean")
    by_anchor = placed.repartition("anchor").sortWithinPartitions("anchor", "fp")
    return by_anchor.mapInArrow(_compare, "a long, b long").distinct()


def group(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE) -> DataFrame:
    """Each document's doc_id, fp and component_id, the smallest doc_id that it reaches by links.

    Null text counts as empty; texts without words have fingerprint 0 and link like any other; repeated
    rows are rows of their own; null keys never name a component unless it has no other; an empty table
    gives no rows; further columns are ignored.
    """
    d = checkpointed(fingerprints(docs, id_col, text_col, k))
    own = _roots(d)
    least = own.groupBy("root").agg(F.min("least").alias("component_id"))
    return d.join(own.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def _roots(d: DataFrame) -> DataFrame:
    """Each distinct fingerprint fp of ``d`` with the least doc_id that has it and the root that names its group."""
    distinct = d.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(distinct))
    return distinct.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE) -> DataFrame:
    """``docs`` with one row of each group: the one of smallest key, null last, and of equal keys the one whose text hashes lowest.

    Rows are decided on by key and text, so rows with different texts that share a key are different
    documents, and rows without a key are deduplicated like any other. Of rows with equal key and text
    one stays, whatever their further columns hold. Null text counts as empty, texts without words
    are one group, texts are hashed whole, an empty table gives no rows; columns stay as they are.
    """
    key, name = docs[id_col].cast("long"), F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    named = docs.select(F.struct(key.isNull().alias("lost"), key.alias("id"), name.alias("name")).alias("doc_id"), docs[text_col].alias("text"))
    d = checkpointed(fingerprints(named, "doc_id", "text", k, "struct<lost: boolean, id: bigint, name: bigint>"))
    own = _roots(d)
    kept = own.groupBy("root").agg(F.min("least").alias("kept"))
    rows = d.groupBy("doc_id", "fp").agg(F.count("*").alias("n")).join(own.join(kept, "root").select("fp", "kept"), "fp")
    # few rows are not to be judged by their key and text alone: those that go, and those kept that occur again
    odd = checkpointed(rows.select("doc_id.id", "doc_id.name", (F.col("doc_id") == F.col("kept")).alias("stays"), "n").filter("NOT stays OR n > 1"))
    gone = odd.select(F.col("id").alias("__gone_id"), F.col("name").alias("__gone_name"))
    out = docs.join(gone, key.eqNullSafe(F.col("__gone_id")) & (name == F.col("__gone_name")), "left_anti")
    twice = odd.filter("stays").select(F.col("id").alias("__twice_id"), F.col("name").alias("__twice_name"))
    if twice.isEmpty():  # the usual case, where texts need not be joined once more
        return out
    again = docs.join(twice, key.eqNullSafe(F.col("__twice_id")) & (name == F.col("__twice_name"))).dropDuplicates(["__twice_id", "__twice_name"])
    return out.unionByName(again.select(*[docs[c] for c in docs.columns]))


def hex_of(fp):
    """A fingerprint column as 16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
