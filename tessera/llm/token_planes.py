"""Token-id output as shuffled byte planes.

Documents are dealt by range of (doc_id, hash of text) and sorted, so that shard k holds the k-th range.
Each shard is one stream of little-endian unsigned 32-bit ids, cut into blocks of a fixed number of ids;
a block is transposed into its four byte planes and each plane is compressed with zstandard. The planes
of similar bytes compress far better than the ids as they lie, and the two high planes all but vanish.

Layout below ``path``:

* ``chunks``: one row per block: shard, chunk, its position in the shard, its planes, and the documents'
  parts that lie in it. The container is Parquet without further compression, so Spark's committer,
  listing and any Hadoop file system work, and a lost executor's block is simply written again.
* ``index``: the chunk index: shard, chunk, start (ids of all blocks before), number of ids, plane sizes.

No task holds more than one batch of texts and one block, however long a document is.
"""

from __future__ import annotations

import gc
import json
import os
import re
import string
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.units import Table, mixed

#: Ids in a block.
BLOCK = 1 << 16
#: Units whose ids a Python worker remembers, and characters of a unit that is remembered.
CACHE, LONGEST = 800_000, 64
#: Texts encoded together, and characters handled together.
TEXTS, GROUP = 1_536, 1 << 18
#: Shard tables up to this many rows are broadcast.
BROADCAST_SHARDS = 100_000
#: Level of zstandard.
LEVEL = 1

CHUNKS = "shard int, chunk int, first long, n_ids int, ordinals array<long>, doc_ids array<long>, lengths array<int>, parts array<int>, planes array<binary>, plane_bytes array<int>"
_ARROW = pa.schema(
    [
        ("shard", pa.int32()), ("chunk", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int32()), ("ordinals", pa.list_(pa.int64())), ("doc_ids", pa.list_(pa.int64())),
        ("lengths", pa.list_(pa.int32())), ("parts", pa.list_(pa.int32())), ("planes", pa.list_(pa.binary())), ("plane_bytes", pa.list_(pa.int32())),
    ]
)


_MARKS = string.punctuation


def _byte_letters() -> dict[int, str]:
    """The letter of each byte in byte-level vocabularies: its own where that prints, else the next from 256."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + k) for k, b in enumerate(others)}


_BYTES = _byte_letters()


class _Known(Table):
    """Units met before with their ids, one after another; emptied when it is full."""

    def __init__(self, limit: int):
        self.limit = limit
        super().__init__(limit + GROUP)  # a group has fewer units than characters

    def clear(self) -> None:
        super().clear()
        self.begin, self.ids = array("q", [0]), array("I")

    def __len__(self) -> int:
        return len(self.begin) - 1

    def keep(self, coded: list[bytes]) -> np.ndarray:
        """Slots for the ids of new units."""
        at = len(self)
        for x in coded:
            self.ids.frombytes(x)
            self.begin.append(len(self.ids))
        return np.arange(at, at + len(coded), dtype=np.int32)


def _powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, base, np.uint64)])


class Encoder:
    """Whole texts to little-endian 32-bit ids with the tokenizers library.

    A byte-level tokenizer with its usual pattern and no normaliser always starts a new piece at a space
    before a character that is not white space, and at punctuation after a letter. Texts are cut at such
    places into units, all characters of many texts at once; the ids of units met before are looked up by
    two polynomial hashes of their characters, and the library is asked once for each that is new. Units of
    over ``LONGEST`` characters, texts with special tokens, and any other tokenizer go to the library whole.
    """

    _gap = re.compile(r" (?=\S)")
    _bases = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)

    def __init__(self, definition: str, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.table = Tokenizer.from_str(definition), _Known(cache)
        j = json.loads(definition)
        pre, added = j.get("pre_tokenizer") or {}, j.get("added_tokens", [])
        self.special = re.compile("|".join(re.escape(t["content"]) for t in added)) if added else None
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not j.get("normalizer")
        plain = plain and not j.get("truncation") and not j.get("padding") and not j["model"].get("dropout") and j["model"].get("type") == "BPE"
        # a space and letters are one piece, so the model can take them without the pattern
        j |= {"pre_tokenizer": None, "post_processor": None, "decoder": None, "added_tokens": []}
        self.model = Tokenizer.from_str(json.dumps(j)) if plain and not any(t["content"].isalpha() for t in added) else None
        self.cut = plain and not any(" " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
        if self.cut:
            every = [chr(c) for c in range(1 << 16)]
            # 1: white space, 2: punctuation of ASCII, 4: a letter
            self.kind = np.array([c.isspace() + 2 * (c in _MARKS) + 4 * c.isalpha() for c in every], np.uint8)
            self.power, self.inverse = ([_powers(x, GROUP + 2) for x in xs] for xs in (self._bases, [pow(x, -1, 1 << 64) for x in self._bases]))

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _ids_of_pieces(self, pieces: list[str], tokenizer=None) -> list[bytes]:
        """As _ids, by one call of the library for all the pieces."""
        if not pieces:
            return []
        e = (tokenizer or self.tokenizer).encode(pieces, is_pretokenized=True, add_special_tokens=False)
        ids, ends = array("I", e.ids).tobytes(), np.searchsorted(np.array(e.word_ids, np.int64), np.arange(len(pieces)), "right").tolist()
        return [ids[4 * a : 4 * b] for a, b in zip([0, *ends], ends, strict=False)]

    def _ask(self, units: list[str], kinds: list[int]) -> list[bytes]:
        """Ids of units of the kinds 0 (a space comes before it), 1 (punctuation after a letter) and 2 (a text's beginning)."""
        out: list = [None] * len(units)
        letters = [i for i, k in enumerate(kinds) if k == 0 and self.model and units[i].isalpha()]
        chosen = set(letters)
        words, marks, heads = [i for i, k in enumerate(kinds) if k == 0 and i not in chosen], *([i for i, k in enumerate(kinds) if k == n] for n in (1, 2))
        for places, coded in (
            (letters, self._ids_of_pieces([f" {units[i]}".encode().decode("latin-1").translate(_BYTES) for i in letters], self.model)),
            (words, self._ids_of_pieces([f" {units[i]}" for i in words])), (marks, self._ids_of_pieces([units[i] for i in marks])), (heads, self._ids([units[i] for i in heads])),
        ):
            for i, x in zip(places, coded, strict=True):
                out[i] = x
        return out

    def _parts(self, text: str) -> Iterator[str]:
        """A text in parts of ``GROUP`` characters or little more, cut at gaps; texts without a gap stay whole."""
        at = 0
        while len(text) - at > GROUP:
            gap = self._gap.search(text, at + GROUP // 2, at + GROUP)
            if not gap:
                break
            yield text[at : gap.start()]
            at = gap.start()
        yield text[at:]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.cut:
            return self._ids(texts)
        out: list[list[bytes]] = [[] for _ in texts]
        group, of, size = [], [], 0

        def done() -> None:
            nonlocal group, of, size
            for i, x in zip(of, self._group(group), strict=True):
                out[i].append(x)
            group, of, size = [], [], 0

        for i, t in enumerate(texts):
            if self.special and self.special.search(t):
                out[i] = self._ids([t])
                continue
            for p in self._parts(t):
                if len(p) >= GROUP:  # one unit without a gap
                    if i in of:
                        done()
                    out[i].append(self._ids([p])[0])
                    continue
                if size + len(p) + 1 > GROUP:
                    done()
                group.append(p)
                of.append(i)
                size += len(p) + 1
        if group:
            done()
        return [x[0] if len(x) == 1 else b"".join(x) for x in out]

    def _group(self, parts: list[str]) -> list[bytes]:
        """Ids of parts of texts, ``GROUP`` characters in all; a part that begins with a gap goes on with a text."""
        if not parts:
            return []
        text = "\n".join(parts) + "\n"
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        kind = self.kind[c if c.max() < 1 << 16 else np.where(c < 1 << 16, c, 0xFFFF)]
        ends = np.cumsum(np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))) - 1  # where each part's line end is
        begins = np.r_[0, ends[:-1] + 1]
        gap = np.flatnonzero((c[:-1] == 32) & (kind[1:] & 1 == 0))
        owner = np.searchsorted(ends, gap)
        # units: the beginning of each part, and what comes after each gap up to the next or the part's end
        start = np.concatenate([begins, gap + 1])
        order = np.argsort(np.concatenate([begins * 2, gap * 2 + 1]), kind="stable")
        start, part = start[order], np.concatenate([np.arange(len(parts)), owner])[order]
        head = order < len(parts)
        stop = np.r_[start[1:] - 1, ends[-1]]
        last = np.flatnonzero(np.r_[part[1:] != part[:-1], True])
        stop[last] = ends[part[last]]
        some = stop > start  # a part may begin with a gap
        start, stop, part, what = start[some], stop[some], part[some], np.where(head[some], 2, 0).astype(np.int8)
        # punctuation at the end of a unit is one of its own after a letter
        inner = np.maximum.accumulate(np.where(kind & 2, -1, np.arange(len(c))))[stop - 1] + 1
        cut = np.flatnonzero((what == 0) & (inner > start) & (inner < stop))
        cut = cut[kind[inner[cut] - 1] & 4 > 0]
        if len(cut):
            tail_start, tail_stop = inner[cut], stop[cut].copy()
            stop[cut] = inner[cut]
            order = np.argsort(np.concatenate([start, tail_start]), kind="stable")
            start, stop, part, what = (np.concatenate(x)[order] for x in ((start, tail_start), (stop, tail_stop), (part, part[cut]), (what, np.ones(len(cut), np.int8))))
        hashes = []
        for k in range(2):
            sums = np.empty(len(c) + 1, np.uint64)
            sums[0] = 0
            np.cumsum((c + np.uint32(1)) * self.power[k][: len(c)], out=sums[1:])
            h = (sums[stop] - sums[start]) * self.inverse[k][start] + what.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019)
            hashes.append(mixed(h, self._bases[1 - k]))
        a, b = hashes
        if len(self.table) > self.table.limit:
            self.table.clear()
        slots = self.table.find(a, b)
        new = np.flatnonzero(slots < 0)
        if len(new):
            _, first, same = np.unique(a[new], return_index=True, return_inverse=True)
            ask = new[first]
            coded = self._ask([text[u:v] for u, v in zip(start[ask].tolist(), stop[ask].tolist(), strict=True)], what[ask].tolist())
            got = self.table.keep(coded)
            short = stop[ask] - start[ask] <= LONGEST
            self.table.add(a[ask[short]], b[ask[short]], got[short])
            slots[new] = got[same]
        begin, ids = np.frombuffer(self.table.begin, np.int64), np.frombuffer(self.table.ids, np.uint32) if len(self.table.ids) else np.zeros(0, np.uint32)
        at, n = begin[slots], begin[slots + 1] - begin[slots]
        total = np.cumsum(n)
        stream = ids[np.repeat(at - (total - n), n) + np.arange(int(total[-1]) if len(total) else 0)]
        per = np.cumsum(np.bincount(part, n, len(parts)).astype(np.int64)).tolist()
        data = memoryview(stream.astype("<u4", copy=False).tobytes())
        return [bytes(data[4 * u : 4 * v]) for u, v in zip([0, *per], per, strict=False)]


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder_of(definition: str, cache: int) -> Encoder:
    """This worker's encoder; its tables outlive a task."""
    if (definition, cache) not in _encoders:
        _encoders.clear()
        _encoders[definition, cache] = Encoder(definition, cache)
    return _encoders[definition, cache]


def to_planes(block: bytes, level: int = LEVEL) -> list[bytes]:
    """The compressed byte planes of a block of 32-bit ids."""
    flat = np.frombuffer(block, np.uint8).reshape(-1, 4)
    z = zstandard.ZstdCompressor(level=level)
    return [z.compress(np.ascontiguousarray(flat[:, k]).tobytes()) for k in range(4)]


def from_planes(planes: list[bytes], n: int) -> bytes:
    """The block again."""
    flat, z = np.empty((n, 4), np.uint8), zstandard.ZstdDecompressor()
    for k, p in enumerate(planes):
        flat[:, k] = np.frombuffer(z.decompress(p, max_output_size=n), np.uint8)
    return flat.tobytes()


def _writer(definition: str, end_id: int, block: int, level: int, cache: int, together: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, encoder = TaskContext.get().partitionId(), encoder_of(definition, cache)
        buf, parts, first, chunk, ordinal = bytearray(), [], 0, 0, 0

        def flush(data: bytes, own: list) -> pa.RecordBatch:
            planes = to_planes(data, level)
            o, d, n, p = (list(x) for x in zip(*own, strict=True))
            row = [[shard], [chunk], [first], [len(data) // 4], [o], [d], [n], [p], [planes], [[len(x) for x in planes]]]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, _ARROW, strict=True)], schema=_ARROW)

        gc.disable()  # no cycles arise, and the tables of pieces are slow to walk
        try:
            for b in batches:
                ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
                for at in range(0, len(ids), together):
                    for doc, coded in zip(ids[at : at + together], encoder.encode(texts[at : at + together]), strict=True):
                        data, part = memoryview(coded + end), 0
                        while len(data):
                            take = data[: 4 * block - len(buf)]
                            buf += take
                            parts.append((ordinal, doc, len(take) // 4, part))
                            data, part = data[len(take) :], part + 1
                            if len(buf) == 4 * block:
                                yield flush(bytes(buf), parts)
                                buf, parts, first, chunk = bytearray(), [], first + block, chunk + 1
                        ordinal += 1
            if buf:
                yield flush(bytes(buf), parts)
        finally:
            gc.enable()

    return run


def write(docs: DataFrame, path: str, *, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, level: int = LEVEL, cache: int = CACHE, together: int = TEXTS) -> None:
    """Write the ids of ``docs`` in ascending order of key below ``path`` (any Hadoop path).

    ``tokenizer`` is the path of a tokenizers JSON file; its content goes to the executors. Every text,
    null counting as empty, is followed by ``end_id``. Ties in the key are ordered by a hash of the text,
    null keys come first, repeated rows are written each, an empty table gives empty tables. ``cache`` and
    ``together`` trade a worker's memory for time and change no file.
    """
    with open(tokenizer, encoding="utf-8") as f:
        definition = f.read()
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    d = d.repartitionByRange(*order).sortWithinPartitions(*order)
    chunks = d.mapInArrow(_writer(definition, end_id, block, level, cache, together), CHUNKS)
    chunks.write.mode("overwrite").option("compression", "none").parquet(f"{path}/chunks")
    spark = docs.sparkSession
    c = spark.read.parquet(f"{path}/chunks").select("shard", "chunk", "first", "n_ids", "plane_bytes")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # over one row per shard
    shards = c.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    index = c.join(shards, "shard").select("shard", "chunk", (F.col("offset") + F.col("first")).alias("start"), "n_ids", "plane_bytes")
    index.write.mode("overwrite").parquet(f"{path}/index")


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """Every block's ids: ``start`` of the block and ``ids``."""

    def run(batches):
        for b in batches:
            for shard, chunk, n, planes in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                ids = np.frombuffer(from_planes(planes, n), "<u4").astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([chunk], pa.int32()), pa.array([ids], pa.list_(pa.int64()))], names=["shard", "chunk", "ids"])

    c = spark.read.parquet(f"{path}/chunks").select("shard", "chunk", "n_ids", "planes")
    index = spark.read.parquet(f"{path}/index").select("shard", "chunk", "start")
    return c.mapInArrow(run, "shard int, chunk int, ids array<long>").join(index, ["shard", "chunk"]).select("start", "ids")


def _gf2_times(m: list[int], v: int) -> int:
    out, k = 0, 0
    while v:
        if v & 1:
            out ^= m[k]
        v, k = v >> 1, k + 1
    return out


def crc_join(a: int, b: int, n: int) -> int:
    """crc32 of x + y from crc32(x), crc32(y) and the length of y: x's remainder is shifted by n zero bytes."""
    if n <= 0:
        return a
    m = [0xEDB88320] + [1 << k for k in range(31)]  # one zero bit
    for _ in range(3):  # to a byte
        m = [_gf2_times(m, x) for x in m]
    while n:
        if n & 1:
            a = _gf2_times(m, a)
        n >>= 1
        if n:
            m = [_gf2_times(m, x) for x in m]
    return a ^ b


def digest(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32.

    Each block is read by itself; the parts of a document that runs over several blocks are joined by
    their crc32 values, so no document is held whole.
    """

    def run(batches):
        names = ["shard", "ordinal", "doc_id", "part", "at", "n", "crc"]
        for b in batches:
            col = {k: b.column(k).to_pylist() for k in b.schema.names}
            for i, n_ids in enumerate(col["n_ids"]):
                data, at, lengths = memoryview(from_planes(col["planes"][i], n_ids)), 0, col["lengths"][i]
                crcs, ats = [], []
                for n in lengths:
                    crcs.append(zlib.crc32(data[4 * at : 4 * (at + n)]))
                    ats.append(col["first"][i] + at)
                    at += n
                k = len(lengths)
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
                rows = [[col["shard"][i]] * k, col["ordinals"][i], col["doc_ids"][i], col["parts"][i], ats, lengths, crcs]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, kinds, strict=True)], names=names)

    c = spark.read.parquet(f"{path}/chunks").select("shard", "first", "n_ids", "ordinals", "doc_ids", "lengths", "parts", "planes")
    segments = c.mapInArrow(run, "shard int, ordinal long, doc_id long, part int, at long, n int, crc long")
    whole = segments.groupBy("shard", "ordinal").agg(
        F.first("doc_id").alias("doc_id"), F.min("at").alias("at"), F.sum("n").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("part", "n", "crc"))).alias("segments")
    )

    def joined(batches):
        for b in batches:
            parts, sizes = b.column(4), b.column(4).value_lengths().to_numpy(zero_copy_only=False)
            n, crc = (parts.flatten().field(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            first = np.cumsum(sizes) - sizes
            out = crc[first] if len(first) else crc
            for i in np.flatnonzero(sizes > 1).tolist():
                for j in range(first[i] + 1, first[i] + sizes[i]):
                    out[i] = crc_join(int(out[i]), int(crc[j]), 4 * int(n[j]))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(out)], names=["shard", "doc_id", "at", "n_tokens", "ids_crc32"])

    docs = whole.select("shard", "doc_id", "at", "n_tokens", "segments").mapInArrow(joined, "shard int, doc_id long, at long, n_tokens long, ids_crc32 long")
    offsets = spark.read.parquet(f"{path}/index").filter("chunk = 0").select("shard", "start")
    offsets = F.broadcast(offsets) if offsets.count() <= BROADCAST_SHARDS else offsets
    return docs.join(offsets, "shard").select("doc_id", (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
