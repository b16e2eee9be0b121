"""Exact top-k search by inner product of integer vectors.

The queries are packed into blocks and all vectors into tiles, dealt to shards; a shuffle brings every block
together with every shard, so nothing goes through the driver. A task multiplies its block with the tiles of
its shard one by one, keeps the best of each tile by partial selection and merges them into one list per
query; the lists of the shards are merged in two levels. A task holds one block and one tile of products,
whatever the number of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries in a block (8 MB at 64 components), vectors and queries in a tile.
BLOCK, TILE, QUERIES = 16_384, 2_048, 1_024
#: Tiles of a shard, about.
TASK_TILES = 64
#: Lists of this many groups of shards meet in the second level.
GROUPS = 64
#: Component x becomes floor(SCALE * x).
SCALE = 256


def matrix(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Scaled components as doubles, shorter vectors padded with zeros, and which rows are whole and finite."""
    ok = vectors.is_valid().to_numpy(zero_copy_only=False)
    sizes = np.where(ok, vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0).astype(np.int64)
    flat = vectors.flatten()
    x = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null becomes NaN
    out = np.zeros((len(vectors), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = x
    ok &= np.isfinite(out).all(axis=1)
    out[~ok] = 0
    with np.errstate(over="ignore"):
        out = np.floor(SCALE * out)
    return out, ok & np.isfinite(out).all(axis=1)


def _padded(a: np.ndarray, d: int) -> np.ndarray:
    return a if a.shape[1] == d else np.pad(a, ((0, 0), (0, d - a.shape[1])))


def best_of_tile(q: np.ndarray, s: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best rows of s (sorted by id) for each row of q, ties to the smaller id."""
    n, d = len(s), max(q.shape[1], s.shape[1])
    q, s, k = _padded(q, d), _padded(s, d), min(k, n)
    bound = np.abs(q).max(initial=0) * np.abs(s).max(initial=0) * max(d, 1)
    if bound * 2 * n < 2**53:  # products, and products with the place in the tile, are exact doubles
        key = (q @ s.T) * n + np.arange(n - 1, -1, -1)
        top = np.argpartition(key, n - k, axis=1)[:, n - k :]
        key = np.take_along_axis(key, top, axis=1).astype(np.int64)
        return ids[top], (key - (n - 1 - top)) // n
    wide = [[int(x) for x in row] for row in s.tolist()]
    found, scores = np.zeros((len(q), k), np.int64), np.zeros((len(q), k), np.int64)
    for i, row in enumerate(q.tolist()):
        own = [int(x) for x in row]
        p = [max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(own, w, strict=True)))) for w in wide]
        top = sorted(range(n), key=lambda j: (-p[j], j))[:k]
        found[i], scores[i] = ids[top], [p[j] for j in top]
    return found, scores


def merge(a: tuple[np.ndarray, np.ndarray] | None, b: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of two lists per query."""
    if a is None:
        return b
    ids, scores = (np.concatenate(x, axis=1) for x in zip(a, b, strict=True))
    order = np.lexsort((ids, -scores))[:, :k]
    return np.take_along_axis(ids, order, axis=1), np.take_along_axis(scores, order, axis=1)


#: Integers in which scaled components are kept, the narrowest that holds them; doubles beyond.
_KINDS = ("<i2", "<i4", "<f8")
PACK = "block int, shard int, tile boolean, first long, ids binary, width int, kind int, vectors binary"


def _packed(x: np.ndarray) -> tuple[int, bytes]:
    most = np.abs(x).max(initial=0)
    kind = next((k for k, t in enumerate(_KINDS[:2]) if most <= np.iinfo(t).max), 2)
    return kind, x.astype(_KINDS[kind]).tobytes()


def _pack(shards: int | None):
    """Rows, sorted by block, to packs of ``TILE`` vectors at most; with ``shards``, each is dealt to one of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, packs, at, seen = TaskContext.get().partitionId(), 0, None, 0
        for b in batches:
            x, ok = matrix(b.column(1))
            ids, blocks = (b.column(c).to_numpy(zero_copy_only=False)[ok] for c in (0, 2))
            order, rows = np.lexsort((ids, blocks)), []
            ids, blocks, x = ids[order].astype(np.int64), blocks[order], x[ok][order]
            cuts = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1]]) if len(blocks) else np.zeros(0, np.int64)
            for begin, end in zip(cuts.tolist(), [*cuts[1:].tolist(), len(blocks)], strict=True):
                if at != blocks[begin]:
                    at, seen = blocks[begin], 0
                for t in range(begin, end, TILE):
                    part = slice(t, min(t + TILE, end))
                    rows.append((int(at), (task * 7919 + packs) % (shards or 1), shards is not None, seen, ids[part].astype("<i8").tobytes(), x.shape[1], *_packed(x[part])))
                    packs, seen = packs + 1, seen + part.stop - t
            kinds = [pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary()]
            cols = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[c.split()[0] for c in PACK.split(", ")])

    return run


def _products(k: int):
    """The best of every shard for every query of a block; the input is sorted by block and shard, queries before tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, queries, lists = None, [], []

        def done() -> Iterator[pa.RecordBatch]:
            for (q, ids, x), found in zip(queries, lists, strict=True):
                if found:
                    n = found[0].shape[1]
                    own = np.array([max(-(2**63), min(2**63 - 1, sum(int(c) ** 2 for c in row))) for row in x.tolist()], np.int64)
                    cols = [np.repeat(v, n) for v in (q, ids, own)] + [found[0].ravel(), found[1].ravel(), np.full(found[0].size, at[1], np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["q", "query_id", "own", "vec_id", "score", "shard"])

        for b in batches:
            for block, shard, tile, first, ids, width, kind, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if at != (block, shard):
                    if at:
                        yield from done()
                    at, queries, lists = (block, shard), [], []
                ids = np.frombuffer(ids, "<i8")
                x = np.frombuffer(data, _KINDS[kind]).reshape(len(ids), width).astype(np.float64)
                if not tile:
                    for j in range(0, len(ids), QUERIES):
                        part = slice(j, j + QUERIES)
                        queries.append((np.arange(len(ids))[part] + first + (block << 40), ids[part], x[part]))
                        lists.append(None)
                else:
                    for j, (_, _, q) in enumerate(queries):
                        lists[j] = merge(lists[j], best_of_tile(q, x, ids, k), k)
        if at:
            yield from done()

    return run


def search(vectors: DataFrame, is_query: Column, *, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score: for each query row its ``k`` best among all other rows.

    ``is_query`` is a condition on the key, named ``vec_id`` in it. Ties go to the smaller key; fewer rows
    give fewer ranks. Rows with null key, or null vector, or null or non-finite components take no part;
    shorter vectors count as padded with zeros; of repeated rows a query leaves out itself alone; scores
    beyond 64 bits stop at the bounds; empty tables give no rows; further columns are ignored.
    """
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL")
    n, n_queries = v.agg(F.count("*"), F.count_if(is_query)).first()
    if not n_queries:
        return v.limit(0).selectExpr("vec_id AS query_id", "CAST(0 AS INT) AS rank", "vec_id", "vec_id AS score")
    blocks, tiles = -(-n_queries // block), -(-n // TILE)
    shards = min(tiles, max(-(-tiles // TASK_TILES), -(-2 * v.sparkSession.sparkContext.defaultParallelism // blocks)))
    number = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int")  # repeated rows are dealt apart
    asked = v.filter(is_query).withColumn("block", number).repartition(blocks, "block").sortWithinPartitions("block")
    asked = asked.mapInArrow(_pack(None), PACK).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    every = v.withColumn("block", F.lit(0)).mapInArrow(_pack(shards), PACK).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    pairs = asked.unionByName(every).repartition(blocks * shards, "block", "shard").sortWithinPartitions("block", "shard", "tile", "first")
    out = pairs.mapInArrow(_products(k + 1), "q long, query_id long, own long, vec_id long, score long, shard int")
    first = Window.partitionBy("q", "group").orderBy(F.desc("score"), "vec_id")
    few = out.withColumn("group", F.col("shard") % GROUPS).withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k + 1)
    lists = few.groupBy("q").agg(F.first("query_id").alias("query_id"), F.first("own").alias("own"), F.array_sort(F.collect_list(F.struct((-1 - F.col("score")).alias("s"), "vec_id"))).alias("l"))
    at = F.array_position("l", F.struct((-1 - F.col("own")).alias("s"), F.col("query_id").alias("vec_id"))).cast("int")
    rest = F.when(at > 0, F.concat(F.slice("l", F.lit(1), at - 1), F.slice("l", at + 1, F.lit(k + 1)))).otherwise(F.col("l"))
    ranked = lists.select("query_id", F.posexplode(F.slice(rest, 1, k)).alias("i", "x"))
    return ranked.select("query_id", (F.col("i") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-1 - F.col("x.s")).alias("score"))
