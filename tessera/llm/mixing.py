"""Mixing sources to target weights.

Words are summed per source, targets follow from the weights by water filling, and each document is
emitted ``floor(rate)`` times plus once more if a hash of its key falls below the fraction of the rate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import checkpointed, n_words
from tessera.operators.ordered import numbered, running_sums

#: Source tables up to this many rows are ordered in one task and broadcast; larger ones are sorted over all
#: tasks and joined by shuffle, where the adaptive skew join splits a hot source.
BROADCAST_SOURCES = 100_000


def _ordered(sizes: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """Sources with their weights, the sums over all, and the sums over those of smaller size for their weight.

    Up to ``BROADCAST_SOURCES`` rows windows over all of them do; beyond it the rows are sorted over all tasks.
    """
    order, ratio = F.col("source").asc_nulls_last(), (F.col("source_size") / F.col("w")).asc()
    weight = lambda k: F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(k - 1, F.lit(len(weights))) + 1).cast("int")).cast("long").alias("w")
    if sizes.count() > BROADCAST_SOURCES:
        s = numbered(sizes, [order], "__k").select("source", "source_size", weight(F.col("__k")))
        s = running_sums(numbered(s, [ratio, order], "__r"), [], "__r", ["source_size", "w"], exclusive=True, one_window=0)
        s = s.withColumnsRenamed({"cum_source_size": "full_size", "cum_w": "full_w"}).drop("__r")
        return s.crossJoin(F.broadcast(s.agg(F.sum("source_size").alias("all_size"), F.sum("w").alias("all_w"))))  # one row
    s = sizes.select("source", "source_size", weight(F.row_number().over(Window.orderBy(order))))
    before = Window.orderBy(ratio, order).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    whole = [F.sum(c).over(everything).alias(n) for c, n in (("source_size", "all_size"), ("w", "all_w"))]
    return s.select("*", *whole, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(n) for c, n in (("source_size", "full_size"), ("w", "full_w"))])


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_rate: float = 3.0) -> DataFrame:
    """One row per source (``source``, ``source_size``) with its ``target`` and ``rate``.

    Sources by code point, null last, weigh ``weights`` in turn. A target is the source's share of all
    words but at most ``max_rate`` times its own; the excess goes to the others by weight until none is
    above. That fixed point is ``min(max_rate * size, level * weight)``: with sources ordered by
    ``max_rate * size / weight``, the level is the first one that the next source does not fall short of.
    Sources without words get target and rate 0; no sources give no rows.
    """
    level = (F.col("all_size").cast("double") - F.lit(max_rate) * F.col("full_size")) / (F.col("all_w") - F.col("full_w"))
    s = checkpointed(_ordered(checkpointed(sizes.select("source", "source_size")), weights)).withColumn("level", level)
    holds = F.lit(max_rate) * F.col("source_size") >= F.col("level") * F.col("w")
    best = s.agg(F.min(F.when(holds, F.struct(F.col("full_w"), F.col("level")))).alias("best"))
    s = s.crossJoin(F.broadcast(best)).withColumn("level", F.col("best.level"))  # best is one row
    target = F.least(F.lit(max_rate) * F.col("source_size"), F.col("level") * F.col("w"))
    target = F.when(F.col("source_size") > 0, F.coalesce(target, F.lit(max_rate) * F.col("source_size"))).otherwise(F.lit(0.0))
    return s.select("source", "source_size", target.alias("target")).withColumn(
        "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    )


def unit_hash(key: Column, seed: str) -> Column:
    """A number in [0, 1) from the md5 of seed and key; a null key counts as the empty string."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


def copies(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), max_rate: float = 3.0, seed: str = "mix"
) -> DataFrame:
    """Each document's key with ``size``, ``source_size``, ``target`` and ``n_copies``.

    Null text has size 0, null sources form one source, repeated rows count as documents of their own
    and share a decision, an empty table gives no rows, further columns are ignored.
    """
    d = checkpointed(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size")))
    sizes = d.groupBy("source").agg(F.sum("size").alias("source_size"))
    t = checkpointed(targets(sizes, weights, max_rate))
    if t.count() <= BROADCAST_SOURCES:
        t = F.broadcast(t)
    t = t.withColumnRenamed("source", "t_source")
    base = F.floor("rate")
    extra = (unit_hash(F.col("doc_id"), seed) < F.col("rate") - base).cast("long")
    return d.join(t, F.col("source").eqNullSafe(F.col("t_source")), "left").select("doc_id", "source", "size", "source_size", "target", (base + extra).alias("n_copies"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), max_rate: float = 3.0, seed: str = "mix") -> DataFrame:
    """``docs`` with every row repeated as often as the mix takes it; columns stay as they are.

    The rate depends on the source alone and the extra copy on key and rate, so rows meet their source's
    rate in one broadcast join and no text is shuffled. Nulls, repeated rows and empty tables are as in
    ``copies``; sources without words are left out.
    """
    sizes = checkpointed(docs.select(F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size")).groupBy("source").agg(F.sum("size").alias("source_size")))
    t = checkpointed(targets(sizes, weights, max_rate)).select(F.col("source").alias("__mix_source"), F.col("rate").alias("__mix_rate"))
    if t.count() <= BROADCAST_SOURCES:
        t = F.broadcast(t)
    base = F.floor("__mix_rate")
    n = base + (unit_hash(docs[id_col], seed) < F.col("__mix_rate") - base).cast("long")
    out = docs.join(t, docs[source_col].eqNullSafe(F.col("__mix_source")), "left").withColumn("__mix_n", n.cast("int"))
    return out.filter("__mix_n > 0").withColumn("__mix_k", F.explode(F.array_repeat(F.lit(1), F.col("__mix_n")))).select(*[out[c] for c in docs.columns])
