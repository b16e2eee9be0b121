"""Running sums, row numbers and quantiles over a global order, without one task that sees all rows.

The rows are sorted over all tasks and checkpointed with their task's number and their place in it. Sums or
counts of the tasks before, a row per task and key, are then added to those within a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import finite
from tessera.session import checkpointed

#: Rows up to which one window per key is enough.
ONE_WINDOW = 1_000_000
_PLACES = 33  # bits of monotonically_increasing_id that count within a task


def _same(keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out &= F.col(f"d.{k}").eqNullSafe(F.col(f"t.{k}"))
    return out


def _sorted(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` in the order, with ``__at``, a number that ascends, and ``__part``, its task."""
    return checkpointed(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id())).withColumn("__part", F.shiftright("__at", _PLACES))


def running_sums(df: DataFrame, keys: list[str], order: str, values: list[str], descending: bool = False, exclusive: bool = False, one_window: int | None = None) -> DataFrame:
    """``df`` with ``cum_<value>`` along ``order`` within ``keys``.

    Up to ``one_window`` rows a window per key does; beyond it a key that holds most rows is spread over as
    many tasks as the sort has. ``order`` must be unique within the keys. ``df`` is computed once.
    """
    df = checkpointed(df)
    by, last = F.col(order).desc() if descending else F.col(order).asc(), -1 if exclusive else 0
    if df.count() <= (ONE_WINDOW if one_window is None else one_window):
        w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(by).rowsBetween(Window.unboundedPreceding, last)
        return df.select("*", *[F.coalesce(F.sum(v).over(w), F.lit(0)).alias(f"cum_{v}") for v in values])
    d = _sorted(df, [*map(F.col, keys), by])
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row per task
    totals = d.groupBy(*keys, "__part").agg(*[F.sum(v).alias(f"__t_{v}") for v in values])
    totals = totals.select(*keys, "__part", *[F.coalesce(F.sum(f"__t_{v}").over(before), F.lit(0)).alias(f"__b_{v}") for v in values])
    inner = Window.partitionBy(*keys, "__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, last)
    d = d.select("*", *[F.coalesce(F.sum(v).over(inner), F.lit(0)).alias(f"__i_{v}") for v in values])
    out = d.alias("d").join(totals.alias("t"), _same([*keys, "__part"]))
    return out.select("d.*", *[(F.col(f"__i_{v}") + F.col(f"__b_{v}")).alias(f"cum_{v}") for v in values]).drop("__part", "__at", *[f"__i_{v}" for v in values])


def numbered(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``df`` with its place ``name`` in the order, from 1."""
    d = _sorted(df, order)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row per task
    counts = d.groupBy("__part").count().select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    place = F.col("__at").bitwiseAND(F.lit((1 << _PLACES) - 1)) + F.col("__before") + 1
    return d.join(F.broadcast(counts), "__part").withColumn(name, place).drop("__part", "__at", "__before")


def numbered_within(df: DataFrame, groups: list[str], order: list[Column], name: str = "rank", size: str | None = None) -> DataFrame:
    """``df`` with its place in its group's order, from 1, and on request the group's size."""
    d = numbered(df, [*map(F.col, groups), *order], "__n")
    first = d.groupBy(*groups).agg(F.min("__n").alias("__first"), F.count("*").alias("__size"))
    out = d.alias("d").join(first.alias("t"), _same(groups))
    return out.select(*[F.col(f"d.{c}") for c in df.columns], (F.col("__n") - F.col("__first") + 1).alias(name), *([F.col("__size").alias(size)] if size else []))


def ranked(df: DataFrame, value: str, key: str) -> DataFrame:
    """``df`` with its place ``rank`` by ``value`` from the largest, ties by ``key``; rows without a value are left out."""
    return numbered(df.filter(F.col(value).isNotNull()), [F.col(value).desc(), F.col(key)])


def quantiles(df: DataFrame, value: str, shares: list[float], keys: list[str] | None = None, one_window: int | None = None) -> DataFrame:
    """Exact quantiles of the finite values per key: keys, ``n`` and q0, q1, ..., interpolated between neighbours.

    Rows are summed to distinct values first. Without finite values there is no row, or without keys nulls.
    """
    keys = keys or []
    d = df.select(*keys, F.col(value).cast("double").alias("__x")).filter(finite(F.col("__x"))).groupBy(*keys, "__x").agg(F.count("*").alias("n"))
    r = checkpointed(running_sums(d, keys, "__x", ["n"], one_window=one_window))
    n = r.groupBy(*keys).agg(F.sum("n").alias("__rows"))
    n = F.broadcast(n) if not keys else n  # one row
    j = r.alias("d").join(n.alias("t"), _same(keys)).select("d.*", "__rows")
    at = [(F.col("__rows") - 1) * F.lit(float(p)) for p in shares]
    reach = lambda place: F.min(F.when(F.col("cum_n") > place, F.col("__x")))
    found = j.groupBy(*keys).agg(F.max("__rows").alias("n"), *[reach(f(h)).alias(f"__{k}{i}") for i, h in enumerate(at) for k, f in (("a", F.floor), ("b", F.ceil))])
    part = [(F.col("n") - 1) * F.lit(float(p)) for p in shares]
    between = lambda i, h: F.col(f"__a{i}") + (F.col(f"__b{i}") - F.col(f"__a{i}")) * (h - F.floor(h))
    return found.select(*keys, "n", *[between(i, h).alias(f"q{i}") for i, h in enumerate(part)])
