"""Alerts on features that tell the classes apart, and the ranking of features by their label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import finite, rate_level
from tessera.operators.ordered import quantiles

#: Least difference of presence, values a class, occurrences of an exclusive value, and shares of a dominant size.
PRESENCE, TOP_VALUES, OCCURRENCES, DOMINANT, RARE = 0.05, 3, 10, 0.80, 0.20


def _spread(long: DataFrame, kind: str, value: Column) -> DataFrame:
    """Largest less smallest ``value`` of the classes; ``long`` has a row per feature (and detail) and class."""
    g = long.groupBy("feature", "detail").agg((F.max(value) - F.min(value)).alias("delta"), F.count(value).alias("k")).filter("k > 1")
    return g.select(F.lit(kind).alias("kind"), "feature", "detail", "delta", rate_level(F.col("delta")).alias("severity"))


def _long(df: DataFrame, label: str, cols: list[str], kind: str) -> DataFrame:
    return df.select(F.col(label).alias("y"), *[F.col(c).cast(kind).alias(c) for c in cols]).unpivot(["y"], cols, "feature", "x")


def alerts(df: DataFrame, label: str, *, binary: list[str] = (), categories: list[str] = (), numbers: list[str] = (), texts: list[str] = (), size: tuple[str, str] | None = None) -> DataFrame:
    """kind, feature, detail, delta and severity, HIGH first.

    Rates of binary columns, shares of categories (null is one), medians relative to their mean, presence of
    texts, values that occur in one class alone, and a size that dominates one class and is rare in another.
    Rows without a label are left out.
    """
    d, none = df.filter(F.col(label).isNotNull()), F.lit(None).cast("string").alias("detail")
    parts = []
    if binary:
        parts.append(_spread(_long(d, label, binary, "double").groupBy("feature", "y").agg(F.avg("x").alias("v")).withColumn("detail", none), "binary_rate", F.col("v")))
    if categories:
        counts = _long(d, label, categories, "string").groupBy("feature", "x", "y").agg(F.count("*").alias("n"))
        classes = counts.select("feature", "y").distinct()
        full = counts.select("feature", "x").distinct().join(classes, "feature")
        own = counts.select(F.col("feature").alias("f"), F.col("x").alias("c"), F.col("y").alias("k"), "n")
        share = full.join(own, F.col("feature").eqNullSafe(F.col("f")) & F.col("x").eqNullSafe(F.col("c")) & F.col("y").eqNullSafe(F.col("k")), "left")
        share = share.select("feature", "x", "y", F.coalesce("n", F.lit(0)).alias("n"))
        share = share.join(counts.groupBy("feature", "y").agg(F.sum("n").alias("total")), ["feature", "y"]).withColumn("v", F.col("n") / F.col("total"))
        worst = _spread(share.select("feature", F.coalesce("x", F.lit("")).alias("detail"), "y", "v"), "category_share", F.col("v"))
        top = F.row_number().over(Window.partitionBy("feature").orderBy(F.desc("delta"), "detail"))
        parts.append(worst.withColumn("k", top).filter("k = 1").drop("k"))
    if numbers:
        m = quantiles(_long(d, label, numbers, "double"), "x", [0.5], ["feature", "y"]).select("feature", "y", F.col("q0").alias("v"))
        m = m.withColumn("v", F.col("v") / F.greatest(F.avg("v").over(Window.partitionBy("feature")), F.lit(1e-9)))  # a row per class
        parts.append(_spread(m.withColumn("detail", none), "relative_median", F.col("v")))
    if texts:
        long = _long(d, label, texts, "string")
        present = long.groupBy("feature", "y").agg(F.avg(F.col("x").isNotNull().cast("double")).alias("v")).withColumn("detail", none)
        parts.append(_spread(present, "presence", F.col("v")).filter(F.col("delta") > PRESENCE))
        counts = long.filter("x IS NOT NULL").groupBy("feature", "x").agg(F.min("y").alias("y"), F.countDistinct("y").alias("classes"), F.count("*").alias("n"))
        by_class = long.filter("x IS NOT NULL").groupBy("feature", "x", "y").agg(F.count("*").alias("n"))
        top = by_class.withColumn("k", F.row_number().over(Window.partitionBy("feature", "y").orderBy(F.desc("n"), "x"))).filter((F.col("k") <= TOP_VALUES) & (F.col("n") >= OCCURRENCES))
        alone = top.join(counts.filter("classes = 1").select("feature", "x"), ["feature", "x"])
        detail = F.concat_ws(" ", F.substring("x", 1, 80), F.lit("only in"), F.col("y").cast("string"), F.col("n").cast("string"))
        parts.append(alone.select(F.lit("exclusive_value").alias("kind"), "feature", detail.alias("detail"), F.lit(1.0).alias("delta"), F.lit("HIGH").alias("severity")))
    if size:
        s = d.filter(F.col(size[0]).isNotNull() & F.col(size[1]).isNotNull()).select(F.col(label).alias("y"), F.concat_ws("x", *[F.col(c).cast("long").cast("string") for c in size]).alias("x"))
        totals = s.groupBy("y").agg(F.count("*").alias("total"))
        share = s.groupBy("y", "x").agg(F.count("*").alias("n")).join(totals, "y").withColumn("v", F.col("n") / F.col("total"))
        big = share.filter(F.col("v") >= DOMINANT).select("y", "x", "v")
        other = big.join(totals.select(F.col("y").alias("z")), F.col("y") != F.col("z")).join(share.select(F.col("y").alias("z"), "x", F.col("v").alias("w")), ["z", "x"], "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
        detail = F.concat_ws(" ", "x", F.lit("in"), F.col("y").cast("string"), F.lit("rare in"), F.col("z").cast("string"))
        parts.append(other.filter(F.col("w") < RARE).select(F.lit("resolution_pattern").alias("kind"), F.lit("x".join(size)).alias("feature"), detail.alias("detail"), (F.col("v") - F.col("w")).alias("delta"), F.lit("HIGH").alias("severity")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    rank = F.when(F.col("severity") == "HIGH", 0).when(F.col("severity") == "MEDIUM", 1).otherwise(2)
    return out.orderBy(rank, "kind", "feature", "detail")


def _corr(a: Column, b: Column) -> Column:
    """Correlation over the rows that have both; null where one is constant."""
    both = lambda x: F.when(a.isNotNull() & b.isNotNull(), x)
    return F.try_divide(F.covar_pop(both(a), both(b)), F.stddev_pop(both(a)) * F.stddev_pop(both(b)))


def label_ranking(df: DataFrame, label: str, features: list[str], top: int = 20) -> DataFrame:
    """feature, corr, missing_gap and score, the larger of |corr| and the gap of missing shares; the ``top`` first."""
    good = {f: F.when(finite(F.col(f).cast("double")), F.col(f).cast("double")) for f in features}
    gap = lambda c: F.abs(F.avg(F.when(F.col(label) == 1, c.isNull().cast("double"))) - F.avg(F.when(F.col(label) == 0, c.isNull().cast("double"))))
    one = df.filter(F.col(label).isNotNull()).agg(F.array(*[F.struct(F.lit(f).alias("feature"), _corr(c, F.col(label).cast("double")).alias("corr"), gap(c).alias("missing_gap")) for f, c in good.items()]).alias("x"))
    r = one.select(F.explode("x").alias("x")).select("x.*")
    return r.withColumn("score", F.greatest(F.coalesce(F.abs("corr"), F.lit(0.0)), F.coalesce("missing_gap", F.lit(0.0)))).orderBy(F.desc("score"), "feature").limit(top)


def correlated_pairs(df: DataFrame, features: list[str], least: float = 0.8) -> DataFrame:
    """feature_a, feature_b, corr and n of every pair with |corr| of ``least`` or more, over rows that have both."""
    good = {f: F.when(finite(F.col(f).cast("double")), F.col(f).cast("double")) for f in features}
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]]
    one = df.agg(F.array(*[F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), _corr(good[a], good[b]).alias("corr"), F.count_if(good[a].isNotNull() & good[b].isNotNull()).alias("n")) for a, b in pairs]).alias("x"))
    r = one.select(F.explode("x").alias("x")).select("x.*").filter(F.abs("corr") >= least)
    return r.orderBy(F.desc(F.abs("corr")), "feature_a", "feature_b")
