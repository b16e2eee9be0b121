"""Profiles of tables: distributions, pivots, duplicates, missing values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import finite
from tessera.operators.ordered import quantiles


def numeric_summary(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row per column: n, min, max, mean, median, sample deviation; nulls, NaN and infinities left out."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "column", "x").filter(finite(F.col("x")))
    s = long.groupBy("column").agg(F.count("x").alias("n"), F.min("x").alias("min"), F.max("x").alias("max"), F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_samp("x"), 6).alias("std"))
    q = quantiles(long, "x", [0.5], ["column"]).select("column", F.round("q0", 6).alias("median"))
    return s.join(q, "column").select("column", "n", "min", "max", "mean", "median", "std")


def value_counts(df: DataFrame, column: str, by: str | None = None) -> DataFrame:
    """Counts of the values, null as ``<None>``, over all rows and for each value of ``by``, in one pass."""
    v = df.select(F.coalesce(F.col(column).cast("string"), F.lit("<None>")).alias("value"), *([F.col(by).cast("string").alias("by")] if by else []))
    if not by:
        return v.groupBy("value").count()
    return v.groupingSets([[F.col("value")], [F.col("by"), F.col("value")]], "by", "value").agg(F.count("*").alias("n"), F.grouping("by").cast("int").alias("is_global"))


def right_closed_histogram(df: DataFrame, column: str, width: int, n_bins: int) -> DataFrame:
    """Counts in (k w, (k + 1) w], the first with 0, empty bins kept, values outside left out."""
    b = F.greatest(F.lit(1), F.ceil(F.col(column) / width)).cast("int")
    counts = df.filter(F.col(column).between(0, width * n_bins)).groupBy(b.alias("bin")).count()
    bins = df.sparkSession.range(1, n_bins + 1).select(F.col("id").cast("int").alias("bin"))
    return bins.join(counts, "bin", "left").select("bin", ((F.col("bin") - 1) * width).alias("low"), (F.col("bin") * width).alias("high"), F.coalesce("count", F.lit(0)).cast("long").alias("n"))


def crosstab(df: DataFrame, row: str, column: str, values: list[str], share: bool = False) -> DataFrame:
    """Counts of ``values`` per row key, zero-filled in the given order; as shares of the row if asked."""
    t = df.groupBy(row).pivot(column, values).count().fillna(0)
    if share:
        total = sum((F.col(f"`{v}`") for v in values), F.lit(0))
        t = t.select(row, *[F.round(F.when(total > 0, F.col(f"`{v}`") / total).otherwise(0.0), 6).alias(v) for v in values])
    return t


def top_values(df: DataFrame, value: Column, n: int) -> DataFrame:
    """The n most frequent values, ties by value."""
    return df.groupBy(value.cast("string").alias("value")).count().orderBy(F.desc("count"), "value").limit(n)


def top_per_group(df: DataFrame, group: str, value: str, n: int) -> DataFrame:
    """The n most frequent values of each group with their shares, ties by value."""
    c = df.groupBy(group, value).count()
    w = Window.partitionBy(group)
    rank = F.row_number().over(w.orderBy(F.desc("count"), value))
    return c.select(group, value, F.col("count").alias("n"), F.round(F.col("count") / F.sum("count").over(w), 6).alias("share"), rank.alias("rank")).filter(F.col("rank") <= n)


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def duplicates(df: DataFrame, key: Column, id_col: str) -> DataFrame:
    """Rows whose key is not their own: id, digest, size of the group and its least id.

    Groups are found by an aggregate over digests and joined back, so a hot digest is neither sorted nor
    held in one task.
    """
    d = df.select(F.col(id_col).alias("id"), F.sha2(key.cast("binary"), 256).alias("digest"))
    g = d.groupBy("digest").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).filter("n > 1")
    return d.join(g, "digest").select("id", "digest", "n", "first_id")


def missing_rates(df: DataFrame, cols: list[str], by: str | None = None) -> DataFrame:
    """Share of nulls in each column (and group), highest first."""
    long = df.select(*([by] if by else []), *[F.col(c).isNull().cast("double").alias(c) for c in cols]).unpivot([by] if by else [], cols, "column", "x")
    return long.groupBy("column", *([by] if by else [])).agg(F.round(F.avg("x"), 6).alias("missing"))


def folder_summary(df: DataFrame, path: Column) -> DataFrame:
    """Per folder: files, depth, and the histogram of suffixes as JSON, most frequent first."""
    p = df.select(path.alias("p")).select(F.regexp_extract("p", r"^(.*)/[^/]*$", 1).alias("folder"), F.lower(F.regexp_extract("p", r"(\.[^./]+)$", 1)).alias("ext"))
    c = p.groupBy("folder", "ext").count()
    pairs = F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("k"), "ext", "count")))
    text = F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda x: F.concat(F.lit('"'), x["ext"], F.lit('":'), x["count"].cast("string"))), ","), F.lit("}"))
    return c.groupBy("folder").agg(F.sum("count").alias("n"), text.alias("extensions")).withColumn("depth", F.size(F.split("folder", "/")))


def unique_on(df: DataFrame, keys: list[str], what: str) -> DataFrame:
    """``df``, or an error if two rows share the keys (one_to_one joins)."""
    if not df.groupBy(*keys).count().filter("count > 1").isEmpty():
        raise ValueError(f"{what}: keys {keys} are not unique")
    return df
