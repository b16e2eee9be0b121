"""Reproducible splits and samples by hash order.

Places in a group come from one sort of all rows over all tasks (``ordered.numbered_within``), so a group that
holds most rows is no task's alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import hash_key
from tessera.operators.ordered import numbered_within


def _placed(df: DataFrame, groups: list[str], id_col: str, size: str | None = None) -> DataFrame:
    """``df`` with its place ``__k`` in its group's hash order."""
    return numbered_within(df, groups, [hash_key(F.col(id_col)), F.col(id_col)], "__k", size)


def split_roles(df: DataFrame, groups: list[str], id_col: str, test: float = 0.1, val: float = 0.1, calibration: float = 0.05, ood: Column | None = None) -> DataFrame:
    """id and split_role: per group the first rows in hash order are test, then validation, then calibration.

    Sizes round half to even; calibration is a share of the rest. Rows for which ``ood`` holds are ood_eval.
    """
    d = _placed(df.select(*groups, id_col, *([ood.alias("__ood")] if ood is not None else [])), groups, id_col, "__n")
    n_test, n_val = F.bround(F.col("__n") * test), F.bround(F.col("__n") * val)
    n_cal = F.bround((F.col("__n") - n_test - n_val) * calibration)
    role = F.when(F.col("__k") <= n_test, "id_test").when(F.col("__k") <= n_test + n_val, "val").when(F.col("__k") <= n_test + n_val + n_cal, "calibration").otherwise("train_core")
    if ood is not None:
        role = F.when(F.col("__ood"), "ood_eval").otherwise(role)
    return d.select(*groups, id_col, role.alias("split_role"))


def fixed_per_group(df: DataFrame, groups: list[str], id_col: str, n: int) -> DataFrame:
    """The first n rows of each group in hash order; tasks keep n rows a group before they are shuffled."""
    w = Window.partitionBy(*groups).orderBy(hash_key(F.col(id_col)), id_col)
    return df.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= n).drop("__k")


def balanced(df: DataFrame, group: str, id_col: str) -> DataFrame:
    """As many rows of each group as the smallest has."""
    least = df.groupBy(group).count().agg(F.min("count")).first()[0]
    return _placed(df, [group], id_col).filter(F.col("__k") <= (least or 0)).drop("__k")


def proportional(df: DataFrame, groups: list[str], id_col: str, total: int) -> DataFrame:
    """About ``total`` rows, shared over the groups by size, one at least, exact by largest remainder."""
    counts = df.groupBy(*groups).count()  # a row per group
    w = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    share = counts.withColumn("q", F.col("count") * total / F.sum("count").over(w)).withColumn("base", F.greatest(F.lit(1), F.floor("q")).cast("long"))
    share = share.withColumn("left", F.lit(total) - F.sum("base").over(w)).withColumn("r", F.row_number().over(Window.orderBy((F.col("q") - F.floor("q")).desc(), *groups)))
    share = share.select(*groups, F.least("count", F.col("base") + (F.col("r") <= F.col("left")).cast("long")).alias("__take"))
    # a group takes at most ``total``, so the first rows of each are found before the join
    return fixed_per_group(df, groups, id_col, total).join(share, groups).withColumn("__k", F.row_number().over(Window.partitionBy(*groups).orderBy(hash_key(F.col(id_col)), id_col))).filter("__k <= __take").drop("__k", "__take")


def folds(df: DataFrame, label: str, id_col: str, k: int = 5) -> DataFrame:
    """Stratified folds by hash order."""
    return _placed(df.select(id_col, label), [label], id_col).select(id_col, label, F.pmod(F.col("__k") - 1, F.lit(k)).cast("int").alias("fold"))
