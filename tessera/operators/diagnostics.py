"""Reports on feature sets: how well they do, how they generalise, what they cost."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import models
from tessera.operators.metrics import auc, cohen_d


def d_prime(area: float) -> float:
    """Distance of two equal normal distributions with this AUC."""
    return 2**0.5 * NormalDist().inv_cdf(min(max(area, 1e-12), 1 - 1e-12))


def tpr_at(area: float, fpr: float = 0.05) -> float:
    """True-positive rate that such distributions have at a false-positive rate."""
    return NormalDist().cdf(d_prime(area) - NormalDist().inv_cdf(1 - fpr))


def auc_mapping(areas: dict[str, float]) -> list[dict]:
    """AUC, d' and TPR at 5 % of named sets, the best first."""
    return [{"name": n, "auc": a, "d_prime": d_prime(a), "tpr_at_fpr5": tpr_at(a)} for n, a in sorted(areas.items(), key=lambda x: (-x[1], x[0]))]


def variants(df: DataFrame, variant: str, features: list[str], group: str, id_col: str) -> DataFrame:
    """Per variant: AUC over stratified folds and over left-out groups, and each feature's class means and Cohen's d. The loop is over variants."""
    spark, rows = df.sparkSession, []
    for v in sorted(r[0] for r in df.select(variant).distinct().collect()):
        d = df.filter(F.col(variant) == v)
        rows.append((v, models.cross_validated_auc(d, features, id_col), models.evaluated_auc(d, features, group, id_col)))
    areas = spark.createDataFrame(rows, f"{variant} string, stratified_auc double, logo_auc double")
    long = df.unpivot([variant, "y"], features, "feature", "x")
    of = lambda k: F.avg(F.when(F.col("y") == k, F.col("x")))
    means = long.groupBy(variant, "feature").agg(of(1).alias("mean_1"), of(0).alias("mean_0"))
    return means.join(cohen_d(long, "y", "x", [variant, "feature"]), [variant, "feature"]).join(F.broadcast(areas), variant)  # a row per variant


def subsampling(df: DataFrame, variant: str, features: list[str]) -> DataFrame:
    """Per variant and feature: how far it tells the label and how far the subsampling (``nuisance_is_420``) of real rows."""
    long = df.unpivot([variant, "y", "nuisance_is_420"], features, "feature", "x")
    keys = [variant, "feature"]
    label = auc(long, "y", "x", keys).select(*keys, F.greatest("auc", 1 - F.col("auc")).alias("label_auc"))
    kind = auc(long.filter("y = 0"), "nuisance_is_420", "x", keys).select(*keys, F.greatest("auc", 1 - F.col("auc")).alias("nuisance_auc"))
    return label.join(kind, keys, "left")


def generalisation(df: DataFrame, sets: dict[str, list[str]], group: str, id_col: str) -> list[dict]:
    """Per feature set: AUC over pooled folds, the mean over folds within each group, and over left-out groups."""
    out = []
    groups = sorted(r[0] for r in df.select(group).distinct().collect())
    for name, features in sets.items():
        within = [models.cross_validated_auc(df.filter(F.col(group) == g), features, id_col) for g in groups]
        within = [a for a in within if a is not None]
        out.append({"set": name, "pooled_auc": models.cross_validated_auc(df, features, id_col), "within_auc": sum(within) / len(within) if within else None, "logo_auc": models.evaluated_auc(df, features, group, id_col)})
    return out


def redundancy(df: DataFrame, shift: str, gap: str) -> float | None:
    """Correlation of how features shift and how far they are from the label."""
    return df.agg(F.corr(shift, gap)).first()[0]


def compared_sets(df: DataFrame, sets: dict[str, list[str]], baseline: str, group: str, id_col: str) -> list[dict]:
    """AUC of every feature set and its difference from the baseline's, the best first."""
    areas = {n: models.evaluated_auc(df, f, group, id_col) for n, f in sets.items()}
    return [{**row, "delta": row["auc"] - areas[baseline]} for row in auc_mapping(areas)]


def latency_ms(f: Callable, inputs: Iterable, passes: int = 3) -> float:
    """Milliseconds an input, the mean of several passes; one pass before them does not count."""
    inputs = list(inputs)
    for x in inputs:
        f(x)
    begin = time.perf_counter()
    for _ in range(passes):
        for x in inputs:
            f(x)
    return 1000 * (time.perf_counter() - begin) / (passes * max(1, len(inputs)))
