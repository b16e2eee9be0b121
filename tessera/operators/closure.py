"""How candidates hold up: degradations, nuisance, branches, and the choice of a crop.

Scores of all candidates, degradations and splits are one long table (``long_scores``), so each suite is a few
grouped aggregates over it instead of a loop.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import phase_distance, residue_start
from tessera.operators import contracts
from tessera.operators.metrics import auc, binary_information, split_metrics

MEASURES = ("auc", "brier", "ece", "tpr", "fpr")
POOLED = ("id_test", "ood_eval")


def pooled(df: DataFrame, split: str = "split", parts: tuple[str, ...] = POOLED) -> DataFrame:
    """``df`` with the rows of the evaluation splits once more as ``pooled_eval``."""
    names = F.array_compact(F.array(F.col(split), F.when(F.col(split).isin(*parts), F.lit("pooled_eval"))))
    return df.withColumn("__split", F.explode(names)).drop(split).withColumnRenamed("__split", split)


def suite(scores: DataFrame, thresholds: DataFrame, keys: list[str]) -> DataFrame:
    """Confusion, rates, Brier, AUC and calibration per ``keys``, candidate and split, pooled ones too.

    ``scores`` has the keys, candidate, split, y and p; ``thresholds`` a threshold per candidate.
    """
    d = pooled(scores.join(thresholds, "candidate"))
    return split_metrics(d, "y", "p", F.col("threshold"), [*keys, "candidate", "split"])


def gaps(clean: DataFrame, degraded: DataFrame) -> DataFrame:
    """Each measure of the degraded rows, of the clean ones, and the difference."""
    base = clean.select("candidate", "split", *[F.col(m).alias(f"clean_{m}") for m in MEASURES])
    d = degraded.join(base, ["candidate", "split"], "left")
    return d.select("candidate", "degradation", "split", *[c for m in MEASURES for c in (F.col(f"clean_{m}"), F.col(m), (F.col(m) - F.col(f"clean_{m}")).alias(f"{m}_gap"))])


def nuisance(scores: DataFrame) -> DataFrame:
    """Per candidate and split: how far scores tell the subsampling of real images (``nuisance_is_420``), and the means of both kinds."""
    d = pooled(scores)
    a = auc(d, "nuisance_is_420", "p", ["candidate", "split"])
    kind = lambda k: F.avg(F.when(F.col("nuisance_is_420") == k, F.col("p")))
    m = d.groupBy("candidate", "split").agg(kind(1).alias("pred_mean_420"), kind(0).alias("pred_mean_444"))
    j = m.join(a, ["candidate", "split"])
    return j.select(
        "candidate", "split", (F.col("n_pos") + F.col("n_neg")).alias("n_rows"), F.col("n_pos").alias("n_420"), F.col("n_neg").alias("n_444"), F.col("auc").alias("auc_nat_raw"), F.greatest("auc", 1 - F.col("auc")).alias("auc_nat_abs"),
        "pred_mean_420", "pred_mean_444", (F.col("pred_mean_420") - F.col("pred_mean_444")).alias("pred_gap_420_minus_444"),
    )


def branches(candidates: DataFrame, clean: DataFrame, nat: DataFrame, gap: DataFrame) -> DataFrame:
    """A row per candidate: validation, clean pooled measures, nuisance, the worst and mean of the degradations, and what it uses.

    ``candidates`` has candidate, feature_set and the validation columns; the rest are pooled_eval rows of
    ``suite``, ``nuisance`` and ``gaps``.
    """
    one = lambda d: d.filter(F.col("split") == "pooled_eval")
    c = one(clean).select("candidate", *[F.col(m).alias(f"clean_pooled_{m}") for m in MEASURES])
    n = one(nat).select("candidate", "auc_nat_raw", "auc_nat_abs", "pred_gap_420_minus_444")
    x = one(gap).groupBy("candidate").agg(F.min("auc").alias("worst_xdeg_auc"), F.avg("auc").alias("mean_xdeg_auc"), F.min("auc_gap").alias("worst_auc_gap"), F.avg("auc_gap").alias("mean_auc_gap"))
    out = reduce(lambda a, b: a.join(b, "candidate", "left"), [c, n, x], candidates)
    return out.withColumns(contracts.usage_flags(F.col("feature_set"))).orderBy(F.desc("val_auc"), F.desc("clean_pooled_auc"))


def feature_gates(clean: DataFrame, nuisance: DataFrame, shift: DataFrame) -> DataFrame:
    """Per feature: AUC on the label and on the nuisance, the largest shift over the labels, and the strict gate; the best first."""
    worst = shift.groupBy("feature").agg(F.max("shift").alias("shift"))
    j = clean.select("feature", F.col("auc_abs").alias("clean")).join(nuisance.select("feature", F.col("auc_abs").alias("nuisance")), "feature", "left").join(worst, "feature", "left")
    return j.withColumn("gate", contracts.strict_gate(F.col("clean"), F.col("nuisance"), F.col("shift"))).orderBy(F.desc("gate"), F.desc("clean"), "feature")


def geometry(sizes: DataFrame, crops: Column, residues: Column, is_ai: Column) -> DataFrame:
    """Every crop size and residue over all images (width, height): who is accepted, what is kept, how far off centre.

    The grid is fixed and small; a row meets it inside its task, and partial sums are shuffled alone.
    """
    short = F.least("width", "height")
    g = sizes.select("width", "height", short.alias("short"), is_ai.cast("int").alias("ai"), F.explode(crops).alias("crop_size")).select("*", F.explode(residues).alias("residue"))
    g = g.withColumn("ok", F.col("short") >= F.col("crop_size") + F.col("residue"))
    off = lambda side: F.abs(_start(side) - (F.col(side) - F.col("crop_size")) / 2)

    def _start(side: str) -> Column:
        return residue_start(F.col(side), F.col("crop_size"), F.col("residue"))

    here = lambda c: F.when(F.col("ok"), c)
    rate = lambda k: F.avg(F.when(F.col("ai") == k, F.col("ok").cast("double")))
    s = g.groupBy("crop_size", "residue").agg(
        F.avg((F.col("ai") == 0).cast("double")).alias("__real"), rate(1).alias("accepted_ai"), rate(0).alias("accepted_real"), F.avg(F.col("ok").cast("double")).alias("coverage_total"), F.count_if("ok").alias("accepted_total"),
        F.avg(here(F.col("crop_size") * F.col("crop_size") / (F.col("short") * F.col("short")))).alias("mean_retained_area"), F.avg(here(F.greatest(off("width"), off("height")))).alias("mean_center_linf"),
    )
    mi = F.greatest(F.lit(0.0), binary_information(F.col("__real"), F.col("accepted_real"), F.col("accepted_ai")))
    return s.select("crop_size", "residue", (F.col("crop_size") + F.col("residue")).alias("threshold"), "accepted_ai", "accepted_real", (F.col("accepted_real") - F.col("accepted_ai")).alias("coverage_gap_real_minus_ai"), "coverage_total", "accepted_total", mi.alias("mi_bits"), "mean_retained_area", "mean_center_linf", phase_distance(F.col("residue"), F.lit(0)).alias("phase_distance"))


def recommended(sweep: DataFrame, least: float = 0.999999, multiple: int = 8) -> DataFrame:
    """The row of the largest crop divisible by ``multiple`` that accepts all generated images, and of its residues the one farthest from the grid, then nearest to the centre, then of largest coverage."""
    m = sweep.filter((F.col("crop_size") % multiple == 0) & (F.col("accepted_ai") >= least))
    return m.orderBy(F.desc("crop_size"), F.desc("phase_distance"), "mean_center_linf", F.desc("coverage_total"), "residue").limit(1)
