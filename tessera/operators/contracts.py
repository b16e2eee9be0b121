"""Checks and rules of the tables that training and evaluation read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Labels, split roles and feature sets.
LABELS = {"ai": 1, "fake": 1, "nature": 0, "real": 0}
ROLES = ("train_core", "calibration", "val", "id_test", "ood_eval")
USES = {
    "uses_research_wavelet": ("always_on_plus_wavelet", "full_v2", "full_v2_minus_content_adaptive_y_srm", "full_v2_minus_dark_textured_hetero", "full_v2_minus_conditional_cfa"),
    "uses_research_ysrm": ("always_on_plus_ysrm", "full_v2", "full_v2_minus_wavelet_decay", "full_v2_minus_conditional_cfa", "full_v2_minus_dark_textured_hetero"),
    "uses_conditional_cfa": ("always_on_plus_cfa_gated", "full_v2", "full_v2_minus_wavelet_decay", "full_v2_minus_content_adaptive_y_srm", "full_v2_minus_dark_textured_hetero"),
}
MOST_BYTES = 20 * 1024 * 1024


def label_number(label: Column) -> Column:
    """1 or 0 of a label's name, null of any other."""
    return F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])[label]


def training_table(df: DataFrame, versions: dict[str, str]) -> DataFrame:
    """``df`` with ``y``, or an error that says what is wrong: missing columns, rows not ok, versions, labels.

    ``versions`` gives the one value that each version column may have. All checks are one aggregate.
    """
    missing = sorted({"split_role", "label", "status", *versions} - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    y, other = label_number(F.col("label")), lambda c: F.slice(F.array_sort(F.collect_set(c)), 1, 10)
    seen = df.agg(
        F.count_if(~F.col("status").eqNullSafe(F.lit("ok"))).alias("bad"), other(F.when(y.isNull(), F.coalesce("label", F.lit("null")))).alias("labels"),
        *[other(F.when(F.col(c) != v, F.col(c).cast("string"))).alias(f"not_{c}") for c, v in versions.items()], *[F.count_if(F.col(c).cast("string") == v).alias(f"is_{c}") for c, v in versions.items()],
    ).first()
    if seen["bad"]:
        raise ValueError(f"{seen['bad']} rows are not ok")
    for c, v in versions.items():
        if seen[f"not_{c}"] or not seen[f"is_{c}"]:
            raise ValueError(f"{c} must be {v!r} alone, found {seen[f'not_{c}']}")
    if seen["labels"]:
        raise ValueError(f"unknown labels: {seen['labels']}")
    return df.withColumn("y", y)


def split_frames(df: DataFrame, roles: tuple[str, ...] = ROLES) -> dict[str, DataFrame]:
    """The rows of every role, or an error that names the roles without rows."""
    there = {r["split_role"] for r in df.filter(F.col("split_role").isin(*roles)).select("split_role").distinct().collect()}
    if len(there) < len(roles):
        raise ValueError(f"no rows for {[r for r in roles if r not in there]}")
    return {r: df.filter(F.col("split_role") == r) for r in roles}


def accepted(manifest: DataFrame, dataset: str, version: str, renames: dict[str, str]) -> DataFrame:
    """Accepted rows whose patch was saved, renamed, with the data set's name and the version where it is missing."""
    d = manifest.filter((F.col("status") == "ACCEPTED") & F.col("saved_patch")).withColumnsRenamed(renames)
    return d.withColumns({"dataset_name": F.lit(dataset), "preprocess_version": F.coalesce("preprocess_version", F.lit(version))})


def nuisance_rows(df: DataFrame, subsampling: Column) -> DataFrame:
    """Real rows of known subsampling, with ``nuisance_is_420``."""
    return df.withColumn("nuisance_is_420", F.when(subsampling == "4:2:0", 1).when(subsampling == "4:4:4", 0)).filter((F.col("y") == 0) & F.col("nuisance_is_420").isNotNull())


def subsampling_label(subsampling: Column) -> Column:
    """1 for 4:4:4 and 0 for 4:2:0, the other way round than ``nuisance_is_420``."""
    return F.when(subsampling == "4:4:4", 1).when(subsampling == "4:2:0", 0)


def usage_flags(feature_set: Column) -> dict[str, Column]:
    """Which branches a feature set uses."""
    return {name: F.coalesce(feature_set.isin(*sets), F.lit(False)) for name, sets in USES.items()}


def strict_gate(clean: Column, nuisance: Column, shift: Column) -> Column:
    """Whether a feature tells the label, not the nuisance, and keeps its place under degradation; false where a value is missing."""
    return F.coalesce((clean > 0.75) & (nuisance < 0.65) & (shift < 1.0) & ~F.isnan(clean) & ~F.isnan(nuisance) & ~F.isnan(shift), F.lit(False))


def payload_status(content: Column, most: int = MOST_BYTES) -> Column:
    """``ok``, ``empty`` or ``too large`` of a file's bytes."""
    n = F.coalesce(F.octet_length(content), F.lit(0))
    return F.when(n == 0, "empty").when(n > most, "too large").otherwise("ok")


def union_of_keys(*lists: list[str]) -> list[str]:
    """Every key once, in the order in which they first appear."""
    return list(dict.fromkeys(k for ks in lists for k in ks))


def numbers(df: DataFrame, cols: list[str]) -> DataFrame:
    """Columns read as numbers, null where they are none."""
    return df.withColumns({c: F.expr(f"try_cast(`{c}` AS double)") for c in cols})


def summary(df: DataFrame, value: str) -> DataFrame:
    """Per split and generator: rows, errors, missing values, and mean, deviation and tenth, middle and ninetieth percentile of ``value``."""
    from tessera.operators.ordered import quantiles

    keys, good = ["split_role", "generator"], F.when(~F.isnan(value), F.col(value))
    s = df.groupBy(*keys).agg(F.count("*").alias("rows"), F.count_if(F.col("status") != "ok").alias("errors"), (F.count("*") - F.count(good)).alias("missing"), F.avg(good).alias("mean"), F.stddev_pop(good).alias("std"))
    q = quantiles(df, value, [0.1, 0.5, 0.9], keys).drop("n").withColumnsRenamed({"q0": "q10", "q1": "q50", "q2": "q90"})
    return s.alias("s").join(q.alias("q"), F.col("s.split_role").eqNullSafe(F.col("q.split_role")) & F.col("s.generator").eqNullSafe(F.col("q.generator")), "left").select("s.*", "q.q10", "q.q50", "q.q90")


def vector(df: DataFrame, names: list[str]) -> Column:
    """The named columns in their order as an array of doubles; what is null or not there is NaN."""
    return F.array(*[F.coalesce(F.col(n).cast("double"), F.lit(float("nan"))) if n in df.columns else F.lit(float("nan")) for n in names])
