"""Classifiers on feature tables: fitting, calibration, cross-validation, ablation, scoring."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import route, safe_logit
from tessera.operators.metrics import auc, bootstrap_delta, ece, threshold_at_fpr
from tessera.operators.sampling import folds
from tessera.session import scratch_dir


def balanced(df: DataFrame, label: str = "y") -> DataFrame:
    """``df`` with the column ``weight`` that gives both classes half of the mass."""
    n = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    total = sum(n.values())
    return df.withColumn("weight", sum((F.when(F.col(label) == k, total / (len(n) * v)).otherwise(0.0) for k, v in n.items()), F.lit(0.0)))


def build(kind: str, features: list[str], total_weight: float) -> Pipeline:
    """``logreg`` (median imputation, standardised, C = 1), ``plain`` (neither standardised nor weighted) or ``gbt``."""
    filled = [f"{f}__filled" for f in features]
    stages = [Imputer(inputCols=features, outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="raw_features")]
    if kind == "logreg":
        stages += [StandardScaler(inputCol="raw_features", outputCol="features", withMean=True), LogisticRegression(labelCol="y", weightCol="weight", regParam=1 / max(total_weight, 1.0), elasticNetParam=0.0, standardization=False, maxIter=200)]
    elif kind == "plain":
        stages += [LogisticRegression(featuresCol="raw_features", labelCol="y", regParam=1 / max(total_weight, 1.0), elasticNetParam=0.0, standardization=False, maxIter=200)]
    else:
        stages += [GBTClassifier(featuresCol="raw_features", labelCol="y", weightCol="weight", maxIter=400, stepSize=0.05, maxDepth=5, minInstancesPerNode=80, featureSubsetStrategy="0.8", seed=42)]
    return Pipeline(stages=stages)


def fit(df: DataFrame, features: list[str], kind: str = "logreg") -> PipelineModel:
    d, sc = balanced(df), df.sparkSession.sparkContext
    if kind == "gbt" and sc.getCheckpointDir() is None:  # boosting cuts its lineage every ten rounds
        sc.setCheckpointDir(scratch_dir(df.sparkSession))
    return build(kind, features, float(df.count())).fit(d)


def raw_scores(model: PipelineModel, df: DataFrame, id_cols: list[str]) -> DataFrame:
    """id columns and ``raw_score``, the margin of class 1."""
    out = model.transform(df.withColumn("weight", F.lit(1.0)) if "weight" not in df.columns else df)
    return out.select(*id_cols, vector_to_array("rawPrediction")[1].alias("raw_score"))


def platt(scores: DataFrame, label: str = "y") -> tuple[float, float]:
    """Slope and intercept of the logistic curve of labels on raw scores."""
    n = scores.count()
    d = VectorAssembler(inputCols=["raw_score"], outputCol="x").transform(scores)
    m = LogisticRegression(featuresCol="x", labelCol=label, regParam=1 / max(n, 1), standardization=False, maxIter=200).fit(d)
    return float(m.coefficients[0]), float(m.intercept)


def calibrated(score: Column, a: float, b: float) -> Column:
    return 1 / (1 + F.exp(-(a * score + b)))


def leave_one_group_out(df: DataFrame, features: list[str], group: str, id_cols: list[str], kind: str = "logreg") -> DataFrame:
    """Raw scores of every group from a model of the others; the loop is over groups, not rows."""
    out = None
    for g in sorted(r[0] for r in df.select(group).distinct().collect()):
        part = raw_scores(fit(df.filter(F.col(group) != g), features, kind), df.filter(F.col(group) == g), [*id_cols, "y", group])
        out = part if out is None else out.unionByName(part)
    return out


def cross_degradation(clean: DataFrame, degraded: DataFrame, features: list[str], group: str, id_cols: list[str], kind: str = "logreg") -> DataFrame:
    """Raw scores of every group's degraded rows from a model of the other groups' clean rows."""
    out = None
    for g in sorted(r[0] for r in clean.select(group).distinct().collect()):
        part = raw_scores(fit(clean.filter(F.col(group) != g), features, kind), degraded.filter(F.col(group) == g), [*id_cols, "y", group])
        out = part if out is None else out.unionByName(part)
    return out


def cross_validated_auc(df: DataFrame, features: list[str], id_col: str, kind: str = "logreg", k: int = 5) -> float:
    """AUC of the probabilities that each row gets from a model of the other folds, pooled over stratified folds."""
    d, out = df.join(folds(df, "y", id_col, k).select(id_col, "fold"), id_col), None
    for f in range(k):
        part = raw_scores(fit(d.filter(F.col("fold") != f), features, kind), d.filter(F.col("fold") == f), ["y"])
        out = part if out is None else out.unionByName(part)
    return auc(out.withColumn("p", calibrated(F.col("raw_score"), 1.0, 0.0)), "y", "p").first()["auc"]


def evaluated_auc(df: DataFrame, features: list[str], group: str, id_col: str, kind: str = "logreg") -> float:
    """AUC of scores from models of the other groups, or of stratified folds where there are fewer than three groups."""
    if df.select(group).distinct().count() < 3:
        return cross_validated_auc(df, features, id_col, kind)
    return auc(leave_one_group_out(df, features, group, [id_col], kind), "y", "raw_score").first()["auc"]


def candidates(train: DataFrame, calibration: DataFrame, validation: DataFrame, sets: dict[str, list[str]], kinds: tuple[str, ...] = ("logreg", "gbt"), target: float = 0.05) -> DataFrame:
    """Every feature set with every kind of model: calibrated, and measured on the validation rows, best first."""
    rows = []
    for name, features in sets.items():
        for kind in kinds:
            m = fit(train, features, kind)
            a, b = platt(raw_scores(m, calibration, ["y"]))
            p = raw_scores(m, validation, ["y"]).withColumn("p", calibrated(F.col("raw_score"), a, b))
            tau = threshold_at_fpr(p, "y", "p", target).first()["threshold"]
            hit, y = F.col("p") >= tau, F.col("y") == 1
            c = p.agg(F.avg((F.col("p") - F.col("y")) ** 2).alias("brier"), F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"), F.count_if(y).alias("pos"), F.count("*").alias("n")).first()
            tn = c["n"] - c["pos"] - c["fp"]
            share = lambda u, v: u / v if v else None
            rows.append((f"{name}__{kind}", name, kind, len(features), auc(p, "y", "p").first()["auc"], c["brier"], ece(p, "y", "p").first()["ece"], float(tau), share(c["tp"], c["pos"]), share(c["fp"], c["n"] - c["pos"]), share(c["tp"], c["tp"] + c["fp"]), share(c["tp"] + tn, c["n"])))
    schema = "candidate string, feature_set string, kind string, n_features int, auc double, brier double, ece double, threshold double, tpr double, fpr double, precision double, accuracy double"
    return train.sparkSession.createDataFrame(rows, schema).orderBy(F.desc("auc"), "brier", "n_features")


def ablation_intervals(train: DataFrame, test: DataFrame, features: list[str], families: dict[str, list[str]], id_col: str, kind: str = "logreg", replicates: int = 2000) -> DataFrame:
    """Per family, AUC of all features less that without it (drop) and with it alone (solo), with paired intervals."""
    score = lambda kept: raw_scores(fit(train, kept, kind), test, [id_col, "y"])
    full, out = score(features).withColumnRenamed("raw_score", "full"), None
    for name, family in families.items():
        for mode, kept in (("drop", [f for f in features if f not in family]), ("solo", [f for f in features if f in family])):
            if not kept:
                continue
            pair = full.join(score(kept).select(id_col, F.col("raw_score").alias("part")), id_col)
            row = bootstrap_delta(pair, "y", "full", "part", id_col, replicates).select(F.lit(name).alias("family"), F.lit(mode).alias("mode"), F.lit(len(kept)).alias("n_features"), "*")
            out = row if out is None else out.unionByName(row)
    return out


def logo_bootstrap(df: DataFrame, sets: dict[str, list[str]], comparisons: list[tuple[str, str]], group: str, id_col: str, kind: str = "logreg", replicates: int = 1000) -> DataFrame:
    """Paired AUC differences of feature sets whose scores come from models of the other groups."""
    scores = {n: leave_one_group_out(df, fs, group, [id_col], kind).select(id_col, "y", F.col("raw_score").alias(n)) for n, fs in sets.items()}
    out = None
    for a, b in comparisons:
        pair = scores[a].join(scores[b].drop("y"), id_col)
        part = bootstrap_delta(pair, "y", a, b, id_col, replicates).select(F.lit(a).alias("set_a"), F.lit(b).alias("set_b"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def ablation(train: DataFrame, test: DataFrame, features: list[str], families: dict[str, list[str]], kind: str = "logreg") -> DataFrame:
    """AUC with all features and without each family, and the difference."""
    spark, rows = train.sparkSession, []
    for name, gone in {"full": [], **families}.items():
        kept = [f for f in features if f not in gone]
        rows.append((name, len(kept), auc(raw_scores(fit(train, kept, kind), test, ["y"]), "y", "raw_score").first()["auc"]))
    full = rows[0][2]
    return spark.createDataFrame([(n, k, a, a - full) for n, k, a in rows], "branch string, n_features int, auc double, delta double")


def importance(model: PipelineModel, features: list[str]) -> list[tuple[str, float]]:
    """Absolute coefficients, or gains of a boosted model, largest first."""
    last = model.stages[-1]
    v = last.coefficients.toArray() if hasattr(last, "coefficients") else last.featureImportances.toArray()
    return sorted(((f, abs(float(x))) for f, x in zip(features, v, strict=True)), key=lambda x: (-x[1], x[0]))


def lock_threshold(calibration: DataFrame, a: float, b: float, target: float = 0.05) -> float:
    p = calibration.select("y", calibrated(F.col("raw_score"), a, b).alias("p"))
    return threshold_at_fpr(p, "y", "p", target).first()["threshold"]


def scored(model: PipelineModel, df: DataFrame, id_cols: list[str], a: float, b: float, tau: float) -> DataFrame:
    """Ids, raw score, probability, its logit, and the route."""
    s = raw_scores(model, df, id_cols).withColumn("prob", calibrated(F.col("raw_score"), a, b))
    return s.select(*id_cols, "raw_score", "prob", safe_logit(F.col("prob")).alias("logit"), (F.col("prob") >= tau).cast("int").alias("pred"), route(F.col("prob"), F.lit(tau)).alias("route"))


def contributions(df: DataFrame, id_cols: list[str], features: list[str], weights: list[float], top: int = 3) -> DataFrame:
    """The ``top`` features of each row by |weight x value|, with their shares."""
    parts = F.array(*[F.struct((-F.abs(F.col(f) * w)).alias("k"), F.lit(f).alias("feature"), (F.col(f) * w).alias("value")) for f, w in zip(features, weights, strict=True)])
    total = F.aggregate(parts, F.lit(0.0), lambda s, x: s - x["k"])
    best = F.slice(F.array_sort(parts), 1, top)
    return df.select(*id_cols, F.transform(best, lambda x: F.struct(x["feature"].alias("feature"), x["value"].alias("value"), (-x["k"] / total).alias("share"))).alias("top"))
