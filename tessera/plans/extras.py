"""Further queries: periodicity, quality of quantisation tables, rankings, ratios."""

from __future__ import annotations

from statistics import NormalDist

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import scalars as X
from tessera.operators import metrics as M
from tessera.operators import patches as P
from tessera.operators import shortcuts
from tessera.operators.kernels import LUMA
from tessera.plans.evaluation import FEATURED, _FEATURES, featured, mid_rank_auc
from tessera.plans.patches import PIXELS, centred
from tessera.plans.registry import query
from tessera.plans.relational import embeddings, pages


def _periodic(name: str, sign: str) -> str:
    return f"round(sum(v * (CASE WHEN {sign} % 2 = 0 THEN 1 ELSE -1 END)) ** 2 / (sum(v * v) * 64 + 1e-8), 6) AS {name}"


@query("patch_periodicity", f"{PIXELS}, m AS (SELECT vec_id, avg(v) AS m FROM px GROUP BY 1), c AS (SELECT vec_id, r, c, v - m AS v FROM px JOIN m USING (vec_id)) SELECT vec_id, {_periodic('pi_x', 'c')}, {_periodic('pi_y', 'r')}, {_periodic('pi_xy', '(r + c)')} FROM c GROUP BY 1")
def patch_periodicity(spark, sf_dir):
    """Energy at the three two-pixel waves of a mean-removed patch."""
    d = centred(spark, sf_dir)
    energy = P.total(F.col("c"), lambda x: x * x)

    def wave(parity):
        w = F.array(*[F.lit(1.0 if parity(i // 8, i % 8) % 2 == 0 else -1.0) for i in range(64)])
        s = P.total(F.zip_with("c", w, lambda x, y: x * y))
        return F.round(s * s / (energy * 64 + P.EPS), 6)

    return d.select("vec_id", wave(lambda r, c: c).alias("pi_x"), wave(lambda r, c: r).alias("pi_y"), wave(lambda r, c: r + c).alias("pi_xy"))


@query(
    "jpeg_quality",
    f"WITH t AS (SELECT vec_id, list_transform(embedding, lambda x: abs(CAST(floor(x * 100) AS INTEGER)) + 1) AS q FROM embeddings), a AS (SELECT vec_id, list_sum(list_transform(range(1, 65), lambda i: q[i] * 100.0::DOUBLE / ({LUMA!r})[i])) / 64 AS a FROM t) SELECT vec_id, least(100, greatest(1, CAST(CASE WHEN a >= 100 THEN round_even(5000 / a, 0) ELSE round_even((200 - a) / 2, 0) END AS INTEGER))) AS quality FROM a",
)
def jpeg_quality(spark, sf_dir):
    t = F.transform("embedding", lambda x: F.abs(F.floor(x.cast("double") * 100).cast("int")) + 1)
    return embeddings(spark, sf_dir).select("vec_id", X.jpeg_quality(t, LUMA).alias("quality"))


_MISSING = "CASE WHEN quality = 0 AND n_lines > 2 THEN NULL ELSE n_caps END"
_RANKED = {**{c: c for c in _FEATURES}, "caps_missing": _MISSING, "n_half": "n_words / 2 + n_lines"}
_PAIRS = " UNION ALL ".join(f"SELECT '{c}' AS feature, corr({e}, quality) AS r, abs(avg((({e}) IS NULL)::INT) FILTER (quality = 1) - avg((({e}) IS NULL)::INT) FILTER (quality = 0)) AS gap FROM f" for c, e in _RANKED.items())


def _ranked_features(spark, sf_dir):
    return featured(spark, sf_dir).select("quality", *[F.expr(e).alias(c) for c, e in _RANKED.items()])


@query("label_correlation_ranking", f"{FEATURED}, c AS ({_PAIRS}), s AS (SELECT feature, round(r, 6) AS corr, round(gap, 6) AS missing_gap, round(greatest(abs(r), gap), 6) AS score FROM c) SELECT *, row_number() OVER (ORDER BY score DESC, feature)::INT AS rank FROM s ORDER BY rank LIMIT 20")
def label_correlation_ranking(spark, sf_dir):
    """The twenty features that tell most of the label, by correlation or by where they are missing: a report."""
    r = shortcuts.label_ranking(_ranked_features(spark, sf_dir), "quality", list(_RANKED))
    r = r.select("feature", F.round("corr", 6).alias("corr"), F.round("missing_gap", 6).alias("missing_gap"), F.round("score", 6).alias("score"))
    return r.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "feature")))  # a row per feature


_COMBINED = " UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr({x}, {y}), 6) AS corr, count(*) FILTER (({x}) IS NOT NULL AND ({y}) IS NOT NULL) AS n FROM f" for i, (a, x) in enumerate(_RANKED.items()) for b, y in list(_RANKED.items())[i + 1 :])


@query("correlated_pairs", f"{FEATURED}, c AS ({_COMBINED}) SELECT * FROM c WHERE abs(corr) >= 0.8")
def correlated_pairs(spark, sf_dir):
    """Pairs of features that say nearly the same."""
    return shortcuts.correlated_pairs(_ranked_features(spark, sf_dir), list(_RANKED)).withColumn("corr", F.round("corr", 6))


_TWO = " UNION ALL ".join(f"SELECT '{f}' AS feature, '{s}' AS slice, {y} AS y, {f} AS x FROM f" for f in _FEATURES for s, y in (("clean", "quality"), ("nat", "toxic")))


@query("chance_corrected_ratio", f"{FEATURED}, u AS ({_TWO}), a AS ({mid_rank_auc('feature, slice', 'y', 'x', 'u')}) SELECT feature, round(abs(max(auc) FILTER (slice = 'clean') - 0.5) / (abs(max(auc) FILTER (slice = 'nat') - 0.5) + 1e-12), 5) AS ratio FROM a GROUP BY 1")
def chance_corrected_ratio(spark, sf_dir):
    a = M.feature_audit(featured(spark, sf_dir), _FEATURES, {"clean": (F.lit(True), "quality"), "nat": (F.lit(True), "toxic")}).withColumn("auc", F.round("auc", 9))
    of = lambda s: F.max(F.when(F.col("slice") == s, F.col("auc")))
    return a.groupBy("feature").agg(F.round(F.abs(of("clean") - 0.5) / (F.abs(of("nat") - 0.5) + 1e-12), 5).alias("ratio"))


@query("path_first_part", "WITH p AS (SELECT page_id, list_filter(list_transform(string_split(url, '/')[1:-2], lambda x: CASE lower(x) WHEN 'en' THEN 'ai' WHEN 'de' THEN 'nature' WHEN 'fr' THEN 'nature' END), lambda x: x IS NOT NULL) AS v FROM pages) SELECT page_id, coalesce(v[1], '-') AS label FROM p")
def path_first_part(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", F.coalesce(X.first_part(F.col("url"), {"en": "ai", "de": "nature", "fr": "nature"}), F.lit("-")).alias("label"))


def d_prime(auc):
    """sqrt(2) times the normal quantile of an AUC, as a vectorised function (a handful of rows)."""

    @F.pandas_udf("double")
    def run(a: pd.Series) -> pd.Series:
        return a.map(lambda x: 2**0.5 * NormalDist().inv_cdf(min(max(x, 1e-12), 1 - 1e-12)))

    return run(auc)


def tpr_at_fpr5(auc):
    """True-positive rate at 5 % false positives under equal normal deviations."""

    @F.pandas_udf("double")
    def run(d: pd.Series) -> pd.Series:
        return d.map(lambda x: NormalDist().cdf(x - NormalDist().inv_cdf(0.95)))

    return run(d_prime(auc))
