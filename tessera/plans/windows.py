"""Further queries of signal operators over embeddings, read as 8 x 8 patches: fits, windows, spectra, masks, details."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tessera.operators import patches as P
from tessera.operators.kernels import tukey
from tessera.operators.study import keep_mask
from tessera.plans.patches import _RADIUS, PIXELS, centred, conv_sql, patch
from tessera.plans.registry import query


@query("patch_line", PIXELS + " SELECT vec_id, round(CASE WHEN stddev_pop(v) < 1e-8 THEN 0 ELSE regr_slope(v, r * 8 + c) END, 9) AS slope, round(CASE WHEN stddev_pop(v) < 1e-8 THEN 0 ELSE regr_r2(v, r * 8 + c) END, 6) AS r2 FROM px GROUP BY 1")
def patch_line(spark, sf_dir):
    """The line through a patch's values in their order, and how much it explains; zeros for a constant patch."""
    x = [k - 31.5 for k in range(64)]
    whole = sum(v * v for v in x)
    along = P.total(F.zip_with("a", F.array(*[F.lit(v) for v in x]), lambda v, w: v * w))
    both = F.struct((along / whole).alias("slope"), P.variance(F.col("a")).alias("var"))
    d = patch(spark, sf_dir).select("vec_id", both.alias("f"))
    flat = F.sqrt("f.var") < P.EPS
    return d.select("vec_id", F.round(F.when(flat, 0.0).otherwise(F.col("f.slope")), 9).alias("slope"), F.round(F.when(flat, 0.0).otherwise(F.col("f.slope") * F.col("f.slope") * (whole / 64) / F.col("f.var")), 6).alias("r2"))


@query("patch_falls", PIXELS + ", m AS (SELECT vec_id, r, avg(v) AS m FROM px GROUP BY 1, 2), l AS (SELECT vec_id, m < lag(m) OVER (PARTITION BY vec_id ORDER BY r) AS falls FROM m) SELECT vec_id, round(avg(falls::INT), 6) AS share FROM l WHERE falls IS NOT NULL GROUP BY 1")
def patch_falls(spark, sf_dir):
    """Share of falls between the means of successive eighths of a patch."""
    means = F.array(*[P.mean(F.slice("a", 8 * k + 1, 8)) for k in range(8)])
    d = patch(spark, sf_dir).select("vec_id", means.alias("m"))
    return d.select("vec_id", F.round(sum((F.get("m", k + 1) < F.get("m", k)).cast("int") for k in range(7)) / 7.0, 6).alias("share"))


@query("patch_centre", PIXELS + " SELECT vec_id, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM px WHERE r BETWEEN 2 AND 5 AND c BETWEEN 2 AND 5 GROUP BY 1")
def patch_centre(spark, sf_dir):
    """Mean and deviation of the central quarter."""
    middle = F.concat(*[F.slice("a", 8 * r + 3, 4) for r in range(2, 6)])
    d = patch(spark, sf_dir).select("vec_id", middle.alias("m"))
    return d.select("vec_id", F.round(P.mean(F.col("m")), 6).alias("mean"), F.round(F.sqrt(P.variance(F.col("m"))), 6).alias("std"))


_TUKEY = "(CASE WHEN least({x}, 1 - {x}) < 0.125 THEN 0.5 * (1 + cos(pi() * (2 * least({x}, 1 - {x}) / 0.25 - 1))) ELSE 1 END)"


@query("patch_window", f"{PIXELS}, m AS (SELECT vec_id, avg(v) AS m FROM px GROUP BY 1), w AS (SELECT vec_id, (v - m) * {_TUKEY.format(x='(r / 7.0::DOUBLE)')} * {_TUKEY.format(x='(c / 7.0::DOUBLE)')} AS v FROM px JOIN m USING (vec_id)) SELECT vec_id, round(avg(v * v), 6) AS energy FROM w GROUP BY 1")
def patch_window(spark, sf_dir):
    """Energy of the mean-removed patch under a Tukey window."""
    w = F.array(*[F.lit(float(x)) for x in tukey(8).ravel()])
    return centred(spark, sf_dir).select("vec_id", F.round(P.total(F.zip_with("c", w, lambda x, y: x * y * x * y)) / 64, 6).alias("energy"))


_SPECTRUM = f"{PIXELS}, m AS (SELECT vec_id, avg(v) AS m FROM px GROUP BY 1), c AS (SELECT vec_id, r, c, v - m AS v FROM px JOIN m USING (vec_id)), g AS (SELECT a.u, b.w FROM (SELECT unnest(range(8)) AS u) a, (SELECT unnest(range(8)) AS w) b), p AS (SELECT vec_id, u, w, (sum(v * cos(2 * pi() * (u * r + w * c) / 8)) ** 2 + sum(v * sin(2 * pi() * (u * r + w * c) / 8)) ** 2) / 4096 AS p FROM c, g GROUP BY 1, 2, 3)"
_F = [k / 8 if k < 4 else k / 8 - 1 for k in range(8)]


def _mean_power(places):
    """Mean power of a mean-removed patch over frequencies; opposite ones have the same."""
    return sum((P.power_at(F.col("c"), 8, u, v) for u, v in places), F.lit(0.0)) / len(places)


@query("patch_rings", f"{_SPECTRUM}, k AS (SELECT vec_id, p, least(3, floor({_RADIUS} / 0.15))::INT AS ring FROM p) SELECT vec_id, " + ", ".join(f"round(avg(p) FILTER (ring = {k}), 9) AS ring{k}" for k in range(4)) + " FROM k GROUP BY 1")
def patch_rings(spark, sf_dir):
    """Mean power at four ranges of radius."""
    rings = [[(u, v) for u in range(8) for v in range(8) if min(3, int(math.hypot(_F[u], _F[v]) / 0.15)) == k] for k in range(4)]
    return centred(spark, sf_dir).select("vec_id", *[F.round(_mean_power(ps), 9).alias(f"ring{k}") for k, ps in enumerate(rings)])


@query("patch_survival", f"{_SPECTRUM} SELECT vec_id, round(log10((avg(p) FILTER ({_RADIUS} >= 0.32 AND {_RADIUS} < 0.46) + 1e-8) / (avg(p) FILTER ({_RADIUS} >= 0.12 AND {_RADIUS} < 0.32) + 1e-8)), 6) AS survival FROM p GROUP BY 1")
def patch_survival(spark, sf_dir):
    """High over middle frequencies, as a logarithm."""
    c = F.col("c")
    return centred(spark, sf_dir).select("vec_id", F.round(F.log10((P.band_energy(c, 8, 0.32, 0.46) + P.EPS) / (P.band_energy(c, 8, 0.12, 0.32) + P.EPS)), 6).alias("survival"))


@query("patch_highband", f"{_SPECTRUM} SELECT vec_id, round(sum(p) FILTER (least(u, 8 - u) > 2 OR least(w, 8 - w) > 2) / (sum(p) + 1e-12), 6) AS share FROM p GROUP BY 1")
def patch_highband(spark, sf_dir):
    """Share of the power outside the central half of the spectrum; the whole is the patch's energy."""
    far = [(u, v) for u in range(8) for v in range(8) if min(u, 8 - u) > 2 or min(v, 8 - v) > 2]
    return centred(spark, sf_dir).select("vec_id", F.round(_mean_power(far) * len(far) / (P.total(F.col("c"), lambda x: x * x) / 64 + 1e-12), 6).alias("share"))


_RING = [(-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1)]


@query(
    "patch_lbp_entropy",
    PIXELS + ", n AS (SELECT p.vec_id, p.r, p.c, k, (q.v >= p.v)::INT AS b FROM px p JOIN (VALUES " + ", ".join(f"({k}, {r}, {c})" for k, (r, c) in enumerate(_RING)) + ") o(k, dr, dc) ON p.r BETWEEN 1 AND 6 AND p.c BETWEEN 1 AND 6 JOIN px q ON q.vec_id = p.vec_id AND q.r = p.r + dr AND q.c = p.c + dc), t AS (SELECT a.vec_id, a.r, a.c, sum((a.b <> b.b)::INT) AS t, sum(a.b * 2 ** a.k) AS code FROM n a JOIN n b ON a.vec_id = b.vec_id AND a.r = b.r AND a.c = b.c AND b.k = (a.k + 1) % 8 GROUP BY 1, 2, 3), h AS (SELECT vec_id, CASE WHEN t > 2 THEN -1 ELSE code END AS code, count(*) / 36.0::DOUBLE AS p FROM t GROUP BY 1, 2) SELECT vec_id, round(-sum(p * log2(p)), 6) AS entropy FROM h GROUP BY 1",
)
def patch_lbp_entropy(spark, sf_dir):
    """Entropy of the patterns of eight neighbours, those that change more than twice being one."""

    def code(i):
        base = (F.floor(i / 6) + 1) * 8 + i % 6 + 1
        bits = [(P.at(F.col("a"), base + r * 8 + c) >= P.at(F.col("a"), base)).cast("int") for r, c in _RING]
        turns = sum((F.abs(bits[k] - bits[(k + 1) % 8]) for k in range(1, 8)), F.abs(bits[0] - bits[1]))
        return F.when(turns > 2, -1).otherwise(sum((b * (1 << k) for k, b in enumerate(bits)), F.lit(0)))

    d = patch(spark, sf_dir).select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(35)), code).alias("codes"))
    d = d.select("vec_id", F.transform(F.array_distinct("codes"), lambda k: F.size(F.filter("codes", lambda x: x == k)) / F.lit(36.0)).alias("p"))
    return d.select("vec_id", F.round(-P.total(F.transform("p", lambda p: p * F.log2(p))), 6).alias("entropy"))


_KEPT = [(r, c) for r in range(6) for c in range(6) if keep_mask((8, 8), (0,))[r + 1, c + 1]]


@query("patch_masked_noise", f"{PIXELS}, f AS ({conv_sql(P.SQUARE3)}) SELECT vec_id, round(avg(abs(v)), 6) AS mar, round(avg(v * v), 6) AS energy FROM f WHERE (r + 1) % 8 BETWEEN 2 AND 6 AND (c + 1) % 8 BETWEEN 2 AND 6 GROUP BY 1")
def patch_masked_noise(spark, sf_dir):
    """Residual sizes off the lines of an eight-pixel grid."""
    kept = F.array(*[F.get("f", 6 * r + c) for r, c in _KEPT])
    d = patch(spark, sf_dir).select("vec_id", P.convolved(F.col("a"), 8, P.SQUARE3).alias("f")).select("vec_id", kept.alias("k"))
    return d.select("vec_id", F.round(P.total(F.col("k"), F.abs) / F.size("k"), 6).alias("mar"), F.round(P.total(F.col("k"), lambda x: x * x) / F.size("k"), 6).alias("energy"))


def _step(source: str, v: str) -> str:
    """One orthonormal Haar step of column ``v``: the low band and the sizes of horizontal and diagonal details."""
    q = f"sum(CASE WHEN r % 2 = {{0}} AND c % 2 = {{1}} THEN {v} END)"
    p, x, y, z = (q.format(a, b) for a, b in ((0, 0), (0, 1), (1, 0), (1, 1)))
    return f"SELECT vec_id, r // 2 AS r, c // 2 AS c, ({p} + {x} + {y} + {z}) / 2 AS low, abs({p} - {x} + {y} - {z}) / 2 AS h, abs({p} - {x} - {y} + {z}) / 2 AS d FROM {source} GROUP BY 1, 2, 3"


_CORR = "round(coalesce(covar_pop(g.{0}, p.{0}) * 4 / (sqrt(var_pop(g.{0}) * 4 * var_pop(p.{0}) * 4) + 1e-12), 0), 5)"


@query("patch_parents", f"{PIXELS}, fine AS ({_step('px', 'v')}), coarse AS ({_step('fine', 'low')}), g AS (SELECT vec_id, r // 2 AS r, c // 2 AS c, avg(h) AS h, avg(d) AS d FROM fine GROUP BY 1, 2, 3) SELECT g.vec_id, {_CORR.format('h')} AS h, {_CORR.format('d')} AS d FROM g JOIN coarse p USING (vec_id, r, c) GROUP BY 1")
def patch_parents(spark, sf_dir):
    """How the sizes of fine details, averaged two by two, go with those of the coarse ones, for two directions."""
    low, fine = P.haar(F.col("a"), 8)
    d = patch(spark, sf_dir).select("vec_id", low.alias("low"), fine.alias("fine"))
    d = d.select("vec_id", "fine", P.haar(F.col("low"), 4)[1].alias("coarse"))

    def corr(k: int):
        quad = lambda i: sum((F.abs(F.get("fine", 16 * k + 8 * (i // 2) + 2 * (i % 2) + o)) for o in (0, 1, 4, 5)), F.lit(0.0)) / 4 * 2
        child, parent = F.array(*[quad(i) for i in range(4)]), F.transform(F.slice("coarse", 4 * k + 1, 4), lambda x: F.abs(x) * 4)
        both = F.struct(child.alias("g"), parent.alias("p"), P.mean(child).alias("mg"), P.mean(parent).alias("mp"))
        sums = P.bound(both, lambda s: F.struct(P.total(F.zip_with(s["g"], s["p"], lambda x, y: (x - s["mg"]) * (y - s["mp"]))).alias("c"), P.total(s["g"], lambda x: (x - s["mg"]) * (x - s["mg"])).alias("g"), P.total(s["p"], lambda y: (y - s["mp"]) * (y - s["mp"])).alias("p")))
        return P.bound(sums, lambda s: F.round(s["c"] / (F.sqrt(s["g"] * s["p"]) + 1e-12), 5))

    return d.select("vec_id", corr(0).alias("h"), corr(2).alias("d"))


@query("patch_mirrored_box", PIXELS + ", o AS (SELECT unnest([-1, 0, 1]) AS d), n AS (SELECT p.vec_id, p.r, p.c, abs(p.r + a.d) AS i, abs(p.c + b.d) AS j FROM px p, o a, o b), k AS (SELECT vec_id, r, c, CASE WHEN i > 7 THEN 14 - i ELSE i END AS i, CASE WHEN j > 7 THEN 14 - j ELSE j END AS j FROM n), b AS (SELECT k.vec_id, k.r, k.c, avg(px.v) AS v FROM k JOIN px ON px.vec_id = k.vec_id AND px.r = k.i AND px.c = k.j GROUP BY 1, 2, 3) SELECT vec_id, round(max(v), 6) AS top, round(min(v), 6) AS low FROM b GROUP BY 1")
def patch_mirrored_box(spark, sf_dir):
    """Means over three by three neighbours, the borders mirrored without their edge."""
    fold = lambda k: 14 - abs(k) if abs(k) > 7 else abs(k)
    means = [sum((F.get("a", 8 * fold(r + i) + fold(c + j)) for i in (-1, 0, 1) for j in (-1, 0, 1)), F.lit(0.0)) / 9 for r in range(8) for c in range(8)]
    d = patch(spark, sf_dir).select("vec_id", F.array(*means).alias("b"))
    return d.select("vec_id", F.round(F.array_max("b"), 6).alias("top"), F.round(F.array_min("b"), 6).alias("low"))


@query("patch_cross_noise", f"{PIXELS}, f AS ({conv_sql(P.SQUARE3)}) SELECT vec_id, round((avg(abs(v)) FILTER (r < 3) + 1e-3) / (avg(abs(v)) FILTER (r >= 3) + 1e-3), 5) AS ratio FROM f GROUP BY 1")
def patch_cross_noise(spark, sf_dir):
    """Noise of one half over that of the other."""
    d = patch(spark, sf_dir).select("vec_id", P.convolved(F.col("a"), 8, P.SQUARE3).alias("f"))
    half = lambda k: P.total(F.slice("f", k, 18), F.abs) / 18 + 1e-3
    return d.select("vec_id", F.round(half(1) / half(19), 5).alias("ratio"))
