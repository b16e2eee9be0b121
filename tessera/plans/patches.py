"""Queries of the signal operators over embeddings, read as 8 x 8 patches."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import patches as P
from tessera.plans.registry import query
from tessera.plans.relational import embeddings

PIXELS = "WITH px AS (SELECT vec_id, i // 8 AS r, i % 8 AS c, v FROM (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings))"


def patch(spark, sf_dir):
    return embeddings(spark, sf_dir).select("vec_id", F.col("embedding").cast("array<double>").alias("a"))


def centred(spark, sf_dir):
    return patch(spark, sf_dir).select("vec_id", P.bound(P.mean(F.col("a")), lambda m: F.transform("a", lambda x: x - m)).alias("c"))


def kernel_sql(k) -> str:
    n = len(k)
    return "(VALUES " + ", ".join(f"({r}, {c}, {float(k[n - 1 - r][n - 1 - c])!r}::DOUBLE)" for r in range(n) for c in range(n)) + ") k(dr, dc, w)"


def conv_sql(k) -> str:
    m = 8 - len(k) + 1
    return f"SELECT vec_id, r - dr AS r, c - dc AS c, sum(v * w) AS v FROM px, {kernel_sql(k)} WHERE r - dr BETWEEN 0 AND {m - 1} AND c - dc BETWEEN 0 AND {m - 1} GROUP BY 1, 2, 3"


@query("patch_moments", PIXELS + ", m AS (SELECT vec_id, avg(v) AS m, stddev_pop(v) AS s FROM px GROUP BY 1) SELECT vec_id, round(any_value(m), 6) AS mean, round(any_value(s * s), 6) AS var, round(avg((v - m) ** 3) / any_value(s ** 3 + 1e-8), 6) AS skew, round(avg((v - m) ** 4) / any_value(s ** 4 + 1e-8) - 3, 6) AS kurt FROM px JOIN m USING (vec_id) GROUP BY 1")
def patch_moments(spark, sf_dir):
    a = F.col("a")
    skew, kurt = P.skew_kurtosis(a)
    return patch(spark, sf_dir).select("vec_id", F.round(P.mean(a), 6).alias("mean"), F.round(P.variance(a), 6).alias("var"), F.round(skew, 6).alias("skew"), F.round(kurt, 6).alias("kurt"))


@query("patch_corr", PIXELS + ", h AS (SELECT a.vec_id, a.v AS x, b.v AS y FROM px a JOIN px b ON a.vec_id = b.vec_id AND b.r = a.r + 4 AND b.c = a.c WHERE a.r < 4) SELECT vec_id, round(covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y) + 1e-8), 6) AS r FROM h GROUP BY 1")
def patch_corr(spark, sf_dir):
    return patch(spark, sf_dir).select("vec_id", F.round(P.correlation(F.slice("a", 1, 32), F.slice("a", 33, 32)), 6).alias("r"))


@query("patch_trimmed_mean", PIXELS + ", o AS (SELECT vec_id, v, row_number() OVER (PARTITION BY vec_id ORDER BY v) AS k FROM px) SELECT vec_id, round(avg(v), 6) AS m FROM o WHERE k > 3 AND k <= 61 GROUP BY 1")
def patch_trimmed_mean(spark, sf_dir):
    return patch(spark, sf_dir).select("vec_id", F.round(P.trimmed_mean(F.col("a")), 6).alias("m"))


def _conv(name, kernel):
    @query(f"patch_conv_{name}", f"{PIXELS}, f AS ({conv_sql(kernel)}) SELECT vec_id, round(avg(abs(v)), 6) AS mean_abs, round(avg(v * v), 6) AS energy FROM f GROUP BY 1")
    def run(spark, sf_dir):
        d = patch(spark, sf_dir).select("vec_id", P.convolved(F.col("a"), 8, kernel).alias("f"))
        return d.select("vec_id", F.round(P.total(F.col("f"), F.abs) / F.size("f"), 6).alias("mean_abs"), F.round(P.total(F.col("f"), lambda x: x * x) / F.size("f"), 6).alias("energy"))


for _name, _kernel in (("edge3", P.EDGE3), ("square3", P.SQUARE3), ("square5", P.SQUARE5)):
    _conv(_name, _kernel)


@query("patch_sobel", f"{PIXELS}, x AS ({conv_sql(P.SOBEL_X)}), y AS ({conv_sql(P.SOBEL_Y)}) SELECT vec_id, round(avg(sqrt(x.v * x.v + y.v * y.v)), 6) AS mean, round(max(sqrt(x.v * x.v + y.v * y.v)), 6) AS top FROM x JOIN y USING (vec_id, r, c) GROUP BY 1")
def patch_sobel(spark, sf_dir):
    d = patch(spark, sf_dir).select("vec_id", P.sobel(F.col("a"), 8).alias("s"))
    return d.select("vec_id", F.round(P.mean(F.col("s")), 6).alias("mean"), F.round(F.array_max("s"), 6).alias("top"))


@query("patch_box", PIXELS + ", b AS (SELECT a.vec_id, a.r, a.c, avg(b.v) AS m, greatest(avg(b.v * b.v) - avg(b.v) ** 2, 0) AS s FROM px a JOIN px b ON a.vec_id = b.vec_id AND b.r BETWEEN a.r AND a.r + 2 AND b.c BETWEEN a.c AND a.c + 2 WHERE a.r < 6 AND a.c < 6 GROUP BY 1, 2, 3) SELECT vec_id, round(max(m), 6) AS top_mean, round(avg(s), 6) AS mean_var FROM b GROUP BY 1")
def patch_box(spark, sf_dir):
    d = patch(spark, sf_dir).select("vec_id", P.box_mean(F.col("a"), 8, 3).alias("m"), P.box_variance(F.col("a"), 8, 3).alias("s"))
    return d.select("vec_id", F.round(F.array_max("m"), 6).alias("top_mean"), F.round(P.mean(F.col("s")), 6).alias("mean_var"))


def _haar_sql(source: str) -> str:
    q = "sum(CASE WHEN r % 2 = {0} AND c % 2 = {1} THEN v END)"
    p, x, y, z = (q.format(a, b) for a, b in ((0, 0), (0, 1), (1, 0), (1, 1)))
    return f"SELECT vec_id, r // 2 AS r, c // 2 AS c, ({p} + {x} + {y} + {z}) / 4 AS v, (({p} - {x} + {y} - {z}) / 4) ** 2 + (({p} + {x} - {y} - {z}) / 4) ** 2 + (({p} - {x} - {y} + {z}) / 4) ** 2 AS e FROM {source} GROUP BY 1, 2, 3"


@query(
    "patch_haar_energy",
    f"""{PIXELS}, h1 AS ({_haar_sql("px")}), h2 AS ({_haar_sql("h1")}), h3 AS ({_haar_sql("h2")}), s AS (SELECT vec_id, var_pop(v) AS s FROM px GROUP BY 1),
    e AS (SELECT vec_id, 1 AS l, avg(e) / 3 AS e FROM h1 GROUP BY 1 UNION ALL SELECT vec_id, 2, avg(e) / 3 FROM h2 GROUP BY 1 UNION ALL SELECT vec_id, 3, avg(e) / 3 FROM h3 GROUP BY 1), n AS (SELECT vec_id, l, e / (s + 1e-8) AS e FROM e JOIN s USING (vec_id))
    SELECT vec_id, round(max(e) FILTER (l = 1), 6) AS e1, round(max(e) FILTER (l = 2), 6) AS e2, round(max(e) FILTER (l = 3), 6) AS e3, round(-regr_slope(ln(e + 1e-8), l), 6) AS alpha FROM n GROUP BY 1""",
)
def patch_haar_energy(spark, sf_dir):
    d = patch(spark, sf_dir).withColumn("s", P.variance(F.col("a")) + P.EPS)
    low = F.col("a")
    for k, n in ((1, 8), (2, 4), (3, 2)):
        ll, high = P.haar(low, n)
        d = d.withColumn(f"h{k}", high).withColumn("a", ll)
        d = d.withColumn(f"e{k}", P.total(F.col(f"h{k}"), lambda x: x * x) / F.size(f"h{k}") / F.col("s"))
    y = [F.log(F.col(f"e{k}") + P.EPS) for k in (1, 2, 3)]
    return d.select("vec_id", *[F.round(f"e{k}", 6).alias(f"e{k}") for k in (1, 2, 3)], F.round((y[0] - y[2]) / 2, 6).alias("alpha"))  # slope through levels 1, 2, 3


@query("patch_checkerboard", PIXELS + " SELECT vec_id, round(abs(avg(v * CASE WHEN (r + c) % 2 = 0 THEN 1 ELSE -1 END)) / (sqrt(avg(v * v)) + 1e-8), 6) AS p FROM px GROUP BY 1")
def patch_checkerboard(spark, sf_dir):
    return patch(spark, sf_dir).select("vec_id", F.round(P.checkerboard(F.col("a"), 8), 6).alias("p"))


_RADIUS = "sqrt((CASE WHEN u < 4 THEN u / 8.0 ELSE u / 8.0 - 1 END) ** 2 + (CASE WHEN w < 4 THEN w / 8.0 ELSE w / 8.0 - 1 END) ** 2)"


@query(
    "patch_dft_bands",
    f"""{PIXELS}, m AS (SELECT vec_id, avg(v) AS m FROM px GROUP BY 1), c AS (SELECT vec_id, r, c, v - m AS v FROM px JOIN m USING (vec_id)), g AS (SELECT a.u, b.w FROM (SELECT unnest(range(8)) AS u) a, (SELECT unnest(range(8)) AS w) b),
    p AS (SELECT vec_id, u, w, (sum(v * cos(2 * pi() * (u * r + w * c) / 8)) ** 2 + sum(v * sin(2 * pi() * (u * r + w * c) / 8)) ** 2) / 4096 AS p FROM c, g GROUP BY 1, 2, 3)
    SELECT vec_id, round(avg(p) FILTER ({_RADIUS} >= 0.12 AND {_RADIUS} < 0.32), 6) AS mid, round(avg(p) FILTER ({_RADIUS} >= 0.32 AND {_RADIUS} < 0.46), 6) AS high FROM p GROUP BY 1""",
)
def patch_dft_bands(spark, sf_dir):
    d = centred(spark, sf_dir)
    return d.select("vec_id", F.round(P.band_energy(F.col("c"), 8, 0.12, 0.32), 6).alias("mid"), F.round(P.band_energy(F.col("c"), 8, 0.32, 0.46), 6).alias("high"))


@query("patch_autocorr", PIXELS + ", m AS (SELECT vec_id, avg(v) AS m, sum(v * v) AS q FROM px GROUP BY 1), c AS (SELECT vec_id, r, c, v - m AS v FROM px JOIN m USING (vec_id)), e AS (SELECT vec_id, sum(v * v) AS e FROM c GROUP BY 1), l AS (SELECT a.vec_id, b.c - a.c AS k, abs(sum(a.v * b.v)) AS s FROM c a JOIN c b ON a.vec_id = b.vec_id AND a.r = b.r AND b.c - a.c BETWEEN 2 AND 5 GROUP BY 1, 2) SELECT vec_id, round(max(s / (e + 1e-8)), 6) AS peak FROM l JOIN e USING (vec_id) GROUP BY 1")
def patch_autocorr(spark, sf_dir):
    return centred(spark, sf_dir).select("vec_id", F.round(P.autocorrelation(F.col("c"), 8, [2, 3, 4, 5]), 6).alias("peak"))


_RING = [(-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1)]


@query(
    "patch_lbp",
    PIXELS + ", n AS (SELECT p.vec_id, p.r, p.c, k, (q.v >= p.v)::INT AS b FROM px p JOIN (VALUES " + ", ".join(f"({k}, {r}, {c})" for k, (r, c) in enumerate(_RING)) + ") o(k, dr, dc) ON p.r BETWEEN 1 AND 6 AND p.c BETWEEN 1 AND 6 JOIN px q ON q.vec_id = p.vec_id AND q.r = p.r + dr AND q.c = p.c + dc), t AS (SELECT a.vec_id, a.r, a.c, sum((a.b <> b.b)::INT) AS t FROM n a JOIN n b ON a.vec_id = b.vec_id AND a.r = b.r AND a.c = b.c AND b.k = (a.k + 1) % 8 GROUP BY 1, 2, 3) SELECT vec_id, round(avg((t > 2)::INT), 6) AS nonuniform FROM t GROUP BY 1",
)
def patch_lbp(spark, sf_dir):
    return patch(spark, sf_dir).select("vec_id", F.round(P.lbp_nonuniform(F.col("a"), 8), 6).alias("nonuniform"))


@query("patch_quadrants", PIXELS + ", q AS (SELECT vec_id, r // 4 AS a, c // 4 AS b, avg(v) AS m FROM px GROUP BY 1, 2, 3) SELECT vec_id, round(avg(m), 6) AS quad_mean, round(stddev_pop(m), 6) AS quad_std FROM q GROUP BY 1")
def patch_quadrants(spark, sf_dir):
    quad = lambda r, c: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: P.at(F.col("a"), (F.floor(i / 4) + r) * 8 + i % 4 + c))
    d = patch(spark, sf_dir).select("vec_id", F.array(*[P.mean(quad(r, c)) for r in (0, 4) for c in (0, 4)]).alias("q"))
    return d.select("vec_id", F.round(P.mean(F.col("q")), 6).alias("quad_mean"), F.round(F.sqrt(P.variance(F.col("q"))), 6).alias("quad_std"))


@query("patch_ycrcb", PIXELS + ", t AS (SELECT a.vec_id, a.v AS r, b.v AS g, c.v AS b FROM px a JOIN px b ON a.vec_id = b.vec_id AND b.r * 8 + b.c = (a.r * 8 + a.c + 21) % 64 JOIN px c ON a.vec_id = c.vec_id AND c.r * 8 + c.c = (a.r * 8 + a.c + 42) % 64), y AS (SELECT vec_id, 0.299 * r + 0.587 * g + 0.114 * b AS y, r, b FROM t) SELECT vec_id, round((var_pop((r - y) * 0.713 + 128) + var_pop((b - y) * 0.564 + 128)) / (var_pop(y) + 1e-8), 5) AS chroma FROM y GROUP BY 1")
def patch_ycrcb(spark, sf_dir):
    """Chroma energy over luma, with the patch and two turns of it as red, green and blue."""
    turned = lambda k: F.concat(F.slice("a", k + 1, 64 - k), F.slice("a", 1, k))
    d = patch(spark, sf_dir).select("vec_id", F.col("a").alias("r"), turned(21).alias("g"), turned(42).alias("b"))
    d = d.withColumn("y", F.zip_with(F.zip_with("r", "g", lambda r, g: 0.299 * r + 0.587 * g), "b", lambda s, b: s + 0.114 * b))
    cr, cb = F.zip_with("r", "y", lambda r, y: (r - y) * 0.713 + 128), F.zip_with("b", "y", lambda b, y: (b - y) * 0.564 + 128)
    return d.select("vec_id", F.round((P.variance(cr) + P.variance(cb)) / (P.variance(F.col("y")) + P.EPS), 5).alias("chroma"))
