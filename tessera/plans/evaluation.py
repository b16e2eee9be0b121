"""Queries of evaluation statistics, sampling and scalar rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scalars as X
from tessera.operators import metrics as M
from tessera.operators import sampling as S
from tessera.operators import shortcuts
from tessera.operators.ordered import quantiles, ranked
from tessera.plans.registry import query
from tessera.plans.relational import customer, documents, events, labels, lineitem, orders, part, supplier

#: A score in (0, 1) from a document's length.
P_SQL = "round(1 / (1 + exp(-(ln(n_chars) - 7))), 9)"


def scored(spark, sf_dir):
    """Labelled documents with y, a score p, and their lengths."""
    d = documents(spark, sf_dir).select("doc_id", "lang", "source", "n_chars").join(labels(spark, sf_dir), "doc_id")
    return d.select("*", F.col("quality").alias("y"), F.round(1 / (1 + F.exp(-(F.log("n_chars") - 7))), 9).alias("p"))


SCORED = f"WITH s AS (SELECT doc_id, lang, source, n_chars, quality, toxic, quality AS y, {P_SQL} AS p FROM documents JOIN labels USING (doc_id))"


def mid_rank_auc(keys: str, y: str, x: str, source: str) -> str:
    """Mid-rank AUC in SQL from rows, not from distinct scores."""
    part = f"PARTITION BY {keys}" if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    head = f"{keys}, " if keys else ""
    return f"""SELECT {head}CASE WHEN count(*) FILTER ({y} = 1) > 0 AND count(*) FILTER ({y} = 0) > 0 THEN round((sum(r) FILTER ({y} = 1) - count(*) FILTER ({y} = 1) * (count(*) FILTER ({y} = 1) + 1) / 2.0)
    / (count(*) FILTER ({y} = 1)::DOUBLE * count(*) FILTER ({y} = 0)), 9) END AS auc
    FROM (SELECT *, rank() OVER ({part} ORDER BY {x}) + (count(*) OVER ({part + ("," if part else "PARTITION BY")} {x}) - 1) / 2.0 AS r FROM {source}) {group}"""


@query("auc_exact", f"{SCORED} {mid_rank_auc('', 'y', 'n_chars', 's')}")
def auc_exact(spark, sf_dir):
    return M.auc(scored(spark, sf_dir), "y", "n_chars").select(F.round("auc", 9).alias("auc"))


@query("auc_by_group", f"{SCORED} {mid_rank_auc('lang', 'y', 'p', 's')}")
def auc_by_group(spark, sf_dir):
    return M.auc(scored(spark, sf_dir), "y", "p", ["lang"]).select("lang", F.round("auc", 9).alias("auc"))


@query("safe_auc", f"{SCORED}, a AS ({mid_rank_auc('source', 'y', 'n_chars', 's')}), n AS (SELECT source, count(*) AS n FROM s GROUP BY 1) SELECT source, coalesce(CASE WHEN n >= 4 THEN auc END, -1) AS auc, coalesce(CASE WHEN n >= 4 THEN greatest(auc, 1 - auc) END, -1) AS auc_abs, n FROM a JOIN n USING (source)")
def safe_auc(spark, sf_dir):
    a = M.safe_auc(scored(spark, sf_dir), "y", "n_chars", ["source"])
    return a.select("source", F.coalesce(F.round("auc", 9), F.lit(-1.0)).alias("auc"), F.coalesce(F.greatest(F.round("auc", 9), 1 - F.round("auc", 9)), F.lit(-1.0)).alias("auc_abs"), "n")


@query("auc_large", f"WITH l AS (SELECT (l_returnflag = 'R')::INT AS y, l_extendedprice AS x FROM lineitem) {mid_rank_auc('', 'y', 'x', 'l')}")
def auc_large(spark, sf_dir):
    l = lineitem(spark, sf_dir).select((F.col("l_returnflag") == "R").cast("int").alias("y"), F.col("l_extendedprice").alias("x"))
    return M.auc(l, "y", "x").select(F.round("auc", 9).alias("auc"))


_EDGES = ", ".join(f"{k / 15!r}::DOUBLE" for k in range(1, 15))
ECE_SQL = f"list_sum(list_transform([{_EDGES}], lambda e: (p >= e)::INT))"


@query("ece", f"{SCORED}, b AS (SELECT {ECE_SQL} AS bin, count(*) AS n, avg(y) AS acc, avg(p) AS conf FROM s GROUP BY 1) SELECT round(sum(n * abs(acc - conf)) / sum(n), 9) AS ece FROM b")
def ece(spark, sf_dir):
    return M.ece(scored(spark, sf_dir), "y", "p").select(F.round("ece", 9).alias("ece"))


THRESHOLD_SQL = "SELECT coalesce(min(t) FILTER (fp <= 0.05 * (SELECT count(*) FROM s WHERE y = 0)), 2.0) AS threshold FROM (SELECT t, (SELECT count(*) FROM s WHERE y = 0 AND s.p >= t) AS fp FROM (SELECT DISTINCT p AS t FROM s))"


@query("threshold_fpr", f"{SCORED} {THRESHOLD_SQL}")
def threshold_fpr(spark, sf_dir):
    return M.threshold_at_fpr(scored(spark, sf_dir), "y", "p")


@query(
    "split_metrics",
    f"""{SCORED}, a AS ({mid_rank_auc("lang", "y", "p", "s")}), b AS (SELECT lang, {ECE_SQL} AS bin, count(*) AS n, avg(y) AS acc, avg(p) AS conf FROM s GROUP BY 1, 2),
    e AS (SELECT lang, round(sum(n * abs(acc - conf)) / sum(n), 9) AS ece FROM b GROUP BY 1),
    c AS (SELECT lang, count(*) AS n, count(*) FILTER (y = 1 AND p >= 0.5) AS tp, count(*) FILTER (y = 0 AND p >= 0.5) AS fp, count(*) FILTER (y = 0 AND p < 0.5) AS tn, count(*) FILTER (y = 1 AND p < 0.5) AS fn, round(avg((p - y) * (p - y)), 9) AS brier FROM s GROUP BY 1)
    SELECT lang, n, tp, fp, tn, fn, brier, round(tp / greatest(1, tp + fn), 9) AS tpr, round(fp / greatest(1, fp + tn), 9) AS fpr, round(tp / greatest(1, tp + fp), 9) AS precision, round((tp + tn) / n, 9) AS accuracy, auc, ece FROM c JOIN a USING (lang) JOIN e USING (lang)""",
)
def split_metrics(spark, sf_dir):
    m = M.split_metrics(scored(spark, sf_dir), "y", "p", F.lit(0.5), ["lang"])
    return m.select("lang", "n", "tp", "fp", "tn", "fn", *[F.round(c, 9).alias(c) for c in ("brier", "tpr", "fpr", "precision", "accuracy", "auc", "ece")])


@query("pooled_eval", f"{SCORED} SELECT coalesce(lang, 'pooled') AS split, count(*) AS n, round(avg((p - y) * (p - y)), 9) AS brier, round(avg(y), 9) AS rate FROM s WHERE lang IN ('de', 'en', 'fr') GROUP BY GROUPING SETS ((lang), ())")
def pooled_eval(spark, sf_dir):
    s = scored(spark, sf_dir).filter(F.col("lang").isin("de", "en", "fr")).select("lang", "y", "p")
    g = s.groupingSets([[F.col("lang")], []], "lang").agg(F.count("*").alias("n"), F.round(F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))), 9).alias("brier"), F.round(F.avg("y"), 9).alias("rate"))
    return g.select(F.coalesce("lang", F.lit("pooled")).alias("split"), "n", "brier", "rate")


_FEATURES = ["n_chars", "n_words", "n_lines", "n_caps"]


def featured(spark, sf_dir):
    d = documents(spark, sf_dir).select(
        "doc_id", "lang", "n_chars", F.regexp_count("text", F.lit(" ")).cast("double").alias("n_words"), F.regexp_count("text", F.lit("\n")).cast("double").alias("n_lines"), F.regexp_count("text", F.lit("[A-Z]")).cast("double").alias("n_caps")
    )
    return d.join(labels(spark, sf_dir), "doc_id").withColumn("n_chars", F.col("n_chars").cast("double"))


_AUDIT = " UNION ALL ".join(f"SELECT '{f}' AS feature, '{s}' AS slice, {y} AS y, {f} AS x FROM f WHERE {w}" for f in _FEATURES for s, y, w in (("label", "quality", "true"), ("en", "quality", "lang = 'en'"), ("nuisance", "toxic", "quality = 1")))
FEATURED = "WITH f AS (SELECT doc_id, lang, n_chars::DOUBLE AS n_chars, len(regexp_extract_all(text, ' '))::DOUBLE AS n_words, len(regexp_extract_all(text, chr(10)))::DOUBLE AS n_lines, len(regexp_extract_all(text, '[A-Z]'))::DOUBLE AS n_caps, quality, toxic FROM documents JOIN labels USING (doc_id))"


@query("feature_audit", f"{FEATURED}, u AS ({_AUDIT}), a AS ({mid_rank_auc('feature, slice', 'y', 'x', 'u')}), n AS (SELECT feature, slice, count(*) AS n FROM u GROUP BY 1, 2) SELECT feature, slice, greatest(auc, 1 - auc) AS auc_abs, n, CASE WHEN greatest(auc, 1 - auc) >= 0.8 THEN 'high' WHEN greatest(auc, 1 - auc) >= 0.65 THEN 'medium' ELSE 'low' END AS risk FROM a JOIN n USING (feature, slice)")
def feature_audit(spark, sf_dir):
    slices = {"label": (F.lit(True), "quality"), "en": (F.col("lang") == "en", "quality"), "nuisance": (F.col("quality") == 1, "toxic")}
    a = M.feature_audit(featured(spark, sf_dir), _FEATURES, slices).withColumn("auc", F.round("auc", 9))
    return a.select("feature", "slice", F.greatest(F.col("auc"), 1 - F.col("auc")).alias("auc_abs"), "n", X.shortcut_level(F.greatest(F.col("auc"), 1 - F.col("auc"))).alias("risk"))


_LONG = " UNION ALL ".join(f"SELECT '{f}' AS feature, quality, lang, {f} AS x FROM f" for f in _FEATURES)


@query("z_shift", f"{FEATURED}, u AS ({_LONG}), m AS (SELECT feature, avg(x) AS m, stddev_pop(x) AS s FROM u WHERE lang = 'en' GROUP BY 1) SELECT feature, round(avg(abs((x - m) / s)), 6) AS z_shift FROM u JOIN m USING (feature) WHERE lang <> 'en' GROUP BY 1")
def z_shift(spark, sf_dir):
    long = featured(spark, sf_dir).unpivot(["quality", "lang"], _FEATURES, "feature", "x")
    return M.z_shift(long.filter("lang = 'en'"), long.filter("lang <> 'en'"), "x", ["feature"]).select("feature", F.round("z_shift", 6).alias("z_shift"))


@query("cohen_d", f"{FEATURED}, u AS ({_LONG}), g AS (SELECT feature, count(*) FILTER (quality = 1) AS n1, count(*) FILTER (quality = 0) AS n0, avg(x) FILTER (quality = 1) AS m1, avg(x) FILTER (quality = 0) AS m0, var_samp(x) FILTER (quality = 1) AS v1, var_samp(x) FILTER (quality = 0) AS v0 FROM u GROUP BY 1) SELECT feature, round((m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)), 6) AS cohen_d FROM g")
def cohen_d(spark, sf_dir):
    long = featured(spark, sf_dir).unpivot(["quality"], _FEATURES, "feature", "x")
    return M.cohen_d(long, "quality", "x", ["feature"]).select("feature", F.round("cohen_d", 6).alias("cohen_d"))


@query("mutual_information", "WITH c AS (SELECT quality AS y, toxic AS z, count(*) AS n FROM labels GROUP BY 1, 2), p AS (SELECT n / sum(n) OVER () AS p, sum(n) OVER (PARTITION BY y) / sum(n) OVER () AS py, sum(n) OVER (PARTITION BY z) / sum(n) OVER () AS pz FROM c) SELECT round(greatest(0, sum(CASE WHEN p > 1e-12 THEN p * log2(p / (py * pz)) ELSE 0 END)), 9) AS mi_bits FROM p")
def mutual_information(spark, sf_dir):
    return M.mutual_information(labels(spark, sf_dir), "quality", "toxic").select(F.round("mi_bits", 9).alias("mi_bits"))


_PROXIES = {"long_text": "n_chars > 2000", "many_lines": "n_lines > 8", "many_caps": "n_caps > 100", "english": "lang = 'en'"}


@query(
    "proxy_asymmetry",
    f"{FEATURED}, u AS ({' UNION ALL '.join(f'''SELECT '{k}' AS proxy, quality AS y, ({c})::INT AS z FROM f''' for k, c in _PROXIES.items())}), r AS (SELECT proxy, avg(y) AS prior, avg(z) FILTER (y = 1) AS a, avg(z) FILTER (y = 0) AS b, count(*) AS n FROM u GROUP BY 1), q AS (SELECT *, prior * a + (1 - prior) * b AS pz FROM r) SELECT proxy, n, round(a, 9) AS rate_1, round(b, 9) AS rate_0, round(abs(a - b), 9) AS gap, CASE WHEN abs(a - b) > 0.3 THEN 'HIGH' WHEN abs(a - b) > 0.1 THEN 'MEDIUM' ELSE 'LOW' END AS risk, round({' + '.join(f'(CASE WHEN {p} > 1e-12 THEN {p} * log2({p} / ({q})) ELSE 0 END)' for p, q in (('prior * a', 'prior * pz'), ('prior * (1 - a)', 'prior * (1 - pz)'), ('(1 - prior) * b', '(1 - prior) * pz'), ('(1 - prior) * (1 - b)', '(1 - prior) * (1 - pz)')))}, 9) AS mi_bits FROM q",
)
def proxy_asymmetry(spark, sf_dir):
    f = featured(spark, sf_dir).select("quality", *[F.expr(f"cast({c} as int)").alias(k) for k, c in _PROXIES.items()])
    u = f.unpivot(["quality"], list(_PROXIES), "proxy", "z")
    r = u.groupBy("proxy").agg(F.avg("quality").alias("prior"), F.avg(F.when(F.col("quality") == 1, F.col("z"))).alias("a"), F.avg(F.when(F.col("quality") == 0, F.col("z"))).alias("b"), F.count("*").alias("n"))
    gap = F.abs(F.col("a") - F.col("b"))
    return r.select("proxy", "n", F.round("a", 9).alias("rate_1"), F.round("b", 9).alias("rate_0"), F.round(gap, 9).alias("gap"), X.rate_level(gap).alias("risk"), F.round(M.binary_information(F.col("prior"), F.col("a"), F.col("b")), 9).alias("mi_bits"))


@query("overlap_coefficient", "WITH q AS (SELECT quantile_cont(l_extendedprice, 0.01) AS lo, quantile_cont(l_extendedprice, 0.99) AS hi FROM lineitem), c AS (SELECT least(59, floor((greatest(least(l_extendedprice, hi), lo) - lo) / (hi - lo) * 60))::INT AS bin, count(*) FILTER (l_returnflag = 'R') AS a, count(*) FILTER (l_returnflag <> 'R') AS b FROM lineitem, q GROUP BY 1) SELECT round(sum(least(a / (SELECT sum(a) FROM c), b / (SELECT sum(b) FROM c))), 9) AS overlap FROM c")
def overlap_coefficient(spark, sf_dir):
    l = lineitem(spark, sf_dir).select((F.col("l_returnflag") == "R").cast("int").alias("y"), F.col("l_extendedprice").alias("x"))
    return M.overlap(l, "y", "x").select(F.round("overlap", 9).alias("overlap"))


@query("correlation_matrix", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for k, a in enumerate(["l_quantity", "l_extendedprice", "l_discount"]) for b in ["l_extendedprice", "l_discount", "l_tax"][k:]))
def correlation_matrix(spark, sf_dir):
    pairs = [(a, b) for k, a in enumerate(["l_quantity", "l_extendedprice", "l_discount"]) for b in ["l_extendedprice", "l_discount", "l_tax"][k:]]
    one = lineitem(spark, sf_dir).agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.corr(a, b), 6).alias("r")) for a, b in pairs]).alias("x"))
    return one.select(F.explode("x").alias("x")).select("x.*")


_BOOTSTRAP = f"""{SCORED}, r AS (SELECT doc_id, y, p, i::INT AS replicate, CAST('0x' || substr(md5('boot|' || i || '|' || doc_id), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE AS u FROM s, range(300) t(i)),
    m AS (SELECT replicate, y, p, (u >= 0.36787944117144233::DOUBLE)::INT + (u >= 0.7357588823428847::DOUBLE)::INT + (u >= 0.9196986029286058::DOUBLE)::INT + (u >= 0.9810118431238462::DOUBLE)::INT + (u >= 0.9963401531726563::DOUBLE)::INT + (u >= 0.9994058151824183::DOUBLE)::INT + (u >= 0.9999167588507119::DOUBLE)::INT AS m FROM r),
    d AS (SELECT replicate, p, coalesce(sum(m) FILTER (y = 1), 0) AS pos, coalesce(sum(m) FILTER (y = 0), 0) AS neg FROM m WHERE m > 0 GROUP BY 1, 2),
    c AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY replicate ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum FROM d),
    a AS (SELECT replicate, sum(pos * (cum + neg / 2.0)) / (sum(pos)::DOUBLE * sum(neg)) AS auc FROM c GROUP BY 1) SELECT round(quantile_cont(auc, 0.025), 9) AS low, round(quantile_cont(auc, 0.975), 9) AS high, count(*) AS replicates FROM a"""


@query("bootstrap_auc", _BOOTSTRAP)
def bootstrap_auc(spark, sf_dir):
    return M.bootstrap_auc(scored(spark, sf_dir), "y", "p", "doc_id", 300).select(F.round("low", 9).alias("low"), F.round("high", 9).alias("high"), "replicates")


@query("paired_shift", "SELECT l_returnflag, round(avg(l_tax - l_discount), 9) AS mean_delta, round(avg(abs((l_tax - l_discount) / s)), 6) AS mean_abs, round(median(abs((l_tax - l_discount) / s)), 6) AS median_abs FROM lineitem, (SELECT stddev_pop(l_discount) AS s FROM lineitem) GROUP BY 1")
def paired_shift(spark, sf_dir):
    l = lineitem(spark, sf_dir).select("l_returnflag", "l_tax", "l_discount")
    s = l.agg(F.stddev_pop("l_discount").alias("s"))
    d = l.crossJoin(F.broadcast(s)).withColumn("d", F.col("l_tax") - F.col("l_discount")).withColumn("z", F.abs(F.col("d") / F.col("s")))  # s is one row
    mean = d.groupBy("l_returnflag").agg(F.round(F.avg("d"), 9).alias("mean_delta"), F.round(F.avg("z"), 6).alias("mean_abs"))
    return mean.join(quantiles(d, "z", [0.5], ["l_returnflag"]).select("l_returnflag", F.round("q0", 6).alias("median_abs")), "l_returnflag")


_SHARES = "SELECT feature, x, y, n, n / sum(n) OVER (PARTITION BY feature, y) AS v FROM (SELECT feature, x, y, count(*) AS n FROM t GROUP BY 1, 2, 3)"
_ALERTS = f"""
r AS (SELECT 'binary_rate' AS kind, 'toxic' AS feature, NULL AS detail, abs(avg(toxic) FILTER (quality = 1) - avg(toxic) FILTER (quality = 0)) AS delta FROM f),
t AS (SELECT 'lang' AS feature, lang AS x, quality AS y FROM f UNION ALL SELECT 'source', source, quality FROM f UNION ALL SELECT 'tag', tag, quality FROM f), h AS ({_SHARES}),
k AS (SELECT 'category_share' AS kind, feature, x AS detail, abs(coalesce(max(v) FILTER (y = 1), 0) - coalesce(max(v) FILTER (y = 0), 0)) AS delta FROM h WHERE feature = 'lang' GROUP BY 2, 3 QUALIFY row_number() OVER (ORDER BY abs(coalesce(max(v) FILTER (y = 1), 0) - coalesce(max(v) FILTER (y = 0), 0)) DESC, x) = 1),
z AS (SELECT feature, y, median(x) AS m FROM (SELECT 'n_chars' AS feature, quality AS y, n_chars AS x FROM f UNION ALL SELECT 'n_words', quality, n_words FROM f) GROUP BY 1, 2),
m AS (SELECT 'relative_median' AS kind, feature, NULL AS detail, (max(m) - min(m)) / greatest(avg(m), 1e-9) AS delta FROM z GROUP BY feature),
p AS (SELECT 'presence' AS kind, feature, NULL AS detail, max(v) - min(v) AS delta FROM (SELECT feature, y, avg((x IS NOT NULL)::INT) AS v FROM t WHERE feature <> 'lang' GROUP BY 1, 2) GROUP BY feature HAVING max(v) - min(v) > 0.05),
e AS (SELECT 'exclusive_value' AS kind, a.feature, substr(a.x, 1, 80) || ' only in ' || a.y || ' ' || a.n AS detail, 1.0 AS delta FROM (SELECT feature, x, y, n FROM h WHERE feature <> 'lang' AND x IS NOT NULL QUALIFY row_number() OVER (PARTITION BY feature, y ORDER BY n DESC, x) <= 3) a WHERE a.n >= 10 AND (SELECT count(*) FROM h b WHERE b.feature = a.feature AND b.x = a.x) = 1),
w AS (SELECT 'size' AS feature, width || 'x' || height AS x, quality AS y, count(*) AS n FROM f GROUP BY 2, 3), q AS (SELECT *, n / sum(n) OVER (PARTITION BY y) AS v FROM w),
s AS (SELECT 'resolution_pattern' AS kind, 'widthxheight' AS feature, a.x || ' in ' || a.y || ' rare in ' || c.y AS detail, a.v - coalesce(b.v, 0) AS delta FROM q a JOIN (SELECT DISTINCT y FROM q) c ON c.y <> a.y LEFT JOIN q b ON b.x = a.x AND b.y = c.y WHERE a.v >= 0.8 AND coalesce(b.v, 0) < 0.2)
SELECT kind, feature, coalesce(detail, '-') AS detail, round(delta, 6) AS delta, CASE WHEN kind IN ('exclusive_value', 'resolution_pattern') OR delta > 0.30 THEN 'HIGH' WHEN delta > 0.10 THEN 'MEDIUM' ELSE 'LOW' END AS severity
FROM (SELECT * FROM r UNION ALL SELECT * FROM k UNION ALL SELECT * FROM m UNION ALL SELECT * FROM p UNION ALL SELECT * FROM e UNION ALL SELECT * FROM s)"""
_ALERT_ROWS = """WITH f AS (SELECT lang, source, n_chars::DOUBLE AS n_chars, len(regexp_extract_all(text, ' '))::DOUBLE AS n_words, quality, toxic, CASE WHEN quality = 0 AND n_chars % 3 > 0 THEN 'low' WHEN n_chars % 5 = 0 THEN 'both' END AS tag,
    CASE WHEN quality = 1 THEN 640 ELSE 100 + n_chars % 7 END AS width, CASE WHEN n_chars % 11 = 0 THEN 481 ELSE 480 END AS height FROM documents JOIN labels USING (doc_id))"""


@query("shortcut_alerts", f"{_ALERT_ROWS}, {_ALERTS}")
def shortcut_alerts(spark, sf_dir):
    """Every kind of asymmetry between the classes: rates, shares, medians, presence, exclusive values, sizes."""
    n = F.col("n_chars")
    f = documents(spark, sf_dir).join(labels(spark, sf_dir), "doc_id").select(
        "lang", "source", n.cast("double").alias("n_chars"), F.regexp_count("text", F.lit(" ")).cast("double").alias("n_words"), "quality", "toxic",
        F.when((F.col("quality") == 0) & (n % 3 > 0), "low").when(n % 5 == 0, "both").alias("tag"), F.when(F.col("quality") == 1, 640).otherwise(100 + n % 7).alias("width"), F.when(n % 11 == 0, 481).otherwise(480).alias("height"),
    )
    a = shortcuts.alerts(f, "quality", binary=["toxic"], categories=["lang"], numbers=["n_chars", "n_words"], texts=["source", "tag"], size=("width", "height"))
    return a.select("kind", "feature", F.coalesce("detail", F.lit("-")).alias("detail"), F.round("delta", 6).alias("delta"), "severity")


_H = "sha256('42|' || doc_id)"


@query(
    "split_roles",
    f"""WITH d AS (SELECT doc_id, lang, source, count(*) OVER w AS n, row_number() OVER (PARTITION BY lang, source ORDER BY {_H}, doc_id) AS k FROM documents WINDOW w AS (PARTITION BY lang, source)),
    s AS (SELECT *, round_even(n * 0.1::DOUBLE, 0) AS t, round_even(n * 0.1::DOUBLE, 0) AS v FROM d), c AS (SELECT *, round_even((n - t - v) * 0.05::DOUBLE, 0) AS c FROM s)
    SELECT doc_id, lang, source, CASE WHEN source IN ('src3', 'src15') THEN 'ood_eval' WHEN k <= t THEN 'id_test' WHEN k <= t + v THEN 'val' WHEN k <= t + v + c THEN 'calibration' ELSE 'train_core' END AS split_role FROM c""",
)
def split_roles(spark, sf_dir):
    return S.split_roles(documents(spark, sf_dir), ["lang", "source"], "doc_id", ood=F.col("source").isin("src3", "src15"))


@query("fixed_sample", f"SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY {_H}, doc_id) <= 20")
def fixed_sample(spark, sf_dir):
    return S.fixed_per_group(documents(spark, sf_dir).select("doc_id", "lang"), ["lang"], "doc_id", 20)


@query("balanced_sample", f"SELECT doc_id, quality FROM labels QUALIFY row_number() OVER (PARTITION BY quality ORDER BY {_H}, doc_id) <= (SELECT min(n) FROM (SELECT count(*) AS n FROM labels GROUP BY quality))")
def balanced_sample(spark, sf_dir):
    return S.balanced(labels(spark, sf_dir).select("doc_id", "quality"), "quality", "doc_id")


@query(
    "stratified_sample",
    f"""WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1), q AS (SELECT lang, n, n * 100 / sum(n) OVER () AS q FROM c), b AS (SELECT *, greatest(1, floor(q)) AS base FROM q),
    r AS (SELECT *, 100 - sum(base) OVER () AS rest, row_number() OVER (ORDER BY q - floor(q) DESC, lang) AS r FROM b), t AS (SELECT lang, least(n, base + (r <= rest)::INT) AS take FROM r)
    SELECT doc_id, lang FROM (SELECT doc_id, d.lang, take, row_number() OVER (PARTITION BY d.lang ORDER BY {_H}, doc_id) AS k FROM documents d JOIN t ON d.lang = t.lang) WHERE k <= take""",
)
def stratified_sample(spark, sf_dir):
    return S.proportional(documents(spark, sf_dir).select("doc_id", "lang"), ["lang"], "doc_id", 100).select("doc_id", "lang")


@query("kfold", f"SELECT doc_id, quality, ((row_number() OVER (PARTITION BY quality ORDER BY {_H}, doc_id) - 1) % 5)::INT AS fold FROM labels")
def kfold(spark, sf_dir):
    return S.folds(labels(spark, sf_dir), "quality", "doc_id")


_START = "CASE WHEN {l} - {c} >= {r} THEN {r} + 8 * greatest(0, least(ceil((({l} - {c}) / 2.0::DOUBLE - {r}) / 8.0::DOUBLE - 0.5::DOUBLE), floor(({l} - {c} - {r}) / 8.0::DOUBLE))) END"


@query(
    "geometry_sweep",
    f"""WITH i AS (SELECT p_partkey, 150 + (p_partkey * 37) % 400 AS w, 140 + p_size * 9 AS h, (p_size > 25)::INT AS y FROM part), c AS (SELECT a.c, b.r FROM (SELECT unnest(range(128, 449, 8)) AS c) a, (SELECT unnest(range(0, 7)) AS r) b),
    s AS (SELECT c, r, y, w, h, {_START.format(l="w", c="c", r="r")} AS x0, {_START.format(l="h", c="c", r="r")} AS y0 FROM i, c), m AS (SELECT *, (x0 IS NOT NULL AND y0 IS NOT NULL)::INT AS ok, greatest(abs(x0 - (w - c) / 2.0::DOUBLE), abs(y0 - (h - c) / 2.0::DOUBLE)) AS drift FROM s)
    SELECT c::BIGINT AS crop, r::BIGINT AS residue, round(avg(ok), 9) AS accepted, round(avg(ok) FILTER (y = 1), 9) AS accepted_1, round(avg(ok) FILTER (y = 0), 9) AS accepted_0, round(coalesce(avg(drift) FILTER (ok = 1), -1), 6) AS drift FROM m GROUP BY 1, 2""",
)
def geometry_sweep(spark, sf_dir):
    """Crop sizes and residues over all images: the grid is fixed and small, each row meets it in a map."""
    i = part(spark, sf_dir).select((150 + F.pmod(F.col("p_partkey") * 37, F.lit(400))).alias("w"), (140 + F.col("p_size") * 9).cast("long").alias("h"), (F.col("p_size") > 25).cast("int").alias("y"))
    grid = i.select("*", F.explode(F.sequence(F.lit(128), F.lit(448), F.lit(8))).alias("c")).select("*", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("r"))
    start = lambda n: F.when(F.col(n) - F.col("c") >= F.col("r"), F.col("r") + 8 * F.greatest(F.lit(0), F.least(F.ceil(((F.col(n) - F.col("c")) / 2 - F.col("r")) / 8 - 0.5), F.floor((F.col(n) - F.col("c") - F.col("r")) / 8))))
    s = grid.withColumn("x0", start("w")).withColumn("y0", start("h")).withColumn("ok", (F.col("x0").isNotNull() & F.col("y0").isNotNull()).cast("int"))
    drift = F.greatest(F.abs(F.col("x0") - (F.col("w") - F.col("c")) / 2), F.abs(F.col("y0") - (F.col("h") - F.col("c")) / 2))
    when = lambda k: F.round(F.avg(F.when(F.col("y") == k, F.col("ok"))), 9)
    return s.groupBy(F.col("c").cast("long").alias("crop"), F.col("r").cast("long").alias("residue")).agg(
        F.round(F.avg("ok"), 9).alias("accepted"), when(1).alias("accepted_1"), when(0).alias("accepted_0"), F.round(F.coalesce(F.avg(F.when(F.col("ok") == 1, drift)), F.lit(-1.0)), 6).alias("drift")
    )


@query("alpha_composite", "SELECT l_orderkey, l_linenumber, ((l_suppkey % 256) * (l_partkey % 256) + (255 - l_suppkey % 256) * 128 + 127) // 255 AS v FROM lineitem")
def alpha_composite(spark, sf_dir):
    v = X.composite(F.col("l_partkey") % 256, F.col("l_suppkey") % 256)
    return lineitem(spark, sf_dir).select("l_orderkey", "l_linenumber", v.cast("long").alias("v"))


@query("route", f"{SCORED} SELECT doc_id, CASE WHEN p < 0.30 THEN 'LOW' WHEN p >= 0.7 THEN 'HIGH' ELSE 'MEDIUM' END AS level, CASE WHEN p < 0.30 THEN 'pass' WHEN p >= 0.7 THEN 'flag' ELSE 'review' END AS action FROM s")
def route(spark, sf_dir):
    return scored(spark, sf_dir).select("doc_id", X.route(F.col("p"), F.lit(0.7)).alias("r")).select("doc_id", "r.level", "r.action")


@query("winsorise", "SELECT l_orderkey, l_linenumber, greatest(least(l_extendedprice, hi), lo) AS v FROM lineitem, (SELECT quantile_cont(l_extendedprice, 0.01) AS lo, quantile_cont(l_extendedprice, 0.99) AS hi FROM lineitem)")
def winsorise(spark, sf_dir):
    l = lineitem(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_extendedprice")
    caps = quantiles(l, "l_extendedprice", [0.01, 0.99])
    return l.crossJoin(F.broadcast(caps)).select("l_orderkey", "l_linenumber", X.winsorised(F.col("l_extendedprice"), F.col("q0"), F.col("q1")).alias("v"))  # caps is one row


@query("status_decision", "SELECT p_partkey, CASE WHEN p_size % 17 = 0 THEN 'DECODE_ERROR' WHEN p_size % 5 = 0 THEN 'UNSUPPORTED_INPUT' WHEN p_size % 7 = 0 THEN 'UNSUPPORTED_INPUT' WHEN least(p_size * 10, p_partkey % 600) < 252 THEN 'LOW_SUPPORT' ELSE 'ACCEPTED' END AS status FROM part")
def status_decision(spark, sf_dir):
    z = F.col("p_size")
    s = X.status(z % 17 != 0, F.when(z % 5 == 0, "GIF").otherwise("PNG"), F.when(z % 7 == 0, "L").otherwise("RGB"), z * 10, F.col("p_partkey") % 600)
    return part(spark, sf_dir).select("p_partkey", s.alias("status"))


@query("logit_and_rounding", "SELECT event_id, round(ln(p / (1 - p)), 9) AS logit, round_even(value, 0) AS even FROM (SELECT event_id, value, greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, value / 100)) AS p FROM events)")
def logit_and_rounding(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", F.round(X.safe_logit(F.col("value") / 100), 9).alias("logit"), X.half_even(F.col("value")).alias("even"))


@query("three_valued_flags", "SELECT o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN 'true' WHEN o_orderstatus = 'O' THEN 'false' ELSE 'null' END AS flag, count(*) AS n FROM orders GROUP BY 1, 2")
def three_valued_flags(spark, sf_dir):
    s = F.when(F.col("o_orderstatus") == "F", " Yes").when(F.col("o_orderstatus") == "O", "0").otherwise("maybe")
    return orders(spark, sf_dir).select("o_orderstatus", F.coalesce(X.three_valued(s).cast("string"), F.lit("null")).alias("flag")).groupBy("o_orderstatus", "flag").agg(F.count("*").alias("n"))


@query("top_contributors", "SELECT l_orderkey, l_linenumber, array_to_string(list_transform(list_sort([{'k': -round(abs(l_quantity), 6), 'f': 'quantity'}, {'k': -round(abs(l_discount * 100), 6), 'f': 'discount'}, {'k': -round(abs(l_tax * -200), 6), 'f': 'tax'}, {'k': -round(abs(l_extendedprice / 1000), 6), 'f': 'price'}])[1:3], lambda x: x.f), ',') AS top FROM lineitem")
def top_contributors(spark, sf_dir):
    v = {"quantity": F.col("l_quantity"), "discount": F.col("l_discount") * 100, "tax": F.col("l_tax") * -200, "price": F.col("l_extendedprice") / 1000}
    pairs = F.array_sort(F.array(*[F.struct((-F.round(F.abs(c), 6)).alias("k"), F.lit(n).alias("f")) for n, c in v.items()]))
    return lineitem(spark, sf_dir).select("l_orderkey", "l_linenumber", F.array_join(F.transform(F.slice(pairs, 1, 3), lambda x: x["f"]), ",").alias("top"))


@query("file_digests", "SELECT page_id, sha256(html) AS sha256, octet_length(encode(html)) AS size_bytes FROM pages")
def file_digests(spark, sf_dir):
    from tessera.plans.relational import pages

    return pages(spark, sf_dir).select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("sha256"), F.octet_length("html").cast("long").alias("size_bytes"))


@query("rank_alignment", "SELECT c_custkey, s_suppkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS k FROM customer) JOIN (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS k FROM supplier) USING (k)")
def rank_alignment(spark, sf_dir):
    """All rows of two tables aligned by rank, as far as the shorter one goes."""
    c = ranked(customer(spark, sf_dir).select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey")
    s = ranked(supplier(spark, sf_dir).select("s_suppkey", "s_acctbal"), "s_acctbal", "s_suppkey")
    return c.join(s, "rank").select("c_custkey", "s_suppkey")
