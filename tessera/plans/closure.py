"""Queries of table contracts, candidate suites, geometry choice, output paths and text rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import scalars as X
from tessera.operators import closure as C
from tessera.operators import contracts, legacy, models
from tessera.operators import metrics as M
from tessera.operators.sampling import split_roles
from tessera.plans.evaluation import _EDGES, FEATURED, _FEATURES, featured, mid_rank_auc
from tessera.plans.registry import query
from tessera.plans.relational import documents, events, labels, lineitem, orders, pages, part
from tessera.sources import artifacts

_SCORES = """WITH b AS (SELECT doc_id, n_chars, quality AS y, CASE doc_id % 3 WHEN 0 THEN 'val' WHEN 1 THEN 'id_test' ELSE 'ood_eval' END AS split, CASE WHEN n_chars % 2 = 0 THEN 1 ELSE 0 END AS k420 FROM documents JOIN labels USING (doc_id)),
    c AS (SELECT b.*, t.candidate, t.threshold, round(1 / (1 + exp(-(ln(n_chars) - t.mid))), 9) AS p FROM b, (VALUES ('full_v2__logreg', 7.0::DOUBLE, 0.5::DOUBLE), ('full_v2__gbt', 6.0::DOUBLE, 0.7::DOUBLE), ('always_on__logreg', 8.0::DOUBLE, 0.3::DOUBLE)) t(candidate, mid, threshold)),
    d AS (SELECT * EXCLUDE (p), x.degradation, round(p * (1 - x.loss * (doc_id % 4)), 9) AS p FROM c, (VALUES ('jpeg90_420', 0.05::DOUBLE), ('resize50_bilinear', 0.2::DOUBLE)) x(degradation, loss))"""
_CANDIDATES = [("full_v2__logreg", 7.0, 0.5, "full_v2"), ("full_v2__gbt", 6.0, 0.7, "full_v2"), ("always_on__logreg", 8.0, 0.3, "always_on")]
_LOSSES = [("jpeg90_420", 0.05), ("resize50_bilinear", 0.2)]


def _measures(source: str, keys: str) -> str:
    """SQL of ``closure.suite`` over rows of ``source``, pooled rows included; gives the CTEs p_, and m_ with the measures."""
    s = f"p_{source} AS (SELECT * FROM {source} UNION ALL SELECT * REPLACE ('pooled_eval' AS split) FROM {source} WHERE split IN ('id_test', 'ood_eval'))"
    a = f"a_{source} AS ({mid_rank_auc(keys, 'y', 'p', 'p_' + source)})"
    bins = f"list_sum(list_transform([{_EDGES}], lambda e: (p >= e)::INT))"
    e = f"e_{source} AS (SELECT {keys}, sum(n * abs(acc - conf)) / sum(n) AS ece FROM (SELECT {keys}, {bins} AS bin, count(*) AS n, avg(y) AS acc, avg(p) AS conf FROM p_{source} GROUP BY ALL) GROUP BY ALL)"
    m = f"r_{source} AS (SELECT {keys}, avg((p - y) * (p - y)) AS brier, count(*) FILTER (y = 1 AND p >= threshold) / greatest(1, count(*) FILTER (y = 1)) AS tpr, count(*) FILTER (y = 0 AND p >= threshold) / greatest(1, count(*) FILTER (y = 0)) AS fpr FROM p_{source} GROUP BY ALL)"
    return f"{s}, {a}, {e}, {m}, m_{source} AS (SELECT * FROM r_{source} JOIN a_{source} USING ({keys}) JOIN e_{source} USING ({keys}))"


def _base(spark, sf_dir):
    b = documents(spark, sf_dir).select("doc_id", "n_chars").join(labels(spark, sf_dir).select("doc_id", F.col("quality").alias("y")), "doc_id")
    split = F.when(F.col("doc_id") % 3 == 0, "val").when(F.col("doc_id") % 3 == 1, "id_test").otherwise("ood_eval")
    mids = F.array(*[F.struct(F.lit(c).alias("candidate"), F.lit(m).alias("mid")) for c, m, _, _ in _CANDIDATES])
    c = b.select("doc_id", "n_chars", "y", split.alias("split"), F.explode(mids).alias("c"))
    return c.select("doc_id", "n_chars", "y", "split", "c.candidate", F.round(1 / (1 + F.exp(-(F.log("n_chars") - F.col("c.mid")))), 9).alias("p"))


def _degraded(c):
    losses = F.array(*[F.struct(F.lit(d).alias("degradation"), F.lit(x).alias("loss")) for d, x in _LOSSES])
    d = c.withColumn("x", F.explode(losses))
    return d.select("doc_id", "y", "split", "candidate", "x.degradation", F.round(F.col("p") * (1 - F.col("x.loss") * (F.col("doc_id") % 4)), 9).alias("p"))


def _thresholds(spark):
    return F.broadcast(spark.createDataFrame([(c, t) for c, _, t, _ in _CANDIDATES], "candidate string, threshold double"))  # a row per candidate


def _suite(scores, spark, keys):
    return C.suite(scores, _thresholds(spark), keys).withColumn("auc", F.round("auc", 9))


_GAPS = ", ".join(f"round(c.{m}, 9) AS clean_{m}, round(d.{m}, 9) AS {m}, round(d.{m} - c.{m}, 9) AS {m}_gap" for m in C.MEASURES)


@query("degradation_gaps", f"{_SCORES}, {_measures('c', 'candidate, split')}, {_measures('d', 'degradation, candidate, split')} SELECT d.candidate, d.degradation, d.split, {_GAPS} FROM m_d d LEFT JOIN m_c c ON d.candidate = c.candidate AND d.split = c.split")
def degradation_gaps(spark, sf_dir):
    """Every measure of every candidate under every degradation, by split, against the clean rows."""
    c = _base(spark, sf_dir)
    g = C.gaps(_suite(c, spark, []), _suite(_degraded(c), spark, ["degradation"]))
    return g.select("candidate", "degradation", "split", *[F.round(f"{a}{m}{z}", 9).alias(f"{a}{m}{z}") for m in C.MEASURES for a, z in (("clean_", ""), ("", ""), ("", "_gap"))])


_NAT = f"n AS (SELECT candidate, split, k420 AS nuisance, p FROM c WHERE y = 0), pn AS (SELECT * FROM n UNION ALL SELECT * REPLACE ('pooled_eval' AS split) FROM n WHERE split IN ('id_test', 'ood_eval')), an AS ({mid_rank_auc('candidate, split', 'nuisance', 'p', 'pn')}), mn AS (SELECT candidate, split, count(*) AS n_rows, count(*) FILTER (nuisance = 1) AS n_420, count(*) FILTER (nuisance = 0) AS n_444, avg(p) FILTER (nuisance = 1) AS a, avg(p) FILTER (nuisance = 0) AS b FROM pn GROUP BY ALL)"


def _nuisance(spark, sf_dir):
    kind = F.when(F.col("n_chars") % 2 == 0, "4:2:0").otherwise("4:4:4")
    return C.nuisance(contracts.nuisance_rows(_base(spark, sf_dir), kind))


@query("nuisance_auc", f"{_SCORES}, {_NAT} SELECT candidate, split, n_rows, n_420, n_444, auc AS auc_nat_raw, greatest(auc, 1 - auc) AS auc_nat_abs, round(a, 6) AS pred_mean_420, round(b, 6) AS pred_mean_444, round(a - b, 6) AS pred_gap_420_minus_444 FROM mn JOIN an USING (candidate, split)")
def nuisance_auc(spark, sf_dir):
    """How far the scores of real rows tell the subsampling."""
    n = _nuisance(spark, sf_dir).withColumn("auc_nat_raw", F.round("auc_nat_raw", 9))
    return n.select("candidate", "split", "n_rows", "n_420", "n_444", "auc_nat_raw", F.greatest("auc_nat_raw", 1 - F.col("auc_nat_raw")).alias("auc_nat_abs"), *[F.round(c, 6).alias(c) for c in ("pred_mean_420", "pred_mean_444", "pred_gap_420_minus_444")])


@query(
    "branch_closure",
    f"""{_SCORES}, {_measures('c', 'candidate, split')}, {_measures('d', 'degradation, candidate, split')}, {_NAT}, g AS (SELECT d.candidate, min(d.auc) AS worst_xdeg_auc, avg(d.auc) AS mean_xdeg_auc, min(d.auc - c.auc) AS worst_auc_gap FROM m_d d JOIN m_c c USING (candidate, split) WHERE split = 'pooled_eval' GROUP BY 1)
    SELECT v.candidate, round(v.auc, 9) AS val_auc, round(c.auc, 9) AS clean_pooled_auc, round(c.tpr, 9) AS clean_pooled_tpr, greatest(an.auc, 1 - an.auc) AS auc_nat_abs, round(worst_xdeg_auc, 9) AS worst_xdeg_auc, round(mean_xdeg_auc, 9) AS mean_xdeg_auc, round(worst_auc_gap, 9) AS worst_auc_gap,
    v.candidate LIKE 'full_v2%' AS uses_research_wavelet, v.candidate LIKE 'full_v2%' AS uses_research_ysrm, v.candidate LIKE 'full_v2%' AS uses_conditional_cfa FROM m_c v JOIN m_c c ON c.candidate = v.candidate AND c.split = 'pooled_eval' JOIN an ON an.candidate = v.candidate AND an.split = 'pooled_eval' JOIN g ON g.candidate = v.candidate WHERE v.split = 'val'""",
)
def branch_closure(spark, sf_dir):
    """A row per candidate with its clean, nuisance and worst degraded results and the branches it uses."""
    c = _base(spark, sf_dir)
    clean = M.checkpointed(_suite(c, spark, []))
    gap = C.gaps(clean, _suite(_degraded(c), spark, ["degradation"]))
    sets = spark.createDataFrame([(c, s) for c, _, _, s in _CANDIDATES], "candidate string, feature_set string")
    val = clean.filter(F.col("split") == "val").select("candidate", F.col("auc").alias("val_auc"))
    b = C.branches(sets.join(val, "candidate"), clean, _nuisance(spark, sf_dir).withColumn("auc_nat_abs", F.round("auc_nat_abs", 9)), gap)
    return b.select("candidate", *[F.round(x, 9).alias(x) for x in ("val_auc", "clean_pooled_auc", "clean_pooled_tpr", "auc_nat_abs", "worst_xdeg_auc", "mean_xdeg_auc", "worst_auc_gap")], *contracts.USES)


_SHIFT = " UNION ALL ".join(f"SELECT '{f}' AS feature, quality, lang, {f} AS x FROM f" for f in _FEATURES)
_GATE_LONG = " UNION ALL ".join(f"SELECT '{f}' AS feature, '{s}' AS slice, {y} AS y, {f} AS x FROM f WHERE {w}" for f in _FEATURES for s, y, w in (("clean", "quality", "true"), ("nuisance", "toxic", "quality = 1")))


@query(
    "feature_gates",
    f"""{FEATURED}, u AS ({_GATE_LONG}), a AS ({mid_rank_auc('feature, slice', 'y', 'x', 'u')}), l AS ({_SHIFT}), s AS (SELECT feature, avg(x) AS m, stddev_pop(x) AS s FROM l WHERE lang = 'en' GROUP BY 1),
    z AS (SELECT feature, max(v) AS shift FROM (SELECT feature, quality, avg(abs((x - m) / s)) AS v FROM l JOIN s USING (feature) WHERE lang <> 'en' GROUP BY 1, 2) GROUP BY 1), j AS (SELECT feature, max(greatest(auc, 1 - auc)) FILTER (slice = 'clean') AS clean, max(greatest(auc, 1 - auc)) FILTER (slice = 'nuisance') AS nuisance FROM a GROUP BY 1)
    SELECT feature, clean, nuisance, round(shift, 6) AS shift, (clean > 0.75 AND nuisance < 0.65 AND shift < 1.0) AS gate FROM j JOIN z USING (feature)""",
)
def feature_gates(spark, sf_dir):
    f = featured(spark, sf_dir)
    a = M.checkpointed(M.feature_audit(f, _FEATURES, {"clean": (F.lit(True), "quality"), "nuisance": (F.col("quality") == 1, "toxic")}).withColumn("auc_abs", F.greatest(F.round("auc", 9), 1 - F.round("auc", 9))))
    long = f.unpivot(["quality", "lang"], _FEATURES, "feature", "x")
    m = long.filter("lang = 'en'").groupBy("feature").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    z = long.filter("lang <> 'en'").join(m, "feature").groupBy("feature", "quality").agg(F.avg(F.abs((F.col("x") - F.col("m")) / F.col("s"))).alias("shift"))
    of = lambda s: a.filter(F.col("slice") == s)
    return C.feature_gates(of("clean"), of("nuisance"), z).select("feature", "clean", "nuisance", F.round("shift", 6).alias("shift"), "gate")


_START = "CASE WHEN {l} - c >= r THEN r + 8 * greatest(0, least(ceil((({l} - c) / 2.0::DOUBLE - r) / 8.0::DOUBLE - 0.5::DOUBLE), floor(({l} - c - r) / 8.0::DOUBLE))) END"
_H = "(CASE WHEN {p} > 1e-12 THEN {p} * log2({p} / ({q})) ELSE 0 END)"
_MI = " + ".join(_H.format(p=p, q=q) for p, q in (("y0 * pr", "y0 * pz"), ("y0 * (1 - pr)", "y0 * (1 - pz)"), ("(1 - y0) * pa", "(1 - y0) * pz"), ("(1 - y0) * (1 - pa)", "(1 - y0) * (1 - pz)")))
_SWEEP = f"""WITH i AS (SELECT 200 + (p_partkey * 37) % 400 AS w, 210 + p_size * 9 AS h, (p_size > 6)::INT AS ai FROM part), g AS (SELECT i.*, least(w, h) AS s, a.c, b.r FROM i, (SELECT unnest(range(216, 257)) AS c) a, (SELECT unnest(range(1, 8)) AS r) b),
    o AS (SELECT *, s >= c + r AS ok, {_START.format(l="w")} AS x0, {_START.format(l="h")} AS y0 FROM g), m AS (SELECT c, r, avg((ai = 0)::INT) AS y0, avg(ok::INT) FILTER (ai = 1) AS pa, avg(ok::INT) FILTER (ai = 0) AS pr, avg(ok::INT) AS total, count(*) FILTER (ok) AS n, avg(c * c / (s * s)::DOUBLE) FILTER (ok) AS kept, avg(greatest(abs(x0 - (w - c) / 2.0::DOUBLE), abs(y0 - (h - c) / 2.0::DOUBLE))) FILTER (ok) AS off FROM o GROUP BY 1, 2), q AS (SELECT *, y0 * pr + (1 - y0) * pa AS pz FROM m),
    sweep AS (SELECT c::INT AS crop_size, r::INT AS residue, (c + r)::INT AS threshold, round(pa, 9) AS accepted_ai, round(pr, 9) AS accepted_real, round(pr - pa, 9) AS coverage_gap_real_minus_ai, round(total, 9) AS coverage_total, n AS accepted_total, round(greatest(0, {_MI}), 9) AS mi_bits, round(kept, 9) AS mean_retained_area, round(off, 9) AS mean_center_linf, least(r, 8 - r)::INT AS phase_distance FROM q)"""


def _sweep(spark, sf_dir):
    i = part(spark, sf_dir).select((200 + F.pmod(F.col("p_partkey") * 37, F.lit(400))).alias("width"), (210 + F.col("p_size") * 9).alias("height"), (F.col("p_size") > 6).alias("ai"))
    s = C.geometry(i, F.sequence(F.lit(216), F.lit(256)), F.sequence(F.lit(1), F.lit(7)), F.col("ai"))
    rounded = {c: F.round(c, 9) for c in ("accepted_ai", "accepted_real", "coverage_gap_real_minus_ai", "coverage_total", "mi_bits", "mean_retained_area", "mean_center_linf")}
    return s.withColumns(rounded)


@query("geometry_audit", f"{_SWEEP} SELECT * FROM sweep")
def geometry_audit(spark, sf_dir):
    return _sweep(spark, sf_dir)


@query("geometry_recommendation", f"{_SWEEP} SELECT * FROM sweep WHERE crop_size % 8 = 0 AND accepted_ai >= 0.2 ORDER BY crop_size DESC, phase_distance DESC, mean_center_linf, coverage_total DESC, residue LIMIT 1")
def geometry_recommendation(spark, sf_dir):
    """The crop and residue to use, one row."""
    return C.recommended(_sweep(spark, sf_dir), least=0.2)


@query("training_table", "SELECT CASE quality WHEN 1 THEN 1 ELSE 0 END AS y, count(*) AS n, sum(n_chars)::BIGINT AS total FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def training_table(spark, sf_dir):
    """Rows by class of a table whose contract was checked."""
    name = F.when(F.col("quality") == 1, F.when(F.col("doc_id") % 2 == 0, "ai").otherwise("fake")).otherwise(F.when(F.col("doc_id") % 2 == 0, "nature").otherwise("real"))
    d = documents(spark, sf_dir).join(labels(spark, sf_dir), "doc_id").select("doc_id", "n_chars", name.alias("label"), F.lit("val").alias("split_role"), F.lit("ok").alias("status"), F.lit("2").alias("feature_version"))
    return contracts.training_table(d, {"feature_version": "2"}).groupBy("y").agg(F.count("*").alias("n"), F.sum("n_chars").alias("total"))


@query("split_counts", "WITH d AS (SELECT doc_id, lang, source, count(*) OVER w AS n, row_number() OVER (PARTITION BY lang, source ORDER BY sha256('42|' || doc_id), doc_id) AS k FROM documents WINDOW w AS (PARTITION BY lang, source)), s AS (SELECT *, round_even(n * 0.25::DOUBLE, 0) AS t, round_even(n * 0.25::DOUBLE, 0) AS v FROM d), c AS (SELECT *, round_even((n - t - v) * 0.4::DOUBLE, 0) AS c FROM s) SELECT CASE WHEN source IN ('src3', 'src15') THEN 'ood_eval' WHEN k <= t THEN 'id_test' WHEN k <= t + v THEN 'val' WHEN k <= t + v + c THEN 'calibration' ELSE 'train_core' END AS split_role, count(*) AS n FROM c GROUP BY 1")
def split_counts(spark, sf_dir):
    """The rows of each required split, none of them empty."""
    d = M.checkpointed(split_roles(documents(spark, sf_dir), ["lang", "source"], "doc_id", 0.25, 0.25, 0.4, ood=F.col("source").isin("src3", "src15")))
    out = None
    for name, part_ in contracts.split_frames(d).items():
        one = part_.agg(F.count("*").alias("n")).select(F.lit(name).alias("split_role"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("subsampling_labels", "SELECT l_returnflag, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 0 ELSE -1 END AS label, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 0 ELSE -1 END AS nuisance_is_420, count(*) AS n FROM lineitem GROUP BY 1")
def subsampling_labels(spark, sf_dir):
    kind = F.when(F.col("l_returnflag") == "R", "4:4:4").when(F.col("l_returnflag") == "A", "4:2:0")
    nuisance = F.when(kind == "4:2:0", 1).when(kind == "4:4:4", 0)
    return lineitem(spark, sf_dir).groupBy("l_returnflag").agg(F.coalesce(F.max(contracts.subsampling_label(kind)), F.lit(-1)).alias("label"), F.coalesce(F.max(nuisance), F.lit(-1)).alias("nuisance_is_420"), F.count("*").alias("n"))


@query("usage_flags", "SELECT s AS feature_set, n, s IN ('full_v2', 'full_v2_minus_conditional_cfa') AS uses_research_wavelet, s IN ('full_v2', 'full_v2_minus_conditional_cfa') AS uses_research_ysrm, s IN ('full_v2', 'always_on_plus_cfa_gated') AS uses_conditional_cfa FROM (SELECT CASE o_orderpriority[1] WHEN '1' THEN 'full_v2' WHEN '2' THEN 'full_v2_minus_conditional_cfa' WHEN '3' THEN 'always_on_plus_cfa_gated' ELSE 'always_on' END AS s, count(*) AS n FROM orders GROUP BY 1)")
def usage_flags(spark, sf_dir):
    k = F.substring("o_orderpriority", 1, 1)
    s = F.when(k == "1", "full_v2").when(k == "2", "full_v2_minus_conditional_cfa").when(k == "3", "always_on_plus_cfa_gated").otherwise("always_on")
    return orders(spark, sf_dir).groupBy(s.alias("feature_set")).agg(F.count("*").alias("n")).withColumns(contracts.usage_flags(F.col("feature_set")))


@query("payload_status", "SELECT CASE WHEN octet_length(encode(html)) = 0 THEN 'empty' WHEN octet_length(encode(html)) > 1500 THEN 'too large' ELSE 'ok' END AS status, count(*) AS n FROM pages GROUP BY 1")
def payload_status(spark, sf_dir):
    return pages(spark, sf_dir).groupBy(contracts.payload_status(F.col("html"), 1500).alias("status")).agg(F.count("*").alias("n"))


@query("union_of_keys", "SELECT unnest(range(8))::INT AS place, unnest(['doc_id', 'text', 'lang', 'source', 'n_chars', 'quality', 'toxic', 'page_id']) AS key UNION ALL VALUES (8, 'url'), (9, 'html')")
def union_of_keys(spark, sf_dir):
    """The columns of three tables, each once, in the order in which they first appear."""
    keys = contracts.union_of_keys(*(t(spark, sf_dir).columns for t in (documents, labels, pages)))
    return spark.createDataFrame(list(enumerate(keys)), "place int, key string")


@query("gated_features", "WITH t AS (SELECT quantile_cont(l_tax, 0.75) AS thr FROM lineitem WHERE l_linestatus = 'F') SELECT l_orderkey, l_linenumber, round(l_discount * (l_tax >= thr)::INT, 9) AS discount_gated, round(l_quantity * (l_tax >= thr)::INT, 9) AS quantity_gated, (l_tax >= thr)::INT AS gate FROM lineitem, t")
def gated_features(spark, sf_dir):
    """Features times the gate of a training slice's quantile."""
    from tessera.operators.ordered import quantiles

    l = lineitem(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_linestatus", "l_discount", "l_quantity", "l_tax")
    thr = quantiles(l.filter("l_linestatus = 'F'"), "l_tax", [0.75]).select(F.col("q0").alias("thr"))
    gate = X.at_least(F.col("l_tax"), F.col("thr")).cast("int")
    d = l.crossJoin(F.broadcast(thr))  # one row
    return d.select("l_orderkey", "l_linenumber", *[F.round(X.gated(F.col(f"l_{c}"), gate), 9).alias(f"{c}_gated") for c in ("discount", "quantity")], gate.alias("gate"))


@query("compare_frames", "SELECT 'o_totalprice' AS \"column\", 0.0::DOUBLE AS max_diff, 0.0::DOUBLE AS mean_diff, count(*) AS n, true AS close FROM orders UNION ALL SELECT 'o_custkey', 0.5, round(avg(CASE WHEN o_orderkey % 3 = 0 THEN 0.5::DOUBLE ELSE 0 END), 6), count(*), false FROM orders")
def compare_frames(spark, sf_dir):
    """Differences of two results by key, column for column, and whether they are within 1e-8."""
    o = orders(spark, sf_dir).select("o_orderkey", "o_totalprice", "o_custkey")
    other = o.withColumn("o_custkey", F.col("o_custkey") + F.when(F.col("o_orderkey") % 3 == 0, 0.5).otherwise(0.0))
    d = M.aligned_difference(o, other, ["o_orderkey"], ["o_totalprice", "o_custkey"])
    return d.select("column", F.round("max_diff", 9).alias("max_diff"), F.round("mean_diff", 6).alias("mean_diff"), "n", (F.col("max_diff") <= 1e-8).alias("close"))


@query(
    "variant_metrics",
    f"{FEATURED}, l AS ({_SHIFT}), g AS (SELECT lang, feature, count(*) FILTER (quality = 1) AS n1, count(*) FILTER (quality = 0) AS n0, avg(x) FILTER (quality = 1) AS m1, avg(x) FILTER (quality = 0) AS m0, var_samp(x) FILTER (quality = 1) AS v1, var_samp(x) FILTER (quality = 0) AS v0 FROM l GROUP BY 1, 2), d AS (SELECT lang, feature, CASE WHEN n1 > 1 AND n0 > 1 AND ((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2) > 1e-24 THEN abs(m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)) END AS d FROM g) SELECT lang AS variant, round(coalesce(sum(d), 0), 5) AS total_d, round(coalesce(sum(d) FILTER (feature IN ('n_chars', 'n_words')), 0), 5) AS length_d, round(coalesce(sum(d) FILTER (feature NOT IN ('n_chars', 'n_words')), 0), 5) AS form_d FROM d GROUP BY 1",
)
def variant_metrics(spark, sf_dir):
    """Sums of |d| over all features and per family, for every variant."""
    long = featured(spark, sf_dir).unpivot(["quality", "lang"], _FEATURES, "feature", "x")
    d = M.cohen_d(long, "quality", "x", ["lang", "feature"]).withColumn("d", F.abs("cohen_d"))
    length = F.col("feature").isin("n_chars", "n_words")
    total = lambda c: F.round(F.coalesce(F.sum(c), F.lit(0.0)), 5)
    return d.groupBy(F.col("lang").alias("variant")).agg(total(F.col("d")).alias("total_d"), total(F.when(length, F.col("d"))).alias("length_d"), total(F.when(~length, F.col("d"))).alias("form_d"))


@query("mean_pivot", "SELECT l_returnflag, round(coalesce(avg(l_discount) FILTER (l_linestatus = 'F'), 0), 6) AS F, round(coalesce(avg(l_discount) FILTER (l_linestatus = 'O'), 0), 6) AS O FROM lineitem GROUP BY 1")
def mean_pivot(spark, sf_dir):
    return lineitem(spark, sf_dir).groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.round(F.avg("l_discount"), 6)).fillna(0.0)


@query(
    "feature_table_summary",
    "WITH f AS (SELECT user_id % 3 AS split_role, event_type AS generator, CASE WHEN event_id % 50 = 0 THEN 'error' ELSE 'ok' END AS status, CASE WHEN event_id % 17 <> 0 THEN value END AS v FROM events) SELECT split_role::BIGINT AS split_role, generator, count(*) AS rows, count(*) FILTER (status <> 'ok') AS errors, count(*) - count(v) AS missing, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(quantile_cont(v, 0.1), 6) AS q10, round(quantile_cont(v, 0.5), 6) AS q50, round(quantile_cont(v, 0.9), 6) AS q90 FROM f GROUP BY 1, 2",
)
def feature_table_summary(spark, sf_dir):
    e = events(spark, sf_dir).select((F.col("user_id") % 3).alias("split_role"), F.col("event_type").alias("generator"), F.when(F.col("event_id") % 50 == 0, "error").otherwise("ok").alias("status"), F.when(F.col("event_id") % 17 != 0, F.col("value")).otherwise(F.lit(float("nan"))).alias("v"))
    return contracts.summary(e, "v").withColumns({c: F.round(c, 6) for c in ("mean", "std", "q10", "q50", "q90")})


@query("phase_distances", "SELECT p_partkey, least((p_size - p_partkey % 11 + 88) % 8, 8 - (p_size - p_partkey % 11 + 88) % 8)::BIGINT AS distance FROM part")
def phase_distances(spark, sf_dir):
    return part(spark, sf_dir).select("p_partkey", X.phase_distance(F.col("p_size").cast("long"), F.col("p_partkey") % 11).alias("distance"))


_LE = "CAST('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) AS BIGINT)"


@query("hash_choices", f"SELECT page_id, (90 + {_LE} % 9)::INT AS quality, ['a', 'b', 'c', 'd', 'e'][{_LE} % 5 + 1] AS pick FROM (SELECT page_id, sha256(url) AS h FROM pages)")
def hash_choices(spark, sf_dir):
    """A quality and a member of a pool by the hash of a name."""
    return pages(spark, sf_dir).select("page_id", legacy.hash_quality(F.col("url")).alias("quality"), legacy.hash_pick(F.col("url"), ["e", "d", "c", "b", "a"]).alias("pick"))


_SIDE = "(greatest({n}, 259) // 2 - 128 - greatest((259 - {n}) // 2, 0)) % 8"


@query("grid_misalignment", f"SELECT p_partkey, ({_SIDE.format(n='w')} = 0 OR {_SIDE.format(n='h')} = 0) AS on_grid FROM (SELECT p_partkey, 150 + (p_partkey * 37) % 400 AS w, 140 + p_size * 9 AS h FROM part)")
def grid_misalignment(spark, sf_dir):
    d = part(spark, sf_dir).select("p_partkey", (150 + F.col("p_partkey") * 37 % 400).alias("w"), (140 + F.col("p_size") * 9).alias("h"))
    return d.select("p_partkey", legacy.on_grid(F.col("w"), F.col("h")).alias("on_grid"))


@query("output_paths", "SELECT page_id, '/out/' || CASE WHEN starts_with(url, 'https://example.org/') THEN substr(url, 21) WHEN starts_with(url, 'http') THEN list_extract(string_split(url, '/'), -1) ELSE url END || '.npy' AS output_path FROM pages")
def output_paths(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", artifacts.output_path(F.col("url"), "https://example.org", "/out").alias("output_path"))


@query("stale_outputs", "SELECT p_partkey, '/out/' || p_partkey AS output_path FROM part WHERE p_size <= 20 AND p_partkey % 2 = 0")
def stale_outputs(spark, sf_dir):
    """Outputs of sources that are no longer accepted."""
    p = part(spark, sf_dir).select("p_partkey", F.concat(F.lit("/out/"), F.col("p_partkey").cast("string")).alias("output_path"), F.when(F.col("p_size") > 20, "ACCEPTED").otherwise("LOW_SUPPORT").alias("status"))
    return artifacts.stale_outputs(p, p.filter("p_partkey % 2 = 0").select("p_partkey", "output_path"))


@query("label_by_depth", "WITH p AS (SELECT page_id, list_filter(list_transform(string_split(url, '/')[1:-2], lambda x: CASE WHEN lower(x) IN ('en', 'page') THEN 'fake' WHEN lower(x) IN ('de', 'fr') THEN 'real' END), lambda x: x IS NOT NULL) AS v FROM pages) SELECT page_id, coalesce(v[1], 'unknown') AS label FROM p")
def label_by_depth(spark, sf_dir):
    """The label of the uppermost folder that has one, the file's name left out."""
    return pages(spark, sf_dir).select("page_id", F.coalesce(X.first_part(F.col("url"), {"en": "fake", "page": "fake", "de": "real", "fr": "real"}), F.lit("unknown")).alias("label"))


@query("clean_text", "SELECT page_id, nullif(trim(replace(' ' || url || '  ', chr(0), ' ')), '') AS s FROM pages")
def clean_text(spark, sf_dir):
    """Bytes as text without blanks and zero bytes at the ends."""
    raw = F.concat(F.lit(" \x00"), F.col("url"), F.lit("\x00 ")).cast("binary")
    return pages(spark, sf_dir).select("page_id", X.clean_text(raw).alias("s"))


@query("json_keys", "SELECT event_type, '{' || string_agg('\"' || k || '\":' || n, ',' ORDER BY k) || '}' AS json FROM (SELECT event_type, user_id % 4 AS k, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def json_keys(spark, sf_dir):
    """A map with numbers for keys, as JSON."""
    c = events(spark, sf_dir).groupBy("event_type", (F.col("user_id") % 4).alias("k")).agg(F.count("*").alias("n"))
    m = c.groupBy("event_type").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias("m"))
    return m.select("event_type", F.to_json(artifacts.stringified(F.col("m"))).alias("json"))


@query("ranked_variants", "SELECT l_returnflag, l_linestatus, n, row_number() OVER (ORDER BY CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END, n DESC, l_returnflag)::INT AS rank FROM (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2)")
def ranked_variants(spark, sf_dir):
    """Groups by severity, then size."""
    g = lineitem(spark, sf_dir).groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    return g.withColumn("rank", F.row_number().over(Window.orderBy(F.when(F.col("l_linestatus") == "F", 0).otherwise(1), F.desc("n"), "l_returnflag")))  # a row per group


@query("accepted_rows", "SELECT p_brand AS generator, count(*) AS n, min(p_partkey) AS first, coalesce(CASE WHEN p_brand LIKE '%1' THEN 'v5' END, 'v4') AS preprocess_version, 'parts' AS dataset_name FROM part WHERE p_size > 20 AND p_partkey % 3 = 0 GROUP BY 1, 4")
def accepted_rows(spark, sf_dir):
    """Accepted rows with a saved patch, renamed and completed, by generator."""
    status = F.when(F.col("p_size") > 20, "ACCEPTED").otherwise("LOW_SUPPORT")
    p = part(spark, sf_dir).select("p_partkey", "p_brand", status.alias("status"), (F.col("p_partkey") % 3 == 0).alias("saved_patch"), F.when(F.col("p_brand").endswith("1"), "v5").alias("preprocess_version"))
    a = contracts.accepted(p, "parts", "v4", {"p_brand": "generator"})
    return a.groupBy("generator", "preprocess_version", "dataset_name").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))


@query("coerced_numbers", "SELECT o_orderstatus, count(TRY_CAST(x AS DOUBLE)) AS n_numbers, count(*) - count(TRY_CAST(x AS DOUBLE)) AS n_others, round(sum(TRY_CAST(x AS DOUBLE)), 2) AS total FROM (SELECT o_orderstatus, CASE o_orderkey % 3 WHEN 0 THEN o_totalprice::VARCHAR WHEN 1 THEN 'n/a' ELSE '1e2' END AS x FROM orders) GROUP BY 1")
def coerced_numbers(spark, sf_dir):
    """Text read as numbers, null where it is none."""
    k = F.col("o_orderkey") % 3
    o = orders(spark, sf_dir).select("o_orderstatus", F.when(k == 0, F.col("o_totalprice").cast("string")).when(k == 1, "n/a").otherwise("1e2").alias("x"))
    return contracts.numbers(o, ["x"]).groupBy("o_orderstatus").agg(F.count("x").alias("n_numbers"), (F.count("*") - F.count("x")).alias("n_others"), F.round(F.sum("x"), 2).alias("total"))


@query("feature_vectors", "SELECT l_orderkey, l_linenumber, 3 + (l_tax <= 0.02)::INT AS missing, round(l_quantity + l_discount + CASE WHEN l_tax > 0.02 THEN l_tax ELSE 0 END, 6) AS total FROM lineitem")
def feature_vectors(spark, sf_dir):
    """Vectors in the schema's order, columns that are null or not there as NaN: how many miss, and the rest's sum."""
    l = lineitem(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", F.when(F.col("l_tax") > 0.02, F.col("l_tax")).alias("l_tax"))
    v = l.select("l_orderkey", "l_linenumber", contracts.vector(l, ["not_there", "l_quantity", "l_discount", "nor_this", "l_tax", "nor_that"]).alias("v"))
    some = F.filter("v", lambda x: ~F.isnan(x))
    return v.select("l_orderkey", "l_linenumber", (F.size("v") - F.size(some)).alias("missing"), F.round(F.aggregate(some, F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("iso_parse", "SELECT o_orderkey, epoch(strptime(strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S'), '%Y-%m-%dT%H:%M:%S'))::BIGINT AS epoch FROM orders")
def iso_parse(spark, sf_dir):
    """ISO text back to seconds."""
    text = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    return orders(spark, sf_dir).select("o_orderkey", F.unix_seconds(F.to_timestamp(text, "yyyy-MM-dd'T'HH:mm:ss")).alias("epoch"))


@query("required_marker", "SELECT page_id, substr(url, instr(lower(url), '://') + 3) AS rest FROM pages")
def required_marker(spark, sf_dir):
    """What follows a marker that every path must have."""
    return pages(spark, sf_dir).select("page_id", X.after_marker(F.col("url"), "://", required=True).alias("rest"))


def _model_rows(spark, sf_dir):
    d = featured(spark, sf_dir).join(documents(spark, sf_dir).select("doc_id", "source"), "doc_id")
    role = F.when(F.col("doc_id") % 4 == 0, "calibration").when(F.col("doc_id") % 4 == 1, "val").otherwise("train_core")
    return M.checkpointed(d.select("doc_id", "source", F.col("quality").alias("y"), "lang", role.alias("split_role"), *_FEATURES))


@query("candidate_grid")
def candidate_grid(spark, sf_dir):
    """Every feature set with logistic regression: calibrated, measured on the validation rows, best first. Fits are beyond SQL."""
    d = _model_rows(spark, sf_dir)
    of = lambda r: d.filter(F.col("split_role") == r)
    sets = {"all": _FEATURES, "length": _FEATURES[:2], "form": _FEATURES[2:]}
    return models.candidates(of("train_core"), of("calibration"), of("val"), sets, ("logreg",))


@query("group_scores")
def group_scores(spark, sf_dir):
    """Scores of each language's rows from a model of the others. Fits are beyond SQL."""
    return models.leave_one_group_out(_model_rows(spark, sf_dir), _FEATURES, "lang", ["doc_id"])
