"""Relational queries over the star-schema tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from tessera.functions import scalars as X
from tessera.operators import profile
from tessera.operators.ordered import numbered, quantiles
from tessera.plans.registry import query
from tessera.session import table


@query(
    "gate_coverage",
    """
WITH t AS (SELECT quantile_cont(value, 0.75) AS thr FROM events WHERE user_id % 5 = 0),
     g AS (SELECT event_type AS label, CAST(user_id % 5 AS BIGINT) AS split_role,
                  CASE WHEN value IS NOT NULL AND NOT isnan(value) AND value >= thr THEN 1 ELSE 0 END AS gate
           FROM events, t)
SELECT split_role, label, round(avg(gate), 6) AS gate_rate, CAST(sum(gate) AS BIGINT) AS gate_on, count(*) AS n
FROM g GROUP BY split_role, label
""",
)
def gate_coverage(spark, sf_dir):
    """Share of rows whose score reaches the training slice's 0.75 quantile, by split and label."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "value")
    thr = quantiles(e.filter(F.pmod("user_id", F.lit(5)) == 0), "value", [0.75]).select(F.col("q0").alias("thr"))
    on = X.at_least(F.col("value"), F.col("thr"))
    return (
        e.crossJoin(F.broadcast(thr))  # one row
        .select(F.pmod("user_id", F.lit(5)).alias("split_role"), F.col("event_type").alias("label"), on.cast("int").alias("gate"))
        .groupBy("split_role", "label")
        .agg(F.round(F.avg("gate"), 6).alias("gate_rate"), F.sum("gate").alias("gate_on"), F.count("*").alias("n"))
    )


def _t(name):
    return lambda spark, sf_dir: table(spark, sf_dir, name)


orders, lineitem, customer, nation, part, documents, labels, events, pages, supplier, region, embeddings, conversations = map(
    _t, "orders lineitem customer nation part documents labels events pages supplier region embeddings conversations".split()
)
STATUS = ["F", "O", "P"]


@query("status_pivot", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1")
def status_pivot(spark, sf_dir):
    return profile.crosstab(orders(spark, sf_dir), "o_orderpriority", "o_orderstatus", STATUS)


@query("status_rates", "SELECT o_orderpriority, round(avg((o_orderstatus = 'F')::INT), 6) AS F, round(avg((o_orderstatus = 'O')::INT), 6) AS O, round(avg((o_orderstatus = 'P')::INT), 6) AS P FROM orders GROUP BY 1")
def status_rates(spark, sf_dir):
    return profile.crosstab(orders(spark, sf_dir), "o_orderpriority", "o_orderstatus", STATUS, share=True)


_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("profile_summary", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, min({c}) AS min, max({c}) AS max, round(avg({c}), 6) AS mean, round(median({c}), 6) AS median, round(stddev_samp({c}), 6) AS std FROM lineitem" for c in _NUM))
def profile_summary(spark, sf_dir):
    return profile.numeric_summary(lineitem(spark, sf_dir), _NUM)


@query(
    "group_stats",
    """SELECT p_brand, count(*) AS n, min(p_size) AS min_size, median(p_size) AS median_size, max(p_size) AS max_size, round(avg(p_retailprice), 9) AS mean_price,
    round(stddev_samp(p_retailprice), 6) AS std_price, round(avg((p_size > 25)::INT), 6) AS large_rate, count(DISTINCT p_type) AS n_types FROM part GROUP BY p_brand""",
)
def group_stats(spark, sf_dir):
    return part(spark, sf_dir).groupBy("p_brand").agg(
        F.count("*").alias("n"), F.min("p_size").alias("min_size"), F.median("p_size").alias("median_size"), F.max("p_size").alias("max_size"), F.round(F.avg("p_retailprice"), 9).alias("mean_price"),
        F.round(F.stddev_samp("p_retailprice"), 6).alias("std_price"), F.round(F.avg((F.col("p_size") > 25).cast("double")), 6).alias("large_rate"), F.count_distinct("p_type").alias("n_types"),
    )


@query("group_pivot_share", "SELECT l_returnflag, round(avg((l_linestatus = 'F')::INT), 6) AS F, round(avg((l_linestatus = 'O')::INT), 6) AS O FROM lineitem GROUP BY 1")
def group_pivot_share(spark, sf_dir):
    return profile.crosstab(lineitem(spark, sf_dir), "l_returnflag", "l_linestatus", ["F", "O"], share=True)


@query("format_distribution", "SELECT l_returnflag AS \"by\", l_linestatus AS value, count(*) AS n, grouping(l_returnflag)::INT AS is_global FROM lineitem GROUP BY GROUPING SETS ((l_linestatus), (l_returnflag, l_linestatus))")
def format_distribution(spark, sf_dir):
    return profile.value_counts(lineitem(spark, sf_dir), "l_linestatus", "l_returnflag")


@query("value_counts_with_null", "SELECT coalesce(CASE WHEN n_chars % 3 > 0 THEN lang END, '<None>') AS value, count(*) AS count FROM documents GROUP BY 1")
def value_counts_with_null(spark, sf_dir):
    d = documents(spark, sf_dir).select(F.when(F.col("n_chars") % 3 > 0, F.col("lang")).alias("v"))
    return profile.value_counts(d, "v")


@query(
    "quality_histogram",
    """WITH b AS (SELECT unnest(range(1, 11)) AS bin), c AS (SELECT greatest(1, ceil(p_size / 10.0)) AS bin, count(*) AS n FROM part WHERE p_size BETWEEN 0 AND 100 GROUP BY 1)
    SELECT b.bin::INT AS bin, ((b.bin - 1) * 10)::INT AS low, (b.bin * 10)::INT AS high, coalesce(n, 0)::BIGINT AS n FROM b LEFT JOIN c ON b.bin = c.bin""",
)
def quality_histogram(spark, sf_dir):
    return profile.right_closed_histogram(part(spark, sf_dir), "p_size", 10, 10)


@query(
    "folder_summary",
    r"""WITH p AS (SELECT regexp_extract(url, '^(.*)/[^/]*$', 1) AS folder, lower(regexp_extract(url, '(\.[^./]+)$', 1)) AS ext FROM pages), c AS (SELECT folder, ext, count(*) AS n FROM p GROUP BY 1, 2)
    SELECT folder, sum(n)::BIGINT AS n, '{' || string_agg('"' || ext || '":' || n, ',' ORDER BY n DESC, ext) || '}' AS extensions, len(string_split(folder, '/'))::INT AS depth FROM c GROUP BY folder""",
)
def folder_summary(spark, sf_dir):
    return profile.folder_summary(pages(spark, sf_dir), F.col("url"))


@query("duplicate_groups", "WITH d AS (SELECT doc_id AS id, sha256(text) AS digest FROM documents), g AS (SELECT digest, count(*) AS n, min(id) AS first_id FROM d GROUP BY 1 HAVING count(*) > 1) SELECT id, digest, n, first_id FROM d JOIN g USING (digest)")
def duplicate_groups(spark, sf_dir):
    return profile.duplicates(documents(spark, sf_dir), F.col("text"), "doc_id")


@query(
    "duplicate_summary",
    """WITH g AS (SELECT sha256(text) AS digest, count(*) AS n, count(DISTINCT source) AS sources, count(DISTINCT lang) AS langs FROM documents GROUP BY 1 HAVING count(*) > 1)
    SELECT count(*) AS n_groups, sum(n)::BIGINT AS n_rows, count(*) FILTER (sources > 1) AS cross_source, count(*) FILTER (sources = 1) AS intra_source, count(*) FILTER (langs > 1) AS cross_label FROM g""",
)
def duplicate_summary(spark, sf_dir):
    d = documents(spark, sf_dir).select(F.sha2(F.col("text").cast("binary"), 256).alias("digest"), "source", "lang")
    g = d.groupBy("digest").agg(F.count("*").alias("n"), F.size(F.collect_set("source")).alias("sources"), F.size(F.collect_set("lang")).alias("langs")).filter("n > 1")
    return g.agg(F.count("*").alias("n_groups"), F.sum("n").alias("n_rows"), F.count_if(F.col("sources") > 1).alias("cross_source"), F.count_if(F.col("sources") == 1).alias("intra_source"), F.count_if(F.col("langs") > 1).alias("cross_label"))


@query("duplicate_group_ids", "SELECT doc_id, dense_rank() OVER (ORDER BY digest)::BIGINT AS group_id FROM (SELECT doc_id, sha256(text) AS digest, count(*) OVER (PARTITION BY sha256(text)) AS n FROM documents) WHERE n > 1")
def duplicate_group_ids(spark, sf_dir):
    d = profile.duplicates(documents(spark, sf_dir), F.col("text"), "doc_id").select("id", "digest")
    rank = numbered(d.select("digest").distinct(), [F.col("digest")], "group_id")
    return d.join(rank, "digest").select(F.col("id").alias("doc_id"), "group_id")


@query("ood_tag", "SELECT doc_id, CASE WHEN source IS NULL THEN 'UNKNOWN' WHEN translate(lower(source), '-_. ', '') IN ('src3', 'src15') THEN 'OOD' ELSE 'ID' END AS eval_group FROM documents")
def ood_tag(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", X.ood_group(F.col("source"), ["src3", "src15"]).alias("eval_group"))


@query(
    "path_inference",
    """WITH p AS (SELECT page_id, url, regexp_replace(url, '^[a-z]+://', '') AS rel FROM pages)
    SELECT page_id, lower(trim(replace(url, chr(92), '/'))) AS key, string_split(rel, '/')[1] AS generator, regexp_replace(url, '\\.[^./]+$', '.npy') AS npy,
    CASE WHEN list_contains(string_split(lower(rel), '/'), 'en') THEN 'ai' WHEN list_contains(string_split(lower(rel), '/'), 'de') THEN 'nature' ELSE 'unknown' END AS label FROM p""".replace("\\\\", "\\"),
)
def path_inference(spark, sf_dir):
    p = pages(spark, sf_dir).select("page_id", "url", F.regexp_replace("url", "^[a-z]+://", "").alias("rel"))
    return p.select(
        "page_id", X.path_key(F.col("url")).alias("key"), F.split("rel", "/")[0].alias("generator"), X.with_suffix(F.col("url"), ".npy").alias("npy"), X.any_part(F.col("rel"), [("en", "ai"), ("de", "nature")]).alias("label")
    )


@query("path_after_marker", "SELECT page_id, CASE WHEN instr(lower(url), '://') > 0 THEN substr(url, instr(lower(url), '://') + 3) END AS rest FROM pages")
def path_after_marker(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", X.after_marker(F.col("url"), "://").alias("rest"))


@query(
    "metadata_left_join",
    "SELECT d.doc_id, d.lang, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, -1) AS toxic, (l.doc_id IS NOT NULL) AS matched FROM documents d LEFT JOIN (SELECT doc_id, quality, toxic FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY quality, toxic) AS k FROM labels) WHERE k = 1) l USING (doc_id)",
)
def metadata_left_join(spark, sf_dir):
    l = profile.keep_first(labels(spark, sf_dir), ["doc_id"], [F.col("quality"), F.col("toxic")]).withColumn("m", F.lit(True))
    return documents(spark, sf_dir).select("doc_id", "lang").join(l, "doc_id", "left").select("doc_id", "lang", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(-1)).alias("toxic"), F.coalesce("m", F.lit(False)).alias("matched"))


@query("metadata_match_rate", "SELECT round(avg((l.doc_id IS NOT NULL)::INT), 6) AS rate FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def metadata_match_rate(spark, sf_dir):
    l = labels(spark, sf_dir).select("doc_id").distinct().withColumn("m", F.lit(1.0))
    return documents(spark, sf_dir).select("doc_id").join(l, "doc_id", "left").agg(F.round(F.avg(F.coalesce("m", F.lit(0.0))), 6).alias("rate"))


@query("stale_semi", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def stale_semi(spark, sf_dir):
    return customer(spark, sf_dir).select("c_custkey", "c_mktsegment").join(orders(spark, sf_dir).select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")


@query("stale_anti", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def stale_anti(spark, sf_dir):
    return customer(spark, sf_dir).select("c_custkey", "c_mktsegment").join(orders(spark, sf_dir).select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query(
    "closure_joins",
    """WITH base AS (SELECT c_nationkey AS k, round(avg(o_totalprice), 6) AS clean FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
    deg AS (SELECT c_nationkey AS k, o_orderstatus AS s, round(avg(o_totalprice), 6) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
    worst AS (SELECT k, min(v) AS worst, round(avg(v), 6) AS mean FROM deg GROUP BY 1)
    SELECT n_name, base.clean, worst.worst, worst.mean, round(worst.worst - base.clean, 6) AS gap FROM nation LEFT JOIN base ON n_nationkey = base.k LEFT JOIN worst ON n_nationkey = worst.k""",
)
def closure_joins(spark, sf_dir):
    o = orders(spark, sf_dir).join(customer(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey")).select("c_nationkey", "o_orderstatus", "o_totalprice")
    g = o.groupBy("c_nationkey", "o_orderstatus").agg(F.sum("o_totalprice").alias("s"), F.count("o_totalprice").alias("n"))
    d = g.select("c_nationkey", "s", "n", F.round(F.col("s") / F.col("n"), 6).alias("v"))
    k = d.groupBy("c_nationkey").agg(F.round(F.sum("s") / F.sum("n"), 6).alias("clean"), F.min("v").alias("worst"), F.round(F.avg("v"), 6).alias("mean"))
    return nation(spark, sf_dir).join(k, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("n_name", "clean", "worst", "mean", F.round(F.col("worst") - F.col("clean"), 6).alias("gap"))


@query("family_counts", "SELECT s_nationkey AS family, count(*) AS n, count(*) FILTER (s_acctbal > 5000) AS high, count(*) FILTER (s_acctbal > 0) AS medium_or_high, round(median(s_acctbal), 6) AS median, round(max(s_acctbal), 6) AS max FROM supplier GROUP BY 1")
def family_counts(spark, sf_dir):
    b = F.col("s_acctbal")
    return supplier(spark, sf_dir).groupBy(F.col("s_nationkey").alias("family")).agg(
        F.count("*").alias("n"), F.count_if(b > 5000).alias("high"), F.count_if(b > 0).alias("medium_or_high"), F.round(F.median(b), 6).alias("median"), F.round(F.max(b), 6).alias("max")
    )


@query("inner_with_suffixes", "SELECT a.l_orderkey, a.l_linenumber, round(abs(a.l_extendedprice - b.l_quantity), 6) AS diff FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber AND a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey AND a.l_shipdate = b.l_shipdate")
def inner_with_suffixes(spark, sf_dir):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]
    l = lineitem(spark, sf_dir)
    return l.select(*keys, "l_extendedprice").join(l.select(*keys, "l_quantity"), keys).select("l_orderkey", "l_linenumber", F.round(F.abs(F.col("l_extendedprice") - F.col("l_quantity")), 6).alias("diff"))


@query("coalesced_left_join", "SELECT o_orderkey, coalesce(c_mktsegment, o_orderpriority) AS segment FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey")
def coalesced_left_join(spark, sf_dir):
    c = customer(spark, sf_dir).filter("c_acctbal > 0").select("c_custkey", "c_mktsegment")
    return orders(spark, sf_dir).join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", F.coalesce("c_mktsegment", "o_orderpriority").alias("segment"))


@query("lookup_join", "SELECT s_suppkey, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def lookup_join(spark, sf_dir):
    n = nation(spark, sf_dir).join(region(spark, sf_dir), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    return supplier(spark, sf_dir).join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "r_name")


@query("one_to_one_join", "SELECT d.doc_id, n_chars, coalesce(quality, -1) AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def one_to_one_join(spark, sf_dir):
    d = profile.unique_on(documents(spark, sf_dir).select("doc_id", "n_chars"), ["doc_id"], "documents")
    l = profile.unique_on(labels(spark, sf_dir).select("doc_id", "quality"), ["doc_id"], "labels")
    return d.join(l, "doc_id", "left").withColumn("quality", F.coalesce("quality", F.lit(-1)))


@query("union_by_name", "SELECT c_custkey AS key, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier")
def union_by_name(spark, sf_dir):
    c = customer(spark, sf_dir).select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return c.unionByName(supplier(spark, sf_dir).select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance")), allowMissingColumns=True)


@query("set_intersection", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersection(spark, sf_dir):
    return customer(spark, sf_dir).select(F.col("c_nationkey").alias("k")).intersect(supplier(spark, sf_dir).select("s_nationkey"))


@query("set_difference", "SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def set_difference(spark, sf_dir):
    return part(spark, sf_dir).select("p_partkey").subtract(lineitem(spark, sf_dir).filter("l_quantity > 45").select("l_partkey"))


@query("top_values", "SELECT l_quantity::INT || 'x' || l_linenumber AS value, count(*) AS count FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_values(spark, sf_dir):
    return profile.top_values(lineitem(spark, sf_dir), F.concat_ws("x", F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber").cast("string")), 10)


@query("top_per_group", "SELECT source, lang, n, round(n / sum(n) OVER (PARTITION BY source), 6) AS share, k::INT AS rank FROM (SELECT source, lang, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS k FROM documents GROUP BY 1, 2) QUALIFY k <= 3")
def top_per_group(spark, sf_dir):
    return profile.top_per_group(documents(spark, sf_dir), "source", "lang", 3)


@query("ranked_first", "SELECT o_orderpriority, n, mean FROM (SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 6) AS mean FROM orders GROUP BY 1) ORDER BY mean DESC, n, o_orderpriority LIMIT 1")
def ranked_first(spark, sf_dir):
    g = orders(spark, sf_dir).groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 6).alias("mean"))
    return g.orderBy(F.desc("mean"), "n", "o_orderpriority").limit(1)


@query("newest_artifact", "SELECT o_orderpriority, arg_max(o_orderkey, o_orderdate::VARCHAR || lpad(o_orderkey::VARCHAR, 12, '0')) AS newest FROM orders GROUP BY 1")
def newest_artifact(spark, sf_dir):
    return orders(spark, sf_dir).groupBy("o_orderpriority").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("newest"))


@query("distinct_counts", "SELECT count(DISTINCT lang) AS langs, count(DISTINCT source) AS sources, array_to_string(list_sort(list(DISTINCT lang)), ',') AS lang_list FROM documents")
def distinct_counts(spark, sf_dir):
    return documents(spark, sf_dir).agg(F.count_distinct("lang").alias("langs"), F.count_distinct("source").alias("sources"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("lang_list"))


@query("missing_rates", "SELECT 'quality' AS \"column\", round(avg((l.quality IS NULL)::INT), 6) AS missing, lang FROM documents LEFT JOIN labels l USING (doc_id) GROUP BY lang UNION ALL SELECT 'toxic', round(avg((l.toxic IS NULL)::INT), 6), lang FROM documents LEFT JOIN labels l USING (doc_id) GROUP BY lang")
def missing_rates(spark, sf_dir):
    d = documents(spark, sf_dir).select("doc_id", "lang").join(labels(spark, sf_dir), "doc_id", "left")
    return profile.missing_rates(d, ["quality", "toxic"], "lang")


@query("snapshot_hash", "SELECT count(*) AS n, sha256(string_agg(url, chr(10) ORDER BY url) || chr(10)) AS digest FROM pages")
def snapshot_hash(spark, sf_dir):
    """Digest of all names in order, each with a line end.

    The names are sorted over all tasks; a digest goes through its bytes one after another, so they are read
    in order, a partition at a time, and never held together.
    """
    digest, n = hashlib.sha256(), 0
    for r in pages(spark, sf_dir).select("url").orderBy("url").toLocalIterator(prefetchPartitions=True):
        digest.update(r["url"].encode() + b"\n")
        n += 1
    return spark.createDataFrame([(n, digest.hexdigest())], "n long, digest string")


@query("accept_rate_ranking", "SELECT c_nationkey, n, round(f / n, 6) AS rate FROM (SELECT c_nationkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS f FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) ORDER BY rate DESC, n DESC, c_nationkey LIMIT 12")
def accept_rate_ranking(spark, sf_dir):
    o = orders(spark, sf_dir).join(customer(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"))
    return o.select("c_nationkey", "n", F.round(F.col("f") / F.col("n"), 6).alias("rate")).orderBy(F.desc("rate"), F.desc("n"), "c_nationkey").limit(12)


@query("importance_rollup", "SELECT coalesce(n_name, 'unknown') AS family, round(sum(s_acctbal), 4) AS total FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON s_nationkey = n_nationkey GROUP BY 1")
def importance_rollup(spark, sf_dir):
    n = nation(spark, sf_dir).filter("n_nationkey < 20")
    return supplier(spark, sf_dir).join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy(F.coalesce("n_name", F.lit("unknown")).alias("family")).agg(F.round(F.sum("s_acctbal"), 4).alias("total"))


@query("feature_set_shift", "WITH m AS (SELECT p_brand AS f, p_size AS lab, max(p_retailprice) AS v FROM part GROUP BY 1, 2), b AS (SELECT f, max(v) AS v FROM m GROUP BY 1) SELECT s, round(avg(v), 6) AS mean, round(median(v), 6) AS median, max(v) AS max FROM b, (VALUES ('all', ''), ('three', 'Brand#3')) t(s, p) WHERE f LIKE p || '%' GROUP BY s")
def feature_set_shift(spark, sf_dir):
    b = part(spark, sf_dir).groupBy(F.col("p_brand").alias("f"), "p_size").agg(F.max("p_retailprice").alias("v")).groupBy("f").agg(F.max("v").alias("v"))
    sets = F.array_compact(F.array(F.lit("all"), F.when(F.col("f").startswith("Brand#3"), "three")))
    return b.select("v", F.explode(sets).alias("s")).groupBy("s").agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.median("v"), 6).alias("median"), F.max("v").alias("max"))


@query("tpch_pricing_summary", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 4) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def tpch_pricing_summary(spark, sf_dir):
    l = lineitem(spark, sf_dir).filter("l_shipdate <= timestamp'1998-09-02'")
    return l.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 4).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n")
    )


@query("json_props", "SELECT event_type, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS total, count(*) AS n FROM events GROUP BY 1")
def json_props(spark, sf_dir):
    return events(spark, sf_dir).groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("total"), F.count("*").alias("n"))


@query("iso_dates", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS iso, epoch(o_orderdate)::BIGINT AS epoch FROM orders")
def iso_dates(spark, sf_dir):
    return orders(spark, sf_dir).select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("epoch"))


@query("skip_existing", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'F')")
def skip_existing(spark, sf_dir):
    done = lineitem(spark, sf_dir).filter("l_linestatus = 'F'").select(F.col("l_orderkey").alias("o_orderkey"))
    return orders(spark, sf_dir).select("o_orderkey").join(done, "o_orderkey", "left_anti")
