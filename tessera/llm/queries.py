"""The queries of this subpackage, each over its whole table, and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.llm import decontaminate, langid, licences, lm, mixing, nbsvm, simhash, token_planes, toolcalls, topk
from tessera.llm.common import temporary
from tessera.session import table


def op1_bit_planes(spark, sf_dir):
    """Token ids of every document, written as bit planes and digested from the files."""
    import public_tokenizers

    path = temporary(spark, "token-planes")
    token_planes.write(table(spark, sf_dir, "documents"), path, tokenizer=public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return token_planes.digest(spark, path)


def op2_tool_calls(spark, sf_dir):
    """Every call of the conversations with its result, and every other message, as canonical JSON."""
    return toolcalls.link(table(spark, sf_dir, "conversations"))


def op3_recurrent_lm(spark, sf_dir):
    """Log-likelihood of every document under the recurrent model and under the word counts."""
    s = lm.score(table(spark, sf_dir, "documents"), lm.held_out(F.col("doc_id")))
    return s.select("doc_id", lm.held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_string_kernels(spark, sf_dir):
    """Language of every document."""
    docs = table(spark, sf_dir, "documents")
    p = langid.predict(docs, langid.fit(docs, held_out=langid.held_out(F.col("k"))))
    return p.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_licence_digests(spark, sf_dir):
    """Canonical digest, licence and licence notices of every document."""
    return licences.scan(table(spark, sf_dir, "documents"))


def op6_nbsvm_quality(spark, sf_dir):
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents")
    s = nbsvm.score(docs, nbsvm.fit(docs, table(spark, sf_dir, "labels"), held_out=nbsvm.held_out(F.col("k"))))
    return s.select("doc_id", nbsvm.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= nbsvm.THRESHOLD).cast("int").alias("predicted"))


def op7_simhash_anchors(spark, sf_dir):
    """Fingerprint and component of every document."""
    g = simhash.group(table(spark, sf_dir, "documents"))
    return g.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op8_mix_sources(spark, sf_dir):
    """Words that the mix of all sources takes from each document."""
    c = mixing.copies(table(spark, sf_dir, "documents"))
    return c.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("n_copies")).alias("taken"))


def op9_exact_topk(spark, sf_dir):
    """The five best vectors for every vector whose id is divisible by 50."""
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_decontaminate(spark, sf_dir):
    """Each document with each benchmark item that it holds."""
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), z AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT source, source_size, CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS INT)] AS BIGINT) AS w FROM z
), a AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS all_size, CAST(sum(w) OVER () AS BIGINT) AS all_w,
    CAST(coalesce(sum(source_size) OVER b, 0) AS BIGINT) AS full_size, CAST(coalesce(sum(w) OVER b, 0) AS BIGINT) AS full_w
  FROM w WINDOW b AS (ORDER BY CAST(source_size AS DOUBLE) / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT *, (CAST(all_size AS DOUBLE) - CAST(3.0 AS DOUBLE) * full_size) / (all_w - full_w) AS level FROM a
), m AS (
  SELECT arg_min(level, full_w) AS level FROM l WHERE CAST(3.0 AS DOUBLE) * source_size >= level * w
), t AS (
  SELECT source, source_size, CASE WHEN source_size > 0 THEN least(CAST(3.0 AS DOUBLE) * source_size, m.level * w) ELSE 0.0::DOUBLE END AS target FROM w, m
), r AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate FROM t
)
SELECT doc_id, size, source_size, target,
  size * CAST(floor(rate) + CASE WHEN CAST('0x' || substr(md5('mix:' || doc_id), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
"""

OP9_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)
SELECT q.vec_id AS query_id, CAST(row_number() OVER w AS INTEGER) AS rank, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 50 = 0
WINDOW w AS (PARTITION BY q.r ORDER BY list_dot_product(q.e, c.e) DESC, c.vec_id)
QUALIFY row_number() OVER w <= 5
"""

OP2_SQL = """
WITH m AS (
  SELECT conv_id, turn, role, CAST(to_json(text) AS VARCHAR) AS text,
    CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
    CASE role WHEN 'user' THEN conv_id || ':' || turn WHEN 'assistant' THEN conv_id || ':' || (turn - 1) END AS call_id
  FROM conversations
), s AS (
  SELECT call_id, count(*) FILTER (kind = 'call') AS n_calls, count(*) FILTER (kind = 'result') AS n_results,
    min({'turn': turn, 'content': text}) FILTER (kind = 'result') AS r
  FROM m WHERE call_id IS NOT NULL GROUP BY call_id
)
SELECT conv_id, turn, 0::INTEGER AS pos, kind, m.call_id, 0::INTEGER AS level,
  CASE WHEN kind = 'message' THEN 'message' WHEN kind = 'result' THEN 'orphan' WHEN n_calls > 1 THEN 'ambiguous' WHEN n_results = 0 THEN 'pending' ELSE 'linked' END AS status,
  CASE WHEN kind = 'call' THEN n_results ELSE 0 END::BIGINT AS n_results,
  CASE WHEN kind = 'call' THEN '{"arguments":{"text":' || text || '},"errors":[],"id":"' || m.call_id || '","level":0,"name":"reply","result":' || coalesce(r.content, 'null') || '}'
    ELSE '{"content":' || text || ',"id":' || coalesce('"' || m.call_id || '"', 'null') || ',"role":"' || CASE WHEN kind = 'result' THEN 'result' ELSE role END || '"}' END AS json
FROM m LEFT JOIN s ON m.call_id = s.call_id
WHERE kind <> 'result' OR n_calls = 0
"""

_KNOWN = ", ".join("({}, {})".format(*("'" + x.replace("'", "''") + "'" for x in row)) for row in licences.TEXTS + licences.NOTICES)
_LINES = ", ".join("({}, {})".format(*("'" + x.replace("'", "''") + "'" for x in row)) for row in licences.NOTICES)
OP5_SQL = f"""
WITH k AS (SELECT sha256({licences.duckdb_canonical("t")}) AS digest, min(licence) AS licence FROM (VALUES {_KNOWN}) v(licence, t) GROUP BY 1
), n AS (SELECT sha256({licences.duckdb_canonical("t")}) AS digest, min(licence) AS notice FROM (VALUES {_LINES}) v(licence, t) GROUP BY 1
), d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d
), f AS (
  SELECT r, string_agg(DISTINCT notice, ',' ORDER BY notice) AS notices, count(*) AS n_notices
  FROM l JOIN n ON sha256({licences.duckdb_canonical("line")}) = n.digest GROUP BY r
)
SELECT d.doc_id, sha256({licences.duckdb_canonical("d.text")}) AS digest, k.licence, coalesce(f.notices, '') AS notices, coalesce(f.n_notices, 0) AS n_notices
FROM d LEFT JOIN f ON d.r = f.r LEFT JOIN k ON sha256({licences.duckdb_canonical("d.text")}) = k.digest
"""

QUERIES = {
    "op1_bit_planes": op1_bit_planes,
    "op2_tool_calls": op2_tool_calls,
    "op3_recurrent_lm": op3_recurrent_lm,
    "op4_string_kernels": op4_string_kernels,
    "op5_licence_digests": op5_licence_digests,
    "op6_nbsvm_quality": op6_nbsvm_quality,
    "op7_simhash_anchors": op7_simhash_anchors,
    "op8_mix_sources": op8_mix_sources,
    "op9_exact_topk": op9_exact_topk,
    "op10_decontaminate": op10_decontaminate,
}
ORACLES = {"op2_tool_calls": OP2_SQL, "op5_licence_digests": OP5_SQL, "op8_mix_sources": OP8_SQL, "op9_exact_topk": OP9_SQL}
