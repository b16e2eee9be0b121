"""The corpus pipeline: quality, near-duplicates, benchmark leaks, source weights, token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, mixing, nbsvm, simhash, token_planes
from tessera.llm.common import remove, temporary
from tessera.session import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    Learns from ``labels`` of the rows that are not held out; without enough labels the share of good ones
    decides for all. Null text counts as empty, and empty texts are judged like any other; null keys and
    repeated rows are judged by their texts, which are read whole; an empty table stays empty.
    """
    model = nbsvm.fit(docs, table(spark, sf_dir, "labels"), held_out=nbsvm.held_out(F.col("k")))
    return nbsvm.keep_good(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, the one of smallest key (null last) and then of lowest text hash.

    Rows are told apart by key and text: different texts that share a key are different documents, rows of
    equal key and text are one. Empty texts and nulls are one group; an empty table stays empty.
    """
    return simhash.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Null and empty texts and null keys stay, repeated rows stay or go alike, texts are searched whole; an
    empty table, or one without benchmark items, stays as it is.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or thinned to their sources' weights.

    Null sources are one source; null and empty texts have no words, and a source without words is left out;
    repeated rows and null keys share one decision by key; an empty table stays empty.
    """
    return mixing.mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's place and checksum in the written token ids, in ascending order of key.

    Null keys come first, null text counts as empty, repeated rows are written each, texts whole, whatever
    their length; an empty table gives no rows.
    """
    import public_tokenizers

    path = temporary(spark, "token-planes")
    # workers also hold what earlier stages left, so they remember fewer pieces here
    token_planes.write(docs, path, tokenizer=public_tokenizers.path("byte_bpe_50k.json"), end_id=0, cache=200_000, together=256)
    return token_planes.digest(spark, path)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontaminated), ("mixing", mixed), ("token_ids", token_ids)]

#: The classifier and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``; what each returns is written and read again.

    The stages' folders are deleted at the end; the token ids, which the result reads, go with the session.
    """
    docs, base = table(spark, sf_dir, "documents"), temporary(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            out.write.mode("overwrite").parquet(f"{base}/{k}-{name}")
            out = spark.read.parquet(f"{base}/{k}-{name}")
        docs = out
    remove(spark, base)
    return docs
