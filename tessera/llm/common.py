"""Shared pieces: reliable checkpoints, word and hash expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import checkpointed, scratch_dir  # noqa: F401

#: A word is a maximal run of characters other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of words; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def fold(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo ``n``; a null key counts as the empty string."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def temporary(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, which goes with the session's JVM."""
    path = f"{scratch_dir(spark)}/{name}/{uuid.uuid4().hex}"
    p, files = _files(spark, path)
    files.mkdirs(p)
    files.deleteOnExit(p)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder."""
    p, files = _files(spark, path)
    files.delete(p, True)
