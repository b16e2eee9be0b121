"""Routing of scored rows as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scalars import route


def routed_stream(spark: SparkSession, path: str, schema: str, score: str, tau: float) -> DataFrame:
    """Rows of Parquet files that appear below ``path``, each with its route."""
    d = spark.readStream.schema(schema).parquet(path)
    return d.select("*", route(F.col(score), F.lit(tau)).alias("route"))


def route_counts(stream: DataFrame, time: str, delay: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Counts per window and level; rows later than ``delay`` are left out."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, window), "route.level").count()
