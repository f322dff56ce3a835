"""Seeded relations of (key INT, other INT), made in parallel from ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def value_pool(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """n random values, repeats possible: (pos, value)."""
    value = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(2**31))
    return spark.range(n).select(F.col("id").alias("pos"), value.cast("int").alias("value"))


def unique_value_pool(spark: SparkSession, n: int) -> DataFrame:
    """The values 0 .. n - 1: (pos, value)."""
    return spark.range(n).select(F.col("id").alias("pos"), F.col("id").cast("int").alias("value"))


def relation(pool: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """n rows whose key is drawn from the pool; other is the row's number."""
    spark = pool.sparkSession
    size = pool.agg(F.count(F.lit(1)).alias("size"))
    draws = spark.range(n).crossJoin(F.broadcast(size)).select("id", F.pmod(F.xxhash64(F.lit(seed), F.lit("draw"), "id"), F.col("size")).alias("pos"))
    return draws.join(pool, "pos").select(F.col("value").alias("key"), F.col("id").cast("int").alias("other"))


def unique_relation(spark: SparkSession, n: int) -> DataFrame:
    """n rows with key = other = row number."""
    return spark.range(n).select(F.col("id").cast("int").alias("key"), F.col("id").cast("int").alias("other"))
