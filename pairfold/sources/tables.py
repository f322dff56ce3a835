"""Reading and writing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def write(df: DataFrame, path: str, key: str | None = None, buckets: int | None = None, table: str | None = None) -> None:
    """Parquet files, or with ``key``, ``buckets`` and ``table`` a bucketed and sorted table, whose equal-key matches need no shuffle."""
    if key and buckets and table:
        df.write.mode("overwrite").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    else:
        df.write.mode("overwrite").parquet(path)
