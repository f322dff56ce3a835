"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's own checkpoint folder; a local one only where all executors are threads of this machine."""
    sc = spark.sparkContext
    have = sc.getCheckpointDir()
    if have:
        return have
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), "pairfold-checkpoints")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def stored(df: DataFrame, **options: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder; it forgets how ``df`` was partitioned, and lost executors cost no lineage.

    ``options`` are the Parquet writer's, such as ``compression``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def forget_at_exit(spark: SparkSession, path: str) -> None:
    _written.append((spark, path))


def forget(*tables: DataFrame) -> None:
    """Delete the files of ``stored`` tables that nothing reads any more."""
    for t in tables:
        for f in {x.rsplit("/", 1)[0] for x in t.inputFiles()}:
            delete(t.sparkSession, f)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _forget_all() -> None:
    for spark, path in _written:
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001  the session, or this file alone, may be gone already
            continue
