"""From raw documents to a training mix: five stages, each over all that the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's documents. All but the last return the columns of the documents. Null and empty texts pass every stage that does not
reject them by its own rule (see the operators); an empty table passes as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairfold.llm import decontam, mixing, neardup, quality, secrets
from pairfold.llm.common import id_remainder, table
from pairfold.llm.components import stored


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line model calls good."""
    labels = table(spark, sf_dir, "labels").where(id_remainder("doc_id", 3) != 1)
    return quality.keep_good(docs, quality.fit(docs, labels))


def first_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that of the smallest id."""
    return neardup.keep_first(docs)


def no_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated with benchmark items."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in the text; n_chars follows the text."""
    return secrets.redact_secrets(docs).withColumn("n_chars", F.length("text").cast("long"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with how often to draw each for the target mix of sources (rate, and copies in whole numbers)."""
    out = mixing.mix(docs)
    return out.select("row.*", F.col("mix.rate").alias("mix_rate"), F.col("mix.copies").alias("mix_copies"))


STAGES = [
    ("quality classifier", good_quality),
    ("near-duplicates", first_of_near_duplicates),
    ("benchmark decontamination", no_benchmark_text),
    ("secret scan", no_secrets),
    ("source mixing", mixed),
]

#: The stages hold trained models and hashing that SQL cannot express; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
