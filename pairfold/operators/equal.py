"""Matchings on equal keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.matching import K, Matching


def hinted(df: DataFrame, hint: str | None) -> DataFrame:
    return df.hint(hint) if hint else df


def pre_right(j: Matching) -> DataFrame:
    """Aggregate the right side by key, then look the left keys up; the default."""
    return j.finish(j.left_keyed().join(hinted(j.per_key(), j.hint), K, "left"))


def relevant_right(j: Matching) -> DataFrame:
    """Right rows whose key some left row has, so that no other key is aggregated.

    The left keys are joined without a broadcast hint: they grow with the data, and Spark broadcasts them by itself when their
    measured size allows it.
    """
    keys = j.left.select(j.theta.key(j.theta.left).alias(K)).where(F.col(K).isNotNull()).distinct()
    return j.right_keyed().join(keys, K, "left_semi")


def pre_left(j: Matching) -> DataFrame:
    """As ``pre_right`` over the right rows that match some left key; pays when the left side is much smaller."""
    return j.finish(j.left_keyed().join(hinted(j.per_key(relevant_right(j)), j.hint), K, "left"))


def join_first(j: Matching) -> DataFrame:
    """Join the different left keys with the right rows, then aggregate; needs nothing of the aggregates but a value for each group."""
    keys = j.left.select(j.theta.key(j.theta.left).alias(K)).where(F.col(K).isNotNull()).distinct()
    joined = keys.join(hinted(j.right_keyed(), j.hint), K).groupBy(K).agg(*j.partials())
    return j.finish(j.left_keyed().join(joined, K, "left"))


def unique(j: Matching) -> DataFrame:
    """Left keys are unique: join, then group by the left row itself, without a join back. A repeated left key is an error."""
    right = hinted(j.right_keyed().withColumn("__pf_m", F.lit(1)), j.hint)
    left = j.left_keyed()
    whole = F.struct(*(F.col(f"`{c}`") for c in j.left.columns))
    known = left.where(F.col(K).isNotNull()).withColumn("__pf_row", whole).select(K, "__pf_row", F.monotonically_increasing_id().alias("__pf_u")).join(right, K, "left")
    states = [F.when(F.max("__pf_m").isNotNull(), s.partial(F.when(F.col("__pf_m").isNotNull(), F.col(f"__pf_v{i}"))) if s.name != "rows" else F.count("__pf_m")).alias(c) for c, s, i in j.states()]
    row = F.when(F.min("__pf_u") == F.max("__pf_u"), F.first("__pf_row")).otherwise(F.raise_error(F.lit("the left key is not unique; choose another strategy")))
    grouped = known.groupBy(K).agg(row.alias("__pf_row"), *states)
    nulls = left.where(F.col(K).isNull()).select(F.lit(None).cast(grouped.schema[K].dataType).alias(K), whole.alias("__pf_row"))
    return j.finish(grouped.unionByName(nulls, allowMissingColumns=True).select("__pf_row.*", *(c for c, _, _ in j.states())))
