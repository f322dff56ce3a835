"""Matchings on any predicate, by pairing the different left keys with the right rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.matching import K, Matching


def nested(j: Matching) -> DataFrame:
    """Every pair of a different left key and an aggregated right key is tested; the specification that all others must equal.

    Aggregating the right side by key first is exact because the predicate sees keys only. No side is broadcast by hint: Spark
    broadcasts the smaller one when its estimated size allows it, and otherwise deals pairs of partitions to tasks.
    """
    keys = j.left.select(j.theta.key(j.theta.left).alias("__pf_lk")).where(F.col("__pf_lk").isNotNull()).distinct()
    right = j.per_key().withColumnRenamed(K, "__pf_rk")
    pairs = keys.join(right, j.theta.holds(F.col("__pf_lk"), F.col("__pf_rk")))
    seen = pairs.groupBy(F.col("__pf_lk").alias(K)).agg(*(s.merge(F.col(c)).alias(c) for c, s, _ in j.states()))
    return j.finish(j.left_keyed().join(seen, K, "left"))
