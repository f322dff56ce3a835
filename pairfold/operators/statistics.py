"""Uniqueness of keys and selectivity of predicates, as one-row frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import aggregates as agg
from ..functions.theta import Theta, column, lt
from .api import match_aggregate


def is_key_unique(df: DataFrame, key) -> DataFrame:
    """``is_unique``: no two rows share a (non-null) key."""
    keyed = df.select(column(key).alias("k")).where("k is not null").groupBy("k").count()
    return keyed.agg((F.coalesce(F.max("count"), F.lit(0)) <= 1).alias("is_unique"))


def _equal_pairs(left: DataFrame, right: DataFrame, on: Theta) -> DataFrame:
    a = left.select(on.key(on.left).alias("k")).where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("a"))
    b = right.select(on.key(on.right).alias("k")).where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("b"))
    return a.join(b, "k").agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("pairs"))


def _rows(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def _share(pairs: DataFrame, left: DataFrame, right: DataFrame, value) -> DataFrame:
    return pairs.crossJoin(F.broadcast(_rows(left, "l"))).crossJoin(F.broadcast(_rows(right, "r"))).select(value.alias("selectivity"))  # one row each


def eq_selectivity(left: DataFrame, right: DataFrame, on: Theta) -> DataFrame:
    """Mean number of partners of a left row; NULL without left rows."""
    return _share(_equal_pairs(left, right, on), left, right, F.when(F.col("l") > 0, F.col("pairs").cast("double") / F.col("l")))


def ne_selectivity(left: DataFrame, right: DataFrame, on: Theta) -> DataFrame:
    """Share of all pairs whose keys differ; NULL without pairs."""
    all_pairs = F.col("l").cast("double") * F.col("r")
    return _share(_equal_pairs(left, right, on), left, right, F.when(all_pairs > 0, 1 - F.col("pairs").cast("double") / all_pairs))


def lt_selectivity(left: DataFrame, right: DataFrame, left_key, right_key) -> DataFrame:
    """Share of all pairs with left key < right key; NULL without pairs."""
    n = match_aggregate(left, right, lt(left_key, right_key), [agg.count("__pf_n")]).agg(F.coalesce(F.sum("__pf_n"), F.lit(0)).alias("pairs"))
    all_pairs = F.col("l").cast("double") * F.col("r")
    return _share(n, left, right, F.when(all_pairs > 0, F.col("pairs").cast("double") / all_pairs))
