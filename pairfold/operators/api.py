"""The public operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import aggregates as agg
from ..functions.theta import Theta
from ..plans.matching import K, Matching
from . import equal, nested, ordered, unequal

RUN = {
    ("=", "pre_right"): equal.pre_right, ("=", "pre_left"): equal.pre_left, ("=", "join_first"): equal.join_first, ("=", "unique"): equal.unique,
    ("<>", "pre_right"): unequal.complement, ("<>", "pre_left"): lambda j: unequal.complement(j, build_left=True), ("<>", "two_sided"): unequal.two_sided,
    ("<", "bucketed"): ordered.bucketed, ("<", "global"): ordered.global_window, ("<", "interval"): ordered.interval, ("band", "difference"): ordered.band_difference,
}


def match_aggregate(left: DataFrame, right: DataFrame, on: Theta, aggregates: list[agg.Aggregate], strategy: str = "auto", **options) -> DataFrame:
    """For every left row: its columns, and the aggregates over the right rows whose key ``on`` matches.

    Left rows without a match stay, with the aggregates of nothing; repeated left rows stay apart. ``strategy`` is ``auto``
    or one that serves the predicate (``plans.matching.STRATEGIES``); options are ``hint`` (a join hint), ``partitions`` (deal
    both sides by key), ``left_unique`` (a repeated left key is then an error), ``left_rows`` and ``right_rows`` (row counts
    for the build side, in place of Catalyst's estimates), ``buckets`` and ``borders`` (of ordered predicates).
    """
    j = Matching(left, right, on, list(aggregates), strategy, **options)
    chosen = j.chosen()
    if j.left_unique and j.family == "=" and strategy == "auto":
        chosen = "unique"
    return nested.nested(j) if chosen == "nested" else RUN[j.family, chosen](j)


def exists(left: DataFrame, right: DataFrame, on: Theta, **options) -> DataFrame:
    """Left rows with a match."""
    return _filtered(left, right, on, True, options)


def not_exists(left: DataFrame, right: DataFrame, on: Theta, **options) -> DataFrame:
    """Left rows without a match."""
    return _filtered(left, right, on, False, options)


def _filtered(left: DataFrame, right: DataFrame, on: Theta, wanted: bool, options: dict) -> DataFrame:
    """Equality is a semi or anti join; an order asks the right side's largest (or smallest) key only; the rest counts."""
    if on.kind == "=" and not options:
        j = Matching(left, right, on, [agg.count("__pf_found")])
        return j.left_keyed().join(j.right_keyed().select(K), K, "left_semi" if wanted else "left_anti").select(*(F.col(f"`{c}`") for c in left.columns))
    if on.kind in ("<", "<=", ">", ">=") and not options:
        far = F.max if on.kind in ("<", "<=") else F.min
        best = right.select(on.key(on.right).alias("__pf_rk")).where("__pf_rk is not null").agg(far("__pf_rk").alias("__pf_rk"))
        found = F.coalesce(on.holds(on.key(on.left), F.col("__pf_rk")), F.lit(False))
        return left.crossJoin(F.broadcast(best)).where(found if wanted else ~found).drop("__pf_rk")  # one row
    counted = match_aggregate(left, right, on, [agg.count("__pf_found")], **options)
    return counted.where(F.col("__pf_found") > 0 if wanted else F.col("__pf_found") == 0).drop("__pf_found")
