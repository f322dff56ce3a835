"""Matchings on different keys, without pairing rows.

What differs from a key is everything but what equals it: invertible aggregates are a grand total less the key's own
part. A minimum or maximum has no inverse, but the two best keys suffice: the best, or for its own rows the second best.
Sums of floating-point values have no exact inverse either (an infinite or very large value under the own key spoils the
difference), so with these, what differs is put together from what is smaller and what is larger.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.matching import K, Matching
from .equal import hinted, relevant_right
from .ordered import bucketed_states


def complement(j: Matching, build_left: bool = False) -> DataFrame:
    """Totals are one row, and best keys two, so broadcasting them is safe at any size."""
    right = j.right_keyed()
    per_key = j.per_key(right)
    floating = any(s.invert and isinstance(per_key.schema[c].dataType, (T.DoubleType, T.FloatType)) for c, s, _ in j.states())
    if floating:
        return two_sided(j)
    sums = [(c, s) for c, s, _ in j.states() if s.invert]
    totals = right.agg(F.count(F.lit(1)).alias("__pf_keys"), *(s.partial(F.col(f"__pf_v{i}")).alias(f"{c}_t") for c, s, i in j.states() if s.invert))
    own = j.per_key(relevant_right(j)) if build_left else per_key
    out = j.left_keyed().join(hinted(own, j.hint), K, "left").crossJoin(F.broadcast(totals))
    known = F.col(K).isNotNull()
    for c, s in sums:
        out = out.withColumn(c, F.when(known, s.invert(F.col(f"{c}_t"), F.col(c))))
    for c, s in ((c, s) for c, s, _ in j.states() if s.extreme):
        best = F.asc(c) if s.extreme == "min" else F.desc(c)
        two = per_key.where(F.col(c).isNotNull()).orderBy(best).limit(2).select(F.struct(F.col(c).alias("v"), F.col(K).alias("k")).alias("x")).agg(F.sort_array(F.collect_list("x"), s.extreme == "min").alias(f"{c}_b"))
        other = F.filter(f"{c}_b", lambda x: x["k"] != F.col(K))
        out = out.crossJoin(F.broadcast(two)).withColumn(c, F.when(known, F.try_element_at(other, F.lit(1))["v"]))
    return j.finish(out)


def two_sided(j: Matching) -> DataFrame:
    """What is smaller and what is larger than each left key, put together; needs no inverse."""
    cols = [(c, s) for c, s, _ in j.states()]
    below, above = (bucketed_states(j.with_theta(kind, j.theta.left)) for kind in (">", "<"))
    above = above.select(K, *(F.col(c).alias(f"{c}_up") for c, _ in cols))
    seen = below.join(above, K).select(K, *(s.combine(F.col(c), F.col(f"{c}_up")).alias(c) for c, s in cols))
    return j.finish(j.left_keyed().join(seen, K, "left"))
