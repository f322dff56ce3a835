"""Matchings on smaller or larger keys, by running aggregates in place of pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.matching import K, Matching
from ..sources.scratch import stored

#: More borders than this are searched by bisection.
TREE = 256
#: A fold's state is the list of its values, and each left key holds the list of all beyond it; more different keys are refused.
FOLD_KEYS = 20_000


def upward(j: Matching) -> bool:
    """Whether the matching right keys lie above the left key."""
    return j.theta.kind in ("<", "<=")


def keys_and_sums(j: Matching) -> DataFrame:
    """Different left keys and aggregated right keys in one frame; at equal keys the side that must not see the other comes first."""
    strict = j.theta.kind in ("<", ">")
    left = j.left.select(j.theta.key(j.theta.left).alias(K)).where(F.col(K).isNotNull()).distinct()
    right = j.per_key()
    both = left.withColumn("__pf_r", F.lit(0 if strict else 1)).unionByName(right.withColumn("__pf_r", F.lit(1 if strict else 0)), allowMissingColumns=True)
    return both.withColumn("__pf_left", F.col("__pf_r") == (0 if strict else 1))


def running(j: Matching, df: DataFrame, by: list[str]) -> DataFrame:
    order = [F.col(K).desc() if upward(j) else F.col(K).asc(), F.col("__pf_r").asc()]
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.select(K, "__pf_left", *by, *(_over(s.merge, F.col(c), w).alias(c) for c, s, _ in j.states()))


def _over(merge, value: Column, w) -> Column:
    """A merge over a window; a fold's list is flattened after it."""
    if merge in (F.sum, F.min, F.max):
        return merge(value).over(w)
    return F.flatten(F.collect_list(value).over(w))


def borders_of(keys: DataFrame, buckets: int) -> list:
    """At most ``buckets`` - 1 values that cut the rows of ``keys`` evenly; the rows hold each key of a side once, so no key is hot."""
    kind = keys.schema[K].dataType
    if buckets < 2:
        return []
    if isinstance(kind, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        shares = [i / buckets for i in range(1, buckets)]
        cut = F.percentile_approx(K, shares, max(10_000, 20 * buckets))
        if isinstance(kind, T.TimestampType):  # as microseconds, which no time zone makes ambiguous
            cut = F.transform(cut, lambda x: F.unix_micros(x))
        return sorted(set(keys.agg(cut).first()[0] or []))
    some = keys.select(K).orderBy(F.xxhash64(K), K).limit(64 * buckets)  # a bounded sample, the same for equal data
    got = sorted(r[0] for r in some.collect())
    return sorted({got[len(got) * i // buckets] for i in range(1, buckets)}) if got else []


def buckets_of(j: Matching) -> int:
    return j.buckets or max(64, int(j.left.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def literals(borders: list, kind: T.DataType) -> list[str] | None:
    """The borders as SQL text, in the key's type; None for a type without a plain text form."""
    if isinstance(kind, T.StringType):
        return [f"CAST(X'{b.encode().hex()}' AS STRING)" for b in borders]
    if isinstance(kind, T.TimestampType):
        return [f"timestamp_micros({b})" for b in borders]
    if isinstance(kind, (T.NumericType, T.DateType, T.TimestampNTZType)):
        return [f"CAST('{b}' AS {kind.simpleString()})" for b in borders]
    return None


def literal(value, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        return F.struct(*(literal(v, f.dataType).alias(f.name) for v, f in zip(value, kind))).cast(kind)
    return F.lit(value).cast(kind)


def bucket_of(borders: list, kind: T.DataType) -> Column:
    """How many borders are at most the key: by a balanced tree of comparisons, or by bisection when that would be too much code."""
    said, n = literals(borders, kind), len(borders)
    if not borders:
        return F.lit(0)
    if n > TREE or said is None:
        held = F.expr(f"array({', '.join(said)})") if said else F.array(*(literal(b, kind) for b in borders))
        steps = ", ".join(str(1 << k) for k in reversed(range(n.bit_length())))
        return F.aggregate(F.expr(f"array({steps})"), F.lit(0), lambda lo, step: F.when((lo + step <= n) & (F.get(held, lo + step - 1) <= F.col(K)), lo + step).otherwise(lo))

    def tree(lo: int, hi: int) -> str:
        if lo == hi:
            return str(lo)
        mid = (lo + hi) // 2
        return f"CASE WHEN {K} < {said[mid]} THEN {tree(lo, mid)} ELSE {tree(mid + 1, hi)} END"

    return F.expr(tree(0, n))


def in_buckets(j: Matching, both: DataFrame, borders: list) -> tuple[DataFrame, DataFrame]:
    """``both`` with its bucket, without right keys of buckets that hold no left key; and what the buckets beyond each hold.

    The buckets' totals are a row for each bucket, a number that is fixed; they are broadcast. Right keys that lie beyond all
    left keys are added up only, never sorted.
    """
    cols = [(c, s) for c, s, _ in j.states()]
    both = both.withColumn("__pf_b", bucket_of(borders, both.schema[K].dataType))
    sums = both.groupBy("__pf_b").agg(F.max("__pf_left").alias("__pf_asked"), *(s.merge(F.when(~F.col("__pf_left"), F.col(c))).alias(c) for c, s in cols))
    order = F.col("__pf_b").desc() if upward(j) else F.col("__pf_b").asc()
    beyond = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)  # over the buckets only
    carry = sums.select("__pf_b", "__pf_asked", *(s.merge(F.col(c)).over(beyond).alias(f"{c}_in") for c, s in cols)).where("__pf_asked").drop("__pf_asked")
    return both, carry


def bucketed_states(j: Matching) -> DataFrame:
    """The states of each different left key: run within buckets of the key range, plus what the buckets beyond hold.

    Both sides are reduced to their different keys and written once; the borders are percentiles of the different keys of both
    sides, so neither repeated keys nor sides that hardly meet make a bucket large.
    """
    both = keys_and_sums(j)
    if j.borders is None:
        both = stored(both)
        borders = borders_of(both, buckets_of(j))
    else:
        borders = sorted(j.borders)
        if isinstance(both.schema[K].dataType, T.TimestampType):
            borders = [int(b.timestamp() * 1_000_000) for b in borders]
    both, carry = in_buckets(j, both, borders)
    carry = F.broadcast(carry)
    run = running(j, both.join(carry.select("__pf_b"), "__pf_b", "left_semi"), ["__pf_b"]).where("__pf_left").join(carry, "__pf_b")
    return run.select(K, *(s.combine(F.col(c), F.col(f"{c}_in")).alias(c) for c, s, _ in j.states()))


def bucketed(j: Matching) -> DataFrame:
    """Cut the key range into buckets, run within each, and add what the buckets beyond hold."""
    if any(s.name == "list" for _, s, _ in j.states()):
        return global_window(j)
    return j.finish(j.left_keyed().join(bucketed_states(j), K, "left"))


def global_window(j: Matching) -> DataFrame:
    """One running window over all keys, in a single task: for small key sets, and for folds, whose keys are counted first."""
    both = keys_and_sums(j)
    if any(s.name == "list" for _, s, _ in j.states()):
        both = stored(both)
        if both.limit(FOLD_KEYS + 1).count() > FOLD_KEYS:
            raise ValueError(f"a fold over an order holds a list for each key; more than {FOLD_KEYS} different keys need an aggregate with states")
    run = running(j, both, []).where("__pf_left").drop("__pf_left")
    return j.finish(j.left_keyed().join(run, K, "left"))


def interval(j: Matching) -> DataFrame:
    """Assign each right row to the nearest left key that sees it, aggregate by interval, then run over the left keys.

    The assignment joins by ranges, so this is for small sets of left keys.
    """
    up, strict = upward(j), j.theta.kind in ("<", ">")
    keys = j.left.select(j.theta.key(j.theta.left).alias(K)).where(F.col(K).isNotNull()).distinct()
    near = keys.withColumn("__pf_n", F.lead(K).over(Window.orderBy(F.col(K).asc() if up else F.col(K).desc())))
    r = j.right_keyed().withColumnRenamed(K, "__pf_rk")
    k, n, rk = F.col(K), F.col("__pf_n"), F.col("__pf_rk")
    inside = {(True, True): (rk > k) & (n.isNull() | (rk <= n)), (True, False): (rk >= k) & (n.isNull() | (rk < n)), (False, True): (rk < k) & (n.isNull() | (rk >= n)), (False, False): (rk <= k) & (n.isNull() | (rk > n))}[up, strict]
    sums = r.join(near, inside).groupBy(K).agg(*j.partials())
    w = Window.orderBy(F.col(K).desc() if up else F.col(K).asc()).rowsBetween(Window.unboundedPreceding, 0)
    run = keys.join(sums, K, "left").select(K, *(_over(s.merge, F.col(c), w).alias(c) for c, s, _ in j.states()))
    return j.finish(j.left_keyed().join(run, K, "left"))


def band_difference(j: Matching) -> DataFrame:
    """Right keys from the left key + ``lo`` to it + ``hi``, as what lies at or above the first less what lies above the second."""
    lo, hi = j.theta.band
    key = j.theta.key(j.theta.left)
    sides = [bucketed_states(j.with_theta(kind, side)) for kind, side in (("<=", key + F.lit(lo)), ("<", key + F.lit(hi)))]
    cols = [(c, s) for c, s, _ in j.states()]
    at_least, above = sides[0].select(F.col(K).alias("__pf_lo"), *(F.col(c).alias(f"{c}_lo") for c, _ in cols)), sides[1].select(F.col(K).alias("__pf_hi"), *(F.col(c).alias(f"{c}_hi") for c, _ in cols))
    out = j.left_keyed().withColumn("__pf_lo", F.col(K) + F.lit(lo)).withColumn("__pf_hi", F.col(K) + F.lit(hi)).join(at_least, "__pf_lo", "left").join(above, "__pf_hi", "left")
    return j.finish(out.select(*(F.col(f"`{c}`") for c in j.left.columns), *(s.invert(F.col(f"{c}_lo"), F.col(f"{c}_hi")).alias(c) for c, s in cols)))
