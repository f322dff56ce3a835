"""The query catalogue, with the same queries in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import aggregates as agg
from .functions.theta import Theta, band, eq, ge, gt, le, lt, ne, theta
from .operators import statistics
from .operators.api import exists, match_aggregate, not_exists
from .sources import generators
from .sources.scratch import forget_at_exit, shared_folder
from .sources.tables import read, write

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def cents(name: str) -> Column:
    """A money column as whole cents, so that sums are exact in any order."""
    return F.round(F.col(name) * 100).cast("bigint")


#: Aggregates by name, with their SQL over a value {v} of right rows r (``r.hit`` marks a match).
AGGREGATES: dict[str, tuple[Callable[[Column], agg.Aggregate], str]] = {
    "sum0": (lambda v: agg.sum0(v), "CAST(COALESCE(SUM({v}), 0) AS BIGINT) AS sum0"),
    "sum": (lambda v: agg.sum_(v), "CAST(SUM({v}) AS BIGINT) AS sum"),
    "count": (lambda v: agg.count(), "COUNT(r.hit) AS count"),
    "min": (lambda v: agg.min_(v), "MIN({v}) AS min"),
    "max": (lambda v: agg.max_(v), "MAX({v}) AS max"),
    "avg": (lambda v: agg.avg(v), "CAST(SUM({v}) AS DOUBLE) / COUNT({v}) AS avg"),
    "avg_trunc": (lambda v: agg.avg_trunc(v), "CAST(CAST(SUM({v}) AS BIGINT) // COUNT({v}) AS DOUBLE) AS avg_trunc"),
}
OPERATORS = {eq: "=", ne: "<>", lt: "<", gt: ">", le: "<=", ge: ">="}


def add(name: str, left: tuple[str, list[str], str], right: tuple[str, str, str | None], op, kinds: list[str], where: str = "TRUE", **options) -> None:
    """Register a query: left (table, columns, key), right (table, key, money column), predicate and aggregates."""
    (lt_name, cols, lk), (rt_name, rk, money) = left, right

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        l, r = read(spark, sf_dir, lt_name).select(*dict.fromkeys([*cols, lk])), read(spark, sf_dir, rt_name).where(where)
        value = cents(money) if money else None
        return match_aggregate(l, r, op(lk, rk), [AGGREGATES[k][0](value) for k in kinds], **options)

    have = ", ".join(f"l.{c}" for c in dict.fromkeys([*cols, lk]))
    v = f"CAST(ROUND({money} * 100) AS BIGINT)" if money else "NULL"
    results = ", ".join(AGGREGATES[k][1].format(v="r.v") for k in kinds)
    QUERIES[name] = run
    SQL[name] = f"SELECT {have}, {results} FROM {lt_name} l LEFT JOIN (SELECT {rk} AS k, {v} AS v, 1 AS hit FROM {rt_name} WHERE {where}) r ON l.{lk} {OPERATORS[op]} r.k GROUP BY {have}"


ORDERS = ("orders", ["o_orderkey"], "o_orderkey")
LINES = ("lineitem", "l_orderkey", "l_extendedprice")
SUPPLIER = ("supplier", ["s_suppkey"], "s_suppkey")
SUPPLIED = ("lineitem", "l_suppkey", "l_extendedprice")
PART = ("part", ["p_partkey"], "p_partkey")
PART_LINES = ("lineitem", "l_partkey", "l_extendedprice")
DATES = ("orders", ["o_orderkey"], "o_orderdate")
SHIPPED = ("lineitem", "l_shipdate", "l_extendedprice")
SIZES = ("part", ["p_partkey"], "p_size")
SIZED = ("part", "p_size", "p_retailprice")

for kind in AGGREGATES:
    add(f"eq_{kind}", ORDERS, LINES, eq, [kind])
for name, options in {
    "eq_nested": {"strategy": "nested"}, "eq_join_first": {"strategy": "join_first"}, "eq_unique": {"strategy": "unique"}, "eq_build_left": {"strategy": "pre_left"},
    "eq_build_right": {"strategy": "pre_right"}, "eq_auto": {}, "eq_auto_given_rows": {"left_rows": 100, "right_rows": 1001}, "eq_sort_merge": {"hint": "merge"}, "eq_shuffle_hash": {"hint": "shuffle_hash", "partitions": 16},
}.items():
    add(name, ORDERS, LINES, eq, ["sum0", "count"], **options)
add("eq_dup_left", ("orders", ["o_orderkey"], "o_custkey"), ("events", "user_id", "value"), eq, ["count", "sum0"])
add("eq_multi_agg", PART, PART_LINES, eq, list(AGGREGATES))
for kind in AGGREGATES:
    add(f"ne_{kind}", SUPPLIER, SUPPLIED, ne, [kind])
for name, options in {"ne_build_left": {"strategy": "pre_left"}, "ne_auto": {}, "ne_auto_given_rows": {"left_rows": 10, "right_rows": 101}, "ne_sort_merge": {"hint": "merge"}, "ne_partitioned": {"hint": "shuffle_hash", "partitions": 16}}.items():
    add(name, PART, PART_LINES, ne, ["sum0"], **options)
add("ne_nested", SUPPLIER, SUPPLIED, ne, ["sum0", "min", "max", "count"], strategy="nested")
add("ne_multi_agg", SUPPLIER, SUPPLIED, ne, list(AGGREGATES))
add("ne_single_key", SUPPLIER, SUPPLIED, ne, ["sum", "count"], where="l_suppkey = 7")
for kind in ("sum0", "sum", "count", "min", "max", "avg", "avg_trunc"):
    add(f"lt_{kind}", DATES, SHIPPED, lt, [kind])
for name, strategy in {"lt_global": "global", "lt_interval": "interval", "lt_nested": "nested"}.items():
    add(name, SIZES, SIZED, lt, ["sum0", "min", "max"], strategy=strategy)
add("lt_double", ("supplier", ["s_suppkey"], "s_acctbal"), ("customer", "c_acctbal", None), lt, ["count"])
add("lt_string", ("part", ["p_partkey"], "p_brand"), ("part", "p_brand", None), lt, ["count"])
for name, op in {"gt_count": gt, "le_count": le, "ge_count": ge}.items():
    add(name, SIZES, SIZED, op, ["count", "sum0", "min", "max"])


def _band(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, c = read(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), read(spark, sf_dir, "customer")
    near = theta("s_acctbal", "c_acctbal", lambda a, b: (b >= a - 100) & (b <= a + 100))
    return match_aggregate(s, c, near, [agg.count(), agg.sum0(cents("c_acctbal"))])


def _band_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same band, without pairs."""
    s, c = read(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), read(spark, sf_dir, "customer")
    return match_aggregate(s, c, band("s_acctbal", "c_acctbal", -100, 100), [agg.count(), agg.sum0(cents("c_acctbal"))])


def _sum_double(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of doubles over other keys; rounded to whole cents, as their last digits depend on the order of addition."""
    found = match_aggregate(read(spark, sf_dir, "supplier").select("s_suppkey"), read(spark, sf_dir, "lineitem"), ne("s_suppkey", "l_suppkey"), [agg.sum0("l_extendedprice", "total"), agg.min_("l_discount", "least")])
    return found.select("s_suppkey", F.round(F.col("total") * 100).cast("bigint").alias("total_cents"), "least")


def _bucketed_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides written as tables bucketed and sorted by key, then matched without a shuffle."""
    sides = []
    for name, key, cols in (("orders", "o_orderkey", ["o_orderkey"]), ("lineitem", "l_orderkey", ["l_orderkey", "l_extendedprice"])):
        table = f"pairfold_bucketed_{name}_{spark.sparkContext.applicationId.replace('-', '_')}"
        path = f"{shared_folder(spark)}/{table}"
        write(read(spark, sf_dir, name).select(cols), path, key, 8, table)
        forget_at_exit(spark, path)
        sides.append(spark.table(table))
    return match_aggregate(*sides, eq("o_orderkey", "l_orderkey"), [agg.sum0(cents("l_extendedprice")), agg.count()], hint="merge")


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds for every pool of 1,000 random values."""
    p = generators.value_pool(spark, 1000)
    return p.agg(F.count("value").alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.count_distinct("pos").alias("positions"), (F.min("value") >= 0).alias("from_zero"), (F.count_distinct("value") > 900).alias("varied"))


def _relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds for every relation of 1,000 rows with keys from a pool."""
    p = generators.value_pool(spark, 1000)
    r = generators.relation(p, 1000)
    inside = match_aggregate(r, p, eq("key", "value"), [agg.count("n")])
    return inside.agg(F.count("key").alias("n"), F.count_distinct("other").alias("others"), F.min("other").alias("first"), F.max("other").alias("last"), F.count(F.when(F.col("n") == 0, 1)).alias("outside"), (F.count_distinct("key") > 500).alias("varied"))


def _exists_less(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exists(read(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), read(spark, sf_dir, "customer"), gt("s_acctbal", "c_acctbal"))


def _mod(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, c = read(spark, sf_dir, "supplier").select("s_suppkey"), read(spark, sf_dir, "customer")
    return match_aggregate(s, c, theta("s_suppkey", "c_custkey", lambda a, b: a % 7 == b % 7), [agg.count(), agg.sum0(cents("c_acctbal"))])


def _two_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))
    return match_aggregate(n.drop("n"), read(spark, sf_dir, "lineitem"), eq(["l_suppkey", "l_linenumber"], ["l_suppkey", "l_linenumber"]), [agg.sum0(cents("l_extendedprice")), agg.count()])


def _mod_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An equality of one's own, as an expression on the keys."""
    return match_aggregate(read(spark, sf_dir, "supplier").select("s_suppkey"), read(spark, sf_dir, "customer"), eq(F.col("s_suppkey") % 10, F.col("c_custkey") % 10), [agg.count()])


def _custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of values, from a least and a largest one."""
    spread = agg.custom("spread", cents("l_extendedprice"), [agg.LEAST, agg.MOST], lambda a, b: b - a)
    return match_aggregate(read(spark, sf_dir, "orders").select("o_orderkey"), read(spark, sf_dir, "lineitem"), eq("o_orderkey", "l_orderkey"), [spread])


def _fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of squared quantities, as a fold."""
    squares = agg.fold("squares", F.col("l_quantity").cast("bigint"), F.lit(0).cast("bigint"), lambda a, v: a + v * v)
    return match_aggregate(read(spark, sf_dir, "orders").select("o_orderkey"), read(spark, sf_dir, "lineitem"), eq("o_orderkey", "l_orderkey"), [squares])


def _exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exists(read(spark, sf_dir, "orders").select("o_orderkey"), read(spark, sf_dir, "lineitem"), eq("o_orderkey", "l_orderkey"))


def _not_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return not_exists(read(spark, sf_dir, "orders").select("o_orderkey"), read(spark, sf_dir, "lineitem"), eq("o_orderkey", "l_orderkey"))


def _statistic(f: Callable[..., DataFrame], *rest) -> Query:
    return lambda spark, sf_dir: f(read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem"), *rest)


def _key_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.is_key_unique(read(spark, sf_dir, "orders"), "o_orderkey").select(F.lit("orders").alias("name"), "is_unique").unionByName(statistics.is_key_unique(read(spark, sf_dir, "lineitem"), "l_orderkey").select(F.lit("lineitem").alias("name"), "is_unique"))


QUERIES |= {
    "theta_band": _band, "theta_mod": _mod, "eq_two_keys": _two_keys, "eq_key_expression": _mod_key, "eq_custom_agg": _custom, "eq_fold": _fold, "exists_eq": _exists, "not_exists_eq": _not_exists,
    "sel_eq": _statistic(statistics.eq_selectivity, eq("o_orderkey", "l_orderkey")), "sel_ne": _statistic(statistics.ne_selectivity, ne("o_orderkey", "l_orderkey")), "sel_lt": _statistic(statistics.lt_selectivity, "o_orderdate", "l_shipdate"), "is_key_unique": _key_unique,
    "gen_unique_rel": lambda spark, _: generators.unique_relation(spark, 1000), "gen_unique_pool": lambda spark, _: generators.unique_value_pool(spark, 1000),
    "gen_pool": _pool, "gen_rel": _relation, "theta_band_difference": _band_difference, "ne_sum_double": _sum_double, "eq_bucketed_merge": _bucketed_merge, "exists_gt": _exists_less,
}
SQL |= {
    "theta_band": "SELECT s_suppkey, s_acctbal, COUNT(c_custkey) AS count, CAST(COALESCE(SUM(CAST(ROUND(c_acctbal * 100) AS BIGINT)), 0) AS BIGINT) AS sum0 FROM supplier LEFT JOIN customer ON c_acctbal >= s_acctbal - 100 AND c_acctbal <= s_acctbal + 100 GROUP BY s_suppkey, s_acctbal",
    "theta_mod": "SELECT s_suppkey, COUNT(c_custkey) AS count, CAST(COALESCE(SUM(CAST(ROUND(c_acctbal * 100) AS BIGINT)), 0) AS BIGINT) AS sum0 FROM supplier LEFT JOIN customer ON s_suppkey % 7 = c_custkey % 7 GROUP BY s_suppkey",
    "eq_two_keys": "SELECT l_suppkey, l_linenumber, CAST(SUM(CAST(ROUND(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS sum0, COUNT(*) AS count FROM lineitem GROUP BY l_suppkey, l_linenumber",
    "eq_key_expression": "SELECT s_suppkey, COUNT(c_custkey) AS count FROM supplier LEFT JOIN customer ON s_suppkey % 10 = c_custkey % 10 GROUP BY s_suppkey",
    "eq_custom_agg": "SELECT o_orderkey, MAX(CAST(ROUND(l_extendedprice * 100) AS BIGINT)) - MIN(CAST(ROUND(l_extendedprice * 100) AS BIGINT)) AS spread FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey",
    "eq_fold": "SELECT o_orderkey, CAST(COALESCE(SUM(CAST(l_quantity AS BIGINT) * CAST(l_quantity AS BIGINT)), 0) AS BIGINT) AS squares FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey",
    "exists_eq": "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)",
    "not_exists_eq": "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)",
    "sel_eq": "SELECT CAST((SELECT COUNT(*) FROM orders JOIN lineitem ON o_orderkey = l_orderkey) AS DOUBLE) / (SELECT COUNT(*) FROM orders) AS selectivity",
    "sel_ne": "SELECT 1 - CAST((SELECT COUNT(*) FROM orders JOIN lineitem ON o_orderkey = l_orderkey) AS DOUBLE) / (CAST((SELECT COUNT(*) FROM orders) AS DOUBLE) * (SELECT COUNT(*) FROM lineitem)) AS selectivity",
    "sel_lt": "SELECT CAST((SELECT COUNT(*) FROM orders JOIN lineitem ON o_orderdate < l_shipdate) AS DOUBLE) / (CAST((SELECT COUNT(*) FROM orders) AS DOUBLE) * (SELECT COUNT(*) FROM lineitem)) AS selectivity",
    "is_key_unique": "SELECT 'orders' AS name, COUNT(*) = COUNT(DISTINCT o_orderkey) AS is_unique FROM orders UNION ALL SELECT 'lineitem', COUNT(*) = COUNT(DISTINCT l_orderkey) FROM lineitem",
    "gen_unique_rel": 'SELECT CAST(i AS INTEGER) AS "key", CAST(i AS INTEGER) AS other FROM range(1000) t(i)',
    "gen_unique_pool": "SELECT i AS pos, CAST(i AS INTEGER) AS value FROM range(1000) t(i)",
}
SQL |= {
    "theta_band_difference": SQL["theta_band"],
    "ne_sum_double": "SELECT s_suppkey, CAST(ROUND(COALESCE(SUM(l_extendedprice), 0) * 100) AS BIGINT) AS total_cents, MIN(l_discount) AS least FROM supplier LEFT JOIN lineitem ON s_suppkey <> l_suppkey GROUP BY s_suppkey",
    "eq_bucketed_merge": SQL["eq_sort_merge"],
    "exists_gt": "SELECT s_suppkey, s_acctbal FROM supplier WHERE EXISTS (SELECT 1 FROM customer WHERE s_acctbal > c_acctbal)",
    "gen_pool": "SELECT COUNT(*) AS n, MIN(i) AS first, MAX(i) AS last, COUNT(DISTINCT i) AS positions, TRUE AS from_zero, TRUE AS varied FROM range(1000) t(i)",
    "gen_rel": "SELECT COUNT(*) AS n, COUNT(DISTINCT i) AS others, CAST(MIN(i) AS INTEGER) AS first, CAST(MAX(i) AS INTEGER) AS last, CAST(0 AS BIGINT) AS outside, TRUE AS varied FROM range(1000) t(i)",
}
