"""Every strategy against brute force in Python, on small relations with all the awkward cases."""

import random

import pytest
from pyspark.sql import functions as F

import pairfold as pf
from pairfold.functions import aggregates as agg
from pairfold.operators import ordered
from pairfold.plans.matching import STRATEGIES, Matching

KINDS = ["sum0", "sum_", "count", "min_", "max_", "avg", "avg_trunc"]
OPS = {"=": (pf.eq, lambda a, b: a == b), "<>": (pf.ne, lambda a, b: a != b), "<": (pf.lt, lambda a, b: a < b), ">": (pf.gt, lambda a, b: a > b), "<=": (pf.le, lambda a, b: a <= b), ">=": (pf.ge, lambda a, b: a >= b)}


def relations():
    r = random.Random(4)
    some = lambda n, pool, nulls: [(None if nulls and r.random() < 0.1 else r.randrange(pool), r.choice([None, *range(-9, 10)])) for _ in range(n)]
    return {
        "random": (some(60, 20, True), some(90, 25, True)), "empty right": (some(10, 5, True), []), "empty left": ([], some(10, 5, True)), "one key": ([(3, 1), (3, 1), (4, 2)], [(3, k) for k in range(20)]),
        "disjoint": ([(k, 0) for k in range(8)], [(k + 100, k) for k in range(8)]), "large right": (some(5, 40, False), some(200, 40, False)), "descending": ([("k", 0)] and [(1, 0), (2, 0), (9, 0)], [(1, 5), (2, 7), (1, 3)]),
        "nulls only": ([(None, 1), (None, 1)], [(None, 2)]), "skew": ([(7, k) for k in range(40)] + [(8, 1)], [(7, k) for k in range(80)] + [(1, 1)]),
    }


def brute(left, right, test):
    out = []
    for k, other in left:
        rows = [v for rk, v in right if k is not None and rk is not None and test(k, rk)]
        vals = [v for v in rows if v is not None]
        total = sum(vals)
        trunc = None if not vals else float(int(total / len(vals)))
        out.append((k, other, total, total if vals else None, len(rows), min(vals, default=None), max(vals, default=None), total / len(vals) if vals else None, trunc))
    return sorted(out, key=str)


def frames(spark, left, right):
    return spark.createDataFrame(left, "key int, other int"), spark.createDataFrame(right, "key int, other int")


def aggregates():
    return [getattr(pf, k)("other", f"r_{k}") if k != "count" else pf.count("r_count") for k in KINDS]


@pytest.mark.parametrize("op", OPS)
def test_strategies_match_brute_force(spark, op):
    make, test = OPS[op]
    family = "<" if op in ("<", ">", "<=", ">=") else op
    for name, (left, right) in relations().items():
        want = brute(left, right, test)
        l, r = frames(spark, left, right)
        for strategy in ("auto", *(STRATEGIES[family] if name in ("random", "one key", "empty right") else ())):
            if strategy == "unique" and len({k for k, _ in left}) < len(left):
                continue
            got = sorted((tuple(x) for x in pf.match_aggregate(l, r, make("key", "key"), aggregates(), strategy).collect()), key=str)
            assert got == want, (op, name, strategy)


@pytest.mark.parametrize("options", [{"hint": "merge"}, {"hint": "shuffle_hash"}, {"partitions": 3}, {"left_rows": 1, "right_rows": 11}, {"left_rows": 2, "right_rows": 20}])
@pytest.mark.parametrize("op", ["=", "<>"])
def test_options_do_not_change_results(spark, op, options):
    left, right = relations()["random"]
    make, test = OPS[op]
    l, r = frames(spark, left, right)
    got = sorted((tuple(x) for x in pf.match_aggregate(l, r, make("key", "key"), aggregates(), **options).collect()), key=str)
    assert got == brute(left, right, test)


def test_any_predicate_and_key_lists(spark):
    left, right = relations()["random"]
    l, r = frames(spark, left, right)
    near = pf.theta("key", "key", lambda a, b: F.abs(a - b) <= 2)
    got = sorted((tuple(x) for x in pf.match_aggregate(l, r, near, aggregates()).collect()), key=str)
    assert got == brute(left, right, lambda a, b: abs(a - b) <= 2)
    both = pf.match_aggregate(l, r, pf.eq(["key", "other"], ["key", "other"]), [pf.count("n")]).collect()
    assert sorted((tuple(x) for x in both), key=str) == sorted(((k, v, sum((k, v) == x for x in right) if k is not None and v is not None else 0) for k, v in left), key=str)


def test_strings_dates_and_borders(spark):
    words = ["a", "b", "b", "c", None, "zz"]
    l = spark.createDataFrame([(w,) for w in words], "w string")
    got = pf.match_aggregate(l, l, pf.lt("w", "w"), [pf.count("n")], buckets=3).collect()
    assert sorted((tuple(x) for x in got), key=str) == sorted(((w, sum(w is not None and x is not None and w < x for x in words)) for w in words), key=str)
    d = l.select(F.to_date(F.lit("2020-01-01")).alias("d")).limit(2)
    assert [x["n"] for x in pf.match_aggregate(d, d, pf.le("d", "d"), [pf.count("n")]).collect()] == [2, 2]
    got = pf.match_aggregate(l, l, pf.gt("w", "w"), [pf.count("n")], borders=["b", "c"]).collect()
    assert sorted((tuple(x) for x in got), key=str) == sorted(((w, sum(w is not None and x is not None and w > x for x in words)) for w in words), key=str)


def test_many_borders(spark):
    l = spark.range(-50, 1000).select(F.col("id").cast("int").alias("k"))
    for borders in (list(range(0, 900, 3)), list(range(10, 700, 100))):
        got = pf.match_aggregate(l, l, pf.ge("k", "k"), [pf.count("n"), pf.sum0("k", "s")], borders=borders).collect()
        assert all(r["n"] == r["k"] + 51 and r["s"] == sum(range(-50, r["k"] + 1)) for r in got) and len(got) == 1050


def test_custom_and_folded_aggregates(spark):
    left, right = relations()["random"]
    l, r = frames(spark, left, right)
    spread = pf.custom("spread", "other", [agg.LEAST, agg.MOST], lambda a, b: b - a)
    folded = pf.fold("folded", F.col("other").cast("long"), F.lit(0).cast("long"), lambda a, v: a + v * v)
    for op, (make, test) in OPS.items():
        got = {}
        for row in pf.match_aggregate(l, r, make("key", "key"), [spread, folded]).collect():
            got.setdefault((row["key"], row["other"]), set()).add((row["spread"], row["folded"]))
        for k, other in left:
            vals = [v for rk, v in right if k is not None and rk is not None and v is not None and test(k, rk)]
            assert got[k, other] == {(max(vals) - min(vals) if vals else None, sum(v * v for v in vals))}, op


def test_inputs_are_checked(spark):
    l, r = frames(spark, [(1, 1)], [(1, 1)])
    with pytest.raises(ValueError):
        pf.match_aggregate(l, r, pf.eq("key", "key"), [pf.count("other")])
    with pytest.raises(ValueError):
        pf.match_aggregate(l, r, pf.eq("key", "key"), [])
    with pytest.raises(ValueError):
        pf.match_aggregate(l, r, pf.eq("key", "key"), [pf.count("n")], "bucketed")
    with pytest.raises(ValueError):
        pf.match_aggregate(l, r, pf.ne("key", "key"), [pf.fold("f", "other", F.lit(0), lambda a, v: a + v)], "pre_right")


def test_exists(spark):
    l, r = frames(spark, [(1, 1), (2, 2), (None, 3)], [(1, 1), (1, 2)])
    assert [x["key"] for x in pf.exists(l, r, pf.eq("key", "key")).collect()] == [1]
    assert sorted(x["other"] for x in pf.not_exists(l, r, pf.eq("key", "key")).collect()) == [2, 3]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_default_plans_pair_no_rows(spark):
    l, r = frames(spark, *relations()["random"])
    for make in (pf.eq, pf.ne, pf.lt, pf.ge):
        plan = plan_of(pf.match_aggregate(l, r, make("key", "key"), [pf.sum0("other"), pf.count("n")]))
        assert "CartesianProduct" not in plan
        nested = [x for x in plan.split("\n") if "BroadcastNestedLoopJoin" in x]
        assert len(nested) <= (1 if make is pf.ne else 0)  # with the one row of totals
        assert "partial_" in plan
    assert "SortMergeJoin" in plan_of(pf.match_aggregate(l, r, pf.eq("key", "key"), [pf.count("n")], hint="merge"))
    assert "ShuffledHashJoin" in plan_of(pf.match_aggregate(l, r, pf.eq("key", "key"), [pf.count("n")], hint="shuffle_hash"))


def test_a_repeated_left_key_is_not_taken_for_unique(spark):
    l, r = frames(spark, [(1, 1), (1, 2)], [(1, 5)])
    with pytest.raises(Exception, match="not unique"):
        pf.match_aggregate(l, r, pf.eq("key", "key"), [pf.sum0("other")], left_unique=True).collect()


def test_sums_of_doubles_over_other_keys(spark):
    l = spark.createDataFrame([(1,), (2,), (3,), (None,)], "k int")
    inf, nan = float("inf"), float("nan")
    for values in ([(1, inf), (2, 1.0), (2, 2.0)], [(1, 1e300), (2, 0.1), (3, 0.2)], [(1, nan), (2, 1.0)]):
        r = spark.createDataFrame(values, "k int, v double")
        found = [sorted(((x["k"], x["s"], x["n"], x["m"]) for x in pf.match_aggregate(l, r, pf.ne("k", "k"), [pf.sum0("v", "s"), pf.count("n"), pf.max_("v", "m")], strategy).collect()), key=str) for strategy in ("auto", "two_sided", "nested")]
        assert str(found[0]) == str(found[1]) == str(found[2])


def bucket_sizes(l, r, theta, **options):
    j = Matching(l, r, theta, [pf.count("n")], **options)
    both = ordered.keys_and_sums(j).cache()
    placed, carry = ordered.in_buckets(j, both, ordered.borders_of(both, ordered.buckets_of(j)))
    asked = [x["__pf_b"] for x in carry.collect()]
    sizes = {x["__pf_b"]: x["count"] for x in placed.groupBy("__pf_b").count().collect()}
    return sizes, asked


def test_buckets_stay_even(spark):
    hot = spark.range(3000).withColumn("k", F.when(F.col("id") < 2970, F.lit(7)).otherwise(F.col("id"))).select("k")
    wide, high = spark.range(3001).withColumnRenamed("id", "k"), spark.range(100_000, 104_000).withColumnRenamed("id", "k")
    words = spark.range(200 * 20).select(F.concat(F.lit("w"), (F.col("id") % 200 + 1000).cast("string")).alias("k"))
    for l, r in ((hot, wide), (wide, high), (words, words), (hot.select(F.col("k").cast("double").alias("k")), wide)):
        sizes, asked = bucket_sizes(l, r, pf.lt("k", "k"), buckets=64)
        assert max(sizes.values()) <= 3 * sum(sizes.values()) / 64 + 3, sorted(sizes.values())[-3:]
        assert len(sizes) > 50
    sizes, asked = bucket_sizes(wide, high, pf.lt("k", "k"), buckets=64)
    assert len(asked) < len(sizes)  # right keys beyond all left keys are added up, not sorted
    got = pf.match_aggregate(wide, high, pf.lt("k", "k"), [pf.count("n")], buckets=64).agg(F.min("n"), F.max("n")).first()
    assert tuple(got) == (4000, 4000)


def test_bands(spark):
    left, right = relations()["random"]
    l, r = frames(spark, left, right)
    whole = [pf.sum0("other", "s"), pf.sum_("other", "t"), pf.count("n"), pf.avg("other", "a")]
    one, two = (sorted((tuple(x) for x in pf.match_aggregate(l, r, pf.band("key", "key", -2, 3), whole, strategy).collect()), key=str) for strategy in ("auto", "nested"))
    assert one == two and Matching(l, r, pf.band("key", "key", -2, 3), whole).chosen() == "difference"
    best = pf.match_aggregate(l, r, pf.band("key", "key", -2, 3), [pf.max_("other", "m", empty_value=-99)]).collect()
    for x in best:
        inside = [v for k, v in right if x["key"] is not None and k is not None and v is not None and x["key"] - 2 <= k <= x["key"] + 3]
        assert x["m"] == max(inside, default=-99)


def test_build_side_follows_real_sizes(spark, tmp_path):
    for name, n in (("small", 50), ("large", 200_000)):
        spark.range(n).select(F.col("id").alias("key"), (F.col("id") * 7).alias("other")).write.parquet(f"{tmp_path}/{name}")
    small, large = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("small", "large"))
    for make in (pf.eq, pf.ne):
        assert Matching(small, large, make("key", "key"), [pf.count("n")]).chosen() == "pre_left"
        assert Matching(large, small, make("key", "key"), [pf.count("n")]).chosen() == "pre_right"
        assert Matching(small, large, make("key", "key"), [pf.count("n")], left_rows=10**9).chosen() == "pre_right"


def test_bucketed_tables_are_matched_without_a_shuffle(spark, tmp_path):
    from pairfold.sources.tables import write

    for name in ("a", "b"):
        write(spark.range(500).select((F.col("id") % 90).alias("key"), F.col("id").alias("other")), f"{tmp_path}/{name}", "key", 4, f"bucketed_{name}")
    out = pf.match_aggregate(spark.table("bucketed_a"), spark.table("bucketed_b"), pf.eq("key", "key"), [pf.sum0("other", "s")], hint="merge")
    assert "Exchange" not in plan_of(out) and "SortMergeJoin" in plan_of(out)
    assert {(r["key"], r["s"]) for r in out.collect()} == {(k, sum(range(k, 500, 90))) for k in range(90)}
    for name in ("a", "b"):
        spark.sql(f"DROP TABLE bucketed_{name}")


def test_exists_over_an_order_asks_one_row(spark):
    l, r = frames(spark, [(1, 1), (5, 2), (None, 3)], [(1, 1), (4, 2)])
    for make, test in ((pf.lt, lambda a, b: a < b), (pf.ge, lambda a, b: a >= b)):
        held = {1: any(test(1, k) for k in (1, 4)), 5: any(test(5, k) for k in (1, 4)), None: False}
        assert {x["key"] for x in pf.exists(l, r, make("key", "key")).collect()} == {k for k, v in held.items() if v}
        assert {x["key"] for x in pf.not_exists(l, r, make("key", "key")).collect()} == {k for k, v in held.items() if not v}
        assert pf.exists(l, r.limit(0), make("key", "key")).count() == 0


def test_folds_over_an_order_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(ordered, "FOLD_KEYS", 10)
    l = spark.range(20).withColumnRenamed("id", "key")
    with pytest.raises(ValueError, match="fold"):
        pf.match_aggregate(l, l, pf.lt("key", "key"), [pf.fold("f", "key", F.lit(0).cast("long"), lambda a, v: a + v)])


def test_borders_of_every_type(spark):
    base = spark.range(300).select(F.col("id").cast("int").alias("i"))
    kinds = {
        "long": F.col("i").cast("long"), "float": F.col("i") / 7.0 - 11, "decimal": (F.col("i") / 100).cast("decimal(12,3)"), "date": F.date_add(F.lit("2019-12-01").cast("date"), F.col("i")), "string": F.concat(F.lit("it's "), F.col("i").cast("string")),
        "ntz": (F.lit("2020-10-25 00:30:00").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("i"))), "ltz": F.timestamp_seconds(F.col("i") * 600 + 1_603_580_000), "bytes": F.col("i").cast("string").cast("binary"), "pair": F.struct(F.col("i") % 7, F.col("i")),
    }
    for name, key in kinds.items():
        l = base.select(key.alias("k"))
        got = sorted(r["n"] for r in pf.match_aggregate(l, l, pf.le("k", "k"), [pf.count("n")], buckets=16).collect())
        assert got == list(range(1, 301)), name
