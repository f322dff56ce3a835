import pytest

import pairfold as pf
from pairfold.operators import statistics as st
from pairfold.sources import generators as gen
from pairfold.sources.tables import read, write
from pairfold.streaming.enrich import stream_match


def value(df):
    return df.first()[0]


def test_uniqueness_and_selectivities(spark):
    a, b = [1, 1, 2, 5], [1, 2, 2, 7, 0]
    l, r = (spark.createDataFrame([(x,) for x in xs], "k int") for xs in (a, b))
    assert not value(st.is_key_unique(l, "k")) and value(st.is_key_unique(l.distinct(), "k")) and value(st.is_key_unique(l.limit(0), "k"))
    same, less = sum(x == y for x in a for y in b), sum(x < y for x in a for y in b)
    assert value(st.eq_selectivity(l, r, pf.eq("k", "k"))) == same / 4
    assert value(st.ne_selectivity(l, r, pf.ne("k", "k"))) == pytest.approx(1 - same / 20)
    assert value(st.lt_selectivity(l, r, "k", "k")) == pytest.approx(less / 20)
    assert value(st.eq_selectivity(l.limit(0), r, pf.eq("k", "k"))) is None
    assert value(st.lt_selectivity(l, r.limit(0), "k", "k")) is None


def test_generators_are_seeded(spark):
    pool = gen.value_pool(spark, 50, seed=3)
    rel = gen.relation(pool, 200, seed=3)
    assert rel.collect() == gen.relation(gen.value_pool(spark, 50, seed=3), 200, seed=3).collect()
    assert sorted(x["other"] for x in rel.collect()) == list(range(200))
    assert {x["key"] for x in rel.collect()} <= {x["value"] for x in pool.collect()}
    assert [(x["key"], x["other"]) for x in gen.unique_relation(spark, 5).collect()] == [(i, i) for i in range(5)]
    assert [x["value"] for x in gen.unique_value_pool(spark, 4).orderBy("pos").collect()] == [0, 1, 2, 3]
    assert gen.relation(gen.value_pool(spark, 0), 3).count() == 0
    assert [f.dataType.simpleString() for f in rel.schema] == ["int", "int"]


def test_tables_and_streams(spark, tmp_path):
    left = gen.relation(gen.unique_value_pool(spark, 6), 30)
    right = gen.relation(gen.unique_value_pool(spark, 6), 90, seed=9)
    write(left, f"{tmp_path}/left.parquet")
    assert read(spark, str(tmp_path), "left").count() == 30
    seen = []
    stream = spark.readStream.schema(left.schema).parquet(f"{tmp_path}/left.parquet")
    q = stream_match(stream, right, pf.eq("key", "key"), [pf.sum0("other", "s")], lambda df, n: seen.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, seen)) == sorted(map(tuple, pf.match_aggregate(left, right, pf.eq("key", "key"), [pf.sum0("other", "s")]).collect()))
