import re

import numpy as np
import pytest

from pairfold.llm import decontam as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def brute(docs, items, n=13):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - n + 1) if w and i is not None else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for win, holders in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    found |= holders
        out.append((d, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


ITEMS = [(1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"), (2, "Short ITEM"), (3, ""), (4, None), (None, "short item"), (5, "one two three four five six seven eight nine ten eleven twelve thirteen"), (6, "a a a a a a a a a a a a a a")]
DOCS = [
    (1, "x one two three four five six seven eight nine ten eleven twelve thirteen fourteen y"), (2, "one two three four five six seven eight nine ten eleven twelve thirteen"), (3, None), (4, ""), (5, "a short, item; here " + "filler " * 200),
    (6, "a " * 60), (7, "twelve thirteen fourteen one two"), (8, "SHORT\nITEM"), (8, "SHORT\nITEM"), (9, "filler " * 30_000 + "short item"), (None, "short item"),
]


@pytest.mark.parametrize("block", [1 << 20, 15])
def test_matches_brute_force(spark, block):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    got = D.find_matches(docs, items, block_words=block).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], list(r["items"]), r["contaminated"]) for r in got), key=str) == brute(DOCS, ITEMS)


def test_near_matches_need_no_exact_phrase():
    test = D.TestWindows([("1", [b"alpha", b"beta", b"gamma", b"delta"])], 13)
    exact, moved, apart = ([b"x", b"alpha", b"beta", b"gamma", b"delta"], [b"alpha", b"new", b"beta", b"gamma", b"x"], [b"alpha", *[b"x"] * 40, b"beta", *[b"x"] * 40, b"gamma"])
    found = D.match_slice([exact, moved, apart], test, near_terms=3, slop=2)
    assert [len(f[1]) for f in found] == [1, 0, 0]
    assert found[0][2] == 1 and found[2][2] == 0


def test_empty_tables_and_extra_columns(spark, awkward):
    items = spark.createDataFrame([], "item_id long, text string")
    assert all(r["n_hit"] == 0 and not r["contaminated"] for r in D.find_matches(awkward, items).collect())
    kept = D.drop_contaminated(awkward, spark.createDataFrame([(1, "quick brown fox")], "item_id long, text string"))
    assert kept.columns == awkward.columns and kept.count() == awkward.count() - 2
    assert D.find_matches(awkward.limit(0), items).count() == 0


def test_altered_copies_are_near_whatever_the_slices(spark):
    passage = [f"rare{i}" for i in range(20)]
    altered = [*passage[:6], "changed", *passage[7:13], "other", *passage[14:]]  # a word replaced in each window of 13
    docs = [(0, " ".join(["common"] * 30 + altered)), *((k, " ".join(["common", "words", f"w{k}"] * 40)) for k in range(1, 30)), (50, " ".join(passage))]
    items = spark.createDataFrame([(1, " ".join(passage)), (2, "common words common")], "item_id long, text string")
    seen = []
    for parts in (1, 4, 31):
        got = {r["doc_id"]: r for r in D.find_matches(spark.createDataFrame(docs, "doc_id long, text string").repartition(parts, "doc_id"), items).collect()}
        assert got[0]["n_near"] >= 8 and not got[0]["contaminated"] and got[0]["n_hit"] == 0 and got[50]["contaminated"]
        seen.append({k: (r["n_near"], r["n_hit"], r["items"]) for k, r in got.items()})
    assert seen[0] == seen[1] == seen[2]


def test_column_names_and_digest(spark):
    import hashlib

    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("my col", D.F.lit(1)).withColumn("a.b", D.F.lit("x")).withColumn("runs", D.F.lit(2))
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = brute(DOCS, ITEMS)
    for r, (d, n, hit, found, bad) in zip(sorted(D.digest(D.find_matches(docs, items)).collect(), key=lambda r: str((r["doc_id"], r["n_words"], r["n_hit"]))), sorted(want, key=lambda x: str(x[:3]))):
        assert (r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (d, n, hit, len(found), bad)
        assert r["items_sha256"] == hashlib.sha256(",".join(found).encode()).hexdigest()
    kept = D.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(d) for d, _, _, _, bad in want if not bad)


def test_items_with_a_null_id_hit_but_are_not_listed(spark):
    docs, items = spark.createDataFrame([(1, "x only here y")], "doc_id long, text string"), spark.createDataFrame([(None, "only here")], "item_id long, text string")
    r = D.find_matches(docs, items).first()
    assert (r["n_hit"], r["items"], r["contaminated"]) == (2, [], True)


def test_many_items_cost_what_their_terms_meet(spark):
    import random
    import time

    r = random.Random(1)
    items = [(str(k), [b"w%d" % r.randrange(3000) for _ in range(25)]) for k in range(20_000)]
    test = D.TestWindows(items, 13)
    texts = [b" ".join(b"w%d" % r.randrange(3000) for _ in range(300)) for _ in range(200)] + [b" ".join(items[7][1])]
    shard = D.Shard.of(texts, 17)
    ranked = D.Ranked.of(test, np.ones(len(test.terms), np.int64), 3, 5)
    begun = time.process_time()
    found = D.match_shard(shard, ranked, 4)
    assert found[-1][0] == [(0, 25)] and "7" in found[-1][1] and time.process_time() - begun < 30
