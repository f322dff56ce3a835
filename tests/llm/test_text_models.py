import numpy as np
import pytest
from pyspark.sql import functions as F

from pairfold.llm import attention, langid, lm, quality, tokencount
from pairfold.llm.queries import QUERIES


def test_language_id(spark, awkward, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = QUERIES["op8_language_id"](spark, folder).join(docs.select("doc_id", "lang"), "doc_id")
    held = found.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert held[0] > 0.95 and 0 <= held[1] and held[2] <= 1
    model = langid.fit(awkward)
    got = langid.identify(awkward, model).collect()
    assert len(got) == awkward.count()
    for r, t in zip(got, [x["text"] for x in awkward.collect()]):
        if not any(c.isalpha() for c in t or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] in ("de", "en", "fr")
    none = langid.fit(awkward.limit(0))
    assert {r["lang_pred"] for r in langid.identify(awkward, none).collect()} == {"und"}
    assert langid.identify(awkward.limit(0), model).count() == 0


def test_language_scores_are_those_of_a_plain_sum():
    model = {"names": ["a", "b"], "buckets": 1 << 10, "prior": np.log([0.5, 0.5]), "logp": np.log(np.random.default_rng(0).dirichlet(np.ones(1 << 10), 2).T)}
    texts = ["Hello there", "x", "words of one text do not change others"]
    each = [langid.predict_texts(model, [t])[1][0] for t in texts]
    assert langid.predict_texts(model, texts)[1] == pytest.approx(each)
    grams, _, letter = langid.hashed_ngrams(["ab"], 1 << 10)
    logit = model["prior"] + sum(model["logp"][g] for g in grams[letter].ravel())
    assert langid.predict_texts(model, ["ab"])[1][0] == pytest.approx(np.exp(logit - np.logaddexp(*logit)).max())


def test_quality_marginals_match_enumeration():
    rng = np.random.default_rng(2)
    for n in (1, 2, 5):
        e, trans = rng.normal(size=n), rng.normal(size=(2, 2))
        weight = {}
        for bits in range(2**n):
            y = [(bits >> i) & 1 for i in range(n)]
            weight[tuple(y)] = np.exp(sum(e[i] * y[i] for i in range(n)) + sum(trans[a, b] for a, b in zip(y, y[1:])))
        total = sum(weight.values())
        want = [sum(w for y, w in weight.items() if y[i]) / total for i in range(n)]
        good, pairs, z = quality.marginals(e, trans, np.array([0]), np.array([n]))
        assert good == pytest.approx(want) and z[0] == pytest.approx(np.log(total))
        assert pairs.sum() == pytest.approx(n - 1)
    both, _, _ = quality.marginals(np.array([0.3, -1, 2, 0.5]), trans, np.array([0, 1]), np.array([1, 3]))
    one, _, _ = quality.marginals(np.array([-1, 2, 0.5]), trans, np.array([0]), np.array([3]))
    assert both[1:] == pytest.approx(one)


def test_quality(spark, awkward, folder):
    found = QUERIES["op7_quality"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").toPandas()
    good, bad = (found[found.quality == k].score.to_numpy() for k in (1, 0))
    assert (good[:, None] > bad).mean() > 0.95 and (found.predicted == (found.score >= 0.5)).all()
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.limit(0)):
        model = quality.fit(awkward, some)
        got = quality.score(awkward, model).collect()
        assert len(got) == awkward.count() and all(0 <= r["score"] <= 1 for r in got)
    assert quality.keep_good(awkward, model).columns == awkward.columns
    assert quality.score(awkward.limit(0), model).count() == 0


def test_token_counts_are_the_librarys(spark, awkward, folder):
    from tokenizers import Tokenizer, models, pre_tokenizers

    for vocabulary in (tokencount.zipf_vocabulary(), [("<unk>", 0.0), *((f"<0x{b:02X}>", -9.0) for b in range(256)), ("▁", -2.0), ("a", -1.0), ("aa", -2.0), ("aaa", -3.0), ("b", -1.5), ("▁a", -3.0), ("ab", -2.5)]):
        lib = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
        lib.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
        texts = ["", " ", "a", " a", "aaaa ab  ba", "▁x", "tabs\tand\nlines", "日本 \U0001f600\U0001f600z", "<s><0x0A>", *(r[0] for r in spark.read.parquet(f"{folder}/documents.parquet").select("text").limit(60).collect())]
        counter = tokencount.Counter(vocabulary)
        assert [counter.text(t) for t in texts] == [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]
    got = tokencount.count_tokens(awkward, vocabulary).collect()
    assert [r["n_tokens"] for r in got] == [counter.text(r["text"]) for r in awkward.collect()]
    assert tokencount.count_tokens(awkward.limit(0), vocabulary).count() == 0


def test_attention_gradients_windows_and_mask():
    shape, rng = attention.Shape(4, 4, 8, 12, 8, 2), np.random.default_rng(1)
    model = attention.Model.fresh(shape, rng.random(16) + 0.1)
    cls, count = rng.integers(0, 16, 200), np.array([1, 2, 7, 8, 9, 73, 100])
    x, y, use, at = attention.cut_windows(cls, count, shape)
    assert sorted(at[use].tolist()) == list(range(200))  # each token once
    loss, grads = model.gradients(x, y, use)
    assert loss == pytest.approx(-attention.score_texts(model, cls, count).mean() * np.log(10), rel=1e-4)
    for k, g in grads.items():
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, sides = model.p[k][i], []
        for e in (0.01, -0.01):
            model.p[k][i] = old + e
            sides.append(model.gradients(x, y, use)[0])
        model.p[k][i] = old
        assert (sides[0] - sides[1]) / 0.02 == pytest.approx(g[i], rel=0.1, abs=2e-4)
    later = cls.copy()
    later[150:] = (later[150:] + 1) % 16  # the future changes nothing
    assert attention.score_texts(model, later, count)[:150] == pytest.approx(attention.score_texts(model, cls, count)[:150], abs=1e-5)
    total = sum(10 ** attention.score_texts(model, np.array([3, k]), np.array([2]))[1] for k in range(16))
    assert total == pytest.approx(1, abs=1e-4)


def test_lm_scores(spark, awkward, folder):
    import math
    import zlib
    from collections import Counter

    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    counts, docs = Counter(), 0
    for r in rows:
        if zlib.crc32(str(r[0]).encode()) % 7 != 2:
            counts.update(r[1].encode().lower().split())
            docs += 1
    n, v = sum(counts.values()) + docs, len(counts) + 1
    got = {r["doc_id"]: r for r in QUERIES["op2_lm_scores"](spark, folder).collect()}
    for r in rows:
        w, g = r[1].encode().lower().split(), got[r[0]]
        base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w) + math.log10((docs + 1) / (n + v + 1))
        assert (g["n_tokens"], g["n_known"], g["train_tokens"]) == (len(w) + 1, sum(counts[x] > 0 for x in w) + 1, n)
        assert g["base_score"] == pytest.approx(base) and g["score"] < 0
    some = awkward.select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("text"))
    for train in (F.lit(True), F.lit(False)):
        found = lm.score(some, lm.fit(some, train, sample=5, rounds=1)).collect()
        assert len(found) == awkward.count() and all(np.isfinite(r["score"]) for r in found)
        assert {r["n_tokens"] for r in found if r["doc_id"] in (2, 3)} == {1}


def test_every_training_document_reaches_the_attention_model(spark):
    texts = [(k, " ".join(f"word{(k * 7 + j * j) % 50}" for j in range(30))) for k in range(12)]
    ids = spark.createDataFrame(texts, "id long, text string").withColumn("h", F.xxhash64("id"))
    sampled = {r["id"] for r in ids.orderBy("h", "id").limit(1).collect()}
    far = next(r["id"] for r in ids.orderBy("id").collect() if r["id"] not in sampled and r["h"] % 64)
    turned = [(k, " ".join(reversed(t.split())) if k == far else t) for k, t in texts]  # all word counts stay
    one, two = (lm.fit(spark.createDataFrame(x, "id long, text string").select("id", F.col("text").cast("binary").alias("text")).coalesce(1), F.lit(True), sample=1, rounds=1)["model"].p for x in (texts, turned))
    assert max(np.abs(one[k] - two[k]).max() for k in one) > 1e-5


def test_every_token_and_pair_of_the_training_texts_is_learned_from(spark):
    words = [f"word{(j * j) % 47}" for j in range(3000)]

    def fitted(words):
        rows = spark.createDataFrame([(1, " ".join(words)), (2, "word1 word2"), (3, "word1 word2")], "id long, text string")
        return lm.fit(rows.select("id", F.col("text").cast("binary").alias("text")).coalesce(1), F.lit(True), sample=0)

    one = fitted(words)
    texts = [np.frombuffer(r["classes"], np.int16) for r in one["encoded"].select("classes").collect()]
    flat, count = np.concatenate(texts), np.array([len(t) for t in texts])
    want = attention.Contexts.frequent(1024, flat, count, 7000)
    assert len(want.pairs) and one["contexts"].pairs.tolist() == want.pairs.tolist()
    n = np.zeros((want.rows, 1024), np.int64)
    np.add.at(n, (want.codes(flat, count), flat), 1)
    assert np.array_equal(one["table"], want.shares(n))
    for k in (700, 2900):
        turned = [*words[:k], words[k + 1], words[k], *words[k + 2 :]]  # all word counts stay
        two = fitted(turned)["model"].p
        assert turned != words and max(np.abs(one["model"].p[i] - two[i]).max() for i in two) > 1e-6


def test_segments_have_the_windows_of_whole_texts_and_weights_are_copies():
    shape, rng = attention.Shape(4, 4, 8, 12, 8, 4), np.random.default_rng(4)
    cls, count = rng.integers(0, 16, 200).astype(np.int16), np.array([1, 2, 12, 13, 72, 100])
    x, y, use, _ = attention.cut_windows(cls, count, shape)
    parts = [p for t in np.split(cls, np.cumsum(count)[:-1]) for p in attention.segments(t.tobytes(), shape, cls.dtype, 12)]
    laid, lens = np.frombuffer(b"".join(parts), np.int16), np.array([len(p) // 2 for p in parts])
    gx, gy, guse, own = attention.segment_windows(laid, lens, shape)
    assert np.array_equal(guse, use) and np.array_equal(gy[guse], y[use]) and len(own) == len(x)
    for i in range(len(x)):
        last = np.flatnonzero(use[i]).max()
        assert gx[i, : last + 1].tolist() == x[i, : last + 1].tolist()
    contexts = attention.Contexts.frequent(16, cls, count, 20)
    assert contexts.cells(laid, lens, shape.overlap + 1).tolist() == (contexts.codes(cls, count) * 16 + cls).tolist()
    model, weight = attention.Model.fresh(shape, rng.random(16) + 0.1), rng.integers(1, 4, len(x))
    again = np.repeat(np.arange(len(x)), weight)
    (loss, g), (same, want) = model.gradients(x, y, use, weight), model.gradients(x[again], y[again], use[again])
    assert loss == pytest.approx(same, rel=1e-5) and all(g[k] == pytest.approx(want[k], abs=1e-5) for k in want)


def test_windows_that_follow_each_other_are_trained_on_together_and_once():
    shape, rng = attention.Shape(4, 4, 8, 12, 8, 4), np.random.default_rng(6)
    cls, count = rng.integers(0, 16, 300), np.array([90, 3, 207])
    x, y, use, _ = attention.cut_windows(cls, count, shape)
    model, weight = attention.Model.fresh(shape, rng.random(16) + 0.1), rng.integers(1, 4, len(x))
    each = [model.gradients(x[i : i + 1], y[i : i + 1], use[i : i + 1], weight[i : i + 1]) for i in range(len(x))]
    share = weight * use.sum(1) / (weight * use.sum(1)).sum()
    for order in (np.arange(len(x)), rng.permutation(len(x))):  # in runs, and apart
        loss, g = model.gradients(x[order], y[order], use[order], weight[order])
        assert loss == pytest.approx(sum(w * one for w, (one, _) in zip(share, each)), rel=1e-5)
        assert all(g[k] == pytest.approx(sum(w * one[k] for w, (_, one) in zip(share, each)), abs=1e-5) for k in g)
    met, take = [], model.gradients
    model.gradients = lambda x, y, use, weight: (met.append(weight.tolist()), take(x, y, use, weight))[1]
    attention.train(model, x, y, use, 0.01, batch=8, weight=np.arange(len(x)), run=4)
    flat = sum(met, [])
    assert sorted(flat) == list(range(len(x))) and sum(b == a + 1 for a, b in zip(flat, flat[1:])) >= len(x) // 4 * 3 and flat != sorted(flat)


def test_scores_do_not_depend_on_the_partitions(spark, folder):
    rows = spark.read.parquet(f"{folder}/documents.parquet").select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("text"))
    found = []
    for n in (1, 5):
        dealt = rows.repartition(n, "text")
        found.append({r["doc_id"]: r["score"] for r in lm.score(dealt, lm.fit(dealt, F.col("id") % 7 != 2, sample=60, shard=50, rounds=1)).collect()})
    assert found[0].keys() == found[1].keys()
    assert max(abs(found[0][k] - v) / max(abs(v), 1) for k, v in found[1].items()) < 1e-6


def test_held_out_scores_beat_the_base(spark):
    got = QUERIES["op2_lm_scores"](spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score") / F.sum("n_tokens"), F.sum("base_score") / F.sum("n_tokens")).first()
    assert got[0] > got[1] + 0.02


def test_context_tables_are_proper():
    rng = np.random.default_rng(3)
    flat, count = rng.integers(0, 12, 500), np.array([100, 0, 1, 399])
    contexts = attention.Contexts.frequent(12, flat, count, 20)
    codes = contexts.codes(flat, count)
    n = np.zeros((contexts.rows, 12))
    np.add.at(n, (codes, flat), 1)
    assert contexts.shares(n).sum(1) == pytest.approx(1, abs=1e-5) and n.sum() == 500
    for i in range(2, 100):
        key = flat[i - 2] * 13 + flat[i - 1]
        at = np.flatnonzero(contexts.pairs == key)
        assert codes[i] == (13 + at[0] if len(at) else flat[i - 1])
    assert codes[0] in (12, *range(13, contexts.rows))


def test_words_encoded_together_have_their_own_ids(folder):
    import pyarrow.parquet as pq

    texts = [t.encode() for t in pq.read_table(f"{folder}/documents.parquet", columns=["text"]).column(0).to_pylist()]
    coder = lm.Encoder(*lm.public_vocabulary(), cache=500)
    words = sorted({w for t in texts for w in lm.words_of(t)}) + [b"don't", b"\xff\xfe", "\u00e9t\u00e9".encode(), "\u65e5\u672c".encode(), b"1234567", b"!!!", "\U0001f600".encode(), b"a'll'"]
    for some in (words, [*words, "a\u00a0b".encode(), "x\u3000".encode(), b"\x01y"]):
        ids, heads = coder.encode_all(some)
        assert [x.tolist() for x in np.split(ids, heads[1:])] == [coder.encode(w) for w in some]
    for _ in range(2):
        for t in texts[:50]:
            number, count, ids, n, _ = coder.slice([t, None])
            want = [i for w in lm.words_of(t) for i in coder.encode(w)] + [coder.end]
            assert ids.tolist() == [*want, coder.end] and count.tolist() == [len(lm.words_of(t)) + 1, 1] and n.tolist() == [len(want), 1]


def test_long_segments_of_tokens():
    counter = tokencount.Counter([("a", -1.0), ("aa", -1.5), ("aaaaa", -2.0), ("▁", -3.0)])
    assert counter.segment("a" * 500_000) == 100_000 and counter.segment("ba" * 3) == 6
    assert tokencount.Counter([]).segment("xé") == 3


def test_repeated_and_long_labelled_texts(spark):
    docs = spark.createDataFrame([(1, "a good text."), (1, "b other"), (1, None), (2, "### $$"), (3, "x" * 200_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, quality int")
    one = quality.fit(docs, labels)
    two = quality.fit(spark.createDataFrame([(1, ""), (2, "### $$")], "doc_id long, text string"), labels)
    assert np.allclose(one["w"], two["w"])


def test_too_many_languages_are_refused(spark, monkeypatch):
    monkeypatch.setattr(langid, "MODEL_BYTES", 8 * (1 << 15) * 3)
    docs = spark.createDataFrame([(f"text {k}", f"l{k}") for k in range(5)], "text string, lang string")
    with pytest.raises(ValueError, match="labels"):
        langid.fit(docs)
    assert len(langid.fit(docs.limit(3))["names"]) == 3
