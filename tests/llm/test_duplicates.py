import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairfold.llm import embeddup, neardup, shingles
from pairfold.llm.components import connected_components


def test_components_of_chains_stars_and_cycles(spark):
    r = random.Random(3)
    links = [(i, i + 1) for i in range(1000, 1040)] + [(5, k) for k in range(100, 160)] + [(7, 8), (8, 7), (7, 7), (None, 3)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_long_chain_takes_few_steps(spark, monkeypatch):
    from pairfold.llm import components

    kept, written = components.stored, []
    monkeypatch.setattr(components, "stored", lambda df: written.append(1) or kept(df))
    n = 1000
    got = {x["node"]: x["component"] for x in connected_components(spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))).collect()}
    assert got == dict.fromkeys(range(n + 1), 0) and len(written) <= 15
    zigzag = [((i * 37) % 500, ((i + 1) * 37) % 500) for i in range(499)]
    written.clear()
    assert set(x["component"] for x in connected_components(spark.createDataFrame(zigzag, "a long, b long")).collect()) == {0} and len(written) <= 24


def test_shingles_match_sets_of_words():
    texts = [b"", None, b"One two", b"a b c d e f g", b"A, b; C d e f g", b"w w w w w w w w", "été der süß five words here".encode(), b"one two"]
    w = shingles.word_hashes(texts)
    h, times, heads = shingles.shingle_counts(w)
    assert w.count.tolist() == [0, 0, 2, 7, 7, 8, 6, 2]
    assert np.diff(heads).tolist() == [0, 0, 1, 3, 3, 1, 2, 1]
    assert times[heads[5]] == 4 and h[heads[3] : heads[4]].tolist() == h[heads[4] : heads[5]].tolist()
    keys = shingles.text_keys(w)
    assert keys[3].tolist() == keys[4].tolist() and keys[2].tolist() == keys[7].tolist() and keys[2].tolist() != keys[3].tolist()
    alone = shingles.shingle_counts(shingles.word_hashes([texts[6]]))
    assert alone[0].tolist() == h[heads[6] : heads[7]].tolist()


def test_hashes_do_not_depend_on_the_blocks(monkeypatch):
    texts = [b"one two  three", None, b"", b"x" * 500, b"four five " * 60, "\u00e9t\u00e9 one".encode(), b" "]
    whole = shingles.word_hashes(texts)
    for size in (7, 64, 333):
        monkeypatch.setattr(shingles, "BLOCK", size)
        part = shingles.word_hashes(texts)
        assert (part.hashes == whole.hashes).all() and (part.head == whole.head).all() and (part.count == whole.count).all()
    assert whole.hashes[0] == whole.hashes[-1] and whole.count.tolist() == [3, 0, 0, 1, 120, 2, 0]


def test_sampling_estimates_weighted_jaccard():
    rng = np.random.default_rng(5)
    h = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    x, y = rng.choice([1.0, 2.0, 3.5], 300).astype(np.float32), rng.choice([1.0, 2.0, 3.5], 300).astype(np.float32)
    want = np.minimum(x, y).sum() / np.maximum(x, y).sum()
    s = neardup.Sampler(2000, 1.0)
    a, b = s.sample(h, x, np.array([0])), s.sample(h, y, np.array([0]))
    assert (a == b).mean() == pytest.approx(want, abs=0.04)


def made_documents():
    r = random.Random(11)
    pool = [f"w{i}" for i in range(3000)]
    text = lambda n: [r.choice(pool) for _ in range(n)]
    docs, common = [], text(40)
    base = text(200)
    for k in range(60):  # one text with edits, most of them close to it only
        t = list(base)
        for _ in range(k % 4):
            t[r.randrange(200)] = r.choice(pool)
        docs.append(t)
    docs += [common + text(30) for _ in range(80)]  # a passage that many share
    docs += [docs[-1]] * 30 + [["tiny", "text"]] * 3 + [[]] * 2 + [text(50) for _ in range(40)]
    r.shuffle(docs)
    return [(i * 3 + 1, " ".join(t)) for i, t in enumerate(docs)]


def test_classes_match_brute_force(spark):
    docs = made_documents()
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    w = shingles.word_hashes([t.encode() for _, t in docs])
    h, _, heads = shingles.shingle_counts(w)
    df = np.bincount((h >> np.uint64(48)).astype(int), minlength=neardup.CELLS)
    _, weight, _ = neardup.weighted(w, 5, neardup.cell_weights(df, len(docs)))
    part = [(h[a:b].tobytes(), weight[a:b].tobytes()) for a, b in zip(heads[:-1], heads[1:])]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if neardup.jaccard(*part[i], *part[j]) >= 0.8:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    assert got == {d: docs[find(i)][0] for i, (d, _) in enumerate(docs)}


def grouped_documents():
    """One large loose group that shares bands, with close clusters of two to twelve in it."""
    r = random.Random(5)
    pool = [f"w{i}" for i in range(3000)]
    docs = []
    for k in range(70):
        t = ["x"] * 750 + [r.choice(pool) for _ in range(20)]
        for _ in range(2 if k % 10 else 12):
            u = list(t)
            u[r.randrange(755, 765)] = r.choice(pool)
            docs.append(u)
    r.shuffle(docs)
    return [(i * 3 + 1, " ".join(t)) for i, t in enumerate(docs)]


@pytest.mark.parametrize("options", [{}, {"part": 16}])
def test_every_pair_of_a_large_band_counts(spark, options):
    docs = grouped_documents()
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), bands=2, rows_a_band=2, **options).collect()}
    w = shingles.word_hashes([t.encode() for _, t in docs])
    h, _, heads = shingles.shingle_counts(w)
    idf = neardup.cell_weights(np.bincount((h >> np.uint64(48)).astype(int), minlength=neardup.CELLS), len(docs))
    _, weight, _ = neardup.weighted(w, 5, idf)
    part = [(h[a:b].tobytes(), weight[a:b].tobytes()) for a, b in zip(heads[:-1], heads[1:])]
    sig = neardup.Sampler(4, float(idf.max())).sample(h, weight, heads[:-1])
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if (sig[i] == sig[j]).reshape(2, 2).all(1).any() and ((sig[i] ^ sig[j]) & 0xFF == 0).mean() >= 0.8 - 0.2 and neardup.jaccard(*part[i], *part[j]) >= 0.8:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    assert got == {d: docs[find(i)][0] for i, (d, _) in enumerate(docs)}


def test_near_duplicates_of_awkward_rows(spark, awkward):
    got = neardup.near_duplicates(awkward).collect()
    assert len(got) == awkward.count()
    assert all(r["class_id"] == r["doc_id"] for r in got)
    assert neardup.near_duplicates(awkward.limit(0)).count() == 0
    kept = neardup.keep_first(awkward)
    assert kept.columns == awkward.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 0, 1, 2, 3, 5, 6, 7]


def vectors():
    rng = np.random.default_rng(8)
    rows, k = [], 0
    for label in (0, 1, None):
        for _ in range(40):
            x = rng.normal(size=12)
            for _ in range(rng.integers(1, 6)):
                rows.append((k, [float(v) for v in x + rng.normal(size=12) * rng.choice([0, 0.05, 0.1, 0.2])], label))
                k += 1
    rows += [(k, None, 0), (k + 1, [], 0), (k + 2, [0.0] * 12, 0), (k + 3, [1.0] * 11 + [None], 0), (k + 4, [float("nan")] * 12, 0), (k + 5, [1.0, 2.0], 0), (k + 6, [2.0, 4.0], 0), (k + 7, [1e300] * 12, 0), (k + 8, [1e-300] * 12, 0)]
    return rows


def test_links_match_brute_force(spark):
    rows = vectors()
    ok = [v is not None and len(v) > 0 and None not in v and np.isfinite(v).all() and any(v) and label is not None for _, v, label in rows]
    unit = [np.array(v) / max(map(abs, v)) / np.linalg.norm(np.array(v) / max(map(abs, v))) if o else None for o, (_, v, _) in zip(ok, rows)]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]) and unit[i] @ unit[j] >= 0.93:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("n_links", F.lit("clash"))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddup.link_vectors(df, block=16).collect()}
    want = {r[0]: (links[i], find(i)) for i, r in enumerate(rows)}
    assert sum(g[0] for g in got.values()) >= 0.99 * sum(links)
    assert all(got[k][0] <= want[k][0] for k in want) and sum(got[k] != want[k] for k in want) <= 4
    assert embeddup.link_vectors(df.limit(0)).count() == 0


def test_traversal_visits_the_nearest_cells():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    grid = embeddup.Grid(x, 5, 0.93, 0.99)
    row, cell, radius = grid.visits(x)
    d1, d2 = grid.distances(x)
    total = (d1[:, :, None] + d2[:, None, :]).reshape(60, -1)
    for i in range(60):
        assert set(cell[row == i].tolist()) == set(np.flatnonzero(total[i] <= radius[i]).tolist())
        assert (row == i).sum() >= min(grid.depth, 25)


@pytest.mark.parametrize("rank", [0, 4, 8])
def test_recall_on_a_grid_of_many_cells(spark, rank):
    """Isotropic families, and vectors of a subspace, against all pairs."""
    rng = np.random.default_rng(rank)
    n, d = 8000, 64
    if rank:
        x = rng.normal(size=(n, rank)) @ rng.normal(size=(rank, d))
    else:
        x = rng.normal(size=(n // 4, d)).repeat(4, 0)
        x += rng.normal(size=(n, d)) * rng.choice([0.15, 0.25, 0.3], (n, 1))
    x = x.astype(np.float32)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hit = u @ u.T >= 0.93
    np.fill_diagonal(hit, False)
    df = spark.createDataFrame([(k, v, 1) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<float>, label int")
    got = embeddup.link_vectors(df).toPandas().set_index("vec_id").loc[range(n)]
    assert hit.sum() > 3000 and got["n_links"].sum() >= 0.99 * hit.sum()
    assert (got["n_links"].to_numpy() <= hit.sum(1)).all()
    if not rank:
        exact = embeddup.link_vectors(df, recall=1.0).toPandas().set_index("vec_id").loc[range(n)]
        assert (exact["n_links"].to_numpy() == hit.sum(1)).all()


def test_many_lengths_and_repeated_ids(spark):
    rows = [(k, [1.0] * (1 + k % 1500), 0) for k in range(3000)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddup.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {k: (1, k % 1500) for k in range(3000)}
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.1], 0), (3, [0.1, 1.0], 0), (3, [0.1, 1.0], 0), (4, [1.0, 1.0], 0)]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embeddup.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == [(1, 2, 1), (1, 2, 1), (2, 1, 1), (3, 1, 1), (3, 1, 1), (4, 0, 4)]
