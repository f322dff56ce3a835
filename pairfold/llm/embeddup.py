"""Links and components of embeddings by cosine, over an inverted multi-index.

Unit vectors are cut in halves. Each half has a codebook of its own (k-means on a bounded sample of ``sample`` vectors, and 16
for each centroid, taken by hash), and the product of the codebooks is a grid of cells. Every vector is indexed in its cell and
is a query too: it visits cells in the order of the multi-sequence traversal, by the sum of its halves' squared distances to the
cell's centroids. How many it visits is calibrated twice, and the larger number counts: on ``probes`` vectors compared exactly
with all vectors (a pair is found from either end, so the better end of each true link is what counts), and on sample vectors
moved to exactly the threshold in random directions, which serves where true links are few. What is found is verified by
cosine in double precision. A target ``recall`` of 1 compares all vectors of a label, exactly; so do lengths of vectors of which
there are fewer than ``small``, all in one pass however many lengths there are.

Equal vectors of a label become one row with a multiplicity first (map-side combined). Index and query rows are dealt by
range of (label, cell, random number) and packed into blocks of at most ``block`` rows, so a cell of most vectors is many
blocks in many tasks; blocks of a cell are joined, and a pair of blocks is one matrix product. It hands on sums of links and
a spanning forest of its links, never the pairs. A link that only one end finds is added for the other end as well; whether
the other end finds it is recomputed from its visiting radius, so nothing counts twice.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and those with a null label,
link with nothing; vectors of different lengths do not link; rows with equal ids are one vector when they are equal, and
else one node, which has the links of all its vectors but none to itself; a null id is a row of its own with a null
component; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed_sample
from .components import connected_components, forget, stored


def unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow in the norm
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = (x.shape[1] + 1) // 2
    return x[:, :cut], x[:, cut:]


def far(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centroids."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1), 0)


def codebook(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = far(x, c).argmin(1)
        n = np.bincount(own, minlength=len(c))
        sums = np.stack([np.bincount(own, x[:, j], len(c)) for j in range(x.shape[1])], 1) if x.shape[1] else np.zeros((len(c), 0))
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


class Grid:
    """Two codebooks and the depth of the traversal."""

    def __init__(self, x: np.ndarray, k: int, threshold: float, recall: float, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.books = [codebook(h, k, rng) for h in halves(x)]
        self.k = [len(c) for c in self.books]
        self.depth = 1
        if not len(x) or max(self.k) == 1:
            return
        x = x[rng.permutation(len(x))[:4000]]
        y = rng.standard_normal(x.shape)
        y -= (y * x).sum(1, keepdims=True) * x
        y /= np.maximum(np.sqrt((y * y).sum(1, keepdims=True)), 1e-300)
        need = self.needed(x, threshold * x + np.sqrt(1 - threshold**2) * y)
        self.depth = int(np.ceil(np.quantile(need, 1 - np.sqrt(1 - recall))))

    def needed(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many cells each row of ``x`` must visit to reach the cell of that row of ``y``."""
        out = np.empty(len(x), np.int64)
        for at in range(0, len(x), 256):
            d1, d2 = self.distances(x[at : at + 256])
            i, j = (d.argmin(1) for d in self.distances(y[at : at + 256]))
            rows = np.arange(len(d1))
            far = d1[rows, i] + d2[rows, j]
            d2.sort(1)
            for r in rows:
                out[at + r] = np.searchsorted(d2[r], far[r] - d1[r] + 1e-12, side="right").sum()
        return out

    def distances(self, x: np.ndarray) -> list[np.ndarray]:
        return [far(h, c) for h, c in zip(halves(x), self.books)]

    def cells(self, x: np.ndarray) -> np.ndarray:
        i, j = (d.argmin(1) for d in self.distances(x))
        return i * self.k[1] + j

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell) of all visits, and each row's visiting radius, which lies between what is visited and what is not.

        The nearest cells of the grid have ranks (r, s) in the two sorted lists with (r + 1) * (s + 1) <= depth, so the
        traversal needs the sums of these alone; all rows of ``x`` go along together.
        """
        d1, d2 = self.distances(x)
        o1, o2 = (nearest(d, self.depth + 1) for d in (d1, d2))
        r, s = np.meshgrid(np.arange(o1.shape[1]), np.arange(o2.shape[1]), indexing="ij")
        near = (r + 1) * (s + 1) <= self.depth + 1
        r, s = r[near], s[near]
        i, j = o1[:, r], o2[:, s]
        total = np.take_along_axis(d1, i, 1) + np.take_along_axis(d2, j, 1)
        order = total.argsort(1, kind="stable")
        ranked = np.take_along_axis(total, order, 1)
        n = min(self.depth, ranked.shape[1])
        last = ranked[:, n - 1]
        after = np.where(ranked > last[:, None] + 1e-9, ranked, np.inf).min(1)
        radius = np.where(np.isfinite(after), (last + np.where(np.isfinite(after), after, 0)) / 2, last + 1)
        row, col = np.nonzero(total <= radius[:, None])
        return row, i[row, col] * self.k[1] + j[row, col], radius

    def reaches(self, x: np.ndarray, cell: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Whether each row's traversal visits the cell beside it."""
        (a, b), (c, d) = halves(x), self.books
        i, j = cell // self.k[1], cell % self.k[1]
        return ((a - c[i]) ** 2).sum(1) + ((b - d[j]) ** 2).sum(1) <= radius


def nearest(d: np.ndarray, n: int) -> np.ndarray:
    """Columns of the ``n`` least of each row, in order."""
    if n < d.shape[1]:
        some = np.argpartition(d, n - 1, axis=1)[:, :n]
        return np.take_along_axis(some, np.take_along_axis(d, some, 1).argsort(1, kind="stable"), 1)
    return d.argsort(1, kind="stable")


def forest(hit: np.ndarray, q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, other node) that connect what the matches ``hit`` (q rows, x columns) connect, at most one for each node."""
    r, c = np.nonzero(hit)
    nodes, at = np.unique(np.concatenate((q[r], x[c])), return_inverse=True)
    a, b = at[: len(r)], at[len(r) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return nodes[label != np.arange(len(nodes))], nodes[label[label != np.arange(len(nodes))]]
        label = new


def usable(labels: pa.Array, vectors: pa.Array) -> pa.Array:
    """Each vector's bytes in double precision; null for those that link with nothing."""
    lens = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.cast(vectors.flatten(), pa.float64())
    x = pc.fill_null(flat, np.nan).to_numpy(zero_copy_only=False) + 0.0  # no negative zeros
    heads = np.cumsum(lens) - lens
    some = lens > 0
    good = np.zeros(len(lens), bool)
    if some.any():
        good[some] = np.logical_and.reduceat(np.isfinite(x), heads[some]) & np.logical_or.reduceat(x != 0, heads[some])
    good &= labels.is_valid().to_numpy(zero_copy_only=False)
    raw = x.tobytes()
    return pa.array([raw[8 * a : 8 * (a + n)] if ok else None for a, n, ok in zip(heads.tolist(), lens.tolist(), good.tolist())], pa.binary())


def link_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, recall: float = 0.995, sample: int = 4000, block: int = 512, probes: int = 512, small: int = 4096, cell: int = 512) -> DataFrame:
    """vec_id, n_links and component_id for each row of ``df``; ids are whole numbers. A cell of the grid holds about ``cell`` vectors."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("v"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), usable(b.column(1), b.column(2))], names=["vec_id", "label", "v"])

    held = stored(rows.mapInArrow(check, "vec_id long, label string, v binary").withColumn("key", F.when(F.col("v").isNotNull(), F.md5("v"))))
    good = held.where("v is not null and vec_id is not null").withColumn("label", F.concat_ws(":", F.octet_length("v"), "label"))
    copies = stored(good.select("vec_id", "label", "key", "v").distinct().groupBy("label", "key").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("n"), F.min("v").alias("v")).withColumn("size", F.octet_length("v")))
    sizes = stored(copies.groupBy("size").agg(F.count(F.lit(1)).alias("count")))
    large = [] if recall >= 1 else [(r["size"], r["count"]) for r in sizes.where(F.col("count") >= small).toLocalIterator()]  # each worth a grid of its own
    found = _link(copies.join(sizes.where(F.col("count") < small).select("size"), "size") if large else copies, 1, threshold, 1.0, sample, block, 0)
    for size, count in large:
        found = found.unionByName(_link(copies.where(F.col("size") == size), int(np.clip(np.sqrt(count / cell), 1, 8192)), threshold, recall, sample, block, probes))
    out = held.withColumn("full", F.concat_ws(":", F.octet_length("v"), "label")).select("vec_id", F.when(F.col("v").isNotNull(), F.col("full")).alias("label"), "key")
    found = stored(found)
    sums = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    member = connected_components(found.where("b is not null").select("a", "b"))
    each = copies.select("label", "key", "node", "n").join(sums, "node", "left").join(member, "node", "left")
    each = stored(each.select("label", "key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "node").alias("component")))
    forget(found, copies)
    return out.join(each, ["label", "key"], "left").select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))


def calibrated(copies: DataFrame, picked, grid: Grid, threshold: float, recall: float, hits: int = 2000) -> int:
    """The depth at which ``recall`` of the true links of the picked vectors are found, from the end that needs less.

    The picked vectors are compared exactly with all vectors. Of a slice's links at most ``hits``, evenly spaced, are measured; depths
    are counted in steps of a quarter of a doubling, a fixed number.
    """
    probe = unit(list(picked["v"]))
    shared = copies.sparkSession.sparkContext.broadcast((probe, picked["label"].to_numpy(str), picked["node"].to_numpy(np.int64), grid))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe, labels, nodes, grid = shared.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 2048):
                b = whole.slice(lo, 2048)
                x = unit(b.column(2).to_pylist())
                hit = (probe @ x.T >= threshold) & (labels[:, None] == b.column(0).to_numpy(zero_copy_only=False).astype(str)) & (nodes[:, None] != b.column(1).to_numpy())
                q, at = np.nonzero(hit)
                if len(q) > hits:
                    some = np.linspace(0, len(q) - 1, hits).astype(int)
                    q, at = q[some], at[some]
                if len(q):
                    need = np.minimum(grid.needed(probe[q], x[at]), grid.needed(x[at], probe[q]))
                    step, n = np.unique(np.ceil(4 * np.log2(need)).astype(np.int32), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(step), pa.array(n)], names=["step", "n"])

    got = copies.select("label", "node", "v").mapInArrow(run, "step int, n long").groupBy("step").agg(F.sum("n").alias("n")).toPandas().sort_values("step")
    if not len(got):
        return 1
    enough = int(np.searchsorted(got["n"].cumsum().to_numpy(), recall * got["n"].sum()))
    return int(np.floor(2 ** (got["step"].to_numpy()[min(enough, len(got) - 1)] / 4) + 1e-9))


def _link(copies: DataFrame, k: int, threshold: float, recall: float, sample: int, block: int, probes: int) -> DataFrame:
    """Links between vectors (of one length, if ``k`` is more than 1): sums (a, n) and forest links (a, b)."""
    spark = copies.sparkSession
    if k > 1:
        picked = hashed_sample(copies.select("label", "node", "v", "key"), ["key", "label"], max(sample, 16 * k)).toPandas()  # a bounded sample
        made = Grid(unit(list(picked["v"])), k, threshold, recall)
        made.depth = max(made.depth, calibrated(copies, picked.iloc[:probes], made, threshold, recall))
    else:
        made = None
    grid = spark.sparkContext.broadcast(made)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Index rows, and a query row for each visit."""
        names = ["label", "query", "cell", "own", "node", "n", "radius", "v"]
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                b = whole.slice(lo, 512)
                if grid.value is None:  # one cell
                    own = np.zeros(b.num_rows, np.int64)
                    row, cell, radius = np.arange(b.num_rows), own, own + 1.0
                else:
                    x = unit(b.column(3).to_pylist())
                    own = grid.value.cells(x)
                    row, cell, radius = grid.value.visits(x)
                for q, r, c in ((False, np.arange(b.num_rows), own), (True, row, cell)):
                    at = pa.array(r)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array(np.full(len(r), q)), pa.array(c), pa.array(own[r]), b.column(1).take(at), b.column(2).take(at), pa.array(radius[r]), b.column(3).take(at)], names=names)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of a cell as blocks."""
        def out(label, query, cell, got):
            own, node, n, radius, v = zip(*got)
            return pa.RecordBatch.from_arrays([pa.array([label]), pa.array([query]), pa.array([cell]), pa.array([np.array(own, np.int64).tobytes()]), pa.array([np.array(node, np.int64).tobytes()]), pa.array([np.array(n, np.int64).tobytes()]), pa.array([np.array(radius).tobytes()]), pa.array([b"".join(v)])], names=["label", "query", "cell", "own", "node", "n", "radius", "v"])

        now, got = None, []
        for b in batches:
            for label, query, cell, *rest in zip(*(b.column(i).to_pylist() for i in range(8))):
                if (label, query, cell) != now or len(got) == block:
                    if got:
                        yield out(*now, got)
                    now, got = (label, query, cell), []
                got.append(rest)
        if got:
            yield out(*now, got)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(b.num_columns))):
                q_own, q, q_n, _, qv, _, x, x_n, x_radius, xv = row
                q, x, q_n, x_n, q_own = (np.frombuffer(i, np.int64) for i in (q, x, q_n, x_n, q_own))
                x_radius = np.frombuffer(x_radius, np.float64)
                a = unit([qv[i : i + len(qv) // len(q)] for i in range(0, len(qv), len(qv) // len(q))])
                c = unit([xv[i : i + len(xv) // len(x)] for i in range(0, len(xv), len(xv) // len(x))])
                hit = (a @ c.T >= threshold) & (q[:, None] != x)  # vectors of a label have one length
                if not hit.any():
                    continue
                i, j = np.nonzero(hit)
                alone = np.ones(len(i), bool)
                for lo in range(0, len(i), 1 << 14):
                    part = slice(lo, lo + (1 << 14))
                    alone[part] = False if grid.value is None else ~grid.value.reaches(c[j[part]], q_own[i[part]], x_radius[j[part]])
                from_q, from_x = np.bincount(i, x_n[j], len(q)).astype(np.int64), np.bincount(j[alone], q_n[i[alone]], len(x)).astype(np.int64)
                n, m = np.flatnonzero(from_q), np.flatnonzero(from_x)
                up, to = forest(hit, q, x)
                none = np.ones(len(n) + len(m), bool)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((q[n], x[m], up))), pa.array(np.concatenate((np.zeros(len(none), np.int64), to)), mask=np.concatenate((none, np.zeros(len(up), bool)))), pa.array(np.concatenate((from_q[n], from_x[m], np.zeros(len(up), np.int64))))], names=["a", "b", "n"])

    fields = "label string, query boolean, cell long, own {0}, node {0}, n {0}, radius {1}, v binary"
    placed = stored(copies.select("label", "node", "n", "v").mapInArrow(place, fields.format("long", "double")).withColumn("salt", F.xxhash64("node", "cell")))
    dealt = placed.repartitionByRange("label", "query", "cell", "salt").sortWithinPartitions("label", "query", "cell", "salt").drop("salt")
    blocks = stored(dealt.mapInArrow(pack, fields.format("binary", "binary")))
    cols = ("own", "node", "n", "radius", "v")
    ask, index = (blocks.where(F.col("query") == x).select("label", "cell", *(F.col(c).alias(f"{p}_{c}") for c in cols)) for p, x in (("q", True), ("x", False)))
    return ask.join(index, ["label", "cell"]).select(*(f"{p}_{c}" for p in "qx" for c in cols)).mapInArrow(verify, "a long, b long, n long")
