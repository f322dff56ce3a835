"""Near-duplicate classes by improved consistent weighted sampling.

A document is a weighted set: its five-word shingles, each weighing term frequency x inverse document frequency. Document
frequencies cover all documents; they are kept in 65,536 hashed cells, a fixed size. A cell's frequency counts as at
least a 16,384th of all shingles, four times what a cell holds on average, so that shingles that share a cell by chance
all weigh alike and only frequent passages weigh less; this rule does not depend on the size of the corpus.

1. One pass sums the cells' document frequencies.
2. One pass gives each document a hash of its words and ``bands * rows`` samples. Copies with equal words become one
   representative, by a map-side combined minimum.
3. Representatives are dealt by range of (band key, hashed id), so that even one band key of most rows is spread over
   many tasks. Within the parts of a band that a task holds, similarities are estimated from the samples' low bytes, and each
   document gives candidate pairs with its nearest and with the part's centre, a number that does not grow with the part;
   documents of one class are joined through these.
4. Candidates are verified by exact weighted Jaccard similarity, and components of verified links are the first classes.
5. Bands that step 3 did not compare pair by pair (of more documents than it takes neighbours, or cut by a border between
   tasks) and that hold several classes are compared whole: every pair of different classes that is estimated at ``loose``
   or more is verified. Bands are cut into blocks of bounded size, in order of class, and each block meets each other one of
   its band, except where both hold one and the same class. Components of all verified links are the classes.

The chance that two documents of similarity 0.8 share none of 16 bands of 4 is 0.0002.

Defined results: null and empty texts, and texts without words, are each a class of their own; a text of fewer than five
words is one shingle; rows with equal ids count as one document; a null id has a null class unless it copies another
document, and never represents one; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FILTER_BITS, bit_set, in_bits, marked_bits, text_slices, without
from .components import connected_components, forget, stored
from .shingles import Words, shingle_counts, text_keys, word_hashes

CELLS, SHARE = 1 << 16, 1 << 14
TABLE = 1 << 16
#: Orders in which bands are dealt; bands of one order find the same leaders, so their pairs are the same.
TURNS = 4
LOW = np.uint64(0xFFFFFFFF)


class Sampler:
    """Improved consistent weighted sampling with the random draws (r, c, beta) taken from a table by hash."""

    def __init__(self, samples: int, usual: float, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.r = rng.gamma(2.0, 1.0, TABLE).astype(np.float32)
        self.c = np.log(rng.gamma(2.0, 1.0, TABLE)).astype(np.float32)
        self.b = rng.random(TABLE, np.float32)
        self.seed = rng.integers(1, 1 << 63, samples, dtype=np.uint64)
        self.odd = rng.integers(1, 1 << 63, samples, dtype=np.uint64) | np.uint64(1)
        self.usual = np.float32(usual)  # the weight of most shingles, tabulated
        self.table = self.draw(np.arange(TABLE), np.float32(np.log(self.usual)))

    def draw(self, at: np.ndarray, log_weight: np.ndarray | np.float32) -> np.ndarray:
        """The sampling order (high 32 bits) and the level (mixed into the low bits) for draws ``at``."""
        t = np.floor(log_weight / self.r[at] + self.b[at])
        order = (self.c[at] - self.r[at] * (t + np.float32(1) - self.b[at])).view(np.int32)
        order = np.where(order < 0, ~order.view(np.uint32), order.view(np.uint32) | np.uint32(0x80000000))
        return (order.astype(np.uint64) << np.uint64(32)) | ((t.astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B1)) & LOW)

    def sample(self, h: np.ndarray, w: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """A 32-bit sample for each set (columns: the draws); ``heads`` are the starts of non-empty sets."""
        out = np.zeros((len(heads), len(self.seed)), np.uint32)
        odd = np.flatnonzero(w != self.usual)
        log_odd = np.log(w[odd])
        for k, (seed, mul) in enumerate(zip(self.seed, self.odd)):
            m = (h ^ seed) * mul
            at = (m >> np.uint64(48)).astype(np.int64)
            key = self.table[at]
            if len(odd):
                key[odd] = self.draw(at[odd], log_odd)
            key ^= m & LOW
            out[:, k] = np.minimum.reduceat(key, heads) & LOW
        return out


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Words]]:
    for b in text_slices(batches, 1, 1 << 20):
        yield b, word_hashes(b.column(1).to_pylist())


def cell_frequencies(rows: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """Document frequency of each hashed cell, and the number of documents; cell -1 counts these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, docs = np.zeros(CELLS, np.int64), 0
        for b, w in slices(batches):
            h, _, _ = shingle_counts(w, size)
            sums += np.bincount((h >> np.uint64(48)).astype(np.int64), minlength=CELLS)
            docs += b.num_rows
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(sums[at], docs), pa.int64())], names=["cell", "n"])

    got = rows.mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # at most CELLS + 1 rows
    df = np.zeros(CELLS + 1, np.int64)
    df[got["cell"].to_numpy(int)] = got["n"].to_numpy(int)
    return df[:CELLS], int(df[CELLS])


def cell_weights(df: np.ndarray, docs: int) -> np.ndarray:
    floor = max(1.0, df.sum() / SHARE)
    return np.log1p(docs / np.maximum(df, floor)).astype(np.float32) if docs else np.ones(CELLS, np.float32)


def weighted(w: Words, size: int, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h, times, heads = shingle_counts(w, size)
    return h, (times * idf[(h >> np.uint64(48)).astype(np.int64)]).astype(np.float32), heads


def band_pairs(band: np.ndarray, doc: list, low: np.ndarray, loose: float, nearest: int = 8, part: int = 4096) -> tuple[list, list]:
    """Candidate pairs within runs of equal ``band``, taken in parts of at most ``part`` documents.

    Similarities within a part are estimated from the samples' low bytes. Each document gives a pair with its ``nearest``
    others, with the next one, and with the part's centre (the document that the others are most similar to), as far as they
    are estimated at ``loose`` or more. So pairs grow with the documents, not with their square: copies of one text meet
    at the centre, and chains of edits are followed from neighbour to neighbour.
    """
    left, right = [], []
    cut = np.flatnonzero(np.concatenate(([True], band[1:] != band[:-1], [True]))) if len(band) else np.zeros(1, int)
    sizes = np.diff(cut)
    two = cut[:-1][sizes == 2]
    ok = (low[two] == low[two + 1]).mean(1) >= loose
    left += [doc[i] for i in two[ok].tolist()]
    right += [doc[i + 1] for i in two[ok].tolist()]
    for first, end in zip(cut[:-1][sizes > 2].tolist(), cut[1:][sizes > 2].tolist()):
        for lo in range(first, end, part):
            x = low[lo : min(end, lo + part)]
            n = len(x)
            near = np.empty((n, n), np.uint16)  # equal samples
            step = max(1, (4 << 20) // (n * x.shape[1]))
            for i in range(0, n, step):
                near[i : i + step] = (x[i : i + step, None, :] == x).sum(2, dtype=np.uint16)
            np.fill_diagonal(near, 0)
            near[near < loose * x.shape[1]] = 0
            centre = int(near.sum(1, dtype=np.int64).argmax())
            some = np.concatenate([np.argpartition(x.shape[1] - near[i : i + 256], min(nearest, n - 1), axis=1)[:, :nearest] for i in range(0, n, 256)])
            i = np.repeat(np.arange(n), some.shape[1])
            pairs = np.concatenate((np.stack((i, some.ravel()), 1), np.stack((np.arange(n), np.full(n, centre)), 1), np.stack((np.arange(n - 1), np.arange(1, n)), 1)))
            pairs = np.unique(np.sort(pairs[near[pairs[:, 0], pairs[:, 1]] > 0], 1), axis=0) + lo
            left += [doc[k] for k in pairs[:, 0].tolist()]
            right += [doc[k] for k in pairs[:, 1].tolist()]
    return left, right


def joining_links(doc: list, label: np.ndarray, number: np.ndarray, sig: np.ndarray, h: list, w: list, rows_a_band: int, loose: float, similarity: float, split: int = 0) -> tuple[list, list]:
    """Verified links that join different classes (``label``) in a block, or between its rows before ``split`` and the others.

    Every pair of different classes that is estimated at ``loose`` or more is verified, in the first of the bands that it shares,
    unless links found before have joined its classes.
    """
    left, right, label, low = [], [], label.copy(), sig.astype(np.uint8)
    for i in range(split or len(doc)):
        start = split or i + 1
        others = np.flatnonzero(label[start:] != label[i]) + start
        near = (low[others] == low[i]).mean(1)
        others, near = others[near >= loose], near[near >= loose]
        k = int(number[i])
        before = (sig[others, : k * rows_a_band] == sig[i, : k * rows_a_band]).reshape(len(others), k, rows_a_band).all(2).any(1)
        others, near = others[~before], near[~before]
        for j in others[np.argsort(-near, kind="stable")].tolist():
            if label[j] != label[i] and jaccard(h[i], w[i], h[j], w[j]) >= similarity:
                left.append(doc[i])
                right.append(doc[j])
                label[label == label[j]] = label[i]
    return left, right


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8, bands: int = 16, rows_a_band: int = 4, nearest: int = 8, part: int = 4096, margin: float = 0.2) -> DataFrame:
    """doc_id and class_id (the smallest id of the class), for each row of ``df``.

    Pairs are verified that are estimated at ``similarity`` less ``margin`` or more; with a margin of ``similarity``, every pair of
    different classes that shares a band is verified, whatever its estimate.
    """
    spark, samples, loose = df.sparkSession, bands * rows_a_band, max(similarity - margin, 1e-6)
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    idf = cell_weights(*cell_frequencies(rows, size))
    shared = spark.sparkContext.broadcast((idf, Sampler(samples, float(idf.max()))))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, sampler = shared.value
        for b, w in slices(batches):
            h, weight, heads = weighted(w, size, idf)
            some = np.flatnonzero(w.count > 0)
            sig = np.zeros((b.num_rows, samples), np.uint32)
            if len(some):
                sig[some] = sampler.sample(h, weight, heads[:-1][some])
            keys = text_keys(w).view(np.int64)
            none = w.count == 0
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys[:, 0], mask=none), pa.array(keys[:, 1], mask=none), pa.array([x.tobytes() for x in sig], pa.binary())], names=["doc_id", "k1", "k2", "sig"])

    signed = stored(rows.mapInArrow(sign, f"doc_id {kind}, k1 long, k2 long, sig binary"))
    copies = signed.where("k1 is not null and doc_id is not null").groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "sig")).alias("x"))
    repeated_ids = signed.agg((F.count("doc_id") > F.count_distinct("doc_id")).alias("x")).first()["x"]
    firsts = stored(copies.select("k1", "k2", F.col("x.doc_id").alias("doc_id"), F.col("x.sig").alias("sig")))

    def keyed(b: pa.RecordBatch) -> tuple[int, np.ndarray, np.ndarray]:
        n = b.num_rows
        sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(n, samples)
        keys = np.zeros((n, bands), np.uint64)
        for k in range(bands):
            for j in range(rows_a_band):
                keys[:, k] = (keys[:, k] ^ sig[:, k * rows_a_band + j]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k + 1)
                keys[:, k] ^= keys[:, k] >> np.uint64(29)
        return n, sig, keys

    def band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, sig, keys = keyed(b)
            low = [x.tobytes() for x in (sig & 0xFF).astype(np.uint8)]
            each = pa.array(np.repeat(np.arange(n), bands))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64).ravel()), b.column(0).take(each), pa.array(low, pa.binary()).take(each), pa.array(np.tile(np.arange(bands, dtype=np.int32) % TURNS, n))], names=["band", "doc_id", "low", "turn"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)  # one partition, whose size the dealing by range bounds
        if not sum(b.num_rows for b in parts):
            return
        table = pa.Table.from_batches(parts)
        low = np.frombuffer(b"".join(table.column("low").to_pylist()), np.uint8).reshape(table.num_rows, samples)
        band, known = table.column("band").to_numpy(), table.schema.field("doc_id").type
        a, b = band_pairs(band, table.column("doc_id").to_pylist(), low, loose, nearest, part)
        keys, sizes = np.unique(band, return_counts=True)
        unfinished = keys[(sizes > nearest + 1) | (sizes > part) | (keys == band[0]) | (keys == band[-1])]
        nones = [None] * len(unfinished)
        yield pa.RecordBatch.from_arrays([pa.array(a + nones, known), pa.array(b + nones, known), pa.array([None] * len(a) + unfinished.tolist(), pa.int64())], names=["a", "b", "band"])

    banded = stored(firsts.select("doc_id", "sig").mapInArrow(band_rows, f"band long, doc_id {kind}, low binary, turn int").withColumn("salt", F.xxhash64("turn", "doc_id")).drop("turn"))
    dealt = banded.repartitionByRange("band", "salt").sortWithinPartitions("band", "salt").select("band", "doc_id", "low")
    compared = stored(dealt.mapInArrow(compare, f"a {kind}, b {kind}, band long"))
    pairs = stored(compared.where("a is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    forget(banded)

    def weighed(ids: DataFrame) -> DataFrame:
        """doc_id, h and w (shingles and weights) for the documents whose id is in column x, and for others that its bit set lets through."""
        bits = spark.sparkContext.broadcast(bit_set(marked_bits(ids)))  # of fixed size

        def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            idf, _ = shared.value
            for b in text_slices(batches, 1, 1 << 20):
                b = b.filter(pa.array(in_bits(bits.value, b.column(2).to_numpy())))  # skips most documents that are no candidates
                if not b.num_rows:
                    continue
                h, weight, heads = weighted(word_hashes(b.column(1).to_pylist()), size, idf)
                cut = list(zip(heads[:-1].tolist(), heads[1:].tolist()))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([h[i:j].tobytes() for i, j in cut], pa.binary()), pa.array([weight[i:j].tobytes() for i, j in cut], pa.binary())], names=["doc_id", "h", "w"])

        asked = rows.where("doc_id is not null and text is not null").withColumn("bit", F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).cast("int"))
        held = stored(asked.mapInArrow(vectors, f"doc_id {kind}, h binary, w binary"))
        return stored(held.dropDuplicates(["doc_id"])) if repeated_ids else held

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [jaccard(*x) >= similarity for x in zip(*(b.column(k).to_pylist() for k in range(2, 6)))]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    held = weighed(pairs.select(F.col("a").alias("x")).unionByName(pairs.select(F.col("b").alias("x"))))
    va = held.select(F.col("doc_id").alias("a"), F.col("h").alias("ha"), F.col("w").alias("wa"))
    vb = held.select(F.col("doc_id").alias("b"), F.col("h").alias("hb"), F.col("w").alias("wb"))
    links = stored(pairs.join(va, "a").join(vb, "b").select("a", "b", "ha", "wa", "hb", "wb").mapInArrow(verify, f"a {kind}, b {kind}"))
    forget(held)
    found = connected_components(links)

    unfinished = spark.sparkContext.broadcast(bit_set(marked_bits(compared.where("band is not null").select(F.col("band").alias("x")), hashed=False)))

    def open_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, _, keys = keyed(b)
            doc, number = np.nonzero(in_bits(unfinished.value, keys.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)[doc, number]), pa.array(number.astype(np.int32)), *(b.column(k).take(pa.array(doc)) for k in (0, 1))], names=["band", "number", "doc_id", "sig"])

    opened = firsts.select("doc_id", "sig").mapInArrow(open_rows, f"band long, number int, doc_id {kind}, sig binary")
    classed = stored(opened.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("band", "number", "doc_id", "sig", F.coalesce("component", "doc_id").alias("class")))
    mixed = classed.groupBy("band").agg((F.min("class") != F.max("class")).alias("mixed")).where("mixed").select(F.col("band").alias("x"))
    words = stored(marked_bits(mixed, hashed=False))
    if not words.isEmpty():
        at = F.expr(f"cast(band & {FILTER_BITS - 1}L as int)")
        marked = classed.withColumn("at", at).withColumn("word", F.shiftright("at", 6)).join(F.broadcast(words), "word")
        several = stored(marked.where(F.expr("(bits & shiftleft(1L, at & 63)) <> 0")).select("band", "number", "doc_id", "sig", "class"))
        vectors = weighed(several.select(F.col("doc_id").alias("x")))
        more = joining(several.join(vectors, "doc_id").select("band", "number", "doc_id", "class", "sig", "h", "w"), kind, samples, rows_a_band, loose, similarity, part)
        found = connected_components(links.unionByName(more))
        forget(several, vectors)
    classes = firsts.select("k1", "k2", "doc_id").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("k1", "k2", F.coalesce("component", "doc_id").alias("class_id"))
    return signed.select("doc_id", "k1", "k2").join(stored(classes), ["k1", "k2"], "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def joining(rows: DataFrame, kind: str, samples: int, rows_a_band: int, loose: float, similarity: float, part: int, most_bytes: int = 16 << 20) -> DataFrame:
    """Links (a, b) between different classes over all pairs of each band of ``rows`` (band, number, doc_id, class, sig, h, w).

    A task cuts its range of (band, class, id) into blocks of at most ``part`` documents and ``most_bytes`` and searches each; the
    blocks of bands that have several, or that a border between tasks may cut, then meet in pairs, each pair in a group of its own.
    """
    names = ["number", "doc_id", "class", "sig", "h", "w"]

    def found(x: dict, split: int = 0) -> tuple[list, list]:
        _, label = np.unique(np.array(x["class"]), return_inverse=True)
        sig = np.frombuffer(b"".join(x["sig"]), np.uint32).reshape(-1, samples)
        return joining_links(x["doc_id"], label, np.array(x["number"]), sig, x["h"], x["w"], rows_a_band, loose, similarity, split)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, now, band, held, same_band, first = TaskContext.get().partitionId() << 32, {k: [] for k in names}, None, 0, False, True
        types: dict[str, pa.DataType] = {}

        def out(last: bool) -> Iterator[pa.RecordBatch]:
            """Links in the block; and its rows, if the band has other blocks or touches a border of the range."""
            a, b = found(now)
            sent = len(now["doc_id"]) if last or first or same_band else 0
            lack = lambda n: [None] * n
            cols = [pa.array(a + lack(sent), types["doc_id"]), pa.array(b + lack(sent), types["doc_id"]), pa.array(lack(len(a)) + [band] * sent, pa.int64()), pa.array(lack(len(a)) + [block] * sent, pa.int64())]
            cols += [pa.array(lack(len(a)) + now[k][:sent], types[k]) for k in names]
            yield pa.RecordBatch.from_arrays(cols, names=["a", "b", "band", "block", *names])

        for batch in batches:
            types = {k: batch.schema.field(k).type for k in names}
            cols = {k: batch.column(k).to_pylist() for k in names}
            for i, key in enumerate(batch.column("band").to_pylist()):
                full = len(now["doc_id"]) >= part or held >= most_bytes
                if now["doc_id"] and (key != band or full):
                    same_band = same_band or key == band
                    yield from out(False)
                    first, same_band = first and key == band, key == band
                    block, now, held = block + 1, {k: [] for k in names}, 0
                band = key
                held += len(cols["h"][i]) + len(cols["w"][i]) + len(cols["sig"][i])
                for k in names:
                    now[k].append(cols[k][i])
        if now["doc_id"]:
            yield from out(True)

    made = f"a {kind}, b {kind}, band long, block long, number int, doc_id {kind}, class {kind}, sig binary, h binary, w binary"
    done = stored(rows.repartitionByRange("band", "class", "doc_id").sortWithinPartitions("band", "class", "doc_id").mapInArrow(blocks, made))
    sent = done.where("block is not null")
    span = stored(sent.groupBy("band", "block").agg(F.min("class").alias("least"), F.max("class").alias("most")))
    one, two = (span.select("band", *(F.col(c).alias(f"{c}{k}") for c in ("block", "least", "most"))) for k in (1, 2))
    meet = stored(one.join(two, "band").where("block1 < block2 and not (least1 = most1 and least2 = most2 and least1 = least2)").select("block1", "block2"))
    sides = meet.select("block1", "block2", F.col("block1").alias("block")).unionByName(meet.select("block1", "block2", F.col("block2").alias("block")))

    def across(x: pa.Table) -> pa.Table:
        x = x.sort_by("block")
        split = int((x.column("block").to_numpy() == x.column("block1").to_numpy()).sum())
        a, b = found({k: x.column(k).to_pylist() for k in names}, split)
        known = x.schema.field("doc_id").type
        return pa.table({"a": pa.array(a, known), "b": pa.array(b, known)})

    crossed = sent.join(sides, "block").select("block1", "block2", "block", *names).groupBy("block1", "block2").applyInArrow(across, f"a {kind}, b {kind}")
    return stored(done.where("a is not null").select("a", "b").unionByName(crossed))


def jaccard(ha: bytes, wa: bytes, hb: bytes, wb: bytes) -> float:
    """Weighted Jaccard similarity of two sets given as sorted hashes and weights."""
    a, b = np.frombuffer(ha, np.uint64), np.frombuffer(hb, np.uint64)
    x, y = np.frombuffer(wa, np.float32), np.frombuffer(wb, np.float32)
    if not len(a) or not len(b):
        return 0.0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    same = b[at] == a
    low = float(np.minimum(x[same], y[at[same]]).sum(dtype=np.float64))
    return low / (float(x.sum(dtype=np.float64)) + float(y.sum(dtype=np.float64)) - low)


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df`` with the smallest id of each class, with all their columns; of rows with equal ids one stays.

    Rows without an id cannot be told apart and all stay.
    """
    classes = stored(near_duplicates(df, id_col, text_col, **options))
    drop = stored(classes.where("doc_id <> class_id").select(F.col("doc_id").alias("x")).distinct())
    kept = without(df, [F.col(f"`{id_col}`")], drop)
    repeated = classes.agg((F.count("doc_id") > F.count_distinct("doc_id")).alias("x")).first()["x"]
    if not repeated:
        return kept
    known = F.col(f"`{id_col}`").isNotNull()
    return kept.where(known).dropDuplicates([id_col]).unionByName(kept.where(~known))
