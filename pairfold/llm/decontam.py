"""Benchmark decontamination over a distributed positional inverted index.

The index is a stored table of shards. A shard holds the postings of a slice of the training documents: the terms that any
test item uses, as sorted 64-bit word hashes, and each term's list of positions in order. It is written once, whatever the
number of items; texts are read only to write it. How often each term occurs in all documents is summed from the shards, in
hashed cells of a fixed number.

Test windows of ``n`` consecutive words are looked up rarest term first, by those frequencies: a window is met only where its
rarest term has a list in the shard. That list, moved by the term's offset, gives candidate starts; the lists of the next
rarest terms, moved by theirs, cut these down one after another by binary search until all agree. A start that survives is
an exact phrase occurrence. A proximity match needs ``near_terms`` of the ``pool`` rarest different terms of a window, each within
``slop`` positions of where the phrase would put it; it is sought from each of so many of the rarest terms that one of them must
be among any ``near_terms``, so a passage with some words replaced is found, and what is found does not depend on how the
documents are sliced.

Test items are the side that is sent to the shards. Their size is measured first: items are cut into blocks of at most
``block_words`` words, and each block is one pass over the index, so what a task receives has a bound however many items there
are; an item of more words is cut into runs of windows. Occurrences are kept as runs of hit positions and united over the blocks.

Words: ASCII letters in lower case, digits and all non-ASCII characters; everything else divides words. Defined results:
null and empty texts have no words, no hits and are not contaminated; items without words match nothing; an item with a null
id hits words but is not listed or counted; an item of fewer than ``n`` words is a single window; equal windows count for
each item that has them; repeated document rows are judged one by one. Two different words count as equal if their 64-bit
hashes are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import stored
from .common import WORD_BYTES, bit_set, in_bits, marked_bits, text_slices, without
from .shingles import word_hashes

#: Hashed cells in which the terms' frequencies are summed.
CELLS_BITS = 20


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORD_BYTES).split()


class TestWindows:
    """The different windows of some items (id, words), as rows of term numbers; -1 pads windows of fewer words."""

    __test__ = False

    def __init__(self, items: list[tuple[str | None, list[bytes]]], n: int):
        self.n = n
        hashes = word_hashes([b" ".join(words) for _, words in items]).hashes if items else np.zeros(0, np.uint64)
        self.terms, number = np.unique(hashes, return_inverse=True)
        at: dict[tuple[int, ...], int] = {}
        holders: list[set[str]] = []
        lo = 0
        for item, words in items:
            ids = number[lo : lo + len(words)].tolist()
            lo += len(words)
            for w in {tuple(ids[i : i + n]) for i in range(max(1, len(ids) - n + 1))} if ids else ():
                k = at.setdefault(w, len(holders))
                if k == len(holders):
                    holders.append(set())
                if item is not None:
                    holders[k].add(item)
        self.holders = [tuple(sorted(h)) for h in holders]
        self.length = np.array([len(w) for w in at], np.int64)
        self.window = np.full((len(at), n), -1, np.int64)
        for w, k in at.items():
            self.window[k, : len(w)] = w


@dataclass
class Ranked:
    """Windows with their offsets from the rarest term on, and for each number of a seed, the windows by that seed's term."""

    test: TestWindows
    order: np.ndarray  # (window, rank): offset; those past a window's length come last
    pool: np.ndarray  # (window, rank): offset of the rarest different terms, -1 where there are fewer
    need: np.ndarray  # terms that make a proximity match
    by_term: list[tuple[np.ndarray, np.ndarray]]  # for each seed: where each term's windows begin, and the windows

    @classmethod
    def of(cls, test: TestWindows, freq: np.ndarray, near_terms: int, pool: int) -> Ranked:
        """``freq``: how often each term of ``test`` occurs in all documents."""
        pool = max(pool, near_terms)
        inside = test.window >= 0
        rarity = np.where(inside, freq[np.maximum(test.window, 0)] if len(freq) else 0, np.iinfo(np.int64).max)
        order = np.lexsort((test.window, rarity), axis=1) if len(rarity) else np.zeros((0, test.n), np.int64)
        ranked = np.take_along_axis(test.window, order, 1)
        fresh = ranked >= 0
        fresh[:, 1:] &= ranked[:, 1:] != ranked[:, :-1]  # equal terms are equally rare, so they stand together
        nth = np.cumsum(fresh, 1) - 1
        offsets = np.full((len(order), pool), -1, np.int64)
        w, k = np.nonzero(fresh & (nth < pool))
        offsets[w, nth[w, k]] = order[w, k]
        have = (offsets >= 0).sum(1)
        need = np.minimum(near_terms, have)
        by_term = []
        for seed in range(pool - near_terms + 1):
            w = np.flatnonzero(have - need >= seed) if len(have) else np.zeros(0, np.int64)
            w = w[have[w] > seed]
            term = test.window[w, offsets[w, seed]]
            turn = np.argsort(term, kind="stable")
            by_term.append((np.searchsorted(term[turn], np.arange(len(test.terms) + 1)), w[turn]))
        return cls(test, order, offsets, need, by_term)


@dataclass
class Shard:
    """Postings of one slice of documents: positions by term, in order. Documents stand so far apart that no window spans two."""

    start: np.ndarray  # each document's first position
    words: np.ndarray  # each document's words
    terms: np.ndarray  # sorted word hashes
    heads: np.ndarray  # where each term's positions begin; and their number
    positions: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes | None], gap: int, bits: np.ndarray | None = None) -> Shard:
        w = word_hashes(texts)
        space = np.arange(len(w.count)) * gap
        h, at = w.hashes, np.arange(len(w.hashes)) + np.repeat(space, w.count)
        if bits is not None:
            some = in_bits(bits, h.view(np.int64))
            h, at = h[some], at[some]
        order = np.argsort(h, kind="stable")
        h, at = h[order], at[order]
        cut = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
        return cls(w.head + space, w.count, h[cut], np.append(cut, len(h)), at)

    def lists(self, ranked: Ranked, seed: int, slot: np.ndarray, chunk: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(window, offset of its seed, positions in the seed's list less the offset), in bounded pieces."""
        first, windows = ranked.by_term[seed]
        present = np.flatnonzero(slot >= 0)
        n = first[present + 1] - first[present]
        some = windows[np.repeat(first[present], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        off = ranked.pool[some, seed]
        own = slot[ranked.test.window[some, off]]
        count = self.heads[own + 1] - self.heads[own]
        ends = np.cumsum(count)
        lo = 0
        while lo < len(some):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + chunk, side="right")))
            n = count[lo:hi]
            w, r = np.repeat(some[lo:hi], n), np.repeat(off[lo:hi], n)
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield w, r, self.positions[np.repeat(self.heads[own[lo:hi]], n) + nth] - r
            lo = hi


def match_shard(shard: Shard, ranked: Ranked, slop: int) -> list[tuple[list[tuple[int, int]], list[str], int]]:
    """For each document: runs of hit word positions (end exclusive), items with a phrase match, windows with a proximity match."""
    test, docs = ranked.test, len(shard.start)
    many, base = max(len(test.length), 1), int(shard.start[-1] + shard.words[-1] + test.n + slop + 1) if docs else 1
    runs: list[list[tuple[int, int]]] = [[] for _ in range(docs)]
    items: list[set[str]] = [set() for _ in range(docs)]
    at = np.minimum(np.searchsorted(test.terms, shard.terms), max(len(test.terms) - 1, 0))
    held = np.flatnonzero(test.terms[at] == shard.terms) if len(test.terms) else np.zeros(0, np.int64)
    if not len(held):
        return [([], [], 0) for _ in range(docs)]
    slot = np.full(len(test.terms), -1, np.int64)
    slot[at[held]] = held
    key = np.repeat(np.arange(len(shard.terms)), np.diff(shard.heads)) * base + shard.positions  # sorted

    def posted(term: np.ndarray, low: np.ndarray, wide: int) -> np.ndarray:
        """Whether each term's list has a position from ``low`` to ``low + wide``."""
        own = slot[term]
        want = own * base + np.maximum(low, 0)
        i = np.minimum(np.searchsorted(key, want), len(key) - 1)
        return (own >= 0) & (key[i] >= want) & (key[i] - want <= wide + np.minimum(low, 0))

    edge: list[np.ndarray] = []
    stop: list[np.ndarray] = []
    phrase, close = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]  # document x window
    for seed in range(len(ranked.by_term)):
        for w, r, begin in shard.lists(ranked, seed, slot):
            got = np.ones(len(w), np.int64)
            for k in range(ranked.pool.shape[1]):
                if k != seed:
                    off = ranked.pool[w, k]
                    got += (off >= 0) & posted(test.window[w, off], begin + off - slop, 2 * slop)
            near = got >= ranked.need[w]
            close.append(np.unique((np.searchsorted(shard.start, (begin + r)[near], side="right") - 1) * many + w[near]))
            if seed:
                continue
            ok = begin >= 0
            w, begin = w[ok], begin[ok]
            for k in range(1, test.n):
                inside = k < test.length[w]
                if not inside.any():
                    break
                off = ranked.order[w, k]
                same = ~inside | posted(test.window[w, off], begin + off, 0)
                w, begin = w[same], begin[same]
            edge.append(begin)
            stop.append(begin + test.length[w])
            phrase.append(np.unique((np.searchsorted(shard.start, begin, side="right") - 1) * many + w))
    first, last = np.concatenate(edge) if edge else np.zeros(0, np.int64), np.concatenate(stop) if stop else np.zeros(0, np.int64)
    for d, lo, hi in spans(first, last):
        own = int(np.searchsorted(shard.start, lo, side="right")) - 1
        runs[own].append((int(lo - shard.start[own]), int(hi - shard.start[own])))
    for d, k in zip(*(x.tolist() for x in np.divmod(np.unique(np.concatenate(phrase)), many))):
        items[d].update(test.holders[k])
    n_close = np.bincount(np.unique(np.concatenate(close)) // many, minlength=docs)
    return [(r, sorted(i), int(c)) for r, i, c in zip(runs, items, n_close)]


def spans(first: np.ndarray, last: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(number, begin, end) of the disjoint runs that cover the same positions as the given ones."""
    order = np.argsort(first, kind="stable")
    first, far = first[order], np.maximum.accumulate(last[order]) if len(last) else last
    head = np.flatnonzero(np.concatenate(([True], first[1:] > far[:-1]))) if len(first) else np.zeros(0, np.int64)
    ends = far[np.append(head[1:], len(first)) - 1] if len(first) else far
    yield from zip(range(len(head)), first[head].tolist(), ends.tolist())


def match_slice(docs: list[list[bytes]], test: TestWindows, near_terms: int = 3, slop: int = 4, pool: int = 5) -> list[tuple[list[tuple[int, int]], list[str], int]]:
    """``match_shard`` over a few documents by themselves, given as words; terms are ranked by these alone."""
    shard = Shard.of([b" ".join(d) for d in docs], test.n + slop)
    at = np.minimum(np.searchsorted(shard.terms, test.terms), max(len(shard.terms) - 1, 0))
    freq = np.where(shard.terms[at] == test.terms, np.diff(shard.heads)[at], 0) if len(shard.terms) else np.zeros(len(test.terms), np.int64)
    return match_shard(shard, Ranked.of(test, freq, near_terms, pool), slop)


def united(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint runs that cover the same positions."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(runs):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def item_blocks(items: DataFrame, item_id: str, text_col: str, n: int, block_words: int) -> Iterator[TestWindows]:
    """Test items in blocks of at most ``block_words`` words, one at a time; a longer item is cut into runs that overlap by ``n`` - 1 words."""
    rows = items.where(F.col(text_col).isNotNull()).select(F.col(item_id).cast("string").alias("i"), F.col(text_col).cast("binary").alias("t"))
    now, size = [], 0
    most = max(block_words, n)
    for r in rows.orderBy("i").toLocalIterator(prefetchPartitions=False):
        words = words_of(bytes(r["t"]))
        for lo in range(0, max(len(words) - n + 1, 1), most - n + 1):
            part = words[lo : lo + most]
            if now and size + len(part) > block_words:
                yield TestWindows(now, n)
                now, size = [], 0
            now.append((r["i"], part))
            size += len(part)
    yield TestWindows(now, n)


SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
FOUND = [T.StructField("n_words", T.LongType()), T.StructField("runs", SPAN), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("n_near", T.LongType())]
RUNS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def write_index(docs: DataFrame, kept: Column, text_col: str, items: DataFrame, item_text: str, gap: int) -> tuple[DataFrame, np.ndarray]:
    """The stored index, a row for each shard with ``kept`` of its documents; and how often the terms of each cell occur."""
    spark = docs.sparkSession
    rows = docs.select(kept.alias("kept"), F.col(text_col).cast("binary").alias("text"))

    def used(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, 0, 1 << 20):
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(word_hashes(b.column(0).to_pylist()).hashes).view(np.int64))], names=["x"])

    words = items.select(F.col(item_text).cast("binary").alias("text")).where("text is not null").mapInArrow(used, "x long")
    bits = spark.sparkContext.broadcast(bit_set(marked_bits(words, hashed=False)))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, 1, 2 << 20):
            s = Shard.of(b.column(1).to_pylist(), gap, bits.value)
            kept = pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(0))
            parts = [s.start.astype(np.int64), s.words.astype(np.int64), s.terms, s.heads.astype(np.int32), s.positions.astype(np.int64 if len(s.positions) and s.positions.max() >> 31 else np.int32)]
            yield pa.RecordBatch.from_arrays([kept, *(pa.array([x.tobytes()], pa.binary()) for x in parts), pa.array([parts[-1].itemsize], pa.int32())], names=["kept", "start", "words", "terms", "heads", "positions", "width"])

    parts = [T.StructField(x, T.BinaryType()) for x in ("start", "words", "terms", "heads", "positions")]
    shards = rows.mapInArrow(run, T.StructType([T.StructField("kept", T.ArrayType(rows.schema["kept"].dataType)), *parts, T.StructField("width", T.IntegerType())]))
    index = stored(shards.withColumn("shard", F.monotonically_increasing_id()))

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(1 << CELLS_BITS, np.int64)
        for b in batches:
            for terms, heads in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                np.add.at(sums, cells_of(np.frombuffer(terms, np.uint64)), np.diff(np.frombuffer(heads, np.int32)))
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums[at])], names=["cell", "n"])

    got = index.select("terms", "heads").mapInArrow(often, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # at most a row for each cell
    freq = np.zeros(1 << CELLS_BITS, np.int64)
    freq[got["cell"].to_numpy(int)] = got["n"].to_numpy(int)
    return index, freq


def cells_of(terms: np.ndarray) -> np.ndarray:
    return (terms >> np.uint64(64 - CELLS_BITS)).astype(np.int64)


def shards_of(b: pa.RecordBatch) -> Iterator[Shard]:
    for start, words, terms, heads, positions, width in zip(*(b.column(x).to_pylist() for x in ("start", "words", "terms", "heads", "positions", "width"))):
        yield Shard(np.frombuffer(start, np.int64), np.frombuffer(words, np.int64), np.frombuffer(terms, np.uint64), np.frombuffer(heads, np.int32).astype(np.int64), np.frombuffer(positions, np.int32 if width == 4 else np.int64).astype(np.int64))


def annotate(docs: DataFrame, kept: Column, text_col: str, items: DataFrame, item_id: str, item_text: str, n: int, near_terms: int, slop: int, block_words: int, pool: int = 5) -> DataFrame:
    """``kept`` as row, n_words, runs, items and n_near for each row of ``docs``; one pass over the index for each block of items.

    With one block, a pass gives all rows. With several, each pass stores what it found, and a join by document unites it.
    """
    sc = docs.sparkSession.sparkContext
    index, freq = write_index(docs, kept, text_col, items, item_text, n + slop)
    kind = index.schema["kept"].dataType.elementType

    def looking(block: TestWindows | None, dense: bool):
        ranked = sc.broadcast(Ranked.of(block, freq[cells_of(block.terms)], near_terms, pool) if block else None)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for i, shard in enumerate(shards_of(whole)):
                    b = whole.slice(i, 1)
                    docs = len(shard.start)
                    found = match_shard(shard, ranked.value, slop) if ranked.value else [([], [], 0)] * docs
                    some = [d for d in range(docs) if dense or found[d][0] or found[d][2]]
                    made = [pa.array([[{"start": lo, "end": hi} for lo, hi in found[d][0]] for d in some], RUNS), pa.array([found[d][1] for d in some], pa.list_(pa.string())), pa.array([found[d][2] for d in some], pa.int64())]
                    place = [pa.array(np.full(len(some), b.column("shard")[0].as_py(), np.int64)), pa.array(some, pa.int32())]
                    if dense:
                        made = [b.column("kept").flatten(), pa.array(shard.words), *made]
                        yield pa.RecordBatch.from_arrays([*made, *place], names=["row", "n_words", "runs", "items", "n_near", "shard", "doc"])
                    else:
                        yield pa.RecordBatch.from_arrays([*made, *place], names=["runs", "items", "n_near", "shard", "doc"])

        place = [T.StructField("shard", T.LongType()), T.StructField("doc", T.IntegerType())]
        return index.mapInArrow(run, T.StructType([T.StructField("row", kind), *FOUND, *place] if dense else [*FOUND[1:], *place]))

    blocks = item_blocks(items, item_id, item_text, n, block_words)
    block, after = next(blocks), next(blocks, None)
    if after is None:
        return looking(block, True).drop("shard", "doc")
    parts = []
    while block is not None:
        parts.append(stored(looking(block, False)))
        block, after = after, next(blocks, None) if after is not None else None
    each = parts[0]
    for p in parts[1:]:
        each = each.unionByName(p)
    whole = each.groupBy("shard", "doc").agg(F.flatten(F.collect_list("runs")).alias("found"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("held"), F.sum("n_near").alias("near"))  # a row for each block at most
    rows = looking(None, True).drop("runs", "items", "n_near").join(whole, ["shard", "doc"], "left")
    empty = F.array().cast("array<string>")
    rows = rows.select("row", "n_words", F.coalesce("found", F.array().cast(SPAN)).alias("runs"), F.coalesce("held", empty).alias("items"), F.coalesce("near", F.lit(0)).cast("long").alias("n_near"))

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs = [[{"start": lo, "end": hi} for lo, hi in united([(x["start"], x["end"]) for x in r])] for r in b.column("runs").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(runs, RUNS) if x == "runs" else b.column(x) for x in b.schema.names], names=b.schema.names)

    return rows.mapInArrow(unite, rows.schema)


def with_counts(rows: DataFrame) -> DataFrame:
    """Adds n_hit and the contamination rule (at least a twentieth of the words hit)."""
    hit = F.aggregate("runs", F.lit(0).cast("long"), lambda a, x: a + (x["end"] - x["start"]))
    return rows.withColumn("n_hit", hit).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def find_matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 13, near_terms: int = 3, slop: int = 4, block_words: int = 1 << 20, pool: int = 5) -> DataFrame:
    """doc_id, n_words, runs of hit words, items, n_near (windows near by), n_hit and contaminated, for each row of ``docs``."""
    found = annotate(docs, F.struct(F.col(id_col).alias("id")), text_col, items, item_id, item_text, n, near_terms, slop, block_words, pool)
    return with_counts(found.select(F.col("row.id").alias("doc_id"), "n_words", "runs", "items", "n_near"))


def digest(found: DataFrame) -> DataFrame:
    """Counts, and a hash of the items, for each document."""
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated", "n_near")


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 13, block_words: int = 1 << 20) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns; texts are told apart by two 64-bit hashes."""
    text = F.col(f"`{text_col}`")
    keys = [F.xxhash64(text), F.xxhash64(F.lit(1), text)]
    found = annotate(docs, F.struct(keys[0].alias("x"), keys[1].alias("y")), text_col, items, item_id, item_text, n, 1, 0, block_words, 1)
    return without(docs, keys, stored(with_counts(found).where("contaminated").select("row.x", "row.y").distinct()))
