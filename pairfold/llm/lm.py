"""Language-model scores of documents: a unigram base, and a causal self-attention model on subword ids.

All of it is learned from every token of all training documents: the counts of words and of subword ids (from the word
counts), the most frequent pairs of classes, for each of these the counts of the classes that follow, and the attention model.
That model begins with a bounded number of texts (``sample`` by hash), which only fixes where the pass over the corpus starts.
Then all texts are cut into segments, dealt to shards by their content, about ``shard`` windows in each, so that the number of
shards grows with the corpus; each shard trains on all of its tokens from the same start, in an order that its segments fix,
and the mean of the shards' parameters is the model. Equal segments are one, with their number as weight. As shards, orders and
counts depend on the documents alone, so do scores, however the documents are partitioned.

Words: ASCII letters in lower case, divided by white space; a text is its words and an end. Each word is encoded with a
space before it by a public byte-level vocabulary, so a text's score is a proper probability of its sequence of words.

Word counts are joined with the documents in two ways: words of at least a ``hot``-th of all training tokens, of which there
can be at most ``hot``, are broadcast; all others are joined by word, and none of these is frequent enough to be a hot key.

Defined results: null and empty texts are their end alone; rows with equal ids are scored one by one; null ids belong to
training; without training documents all counts are 0 and the model is the untrained start; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import itertools
import math
import re
import uuid
import zlib
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import attention
from .common import hashed_sample, text_slices
from .components import stored


#: White space or controls that the vocabulary's word pattern may join with a space beside them.
NO_PLAIN_SPACE = re.compile(rb"[\x00-\x1f\x7f]|\xc2[\x80-\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8-\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def split_words(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Different words of binary texts, which of them stands at each place, and words of each text; as ``words_of`` splits them."""
    texts = pc.fill_null(texts, b"")
    laid = pc.ascii_split_whitespace(pc.ascii_lower(pa.Array.from_buffers(pa.string(), len(texts), texts.buffers(), 0, texts.offset)))
    found, count = laid.flatten().dictionary_encode(), np.diff(laid.offsets.to_numpy())
    at, words = found.indices.to_numpy(), found.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
    if b"" in words:  # white space at a text's beginning or end
        whole = at != words.index(b"")
        at, count = at[whole], np.bincount(np.repeat(np.arange(len(count)), count)[whole], minlength=len(count))
    return words, at, count


class Encoder:
    """Subword ids of words; the id after the last one is the end.

    Words met get numbers, under which flat arrays hold their ids and their gains (those of ``often``, log10 of a frequent
    word's count and one, else not a number). ``slice`` forgets the others once it holds ``cache`` words beside the frequent ones, so the arrays stay
    bounded.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, often: dict[bytes, float] | None = None, cache: int = 200_000):
        import tiktoken

        self.coder = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.end, self.cache = max(ranks.values()) + 1, cache + len(often or {})
        self.gain = often or {}
        self.opens = np.zeros(self.end + 1, bool)
        self.opens[[i for piece, i in ranks.items() if piece.startswith(b" ")]] = True
        self.number: dict[bytes, int] = {}
        self.words: list[bytes] = [b""]  # number 0 is the end
        self.ids, self.heads, self.gains = array("i", [self.end]), array("q", [0, 1]), array("d", [0.0])
        self.first = 1
        self.empty()
        self.numbers(list(self.gain))
        self.first = len(self.words)

    def empty(self) -> None:
        """Forget all words but the frequent ones, which have the first numbers."""
        n = self.first
        del self.words[n:], self.heads[n + 1 :], self.gains[n:]
        del self.ids[self.heads[n] :]
        self.number = defaultdict(itertools.count(n).__next__, zip(self.words, range(n)))  # a word that has no number gets the next one

    def encode(self, w: bytes) -> list[int]:
        return self.coder.encode_ordinary(" " + w.decode("utf-8", "replace"))

    def encode_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words laid end to end, and where each word's begin; as one text, whose words the spaces keep apart."""
        joined = b" ".join(words)
        if not NO_PLAIN_SPACE.search(joined):
            ids = np.asarray(self.coder.encode_to_numpy(" " + joined.decode("utf-8", "replace"), disallowed_special=())).astype(np.int32) if words else np.zeros(0, np.int32)
            heads = np.flatnonzero(self.opens[ids])
            if len(heads) == len(words):
                return ids, heads
        each = [self.encode(w) for w in words]
        n = np.array([len(x) for x in each])
        return np.array([i for x in each for i in x], np.int32), np.cumsum(n) - n

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The numbers of words; what is new among them is encoded."""
        out = np.fromiter(map(self.number.__getitem__, words), np.int32, len(words))
        new = list(itertools.islice(reversed(self.number), len(self.number) - len(self.words)))[::-1]
        if new:
            ids, heads = self.encode_all(new)
            first = len(self.ids)
            self.words += new
            self.ids.frombytes(ids.tobytes())
            self.heads.frombytes((np.append(heads[1:], len(ids)) + first).astype(np.int64).tobytes())
            self.gains.extend(map(self.gain.get, new, itertools.repeat(math.nan)))
        return out

    def ids_of(self, words: list[bytes]) -> array:
        out = array("i")
        for k in self.numbers(words).tolist():
            out += self.ids[self.heads[k] : self.heads[k + 1]]
        return out

    def slice(self, texts: pa.Array | list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of texts laid end to end, ends included: word numbers, words of each text, ids, ids of each text, and the words' gains."""
        if len(self.words) >= self.cache:
            self.empty()
        words, at, count = split_words(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.binary()))
        number, count = np.insert(self.numbers(words)[at], np.cumsum(count), 0), count + 1
        heads, ids, gains = np.frombuffer(self.heads, np.int64), np.frombuffer(self.ids, np.int32), np.frombuffer(self.gains)  # not copied
        start, n = heads[number], np.diff(heads)[number]
        ends = np.cumsum(n)
        at = np.repeat(start - (ends - n), n) + np.arange(n.sum())
        return number, count, ids[at], np.add.reduceat(n, np.cumsum(count) - count) if len(count) else count, gains[number]


_kept: dict[str, object] = {}


def kept(name: str, make):
    """One object in a worker, made anew when another query or stage asks; so caches of earlier ones take no memory."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = make()
    return _kept[name]


def public_vocabulary(path: str | None = None) -> tuple[dict[bytes, int], str]:
    """Ranks and word pattern of a public byte-level vocabulary file."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, public_tokenizers.PATTERN


WORD, END = 0, 1


def gather(train: DataFrame, flush: int = 600_000) -> DataFrame:
    """(kind, word, c) over the texts of ``train`` (columns id and text): words and the end, with how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter[bytes] = Counter()
        docs = 0

        def out() -> pa.RecordBatch:
            kinds = np.repeat(np.array([WORD, END], np.int8), [len(sums), 1])
            return pa.RecordBatch.from_arrays([pa.array(kinds), pa.array([*sums, b""], pa.binary()), pa.array([*sums.values(), docs], pa.int64())], names=["kind", "word", "n"])

        for b in text_slices(batches, 1, 1 << 20):
            for t in b.column(1).to_pylist():
                sums.update(words_of(t))
            docs += b.num_rows
            if len(sums) >= flush:
                yield out()
                sums.clear()
                docs = 0
        if docs:
            yield out()

    return train.mapInArrow(run, "kind byte, word binary, n long").groupBy("kind", "word").agg(F.sum("n").alias("c"))


def count_ids(words: DataFrame, vocabulary, name: str) -> np.ndarray:
    """How often each subword id is in the training text, from the word counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pairfold.llm.lm import Encoder, kept

        coder = kept(name, lambda: Encoder(*vocabulary.value))
        sums = np.zeros(coder.end + 1, np.int64)
        for b in batches:
            ids, n = [], []
            kind, c = b.column(0).to_numpy(), b.column(2).to_numpy()
            sums[coder.end] += c[kind == END].sum()
            ids, heads = coder.encode_all(b.column(1).filter(pa.array(kind == WORD)).to_pylist())
            sums += np.bincount(ids, np.repeat(c[kind == WORD], np.diff(np.append(heads, len(ids)))), len(sums)).astype(np.int64)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums[at])], names=["id", "n"])

    got = words.mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()  # at most a row for each id
    out = np.zeros(max(vocabulary.value[0].values()) + 2)
    out[got["id"].to_numpy(int)] = got["n"].to_numpy(float)
    return out


def id_classes(counts: np.ndarray, opens: np.ndarray, shape: attention.Shape, shared: int = 32) -> np.ndarray:
    """A class for each id: frequent ids alone; rarer ones by rank in ``shared`` classes for ids that open a word, and as many for others.

    Groups hold classes of like frequency, those of words' openings first. The end (the last id) is always a class alone.
    """
    order = np.argsort(-counts, kind="stable")
    order = np.concatenate(([len(counts) - 1], order[order != len(counts) - 1]))
    single = max(1, min(shape.classes - 2 * shared, len(counts)))
    cls = np.empty(len(counts), int)
    cls[order[:single]] = np.arange(single)
    for side, first in ((True, single), (False, single + shared)):
        mine = order[single:][opens[order[single:]] == side]
        cls[mine] = first + np.arange(len(mine)) * shared // max(len(mine), 1)
    mass = np.bincount(cls, counts, shape.classes)
    side = np.zeros(shape.classes, bool)
    side[cls] = opens
    rank = np.empty(shape.classes, int)
    rank[np.lexsort((-mass, ~side))] = np.arange(shape.classes)
    return rank[cls]


def fit(rows: DataFrame, train: Column, vocabulary_path: str | None = None, shape: attention.Shape | None = None, sample: int = 1200, longest: int = 1 << 16, rounds: int = 3, hot: int = 1 << 20, shard: int = 24576, pairs: int = 7000) -> dict:
    """Learn from the rows (columns id and text) where ``train`` holds.

    ``shard`` is about the number of windows that are trained on between the start and a mean; ``pairs`` bounds the table of
    class pairs. The attention model meets ``sample`` of the texts, of at most ``longest`` bytes of classes, ``rounds`` times before all texts.
    """
    spark, shape, name = rows.sparkSession, shape or attention.Shape(), uuid.uuid4().hex
    vocabulary = spark.sparkContext.broadcast(public_vocabulary(vocabulary_path))  # a tokenizer's vocabulary, not corpus data
    words = stored(gather(rows.where(train).select("id", "text")), compression="zstd")
    total, different = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    often = {bytes(r["word"]): math.log10(r["c"] + 1) for r in words.where((F.col("kind") == WORD) & (F.col("c") * hot >= total)).toLocalIterator()}  # at most ``hot``
    docs = (words.where(F.col("kind") == END).first() or {"c": 0})["c"]
    counts = count_ids(words, vocabulary, name)
    ranks = vocabulary.value[0]
    opens = np.zeros(len(counts), bool)
    opens[[i for piece, i in ranks.items() if piece.startswith(b" ")]] = True
    opens[-1] = True  # the end stands where a word could begin
    cls = id_classes(counts, opens, shape).astype(class_type(shape))
    in_class = np.bincount(cls, counts + 0.5, shape.classes)
    log_own = np.log10((counts + 0.5) / in_class[cls])
    fitted = {"name": name, "vocabulary": vocabulary, "words": words.where(F.col("kind") == WORD).select("word", "c"), "hot": hot, "total": int(total), "different": int(different), "docs": int(docs)}
    fitted["shared"] = spark.sparkContext.broadcast((often, cls, log_own, shape.classes))  # at most ``hot`` words, and fixed sizes
    found = stored(_encode(rows, fitted, train), compression="zstd")
    known = found.where("uid is not null and learn").select("id", "classes")
    contexts = attention.Contexts(shape.classes, _frequent_pairs(found.where("uid is null"), pairs))
    model = attention.Model.fresh(shape, np.maximum(in_class, 0.5))
    first = hashed_sample(known, ["id", "classes"], sample, F.octet_length("classes") <= longest)  # a bounded number, trained on once more than the others are
    texts = sorted((np.frombuffer(r["classes"], cls.dtype) for r in first.collect()), key=lambda t: t.tobytes())
    if texts:
        x, y, use, _ = attention.cut_windows(np.concatenate(texts), np.array([len(t) for t in texts]), shape)
        attention.train(model, x, y, use, 0.02, batch=64, rounds=rounds)
    stride = shape.window - shape.overlap
    model, table = _train_everywhere(known, model, contexts, shard, max(1, math.ceil(counts.sum() / (shard * stride))))
    return fitted | {"model": model, "contexts": contexts, "table": table, "rows": rows, "encoded": found.where("uid is not null")}


def class_type(shape: attention.Shape) -> np.dtype:
    return np.dtype(np.int16 if shape.classes < 1 << 15 else np.int32)


def _frequent_pairs(found: DataFrame, most: int) -> np.ndarray:
    """The ``most`` most frequent pairs of classes in all training texts, of those that occur twice; ``found`` has their counts by task."""
    each = found.select(F.explode(F.arrays_zip("cell", "n")).alias("x"))
    got = each.groupBy(F.col("x.cell").alias("i")).agg(F.sum("x.n").alias("n")).where("n > 1").orderBy(F.desc("n"), "i").limit(most).toArrow()
    return got.column("i").to_numpy().astype(np.int64)


def _train_everywhere(known: DataFrame, start: attention.Model, contexts: attention.Contexts, size: int, shards: int, part: int = 2048, held_bytes: int = 32 << 20) -> tuple[attention.Model, np.ndarray]:
    """The model trained on every token of the classes of all training texts, and the table of their contexts.

    Texts are cut into segments of ``part`` tokens, which are dealt to shards by their hashes. Equal segments are trained on
    and counted together, with their number as weight, so that however many copies there are, no shard is long. Each shard
    trains from ``start``, and the mean of their parameters, by tokens' weights, is the model. A task hands on one sum of
    parameters (numbers below ``size_of``), the weight of these (-1) and the cells it met.
    """
    keys, shape = sorted(start.p), start.shape
    kind, lead = class_type(shape), shape.overlap + 1
    size_of = sum(start.p[k].size for k in keys)
    shared = known.sparkSession.sparkContext.broadcast((start, contexts))  # fixed sizes

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: Counter[bytes] = Counter()
        held = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([*met], pa.binary()), pa.array([*met.values()], pa.int64())], names=["segment", "n"])

        for b in text_slices(batches, 0):
            for text in b.column(0).to_pylist():
                for x in attention.segments(text, shape, kind, part):
                    held += 0 if x in met else len(x)
                    met[x] += 1
            if held >= held_bytes:
                yield out()
                met.clear()
                held = 0
        if met:
            yield out()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, contexts = shared.value
        sums, seen = np.zeros(size_of), 0
        cells = np.zeros(contexts.rows * contexts.classes, np.int64)

        def one(held: list[bytes], times: list[int]) -> int:
            model = attention.Model(shape, {k: v.copy() for k, v in first.p.items()})
            laid, lens, n = np.frombuffer(b"".join(held), kind), np.array([len(x) for x in held]) // kind.itemsize, np.array(times)
            np.add.at(cells, contexts.cells(laid, lens, lead), np.repeat(n, lens - lead))
            x, y, use, own = attention.segment_windows(laid, lens, shape)
            attention.train(model, x, y, use, 0.008, batch=256, weight=n[own], run=4)
            weight = int((n * (lens - lead)).sum())
            sums[:] += np.concatenate([model.p[k].ravel() for k in keys]).astype(np.float64) * weight
            return weight

        now, held, times, tokens = None, [], [], 0
        for b in batches:
            for s, x, n in zip(*(c.to_pylist() for c in b.columns)):
                if held and s == now and x == held[-1]:
                    times[-1] += n
                    continue
                if held and (s != now or tokens >= 4 * size * (shape.window - shape.overlap)):
                    seen += one(held, times)
                    held, times, tokens = [], [], 0
                now = s
                held.append(x)
                times.append(n)
                tokens += len(x) // kind.itemsize - lead
        seen += one(held, times) if held else 0
        if seen:
            at = np.flatnonzero(cells)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(([-1], np.arange(size_of), at + size_of)).astype(np.int32)), pa.array(np.concatenate(([seen], sums, cells[at])))], names=["i", "v"])

    met = known.select("classes").mapInArrow(cut, "segment binary, n long")
    dealt = met.select(F.pmod(F.xxhash64("segment"), F.lit(shards)).alias("shard"), "segment", "n").repartition("shard").sortWithinPartitions("shard", "segment")
    got = dealt.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()  # a row for each parameter and cell
    i, v = got.column("i").to_numpy(), got.column("v").to_numpy()
    n = np.zeros(contexts.rows * contexts.classes, np.int64)
    n[i[i >= size_of] - size_of] = v[i >= size_of].astype(np.int64)
    table = contexts.shares(n.reshape(contexts.rows, contexts.classes))
    if not len(i):
        return start, table
    flat, at, p = np.zeros(size_of), 0, {}
    inner = (i >= 0) & (i < size_of)
    flat[i[inner]] = v[inner] / v[i == -1]
    for k in keys:
        p[k] = flat[at : at + start.p[k].size].reshape(start.p[k].shape).astype(np.float32)
        at += start.p[k].size
    return attention.Model(shape, p), table


def _encode(rows: DataFrame, fitted: dict, train: Column | None = None) -> DataFrame:
    """For each of ``rows`` (id, text) its classes, what its frequent words add to the base, its other words and how often each occurs.

    Where ``train`` holds, the pairs of classes before each token are counted as well: each task adds rows without a uid that
    hold the pairs it met and their counts.
    """
    vocabulary, shared, name, docs = fitted["vocabulary"], fitted["shared"], fitted["name"], fitted["docs"]
    counting = train is not None
    learn = F.coalesce(train, F.lit(False)) if counting else F.lit(False)
    asked = rows.select(F.monotonically_increasing_id().alias("uid"), "text", "id", learn.alias("learn"))
    made = {"uid": "long", "id": asked.schema["id"].dataType.simpleString(), "n_tokens": "long", "n_hot": "long", "base_hot": "double", "own": "double", "words": "array<binary>", "times": "array<int>", "classes": "binary", "learn": "boolean", "cell": "array<int>", "n": "array<int>"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pairfold.llm.lm import Encoder, kept

        often, cls, log_own, classes = shared.value
        coder, end_gain = kept(name + "gains", lambda: Encoder(*vocabulary.value, often)), math.log10(docs + 1)
        sums = np.zeros((classes + 1) ** 2, np.int32) if counting else None  # a task's texts hold far fewer tokens than an int can count
        types = None
        for b in text_slices(batches, 1, 1 << 20):
            number, count, ids, n_ids, gains = coder.slice(b.column(1))
            heads = np.cumsum(count) - count
            cold = np.isnan(gains)
            hot = np.add.reduceat((~cold).astype(np.int64), heads) - int(not docs)
            base = np.add.reduceat(np.where(cold, 0.0, gains), heads) + end_gain
            doc = np.repeat(np.arange(len(count)), count)[cold]
            pair, times = np.unique(doc * (len(coder.words) + 1) + number[cold], return_counts=True)
            own, word = np.divmod(pair, len(coder.words) + 1)
            cuts = pa.array(np.searchsorted(own, np.arange(len(count) + 1)), pa.int32())
            words = pa.array([coder.words[k] for k in word.tolist()], pa.binary())
            flat = cls[ids]
            if sums is not None:
                use = np.repeat(b.column(3).to_numpy(zero_copy_only=False), n_ids)
                np.add.at(sums, attention.pair_codes(flat, n_ids, classes)[use], np.int32(1))
            ends = np.concatenate(([0], np.cumsum(n_ids)))
            laid = pa.Array.from_buffers(pa.binary(), len(n_ids), [None, pa.py_buffer((ends * flat.itemsize).astype(np.int32)), pa.py_buffer(flat)])
            none = pa.nulls(len(count), pa.list_(pa.int32()))
            arrays = [b.column(0), b.column(2), pa.array(count, pa.int64()), pa.array(hot), pa.array(base), pa.array(np.add.reduceat(log_own[ids], ends[:-1])), pa.ListArray.from_arrays(cuts, words), pa.ListArray.from_arrays(cuts, pa.array(times, pa.int32())), laid, b.column(3), none, none]
            types = [x.type for x in arrays]
            yield pa.RecordBatch.from_arrays(arrays, names=[*made])
        if types is not None and sums is not None:
            at = np.flatnonzero(sums)
            for lo in range(0, len(at), 1 << 17):
                some = at[lo : lo + (1 << 17)]
                cuts = pa.array([0, len(some)], pa.int32())
                cells = [pa.ListArray.from_arrays(cuts, pa.array(x, pa.int32())) for x in (some, sums[some])]
                yield pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in types[:-2]), *cells], names=[*made])

    return asked.mapInArrow(run, ", ".join(f"{k} {v}" for k, v in made.items()))


def score(rows: DataFrame, fitted: dict, keep: dict[str, Column] | None = None, table_share: float = 0.4) -> DataFrame:
    """doc_id, what ``keep`` computes, n_tokens, n_known, train_tokens, base_score and score, for each of ``rows`` (id, text).

    A class's probability is that of the attention model and, to the share of ``table_share``, that of the table of contexts.
    The rows that the model was fitted on are encoded already.
    """
    keep, total = keep or {}, fitted["total"]
    found = fitted["encoded"] if rows is fitted["rows"] else stored(_encode(rows, fitted), compression="zstd")
    shared = rows.sparkSession.sparkContext.broadcast(tuple(fitted[k] for k in ("model", "contexts", "table")))  # fixed sizes
    asked = found.select("uid", "classes", F.col("id").alias("doc_id"), *(c.alias(k) for k, c in keep.items()), "n_tokens", "n_hot", "base_hot", "own")
    kinds = {f.name: f.dataType.simpleString() for f in asked.schema if f.name not in ("classes", "own")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, contexts, table = shared.value
        scorer, kind = model.scorer(), class_type(model.shape)
        for b in text_slices(batches, 1, 1 << 20):
            texts = [np.frombuffer(x, kind) for x in b.column(1).to_pylist()]
            flat, n_ids = np.concatenate(texts), np.array([len(x) for x in texts])
            each = np.exp(attention.nat_scores(scorer, flat, n_ids))
            each *= 1 - table_share
            each += table_share * table[contexts.codes(flat, n_ids), flat]
            sums = np.add.reduceat(np.log10(each), np.cumsum(n_ids) - n_ids) + b.column("own").to_numpy()
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in kinds), pa.array(sums)], names=[*kinds, "score"])

    scored = stored(asked.mapInArrow(run, ", ".join(f"{k} {v}" for k, v in kinds.items()) + ", score double"))
    rare = fitted["words"].where(F.col("c") * fitted["hot"] < total)
    each = found.select("uid", F.explode(F.arrays_zip("words", "times")).alias("x")).select("uid", F.col("x.words").alias("word"), F.col("x.times").alias("n"))
    sums = each.join(rare, "word").groupBy("uid").agg(F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("base_cold"), F.sum("n").alias("n_cold"))
    minus = float(np.log10(total + fitted["different"] + 1))
    out = scored.join(sums, "uid", "left")
    return out.select(
        "doc_id", *keep, "n_tokens", (F.col("n_hot") + F.coalesce("n_cold", F.lit(0))).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base_hot") + F.coalesce("base_cold", F.lit(0.0)) - F.col("n_tokens") * F.lit(minus)).alias("base_score"), "score",
    )
