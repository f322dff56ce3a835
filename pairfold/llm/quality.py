"""Document quality from a linear-chain conditional random field over lines.

Every line gets one of two labels, bad or good. A line's features come from itself, from the lines before and after it
and from the document (numbers of words and lines); the chain's transition weights tie neighbouring labels. The weights
maximise the conditional likelihood of labelled documents, each of whose lines takes the document's label. At most
``sample`` labelled documents of at most ``longest`` bytes are fitted on, taken by the hash of their ids; that bound is the only
sample, and scoring covers every line of every text. A document's score is the mean of its lines' forward-backward marginals, weighted by
line length.

Defined results: a null text counts as empty, and an empty text is one empty line, so it gets the model's score for
that; repeated ids are scored one by one, and of their texts the first in order is learned from; several labels of an id count as their largest; null labels teach nothing;
if no label can be learned from (or only one kind), every score is 0.5 (or that label's side of it by the fit).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hashed_sample, text_slices

#: Byte classes: 0 other letters and spaces, 1 digit, 2 upper case, 3 punctuation of prose, 4 further symbols, 5 part of a non-ASCII character, 6 sentence end
CLASS = np.zeros(256, np.uint8)
CLASS[48:58] = 1
CLASS[65:91] = 2
CLASS[[ord(c) for c in ",;:'\"-()"]] = 3
CLASS[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = 4
CLASS[128:] = 5
CLASS[[ord(c) for c in ".!?"]] = 6
LINE, DOC = 21, 12


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Features of each line with its neighbours and its document, and the lines' lengths."""
    lines = (text or "").split("\n")
    x = np.zeros((len(lines), LINE), np.float32)
    size = np.zeros(len(lines))
    words_in_all: set[str] = set()
    total = 0
    for i, line in enumerate(lines):
        words = line.split()
        n = len(words)
        size[i] = len(line)
        if not n:
            x[i, 20] = 1
            continue
        raw = line.encode("utf-8", "replace")
        by = np.bincount(CLASS[np.frombuffer(raw, np.uint8)], minlength=7) / len(raw)
        kinds = set(words)
        words_in_all |= kinds
        total += n
        lens = list(map(len, words))
        most = max(lens)
        repeat = sum(map(str.__eq__, words[1:], words)) / n
        short = sum(k <= 3 for k in lens) / n
        x[i, :20] = (np.log1p(len(line)) / 5, np.log1p(n) / 4, (len(line) - n + 1) / n / 8, *by[1:7] * (5, 5, 5, 5, 1, 10), len(kinds) / n, repeat * 3, short, most > 25, n <= 3, n <= 10, n >= 60, lines[i][-1:] in ".!?", by[4] > 0.02, by[6] > 0.004, len(kinds) / n < 0.6)
    before, after = np.vstack((np.zeros((1, LINE), np.float32), x[:-1])), np.vstack((x[1:], np.zeros((1, LINE), np.float32)))
    d = np.zeros(DOC, np.float32)
    d[:4] = 1, np.log1p(total) / 6, np.log1p(len(lines)) / 3, len(words_in_all) / max(total, 1)
    d[4 + min(7, int(np.log2(total + 1) * 0.8))] = 1
    return np.hstack((x, before, after, np.tile(d, (len(lines), 1)))), size


WIDTH = 3 * LINE + DOC


def marginals(score: np.ndarray, trans: np.ndarray, heads: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For chains laid end to end: P(good) of each line, expected transitions (2 x 2) and each chain's log normaliser.

    ``score`` is a line's log odds for good. Chains run side by side, longest first, so a step covers all that are that long.
    """
    order = np.argsort(-lens, kind="stable")
    heads, lens = heads[order], lens[order]
    n, longest = len(lens), int(lens.max(initial=0))
    alive = np.searchsorted(-lens, -np.arange(1, longest + 1), side="right") if n else np.zeros(0, int)
    emit = np.zeros((len(score), 2))
    emit[:, 1] = score
    alpha, beta = np.zeros_like(emit), np.zeros_like(emit)
    add = np.logaddexp
    for t in range(longest):
        at = heads[: alive[t]] + t
        alpha[at] = emit[at]
        if t:
            a = alpha[at - 1]
            alpha[at] += add(a[:, :1] + trans[0], a[:, 1:] + trans[1])
    for t in range(longest - 2, -1, -1):
        at = heads[: alive[t + 1]] + t
        b = beta[at + 1] + emit[at + 1]
        beta[at] = add(b[:, :1] + trans[:, 0], b[:, 1:] + trans[:, 1])
    z = add(*alpha[heads + lens - 1].T) if n else np.zeros(0)
    line_z = np.zeros(len(score))
    line_z[np.repeat(heads, lens) + (np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens))] = np.repeat(z, lens)
    good = np.exp(np.clip(alpha[:, 1] + beta[:, 1] - line_z, -700, 0))
    inner = np.ones(len(score), bool)
    inner[heads] = False
    at = np.flatnonzero(inner)
    pair = alpha[at - 1][:, :, None] + trans + (emit[at] + beta[at])[:, None, :] - line_z[at][:, None, None]
    back = np.empty(n)
    back[order] = z
    return good, np.exp(np.clip(pair, -700, 0)).sum(0), back


def chain_shape(lens: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(lens)[:-1])).astype(int) if len(lens) else np.zeros(0, int)


def fit_chains(x: np.ndarray, lens: np.ndarray, label: np.ndarray, steps: int = 150, ridge: float = 1e-3) -> dict:
    """Weights and transitions that maximise the ridge-penalised conditional likelihood (Adam over all chains)."""
    w, trans = np.zeros(WIDTH), np.zeros((2, 2))
    if len(lens):
        heads, y = chain_shape(lens), np.repeat(label, lens)
        own = np.array([[((lens - 1) * (label == 0)).sum(), 0], [0, ((lens - 1) * (label == 1)).sum()]], float)
        weight = 1.0 / len(lens)
        m = [np.zeros_like(w), np.zeros_like(trans)]
        v = [np.zeros_like(w), np.zeros_like(trans)]
        for step in range(1, steps + 1):
            good, pairs, _ = marginals(x @ w, trans, heads, lens)
            grads = [x.T @ (y - good) * weight - ridge * w, (own - pairs) * weight - ridge * trans]
            for k, (p, g) in enumerate(zip((w, trans), grads)):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                p += 0.1 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return {"w": w, "trans": trans}


def score_texts(model: dict, texts: list[str | None]) -> np.ndarray:
    """Length-weighted mean of the lines' marginals, for each text."""
    made = [line_features(t) for t in texts]
    if not made:
        return np.zeros(0)
    lens = np.array([len(s) for _, s in made])
    heads = chain_shape(lens)
    good, _, _ = marginals(np.vstack([x for x, _ in made]) @ model["w"], model["trans"], heads, lens)
    size = np.concatenate([s for _, s in made]) + 1
    return np.clip(np.add.reduceat(good * size, heads) / np.add.reduceat(size, heads), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 3000, longest: int = 1 << 17) -> dict:
    """Fit on at most ``sample`` labelled documents, the first by the hash of their ids."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
    chosen = hashed_sample(known, ["id"], sample)  # a bounded table: its size is proven by the limit
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    rows = rows.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= longest).groupBy("id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.first("label").alias("label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, 1, 1 << 20):
            made = [line_features(t.as_py())[0].astype(np.float32) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in made], pa.binary()), b.column(2)], names=["id", "x", "label"])

    kind = rows.schema["id"].dataType.simpleString()
    got = rows.mapInArrow(run, f"id {kind}, x binary, label int").toPandas().sort_values("id", kind="stable")
    xs = [np.frombuffer(x, np.float32).reshape(-1, WIDTH) for x in got["x"]]
    lens = np.array([len(x) for x in xs], int)
    return fit_chains(np.vstack(xs).astype(float) if xs else np.zeros((0, WIDTH)), lens, got["label"].to_numpy(int))


def score(df: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, what ``keep`` computes from the row, score and predicted, for each row of ``df``."""
    keep = keep or {}
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *(c.alias(k) for k, c in keep.items()))
    out = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text"), "score double, predicted int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, 1, 1 << 20):
            s = score_texts(model, b.column(1).to_pylist())
            cols = [b.column(i) for i in range(b.num_columns) if i != 1]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*(n for n in b.schema.names if n != "text"), "score", "predicted"])

    return rows.mapInArrow(run, out)


def keep_good(df: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that the model calls good, with all their columns."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, at, 1 << 20):
            yield b.filter(pa.array(score_texts(model, b.column(at).to_pylist()) >= 0.5))

    return df.mapInArrow(run, df.schema)
