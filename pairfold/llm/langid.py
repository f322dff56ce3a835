"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counting reads every learning text once: each task adds up a dense table (language x bucket) and hands on its non-zero
cells, which Spark sums. The model is a matrix of at most ``buckets`` x number of languages; its size is checked before
it is broadcast. Scoring turns a slice of texts into one array of code points, hashes all n-grams of it, gathers rows of
the matrix and adds them up by document, so no Python loop runs over characters.

Defined results: a null text, or one without a letter, is ``und`` with score 0, as is every text when nothing could be
learned; equal scores go to the language that sorts first; rows whose language or text is null teach nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_slices

ORDERS = (1, 2, 3)
PAD = " " * max(ORDERS)
MODEL_BYTES = 256 << 20
_letters: np.ndarray | None = None


def letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x10000)), bool, 0x10000)
    return _letters


def hashed_ngrams(texts: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the n-grams that start at each character (a column for each order), the document of each character, and whether it is a letter."""
    low = [t.lower() for t in texts]
    lens = np.array([len(t) for t in low], np.int64)
    code = np.frombuffer((PAD.join(low) + PAD).encode("utf-32-le", "surrogatepass"), np.uint32)
    table = letter_table()
    letter = table[np.minimum(code, 0xFFFF)]
    for at in np.flatnonzero(code > 0xFFFF):
        letter[at] = chr(int(code[at])).isalpha()
    c = np.where(letter, code, 32).astype(np.uint64)
    starts = np.concatenate(([0], np.cumsum(lens + len(PAD))[:-1])) if len(lens) else np.zeros(0, np.int64)
    own = np.repeat(starts - np.concatenate(([0], np.cumsum(lens)[:-1])), lens) + np.arange(lens.sum())
    shift, out, h = np.uint64(64 - int(buckets).bit_length() + 1), [], np.zeros_like(c)
    for n in range(1, max(ORDERS) + 1):
        h = h[: len(c) - n + 1] * np.uint64(0x100000001B3) + c[n - 1 :] + np.uint64(n)
        if n in ORDERS:
            out.append(((h[own] * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64))
    return np.stack(out, 1) if out else np.zeros((0, 0), np.int64), np.repeat(np.arange(len(lens)), lens), letter[own]


def count_ngrams(df: DataFrame, text_col: str, label_col: str, buckets: int) -> DataFrame:
    """(label, bucket, n) over all rows; bucket -1 holds the number of documents."""
    rows = df.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(label_col).cast("string").alias("label"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in text_slices(batches, 1, 1 << 20):
            labels, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for label in set(labels):
                mine = [t for t, x in zip(texts, labels) if x == label]
                grams, _, letter = hashed_ngrams(mine, buckets)
                one = sums.setdefault(label, np.zeros(buckets + 1, np.int64))
                one[:buckets] += np.bincount(grams[letter].ravel(), minlength=buckets)
                one[buckets] += len(mine)
        for label, one in sums.items():
            at = np.flatnonzero(one)
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(at), pa.string()), pa.array(np.where(at == buckets, -1, at), pa.int32()), pa.array(one[at], pa.int64())], names=["label", "bucket", "n"])

    return rows.mapInArrow(run, "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n"))


def fit(df: DataFrame, text_col: str = "text", label_col: str = "lang", buckets: int = 1 << 15, alpha: float = 0.5) -> dict:
    """Class names in order, the log-probability matrix (bucket x class) and the log prior."""
    most = MODEL_BYTES // (8 * buckets)
    if df.where(F.col(text_col).isNotNull()).select(F.col(label_col).cast("string").alias("x")).where("x is not null").distinct().limit(most + 1).count() > most:  # before any task counts
        raise ValueError(f"more than {most} labels x {buckets} buckets exceed the model's {MODEL_BYTES} bytes; use fewer buckets")
    cells = count_ngrams(df, text_col, label_col, buckets).toPandas()  # within the model's size
    names = sorted(cells["label"].unique())
    table = np.zeros((buckets + 1, len(names)))
    table[cells["bucket"].to_numpy(), cells["label"].map({x: i for i, x in enumerate(names)}).to_numpy(int)] = cells["n"].to_numpy()  # -1: the last row
    grams, docs = table[:buckets] + alpha, table[buckets] + 1.0
    return {"names": names, "logp": np.log(grams / grams.sum(0)) if names else grams, "prior": np.log(docs / docs.sum()) if names else docs, "buckets": buckets}


def predict_texts(model: dict, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """A class and its posterior for each text."""
    grams, doc, letter = hashed_ngrams([t or "" for t in texts], model["buckets"])
    logit = np.tile(model["prior"], (len(texts), 1))
    has = np.zeros(len(texts), bool)
    grams, doc = grams[letter], doc[letter]
    for at in range(0, len(doc), 1 << 18):  # bounds what is gathered at once, within long texts too
        part, own = grams[at : at + (1 << 18)], doc[at : at + (1 << 18)]
        heads = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        one = sum(np.add.reduceat(model["logp"][part[:, k]], heads, axis=0) for k in range(part.shape[1]))
        logit[own[heads]] += one
        has[own[heads]] = True
    if not model["names"]:
        return ["und"] * len(texts), np.zeros(len(texts))
    best = logit.argmax(1)
    post = 1 / np.exp(logit - logit.max(1, keepdims=True)).sum(1)
    return [model["names"][k] if x else "und" for k, x in zip(best, has)], np.where(has, post, 0.0)


def identify(df: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, what ``keep`` computes from the row, lang_pred and score, for each row of ``df``."""
    keep = keep or {}
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *(c.alias(k) for k, c in keep.items()))
    shared = df.sparkSession.sparkContext.broadcast(model)
    out = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text"), "lang_pred string, score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, 1, 1 << 20):
            names, score = predict_texts(shared.value, b.column(1).to_pylist())
            cols = [b.column(i) for i in range(b.num_columns) if i != 1]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(names, pa.string()), pa.array(score)], names=[*(n for n in b.schema.names if n != "text"), "lang_pred", "score"])

    return rows.mapInArrow(run, out)
