"""Helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


#: Upper case to lower case; ASCII other than digits and letters to a space; bytes of non-ASCII characters as they are.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Bits of a set of hashes (1 MB), a fixed size.
FILTER_BITS = 1 << 23


def marked_bits(ids: DataFrame, hashed: bool = True) -> DataFrame:
    """(word, bits): a bit set of the hashes of column x (or of x itself), at most FILTER_BITS / 64 rows, whatever the number of ids."""
    at = ids.select((F.pmod(F.xxhash64("x"), F.lit(FILTER_BITS)) if hashed else F.expr(f"x & {FILTER_BITS - 1}L")).cast("int").alias("at"))
    return at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, at & 63)")).alias("bits"))


def bit_set(marked: DataFrame) -> np.ndarray:
    """A bit set as one array of fixed size."""
    words = marked.toPandas()
    out = np.zeros(FILTER_BITS >> 6, np.int64)
    out[words["word"].to_numpy(int)] = words["bits"].to_numpy(np.int64)
    return out


def in_bits(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the set holds each number, taken modulo its size."""
    at = at & (FILTER_BITS - 1)
    return (bits[at >> 6] >> (at & 63)) & 1 == 1


def without(df: DataFrame, keys: list[Column], drop: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``keys`` are not in ``drop`` (columns x, y, ...), with all their columns.

    Most rows are let through by a bit set of fixed size over the first keys to drop; only those that it marks are compared
    with these keys, so most texts are never dealt anew. Null keys stay.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    at = F.pmod(F.xxhash64("x"), F.lit(FILTER_BITS)).cast("int")
    rows = df.select(row.alias("row"), *(k.alias(c) for k, c in zip(keys, drop.columns))).withColumn("at", at).withColumn("word", F.shiftright("at", 6))
    bits = stored(marked_bits(drop))  # of fixed size
    marked = rows.join(F.broadcast(bits), "word", "left").withColumn("hit", F.col("bits").isNotNull() & F.expr("(bits & shiftleft(1L, at & 63)) <> 0"))
    return marked.where("not hit").select("row").unionByName(marked.where("hit").join(drop, drop.columns, "left_anti").select("row")).select("row.*")


def hashed_sample(rows: DataFrame, by: list[str], most: int, where: Column | None = None) -> DataFrame:
    """At most ``most`` of the rows (of those where ``where`` holds), the first by the hash of the columns ``by``; equal data, equal sample.

    The rows are counted first, and only the share of hashes that holds about twice as many is ordered, so that tasks hand few
    rows to the one that orders them, however many tasks there are.
    """
    count = rows.count()
    h = F.xxhash64(*by)
    near = F.pmod(F.xxhash64(F.lit(1), *by), F.lit(1 << 30)) < min(1 << 30, (1 << 31) * most // max(count, 1) + 1)
    return rows.where(near if where is None else near & where).orderBy(h, *by).limit(most)


def text_slices(batches: Iterator[pa.RecordBatch], column: int = 1, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts of a slice stay near ``max_bytes``; a longer text has a slice of its own."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for i, size in enumerate(sizes):
            if total and total + size > max_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        yield batch.slice(start, n - start)
