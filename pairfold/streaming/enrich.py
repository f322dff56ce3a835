"""A stream as the left side, matched with a static right side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..functions.aggregates import Aggregate
from ..functions.theta import Theta
from ..operators.api import match_aggregate


def stream_match(left: DataFrame, right: DataFrame, on: Theta, aggregates: list[Aggregate], sink: Callable[[DataFrame, int], None], **options) -> DataStreamWriter:
    """A writer that hands each micro-batch of ``left``, joined with ``right``, to ``sink``; start it with a checkpoint location."""
    return left.writeStream.foreachBatch(lambda batch, n: sink(match_aggregate(batch, right, on, aggregates, **options), n))
