"""The logical operator, matching right rows to each left row, and the choice of a strategy for it."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.aggregates import Aggregate, State
from ..functions.theta import Key, Theta, column

K = "__pf_key"
#: Build on the left keys when the right side has more than this many times their rows.
BUILD_LEFT_FACTOR = 10
STRATEGIES = {
    "=": ("pre_right", "pre_left", "join_first", "unique", "nested"),
    "<>": ("pre_right", "pre_left", "two_sided", "nested"),
    "<": ("bucketed", "global", "interval", "nested"),
    "band": ("difference", "nested"),
    "custom": ("nested",),
}


@dataclass
class Matching:
    """One row for each left row: its columns and the aggregates over the right rows that match it."""

    left: DataFrame
    right: DataFrame
    theta: Theta
    aggregates: list[Aggregate]
    strategy: str = "auto"
    hint: str | None = None
    partitions: int | None = None
    left_unique: bool = False
    left_rows: int | None = None
    right_rows: int | None = None
    buckets: int | None = None
    borders: list | None = field(default=None)

    def __post_init__(self) -> None:
        taken = {c.lower() for c in self.left.columns}
        names = [a.alias for a in self.aggregates]
        if not names:
            raise ValueError("no aggregate given")
        if len({n.lower() for n in names}) < len(names) or taken & {n.lower() for n in names}:
            raise ValueError(f"aggregate names {names} must differ from each other and from the left columns")

    @property
    def family(self) -> str:
        return "<" if self.theta.kind in ("<", ">", "<=", ">=") else self.theta.kind

    def states(self) -> list[tuple[str, State, int]]:
        """(column, state, aggregate) of all aggregates."""
        return [(f"__pf_{i}_{s.name}", s, i) for i, a in enumerate(self.aggregates) for s in a.states]

    def left_keyed(self) -> DataFrame:
        out = self.left.withColumn(K, self.theta.key(self.theta.left))
        return out.repartition(self.partitions, K) if self.partitions else out

    def right_keyed(self) -> DataFrame:
        """Key and values of the right rows that can match at all."""
        values = [(F.lit(1) if a.value is None else column(a.value)).alias(f"__pf_v{i}") for i, a in enumerate(self.aggregates)]
        out = self.right.select(self.theta.key(self.theta.right).alias(K), *values).where(F.col(K).isNotNull())
        return out.repartition(self.partitions, K) if self.partitions else out

    def partials(self) -> list[Column]:
        return [s.partial(F.col(f"__pf_v{i}")).alias(c) for c, s, i in self.states()]

    def per_key(self, right: DataFrame | None = None) -> DataFrame:
        """The right side aggregated by key (partial sums before the shuffle)."""
        return (self.right_keyed() if right is None else right).groupBy(K).agg(*self.partials())

    def finish(self, df: DataFrame) -> DataFrame:
        """Left columns and results from a frame that has the left columns and all states."""
        finals = [a.final(*(F.col(c) for c, _, j in self.states() if j == i)).alias(a.alias) for i, a in enumerate(self.aggregates)]
        return df.select(*(F.col(f"`{c}`") for c in self.left.columns), *finals)

    def chosen(self) -> str:
        """The strategy asked for, or the best that the predicate and the aggregates allow."""
        fit = STRATEGIES[self.family]
        if self.strategy != "auto":
            if self.strategy not in fit:
                raise ValueError(f"{self.strategy} does not serve {self.theta.kind}; choose from {fit}")
            if self.family == "<>" and self.strategy in ("pre_right", "pre_left") and not self.can_complement():
                raise ValueError("an aggregate that can neither be inverted nor be min or max needs the nested strategy for <>")
            if any(s.name == "list" for _, s, _ in self.states()) and self.strategy == "two_sided":
                raise ValueError("a fold needs the nested strategy for <>")
            if self.strategy == "difference" and not self.can_subtract():
                raise ValueError("an aggregate without an exact inverse needs the nested strategy for a band")
            return self.strategy
        if self.family == "custom" or self.family == "<>" and not self.can_complement():
            return "nested"
        if self.family == "band":
            return "difference" if self.can_subtract() else "nested"
        if self.family == "<":
            return "bucketed"
        left = estimated_rows(self.left, self.theta.key(self.theta.left)) if self.left_rows is None else self.left_rows
        right = estimated_rows(self.right, self.theta.key(self.theta.right)) if self.right_rows is None else self.right_rows
        return "pre_left" if BUILD_LEFT_FACTOR * left < right else "pre_right"

    def can_complement(self) -> bool:
        return all(a.invertible or a.extreme for a in self.aggregates)

    def can_subtract(self) -> bool:
        """Whether every state has an inverse that is exact, as sums of floating-point values have not."""
        types = self.per_key().schema
        return all(s.invert and not isinstance(types[c].dataType, (T.DoubleType, T.FloatType)) for c, s, _ in self.states())

    def with_theta(self, kind: str, left: Key) -> Matching:
        """The same aggregates for another predicate and left key, by the default strategy."""
        return replace(self, theta=Theta(kind, left, self.theta.right), strategy="auto")


def estimated_rows(df: DataFrame, key: Column) -> float:
    """Rows by Catalyst's statistics: its count where it knows one, else the size of the key column over the key's width; reads no data."""
    keys = df.select(key.alias(K))
    stats = keys._jdf.queryExecution().optimizedPlan().stats()
    known = stats.rowCount()
    if known.isDefined():
        return float(str(known.get()))
    width = 8 + keys._jdf.schema().apply(0).dataType().defaultSize()
    return float(str(stats.sizeInBytes())) / width
