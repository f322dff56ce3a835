"""Aggregates over matching rows, as column expressions.

An aggregate is a list of states. A state says how it is computed from right rows (``partial``), merged over partial results
(``merge``, usable in a grouping and in a window), combined from two values, and, where that exists, taken out of a total
again (``invert``). ``final`` makes the result from the states; with no matching row every state is NULL (or 0).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def _plus(a: Column, b: Column) -> Column:
    return F.coalesce(a + b, a, b)


def _minus(total: Column, own: Column) -> Column:
    return total - F.coalesce(own, F.lit(0))


@dataclass(frozen=True)
class State:
    name: str
    partial: Callable[[Column], Column]
    merge: Callable[[Column], Column]
    combine: Callable[[Column, Column], Column]
    invert: Callable[[Column, Column], Column] | None = None
    extreme: str | None = None  # "min" or "max": has no inverse, but a best value with another key can be kept


def summed(name: str, partial: Callable[[Column], Column]) -> State:
    return State(name, partial, F.sum, _plus, _minus)


ROWS = summed("rows", lambda v: F.count(F.lit(1)))
VALUES = summed("values", F.count)
SUM = summed("sum", F.sum)
LEAST = State("least", F.min, F.min, F.least, extreme="min")
MOST = State("most", F.max, F.max, F.greatest, extreme="max")


@dataclass(frozen=True)
class Aggregate:
    """``value`` is a column (or its name) of the right side; ``alias`` names the result."""

    alias: str
    value: Column | str | None
    states: tuple[State, ...]
    final: Callable[..., Column]  # takes the states' columns in order
    kind: str = "custom"

    @property
    def invertible(self) -> bool:
        return all(s.invert for s in self.states)

    @property
    def extreme(self) -> bool:
        return len(self.states) == 1 and self.states[0].extreme is not None


def count(alias: str = "count") -> Aggregate:
    """Matching rows; 0 without any."""
    return Aggregate(alias, None, (ROWS,), lambda n: F.coalesce(n, F.lit(0)), "count")


def sum0(value: Column | str, alias: str = "sum0") -> Aggregate:
    """Sum; 0 without a value."""
    return Aggregate(alias, value, (SUM,), lambda s: F.coalesce(s, F.lit(0)), "sum0")


def sum_(value: Column | str, alias: str = "sum") -> Aggregate:
    """Sum; NULL without a value. The count of values tells that from a sum of 0 when a total is inverted."""
    return Aggregate(alias, value, (SUM, VALUES), lambda s, n: F.when(n > 0, s), "sum")


def min_(value: Column | str, alias: str = "min", empty_value=None) -> Aggregate:
    """Least value; ``empty_value`` (NULL by default) without a value."""
    return Aggregate(alias, value, (LEAST,), lambda m: F.coalesce(m, F.lit(empty_value)), "min")


def max_(value: Column | str, alias: str = "max", empty_value=None) -> Aggregate:
    """Largest value; ``empty_value`` (NULL by default) without a value."""
    return Aggregate(alias, value, (MOST,), lambda m: F.coalesce(m, F.lit(empty_value)), "max")


def avg(value: Column | str, alias: str = "avg") -> Aggregate:
    """Exact mean as a double; NULL without a value."""
    return Aggregate(alias, value, (SUM, VALUES), lambda s, n: F.when(n > 0, s.cast("double") / n), "avg")


def avg_trunc(value: Column | str, alias: str = "avg_trunc") -> Aggregate:
    """Mean of whole numbers, truncated toward zero and then widened to a double; NULL without a value."""
    return Aggregate(alias, value, (SUM, VALUES), lambda s, n: F.when(n > 0, F.call_function("div", s, n).cast("double")), "avg_trunc")


def custom(alias: str, value: Column | str | None, states: list[State], final: Callable[..., Column]) -> Aggregate:
    """An aggregate of one's own, from expressions."""
    return Aggregate(alias, value, tuple(states), final)


def fold(alias: str, value: Column | str, zero: Column, step: Callable[[Column, Column], Column], finish: Callable[[Column], Column] | None = None) -> Aggregate:
    """An arbitrary fold over the matching values, for what has no partial form; its state is the list of values."""
    listed = State("list", F.collect_list, lambda v: F.flatten(F.collect_list(v)), lambda a, b: F.coalesce(F.concat(a, b), a, b))
    return Aggregate(alias, value, (listed,), lambda v: F.aggregate(F.coalesce(v, F.array()), zero, step, *([finish] if finish else [])), "fold")
