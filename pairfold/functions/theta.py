"""Predicates between a left and a right key."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

Key = str | Column | list[str | Column]


def column(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


@dataclass(frozen=True)
class Theta:
    """``kind`` is =, <>, <, >, <=, >=, band or custom; the predicate reads kind(left key, right key).

    A NULL key, or one with a NULL part, matches nothing. A band holds the right keys from the left key + lo to it + hi.
    """

    kind: str
    left: Key
    right: Key
    test: Callable[[Column, Column], Column] | None = None
    band: tuple | None = None

    def key(self, side: Key) -> Column:
        if not isinstance(side, list):
            return column(side)
        parts = [column(x) for x in side]
        whole = F.struct(*(p.alias(f"k{i}") for i, p in enumerate(parts)))
        known = parts[0].isNotNull()
        for p in parts[1:]:
            known = known & p.isNotNull()
        return F.when(known, whole)

    def holds(self, left: Column, right: Column) -> Column:
        tests = {"=": lambda: left == right, "<>": lambda: left != right, "<": lambda: left < right, ">": lambda: left > right, "<=": lambda: left <= right, ">=": lambda: left >= right}
        return self.test(left, right) if self.test else tests[self.kind]()


def eq(left: Key, right: Key) -> Theta:
    return Theta("=", left, right)


def ne(left: Key, right: Key) -> Theta:
    return Theta("<>", left, right)


def lt(left: Key, right: Key) -> Theta:
    return Theta("<", left, right)


def gt(left: Key, right: Key) -> Theta:
    return Theta(">", left, right)


def le(left: Key, right: Key) -> Theta:
    return Theta("<=", left, right)


def ge(left: Key, right: Key) -> Theta:
    return Theta(">=", left, right)


def theta(left: Key, right: Key, test: Callable[[Column, Column], Column]) -> Theta:
    """Any predicate, given as a function of the two key columns."""
    return Theta("custom", left, right, test)


def band(left: str | Column, right: str | Column, lo, hi) -> Theta:
    """Right keys between the left key + ``lo`` and the left key + ``hi``, both included; numeric keys."""
    return Theta("band", left, right, lambda a, b: (b >= a + F.lit(lo)) & (b <= a + F.lit(hi)), (lo, hi))
