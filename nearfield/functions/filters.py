"""Label filters: from a query's anchor label to the closed interval that a row's label must lie in.

Four kinds, one for each label: Shift, IntervalMap, Divide and Interval.  All give DOUBLE bounds; an open end is +infinity.  A
NULL or NaN label lies in no interval, and neither does anything in an interval with a NULL bound.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_SHIFT = 1e-7


@dataclass(frozen=True)
class Shift:
    """anchor - left to anchor + right, each at least LEAST_SHIFT wide."""

    left: float
    right: float

    def bounds(self, anchor: Column, _: Column | None = None) -> tuple[Column, Column]:
        x = anchor.cast("double")
        return x - max(self.left, LEAST_SHIFT), x + max(self.right, LEAST_SHIFT)


@dataclass(frozen=True)
class IntervalMap:
    """The interval of the anchor's category; categories count from 1, and any other has no interval."""

    intervals: tuple[tuple[float, float], ...]

    def bounds(self, anchor: Column, _: Column | None = None) -> tuple[Column, Column]:
        at = anchor.cast("int") - 1
        low, high = (F.array(*(F.lit(float(i[side])) for i in self.intervals)) for side in (0, 1))
        return F.get(low, at), F.get(high, at)


@dataclass(frozen=True)
class Divide:
    """At least the anchor's integer part, divided without remainder."""

    divisor: int

    def bounds(self, anchor: Column, _: Column | None = None) -> tuple[Column, Column]:
        whole = anchor.cast("bigint")
        low = (whole - F.when(whole < 0, -F.pmod(-whole, F.lit(self.divisor))).otherwise(F.pmod(whole, F.lit(self.divisor)))) / F.lit(self.divisor)
        return low.cast("double"), F.lit(float("inf"))


@dataclass(frozen=True)
class Interval:
    """The bounds that the query states itself, in two columns."""

    def bounds(self, anchor: Column, upper: Column | None = None) -> tuple[Column, Column]:
        if upper is None:
            raise ValueError("an Interval filter needs a column for each bound")
        return anchor.cast("double"), upper.cast("double")


Filter = Shift | IntervalMap | Divide | Interval


def with_bounds(queries: DataFrame, filters: Sequence[Filter], anchors: Sequence[str | tuple[str, str]]) -> DataFrame:
    """queries with lo_i and hi_i for each filter; an anchor is a column name, or a pair of them for Interval."""
    if len(filters) != len(anchors):
        raise ValueError(f"{len(filters)} filters for {len(anchors)} anchors")
    added = {}
    for i, (one, anchor) in enumerate(zip(filters, anchors)):
        names = (anchor,) if isinstance(anchor, str) else anchor
        added[f"lo_{i}"], added[f"hi_{i}"] = one.bounds(*(F.col(n) for n in names))
    return queries.withColumns(added) if added else queries


def inside(labels: Sequence[str], numbers: Sequence[int] | None = None) -> Column:
    """Whether every label lies in its interval: the one of its place, or of the number given for it."""
    held = F.lit(True)
    for i, label in zip(range(len(labels)) if numbers is None else numbers, labels):
        held = held & (F.col(label) >= F.col(f"lo_{i}")) & (F.col(label) <= F.col(f"hi_{i}"))
    return held


def range_middle(i: int, least: float) -> Column:
    """The middle of an interval, counted from the label's least value."""
    return (F.col(f"lo_{i}") + F.col(f"hi_{i}")) / 2 - F.lit(float(least))
