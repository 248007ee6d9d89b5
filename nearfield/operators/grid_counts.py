"""Counts by grid cell, their n-dimensional prefix sums, and counts of boxes from either."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cell_counts(placed: DataFrame, coordinates: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., coordinates..., cnt) of the cells that hold rows."""
    return placed.groupBy(*by, *coordinates).agg(F.count("*").alias("cnt"))


def prefix_sums(counts: DataFrame, coordinates: Sequence[str], shape: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """(by..., coordinates..., cnt, cum) of every cell of the grid: cum counts the cells at or below it in all coordinates.

    The dense grid is made here, so its size is the product of shape for each group.
    """
    groups = counts.select(*by).distinct() if by else counts.sparkSession.range(1).select()
    dense = groups
    for name, size in zip(coordinates, shape):
        dense = dense.withColumn(name, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(size - 1).cast("bigint"))))
    out = dense.join(counts, [*by, *coordinates], "left").withColumn("cnt", F.coalesce("cnt", F.lit(0).cast("bigint"))).withColumn("cum", F.col("cnt"))
    for name in coordinates:
        others = [*by, *(c for c in coordinates if c != name)]
        out = out.withColumn("cum", F.sum("cum").over(Window.partitionBy(*others).orderBy(name).rowsBetween(Window.unboundedPreceding, 0)))
    return out


def compressed(sums: DataFrame, coordinates: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """The prefix sums without the cells that repeat their neighbour's below in the last coordinate."""
    last = coordinates[-1]
    before = F.lag("cum").over(Window.partitionBy(*by, *coordinates[:-1]).orderBy(last))
    return sums.withColumn("__before", before).where(F.col("__before").isNull() | (F.col("__before") != F.col("cum"))).drop("__before", "cnt")


def changes(sums: DataFrame, coordinates: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """The compressed prefix sums as runs: each holds from its last coordinate up to the cell before until, and none is zero."""
    last = coordinates[-1]
    after = F.lead(last).over(Window.partitionBy(*by, *coordinates[:-1]).orderBy(last))
    return compressed(sums, coordinates, by).withColumn("until", F.coalesce(after, F.lit((1 << 62)))).where("cum > 0")


def box_counts_from_changes(runs: DataFrame, boxes: DataFrame, coordinates: Sequence[str], key: str = "qid", by: Sequence[str] = ()) -> DataFrame:
    """(key, by..., cnt) of boxes(key, by..., c_lo, c_hi for each coordinate c), each counted in the group that by names, from changes().

    Each of the 2^n corners of a box is the sum of one run: the one that holds its last coordinate among those with its others.
    """
    corners = []
    for low in product((False, True), repeat=len(coordinates)):
        at = [((F.col(f"{c}_lo") - 1) if one else F.col(f"{c}_hi")).cast("bigint").alias(c) for c, one in zip(coordinates, low)]
        corners.append(F.struct(*at, F.lit((-1) ** sum(low)).alias("sign")))
    asked = boxes.select(key, *by, F.explode(F.array(*corners)).alias("corner")).select(key, *by, "corner.*")
    last = coordinates[-1]
    asked = asked.where(" AND ".join(f"{c} >= 0" for c in coordinates)).withColumnRenamed(last, "__at")
    found = asked.join(runs.hint("merge"), [*by, *coordinates[:-1]]) if by or len(coordinates) > 1 else asked.join(F.broadcast(runs))
    found = found.where((F.col("__at") >= F.col(last)) & (F.col("__at") < F.col("until")))
    return found.groupBy(key, *by).agg(F.sum(F.col("cum") * F.col("sign")).alias("cnt"))


def box_counts(counts: DataFrame, boxes: DataFrame, coordinates: Sequence[str], key: str = "qid", by: Sequence[str] = ()) -> DataFrame:
    """(key, by..., cnt): rows in each box (c_lo, c_hi for each coordinate c), straight from the cells; empty boxes drop out."""
    held = F.lit(True)
    for c in coordinates:
        held = held & F.col(c).between(F.col(f"{c}_lo"), F.col(f"{c}_hi"))
    return counts.join(boxes, held).groupBy(key, *by).agg(F.sum("cnt").alias("cnt"))


def box_counts_from_sums(sums: DataFrame, boxes: DataFrame, coordinates: Sequence[str], key: str = "qid", by: Sequence[str] = ()) -> DataFrame:
    """The same by inclusion and exclusion: an equi-join for the 2^n corners of each box.

    The sums are broadcast where they are as few as a parameter says (F.broadcast); the corners, 2^n for each box, never are.
    """
    corners = []
    for low in product((False, True), repeat=len(coordinates)):
        at = [((F.col(f"{c}_lo") - 1) if one else F.col(f"{c}_hi")).cast("bigint").alias(c) for c, one in zip(coordinates, low)]
        corners.append(F.struct(*at, F.lit((-1) ** sum(low)).alias("sign")))
    asked = boxes.select(key, F.explode(F.array(*corners)).alias("corner")).select(key, "corner.*")
    # the planner takes the exploded corners for as few bytes as the boxes, and would broadcast them: a merge where sums aren't broadcast
    found = asked.hint("merge").join(sums.select(*by, *coordinates, "cum"), list(coordinates))
    return found.groupBy(key, *by).agg(F.sum(F.col("cum") * F.col("sign")).alias("cnt"))


def intersecting(queries: DataFrame, cells: DataFrame, dimensions: int, left: str = "", right: str = "cell_") -> DataFrame:
    """Pairs of queries (lo_i, hi_i) and cells (cell_lo_i, cell_hi_i) whose closed boxes meet."""
    meet = F.lit(True)
    for i in range(dimensions):
        meet = meet & (F.col(f"{left}hi_{i}") >= F.col(f"{right}lo_{i}")) & (F.col(f"{right}hi_{i}") >= F.col(f"{left}lo_{i}"))
    return queries.join(cells, meet)


def expanded(segments: DataFrame, start: str = "start", length: str = "length", name: str = "position") -> DataFrame:
    """A row for each position of each segment; empty segments give none."""
    return segments.where(F.col(length) > 0).withColumn(name, F.explode(F.sequence(F.col(start), F.col(start) + F.col(length) - 1)))


def gathered(segments: DataFrame, rows: DataFrame, place: str, start: str = "start", length: str = "length") -> DataFrame:
    """segments' columns beside the rows whose place lies in the segment: an equi-join on places, a row for each.

    A segment of any length is dealt out by the places that it holds, so no task has to take one whole.
    """
    return expanded(segments, start, length, "__place").join(rows, F.col("__place") == rows[place]).drop("__place", start, length)
