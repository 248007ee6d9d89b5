"""Boxes as intervals of Morton codes."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def z_intervals(boxes: DataFrame, coordinates: Sequence[str], bits: int, levels: int | None = None, key: str = "qid") -> DataFrame:
    """(key, z_lo, z_hi): the intervals of Morton codes that hold the cells of each box (c_lo, c_hi for each coordinate c).

    The cube of all cells is halved in each direction, levels times (by default until single cells); parts within the box
    are done, parts beside it drop out.  With fewer levels the last parts count whole, so the intervals hold some cells outside the box
    too, and none is lost.  Intervals that follow each other are one.  Boxes that are alike are halved once: the work is that of the different ones.
    """
    sides = [f"{c}_{side}" for c in coordinates for side in ("lo", "hi")]
    own = boxes.select(key, *(F.col(s).cast("bigint").alias(s) for s in sides))
    each = _halved(own.select(*sides).distinct().withColumn("__box", F.struct(*sides)), coordinates, bits, levels, "__box")
    each = each.groupBy("__box").agg(F.collect_list(F.struct("z_lo", "z_hi")).alias("__all")).select(*(F.col("__box")[s].alias(s) for s in sides), "__all")
    return own.join(each, sides).select(key, F.inline("__all"))


def _halved(boxes: DataFrame, coordinates: Sequence[str], bits: int, levels: int | None, key: str) -> DataFrame:
    """The same, box by box."""
    n, levels = len(coordinates), bits if levels is None else min(levels, bits)
    now = boxes.select(key, *(F.col(f"{c}_{side}").cast("bigint").alias(f"{side}{i}") for i, c in enumerate(coordinates) for side in ("lo", "hi")))
    meets = " AND ".join(f"lo{i} <= hi{i} AND lo{i} < {1 << bits} AND hi{i} >= 0" for i in range(n))
    now = now.where(meets).withColumns({"z": F.lit(0).cast("bigint"), "level": F.lit(0), "done": F.lit(False), **{f"p{i}": F.lit(0).cast("bigint") for i in range(n)}})
    fields = ["z", "level", "done", *(f"p{i}" for i in range(n))]
    for level in range(1, levels + 1):
        size = 1 << bits - level
        parts = []
        for half in product((0, 1), repeat=n):
            # the first coordinate has the highest bit, as in morton_code
            number = sum(b << n - 1 - i for i, b in enumerate(half))
            own = [f"(2 * p{i} + {b})" for i, b in enumerate(half)]
            within = " AND ".join(f"{p} * {size} >= lo{i} AND {p} * {size} + {size - 1} <= hi{i}" for i, p in enumerate(own))
            parts.append(f"named_struct('z', z * {1 << n} + {number}L, 'level', {level}, 'done', {within}, " + ", ".join(f"'p{i}', {p}" for i, p in enumerate(own)) + ")")
        beside = " OR ".join(f"c.p{i} * {size} > hi{i} OR c.p{i} * {size} + {size - 1} < lo{i}" for i in range(n))
        itself = "named_struct(" + ", ".join(f"'{f}', {f}" for f in fields) + ")"
        now = now.withColumn("c", F.explode(F.expr(f"if(done, array({itself}), filter(array({', '.join(parts)}), c -> NOT ({beside})))")))
        now = now.select(key, *(f"{side}{i}" for i in range(n) for side in ("lo", "hi")), "c.*")
    cells = F.expr(f"shiftleft(1L, {n} * ({bits} - level))")
    found = now.select(key, (F.col("z") * cells).alias("z_lo"), ((F.col("z") + 1) * cells - 1).alias("z_hi"))
    order = Window.partitionBy(key).orderBy("z_lo")
    found = found.withColumn("new", F.coalesce(F.lag("z_hi").over(order) + 1 != F.col("z_lo"), F.lit(True)).cast("int"))
    found = found.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return found.groupBy(key, "run").agg(F.min("z_lo").alias("z_lo"), F.max("z_hi").alias("z_hi")).drop("run")
