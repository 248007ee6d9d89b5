"""Places in a sorted order, without one task that sees all rows: rows are dealt by ranges of the key, and only the ranges' counts are
added up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.sources.lineage import cut

def with_places(rows: DataFrame, key: Sequence[str], name: str = "place") -> DataFrame:
    """rows with their place, from 0, in the order of the key's columns; rows with equal keys follow each other in any order."""
    dealt = cut(rows.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("__at", F.monotonically_increasing_id()))
    # the number of a row holds its range in the upper bits and its place within in the lower ones
    part = F.shiftright("__at", 33)
    counts = dealt.groupBy(part.alias("__part")).count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = counts.select("__part", before.alias("__first"))  # one row for each range
    out = dealt.withColumn("__part", part).join(F.broadcast(first), "__part")
    return out.withColumn(name, F.col("__first") + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__at", "__part", "__first")


def ranks(values: DataFrame, value: str, ends: DataFrame, end: str, closed: str) -> DataFrame:
    """ends with below: how many values are less than the end or, where closed holds, not greater.  Null and NaN values count nowhere; a null
    end has none below it, and a NaN end all.

    One pass over both in their common order: equal values are one row with their number, an open end comes before the values equal to it and a
    closed one after them, and a running sum of the numbers is what is below.  Rows are dealt by ranges of that order, so each task adds up its own
    range, and only the ranges' sums are brought together.
    """
    x = lambda frame, name: (frame[name].cast("double") + F.lit(0.0)).alias("x")  # noqa: E731  zeros without a sign
    counted = values.select(x(values, value)).where("x IS NOT NULL AND NOT isnan(x)").groupBy("x").agg(F.count("*").alias("n")).select("x", F.lit(1).alias("kind"), "n")
    asked = ends.select(x(ends, end), F.when(F.col(closed), 2).otherwise(0).alias("kind")).distinct().withColumn("n", F.lit(0).cast("long"))
    dealt = cut(counted.unionAll(asked).repartitionByRange("x", "kind").withColumn("part", F.spark_partition_id()))
    sums = dealt.groupBy("part").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = sums.select("part", before.alias("first"))  # one row for each range
    within = F.sum("n").over(Window.partitionBy("part").orderBy("x", "kind").rowsBetween(Window.unboundedPreceding, 0))
    found = dealt.withColumn("within", within).where("kind <> 1").join(F.broadcast(first), "part")
    found = found.select(F.col("x").alias("__x"), F.col("kind").alias("__kind"), (F.col("first") + F.col("within")).alias("below"))
    same = (ends[end].cast("double") + F.lit(0.0)).eqNullSafe(found["__x"]) & (F.when(ends[closed], 2).otherwise(0) == found["__kind"])
    return ends.join(found, same).select(*(ends[c] for c in ends.columns), "below")
