"""Tables laid out in parts, so that a batch of queries reads those alone that it needs.

A part is a folder ``part=<n>`` with the rows of one range of the order's columns, sorted by them.  The manifest says what each part
holds: a row for each part and value of the key columns, with its number of rows and the least and greatest value of one more column.  What
is read is found in the manifest first, and reaches the scan as a list of part numbers, which Spark prunes folders by.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows for which there is one part, and parts that even a small table has.
ROWS_A_PART, LEAST_PARTS = 200_000, 8


@dataclass(frozen=True)
class Layout:
    """Columns by whose ranges rows are dealt into parts, those that the manifest tells apart, and the one that it bounds."""

    order: tuple[str, ...] = ("id",)
    keys: tuple[str, ...] = ()
    bounded: str = "id"


def write_parts(rows: DataFrame, path: str, layout: Layout, parts: int, key: str = "id") -> None:
    """Rows with equal order go into several parts too, by a hash of their key, where they are too many for one."""
    tie = "__tie"
    dealt = rows.drop("part").withColumn(tie, F.xxhash64(key)).repartitionByRange(parts, *layout.order, tie)
    dealt.withColumn("part", F.spark_partition_id()).sortWithinPartitions("part", *layout.order, tie).drop(tie).write.mode("overwrite").partitionBy("part").parquet(path)


def read_parts(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table of a folder; schema is that of its rows, without or with part."""
    own = T.StructType([*(f for f in schema if f.name != "part"), T.StructField("part", T.IntegerType())])
    return spark.read.schema(own).parquet(path)


def manifest(table: DataFrame, layout: Layout) -> DataFrame:
    """(part, keys..., low, high, rows)."""
    return table.groupBy("part", *layout.keys).agg(F.min(layout.bounded).alias("low"), F.max(layout.bounded).alias("high"), F.count("*").alias("rows"))


def numbers(wanted: DataFrame) -> list[int]:
    """The parts of a table of (part, ...); a table has as many as it has rows for ROWS_A_PART."""
    return sorted(r[0] for r in wanted.select("part").distinct().collect())


def only(table: DataFrame, parts: Sequence[int]) -> DataFrame:
    return table.where(F.col("part").isin(list(parts)))
