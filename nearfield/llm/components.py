"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.shared_store import written


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(a, b): the smallest node of its component.

    Alternating large-star and small-star steps, each a minimum by node and a join, until the edges no longer change.
    A node's neighbours are never gathered in one place, and every step is written to the shared folder.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while (mark := tuple(now.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())) != before:
        before = mark
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.expr("array(struct(a, m AS b), struct(b AS a, m AS b))")).alias("e")).select("e.*")
        now = written(small.where("a <> b").distinct(), "edges")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionAll(roots.select(F.col("root").alias("node"), "root")).groupBy("node").agg(F.min("root").alias("root"))
