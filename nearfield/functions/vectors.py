"""Distances between array columns, in DOUBLE and inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)


def squared_l2(left: str | Column, right: str | Column) -> Column:
    """Sum of squared differences; NULL if the lengths differ."""

    def term(x: Column, y: Column) -> Column:
        return (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))

    return _sum(F.zip_with(left, right, term))


def dot(left: str | Column, right: str | Column) -> Column:
    return _sum(F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double")))


def cosine_distance(left: str | Column, right: str | Column) -> Column:
    return 1 - dot(left, right) / (F.sqrt(dot(left, left)) * F.sqrt(dot(right, right)))


def looked_up(table: str | Column, codes: str | Column) -> Column:
    """Sum of table[i][codes[i]]: the distance that a product-quantised vector has by a query's table."""
    return _sum(F.zip_with(table, codes, lambda row, code: F.get(row, code)))
