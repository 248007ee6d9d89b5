"""Rows as such: quoted names, what identifies a row by its text, and dropping rows from whole documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys of dropped rows that are broadcast (about 100 MB in an executor); of more, documents are shuffled to a join.
MAX_BROADCAST_KEYS = 1_000_000


def quoted(name: str) -> str:
    """A column's name as an expression, whatever it holds."""
    return "`" + name.replace("`", "``") + "`"


def column(frame: DataFrame, name: str) -> Column:
    return frame[quoted(name)]


def all_columns(frame: DataFrame, but: tuple[str, ...] = ()) -> list[Column]:
    """All columns but those named like one of the given ones; names differ by more than their case."""
    left = {b.lower() for b in but}
    return [column(frame, c) for c in frame.columns if c.lower() not in left]


def numbered(frame: DataFrame) -> DataFrame:
    """frame with its columns named c0, c1...: Spark's Arrow functions can't take names with dots."""
    return frame.toDF(*(f"c{i}" for i in range(len(frame.columns))))


def fingerprint(text: Column) -> list[Column]:
    """Two 64-bit hashes of a text: rows that agree in both are taken for the same text."""
    return [F.xxhash64(text), F.xxhash64(F.lit(1), text)]


def without(documents: DataFrame, keys: list[Column], gone: DataFrame) -> DataFrame:
    """documents without the rows whose keys are a row of gone, which is written and holds each key once; null keys match null ones."""
    if gone.count() <= MAX_BROADCAST_KEYS:
        gone = F.broadcast(gone)
    same = F.lit(True)
    for own, name in zip(keys, gone.columns):
        same = same & own.eqNullSafe(gone[name])
    return documents.join(gone, same, "left_anti")
