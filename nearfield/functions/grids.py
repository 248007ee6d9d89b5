"""Grid coordinates and Morton codes as expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_BITS = 63


def coordinate(x: Column, left: float, span: float, cells: int) -> Column:
    """The cell of x among equal cells from left to left + span; what lies outside counts to the outermost ones."""
    inner = F.greatest(F.lit(float(left)), F.least(x.cast("double"), F.lit(float(left) + float(span))))
    return F.least(F.floor((inner - F.lit(float(left))) * F.lit(float(cells)) / F.lit(float(span))).cast("bigint"), F.lit(cells - 1).cast("bigint"))


def flattened(coordinates: Sequence[Column], shape: Sequence[int]) -> Column:
    """Row-major number of a cell."""
    out = F.lit(0).cast("bigint")
    for c, size in zip(coordinates, shape):
        out = out * F.lit(size) + c
    return out


def unflattened(number: Column, shape: Sequence[int]) -> list[Column]:
    out, rest = [], number
    for size in reversed(shape):
        out.append(F.pmod(rest, F.lit(size)))
        rest = F.floor(rest / F.lit(size)).cast("bigint")
    return out[::-1]


def _check(dimensions: int, bits: int) -> None:
    if dimensions * bits > MAX_BITS:
        raise ValueError(f"{dimensions} dimensions of {bits} bits don't fit into {MAX_BITS}")


def morton_code(coordinates: Sequence[Column], bits: int) -> Column:
    """The coordinates' bits, highest first, taken in turn."""
    _check(len(coordinates), bits)
    out = F.lit(0).cast("bigint")
    n = len(coordinates)
    for bit in range(bits):
        for i, c in enumerate(coordinates):
            one = F.shiftright(c.cast("bigint"), bit).bitwiseAND(F.lit(1).cast("bigint"))
            out = out.bitwiseOR(F.shiftleft(one, bit * n + (n - 1 - i)))
    return out


def morton_coordinates(code: Column, dimensions: int, bits: int) -> list[Column]:
    """The coordinates that morton_code was given."""
    _check(dimensions, bits)
    out = []
    for i in range(dimensions):
        c = F.lit(0).cast("bigint")
        for bit in range(bits):
            one = F.shiftright(code, bit * dimensions + (dimensions - 1 - i)).bitwiseAND(F.lit(1).cast("bigint"))
            c = c.bitwiseOR(F.shiftleft(one, bit))
        out.append(c)
    return out
