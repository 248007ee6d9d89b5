"""Count-min sketches of 64-bit keys, built by partition and merged cell by cell.

A sketch has DEPTH rows of ``width`` cells.  Each task counts its own keys and sends, for each block of cells, the cells
it hit as packed steps, each at most ``most`` times, since only counts up to ``most`` are told apart.  Merging adds
them up.  A key's estimate is the least of its cells: never below its true count (up to ``most``).

What comes back is, for each threshold, one bit for each cell: width * DEPTH / 8 bytes, at most 2 * MAX_WIDTH / 8 = 256 MB
however large the input is; a fuller sketch only overestimates more.  That is what gets broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from nearfield.llm.text_kernels import mix, pack_sorted, release, unpack_sorted

BLOCK, MIN_WIDTH, MAX_WIDTH = 1 << 20, 1 << 20, 1 << 30

PARTIAL = "row int, block int, cells binary"


def width_for(keys: float, load: float = 0.5) -> int:
    """The power of two that holds about that many keys at this load, within the bounds."""
    return int(min(MAX_WIDTH, max(MIN_WIDTH, 1 << int(np.ceil(np.log2(max(1.0, keys / load)))))))


def cells_of(keys: np.ndarray, row: int, width: int) -> np.ndarray:
    return (mix(keys + np.uint64(row * 0x632BE59BD9B4E019 & (1 << 64) - 1)) & np.uint64(width - 1)).astype(np.int64)


def partial_rows(keys: np.ndarray, width: int, depth: int, most: int) -> Iterator[pa.RecordBatch]:
    """A task's own sketch, as rows of PARTIAL."""
    for row in range(depth):
        cells = np.sort(cells_of(keys, row, width))
        if most < len(cells):
            again = np.concatenate([np.zeros(most, bool), cells[most:] == cells[:-most]])
            cells = cells[~again]
        blocks, starts = np.unique(cells // BLOCK, return_index=True)
        packed = [pack_sorted(part - b * BLOCK) for b, part in zip(blocks, np.split(cells, starts[1:]))]
        yield pa.RecordBatch.from_pydict({"row": pa.array([row] * len(blocks), pa.int32()), "block": pa.array(blocks.astype(np.int32)), "cells": pa.array(packed, pa.binary())})


class Sketch:
    """Merged estimates, as far as the thresholds tell them apart."""

    def __init__(self, bits: dict[int, np.ndarray], width: int):
        self.bits, self.width = bits, width

    def at_least(self, keys: np.ndarray, threshold: int) -> np.ndarray:
        """Whether each key's estimate is at least one of the given thresholds."""
        out = np.ones(len(keys), dtype=bool)
        for row, bits in enumerate(self.bits[threshold]):
            cells = cells_of(keys, row, self.width)
            out &= (bits[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8) & 1).astype(bool)
        return out


def merged(partials: DataFrame, width: int, depth: int, thresholds: tuple[int, ...]) -> Sketch:
    """Adds the tasks' sketches up, block by block on the executors."""

    def add(table: pa.Table) -> pa.Table:
        release(table.nbytes)
        hit = np.concatenate([unpack_sorted(packed.as_py()) for packed in table.column("cells")])
        counts = np.bincount(hit, minlength=min(BLOCK, width))
        bits = [np.packbits(counts >= t).tobytes() for t in thresholds]
        n = len(thresholds)
        return pa.table({"row": pa.array([table["row"][0].as_py()] * n, pa.int32()), "block": pa.array([table["block"][0].as_py()] * n, pa.int32()), "threshold": pa.array(thresholds, pa.int32()), "bits": pa.array(bits, pa.binary())})

    rows = partials.groupBy("row", "block").applyInArrow(add, "row int, block int, threshold int, bits binary").toArrow()
    out = {t: np.zeros((depth, width // 8), dtype=np.uint8) for t in thresholds}
    for row, block, threshold, bits in zip(*(rows.column(i) for i in range(4))):
        own = np.frombuffer(bits.as_buffer(), dtype=np.uint8)
        at = block.as_py() * BLOCK // 8
        out[threshold.as_py()][row.as_py(), at : at + len(own)] = own
    return Sketch(out, width)
