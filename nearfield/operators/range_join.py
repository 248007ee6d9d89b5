"""Join of queries with the rows whose labels lie in the queries' intervals.

A few queries are broadcast and tested against each row in one pass over the data: at most MAX_BROADCAST of them, of BROADCAST_BYTES at most.
Beyond that both sides meet by grid cell instead: a row has one cell, a query one for each cell that its box meets, so the join is an
equi-join, and the exact test follows.  Wide queries have coarser cells of their own, and full cells are cut into pieces (dealt_cells).
Without labels, where every row meets every query, the queries come in blocks of that size, each broadcast and held against the data.

Either way, the least and greatest bound over all queries are put on the scan as constants, where they reach Parquet's statistics.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.functions.filters import inside
from nearfield.sources.lineage import cut

MAX_BROADCAST, BROADCAST_BYTES = 5_000, 128 << 20
#: Queries for which few rows are dealt over one more task.
QUERIES_A_TASK = 256
#: Cells along a label at the finest level and a query's most cells; levels, the finest first; rows of a cell that stay together.
CELLS, MAX_CELLS, LEVELS, PIECE = 64, 256, (6, 4, 2, 0), 100_000


def label_extent(data: DataFrame, labels: Sequence[str]) -> list[tuple[float, float]]:
    """Least and greatest value of each label, in one pass; NaN left out."""
    if not labels:
        return []
    clean = [F.when(~F.isnan(F.col(name).cast("double")), F.col(name).cast("double")) for name in labels]
    row = data.agg(*(f(c).alias(f"{kind}_{i}") for i, c in enumerate(clean) for kind, f in (("lo", F.min), ("hi", F.max)))).first()
    return [(row[f"lo_{i}"] if row[f"lo_{i}"] is not None else 0.0, row[f"hi_{i}"] if row[f"hi_{i}"] is not None else 0.0) for i in range(len(labels))]


def _bytes(queries: DataFrame) -> Column:
    """About how many bytes a query takes: 8 for each number, twice that for each column."""
    total = F.lit(16 * len(queries.columns)).cast("long")
    for field in queries.schema:
        if isinstance(field.dataType, T.ArrayType):
            inner = F.coalesce(F.size(F.get(field.name, F.lit(0))), F.lit(1)) if isinstance(field.dataType.elementType, T.ArrayType) else F.lit(1)
            total = total + 8 * F.greatest(F.size(field.name), F.lit(0)) * inner
    return total


def bounded(data: DataFrame, queries: DataFrame, labels: Sequence[str], numbers: Sequence[int]) -> tuple[DataFrame, int, int]:
    """data within the union of all intervals, label by label, and the number of queries and their bytes."""
    row = queries.agg(F.count("*").alias("n"), F.sum(_bytes(queries)).alias("bytes"), *(f(f"{kind}_{i}").alias(f"{kind}_{i}") for i in numbers for kind, f in (("lo", F.min), ("hi", F.max)))).first()
    for i, name in zip(numbers, labels):
        if row[f"lo_{i}"] is not None:
            data = data.where(F.col(name) >= F.lit(row[f"lo_{i}"]))
        if row[f"hi_{i}"] is not None and row[f"hi_{i}"] != float("inf"):
            data = data.where(F.col(name) <= F.lit(row[f"hi_{i}"]))
    return data, row["n"], row["bytes"] or 0


def range_join(data: DataFrame, queries: DataFrame, labels: Sequence[str], max_broadcast: int = MAX_BROADCAST, numbers: Sequence[int] | None = None) -> DataFrame:
    """data's columns beside queries' columns (lo_i and hi_i among them), for each row inside each query's intervals.

    Label j is held against interval numbers[j], by default j.
    """
    numbers = list(range(len(labels)) if numbers is None else numbers)
    data, n, size = bounded(data, queries, labels, numbers)
    if n <= max_broadcast and size <= BROADCAST_BYTES:
        return data.join(F.broadcast(queries), inside(labels, numbers))
    if labels:
        return cell_join(data, queries, labels, numbers)
    return _in_blocks(data, queries, F.lit(True), n, size, max_broadcast)


def _in_blocks(rows: DataFrame, queries: DataFrame, condition: Column, n: int, size: int, max_broadcast: int) -> DataFrame:
    blocks, out = 1 + max(size // BROADCAST_BYTES, n // max(1, max_broadcast)), None
    for block in range(blocks):
        own = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == block)
        own = rows.join(F.broadcast(own), condition)
        out = own if out is None else out.unionAll(own)
    return out


def against(rows: DataFrame, queries: DataFrame, condition: Column, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """rows beside all queries for which the condition holds; queries come in blocks that can be broadcast, and are held against all rows.

    For rows that are few for each query: lists, parts, sub-clusters.  As they may lie in one file, they are dealt over more tasks where queries are many.
    """
    n, size = queries.agg(F.count("*"), F.sum(_bytes(queries))).first()
    tasks = min(2 * rows.sparkSession.sparkContext.defaultParallelism, 1 + n // QUERIES_A_TASK)
    return _in_blocks(rows.repartition(tasks) if tasks > 1 else rows, queries, condition, n, size or 0, max_broadcast)


def _quantiles(data: DataFrame, labels: Sequence[str]) -> list[list[float]]:
    """For each label, the values that cut its rows into CELLS about equal shares, each value once."""
    shares = [i / CELLS for i in range(1, CELLS)]
    clean = [F.when(~F.isnan(F.col(n).cast("double")), F.col(n).cast("double")) for n in labels]
    row = data.agg(*(F.percentile_approx(c, shares, 10_000).alias(f"q{i}") for i, c in enumerate(clean))).first()
    return [sorted(set(q or [])) for q in row]


def _cell(x: Column, bounds: Sequence[float]) -> Column:
    """How many of the ascending bounds aren't greater than x, by halving; null for null."""
    if not bounds:
        return F.when(x.isNotNull(), F.lit(0))
    x, held = x.cast("double"), F.array(*map(F.lit, bounds))
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    found = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda c, s: F.when((c + s <= len(bounds)) & (F.get(held, c + s - 1) <= x), c + s).otherwise(c))
    return F.when(x.isNotNull(), found)


def dealt_cells(data: DataFrame, queries: DataFrame, labels: Sequence[str], numbers: Sequence[int]) -> tuple[DataFrame, DataFrame, list[str]]:
    """data's and queries' rows beside the cells where they meet, and the key columns.

    Cells are bounded by quantiles, so that they hold about as many rows each as far as labels differ.  Each query has a level of its own: the finest of
    LEVELS (halvings of the grid along each label) at which its box has MAX_CELLS cells at most; a row has a cell for each level in use.  A cell with
    more than PIECE rows is cut into pieces by the rows' hash, and its queries go to each piece.
    """
    bounds = _quantiles(data, labels)
    corners = {f"__{side}{j}": _cell(F.col(f"{side}_{n}"), bounds[j]) for j, n in enumerate(numbers) for side in ("lo", "hi")}
    fits, most = F.lit(LEVELS[-1]), (CELLS - 1).bit_length()
    for level in reversed(LEVELS[:-1]):
        size = F.lit(1).cast("bigint")
        for j in range(len(labels)):
            size = size * (F.shiftright(F.col(f"__hi{j}"), most - level) - F.shiftright(F.col(f"__lo{j}"), most - level) + 1)
        fits = F.when(size <= MAX_CELLS, level).otherwise(fits)
    boxes = queries.withColumns(corners).where(" AND ".join(f"__lo{j} <= __hi{j}" for j in range(len(labels)))).withColumn("__level", fits)
    used = [r[0] for r in boxes.select("__level").distinct().collect()]  # of LEVELS
    for j in range(len(labels)):
        boxes = boxes.withColumn(f"__c{j}", F.explode(F.expr(f"sequence(shiftright(__lo{j}, {most} - __level), shiftright(__hi{j}, {most} - __level))")))
    boxes = boxes.drop(*corners)
    placed = data.withColumns({f"__a{j}": _cell(F.col(n), bounds[j]) for j, n in enumerate(labels)}).withColumn("__level", F.explode(F.array(*map(F.lit, used))) if used else F.lit(0))
    placed = placed.withColumns({f"__c{j}": F.expr(f"shiftright(__a{j}, {most} - __level)") for j in range(len(labels))}).drop(*(f"__a{j}" for j in range(len(labels))))
    keys = ["__level", *(f"__c{j}" for j in range(len(labels)))]
    pieces = F.ceil(F.col("count") / F.lit(PIECE)).cast("int").alias("__pieces")
    large = cut(placed.groupBy(*keys).count().where(F.col("count") > PIECE).select(*keys, pieces))
    large = F.broadcast(large) if large.count() <= MAX_BROADCAST else large
    own = F.xxhash64(*(F.col(f.name) for f in data.schema if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))))
    placed = placed.join(large, keys, "left").withColumn("__piece", F.pmod(own, F.coalesce("__pieces", F.lit(1))).cast("int")).drop("__pieces")
    boxes = boxes.join(large, keys, "left").withColumn("__piece", F.explode(F.sequence(F.lit(0), F.coalesce("__pieces", F.lit(1)) - 1))).drop("__pieces")
    return placed, boxes, [*keys, "__piece"]


def cell_join(data: DataFrame, queries: DataFrame, labels: Sequence[str], numbers: Sequence[int]) -> DataFrame:
    """The same by an equi-join on grid cells."""
    placed, boxes, keys = dealt_cells(data, queries, labels, numbers)
    return placed.join(boxes, keys).where(inside(labels, numbers)).drop(*keys)
