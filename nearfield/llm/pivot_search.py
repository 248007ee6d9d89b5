"""Operator 7: exact top-k by inner product, with pivot-table elimination.

1. Table.  Each vector's distances to many pivots are computed once and written to the shared folder beside it.  The pivots, at most
   PIVOTS and three quarters of the vectors' length, are picked from a bounded sample, each as far as possible from the span of those
   before; they change how much is skipped, never the result.  Vectors lie in blocks by their nearest pivot.
2. Bounds.  For integer vectors 2 q.x = |q|^2 + |x|^2 - d(q, x)^2, so a lower bound of the distance is an upper bound of the score.
   One pivot gives d(q, x) >= |d(q, p) - d(x, p)|.  The largest lower bound that all of a table's distances prove together is larger:
   they fix where q and x lie in the pivots' span, and how far off it, so only the angle between the two remainders is unknown.
   That bound is one matrix product for a block, and it is the one used for vectors.
3. A query first searches the block that it lies in: its k-th best score there is the least that counts elsewhere.  Each block's
   interval of distances from each pivot bounds the scores of all its vectors, so blocks that can't win are never opened; the others
   get the query with its least score.  In a block a query's candidates are scored in the order of their bounds, in steps, until the
   next bound lies under the k-th best score.

Scores are exact: sums of integer products in doubles up to 2^53, in Python's integers beyond.  One beyond the range of long is given
as the nearest long.  Blocks of queries and vectors are of bounded size; the blocks' intervals are held in chunks of CHUNK_BLOCKS.

Defined cases: vectors that are null, or hold null or non-finite components (or ones beyond 1e150), take no part, nor do empty ones; a
query meets only vectors of its own length; rows with a null id take no part as candidates or queries; rows that share a vec_id are no
candidates of each other, are each a candidate (once, with their best score) of others, and as queries give one list of
their best scores; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearfield.llm.shared_store import small_batches, written

PIVOTS, SAMPLE, STEP = 256, 2048, 64
#: Vectors and queries of a block at most, and vectors for which there is a group of their own at least.
BLOCK_VECTORS, BLOCK_QUERIES, GROUP_VECTORS = 16_384, 2048, 2048
#: Queries whose bounds are held at a time, block intervals that a worker holds at a time, rows of an Arrow batch of queries.
CHUNK_QUERIES, CHUNK_BLOCKS, CHUNK_ROWS = 256, 50_000, 2048
_BLOCK = ["size", "grp", "piece"]
_LONG = np.iinfo(np.int64)


def integer_vectors(table: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v array<double>): floor(scale * x) of each usable vector."""
    clean = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x")).where("id IS NOT NULL AND size(x) > 0")
    clean = clean.where("forall(x, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) <= 1e150D)")
    # from 2^52 on a double is whole already
    return clean.select("id", F.expr(f"transform(x, c -> if(abs({scale} * c) < 4503599627370496D, double(floor({scale} * c)), {scale} * c))").alias("v"))


@dataclass
class Pivots:
    """Pivots of one vector length, independent of each other, and their coordinates in an orthonormal basis of their span."""

    points: np.ndarray
    lower: np.ndarray

    @classmethod
    def of(cls, sample: np.ndarray) -> Pivots:
        rest, chosen, basis = sample.copy(), [], np.zeros((0, sample.shape[1]))
        sizes = np.linalg.norm(sample, axis=1)
        while len(chosen) < min(PIVOTS, max(1, sample.shape[1] * 3 // 4)):
            off = np.linalg.norm(rest, axis=1)
            at = int(off.argmax())
            if off[at] <= 1e-3 * max(sizes[at], 1.0):
                break
            axis = rest[at] - basis.T @ (basis @ rest[at])
            chosen.append(at)
            basis = np.vstack([basis, axis / np.linalg.norm(axis)])
            rest -= np.outer(rest @ basis[-1], basis[-1])
            rest[at] = 0
        return cls(sample[chosen], sample[chosen] @ basis.T)

    @property
    def reach(self) -> float:
        return float(np.linalg.norm(self.points, axis=1).max(initial=0.0))

    def distances(self, vectors: np.ndarray) -> np.ndarray:
        squares = (vectors**2).sum(1)[:, None] + (self.points**2).sum(1)[None, :] - 2 * vectors @ self.points.T
        return np.sqrt(np.maximum(squares, 0))

    def located(self, distances: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From a vector's distances and squared length: its coordinates in the span, and its remainder's length or a little more."""
        products = (squares[:, None] + (self.points**2).sum(1)[None, :] - distances**2) / 2
        inside = np.linalg.solve(self.lower, products.T).T if len(self.points) else products
        slack = 1e-9 * (np.sqrt(squares) + self.reach) ** 2
        return inside, np.sqrt(np.maximum(squares - (inside**2).sum(1), 0) + slack)


def pick_pivots(vectors: DataFrame) -> dict[int, Pivots]:
    """Pivots for each vector length in a sample of at most SAMPLE rows."""
    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow().to_pylist()
    return {size: Pivots.of(np.array([r["v"] for r in sample if len(r["v"]) == size])) for size in {len(r["v"]) for r in sample}}


def _none(size: int) -> Pivots:
    return Pivots(np.zeros((0, size)), np.zeros((0, 0)))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = array.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(array), len(values) // max(1, len(array)))


def _scores(query: np.ndarray, vectors: np.ndarray, exact: bool) -> np.ndarray:
    if exact:
        return (vectors @ query).astype(np.int64)
    own = [int(c) for c in query]
    return np.array([max(_LONG.min, min(_LONG.max, sum(a * int(c) for a, c in zip(own, v)))) for v in vectors], dtype=np.int64)


@dataclass
class Found:
    """Best scores of queries in a block: columns query_id, vec_id and score, and how many vectors were scored."""

    columns: tuple[list, list, list]
    scored: int


def best_in_block(queries: np.ndarray, query_ids: np.ndarray, from_queries: np.ndarray, least: np.ndarray, vectors: np.ndarray, ids: np.ndarray, from_vectors: np.ndarray, pivots: Pivots, k: int) -> Found:
    """Each query's k best scores in the block, as far as they reach its least; from_* are the distances from the pivots."""
    squares, query_squares = (vectors**2).sum(1), (queries**2).sum(1)
    inside, off = pivots.located(from_vectors, squares)
    out, scored = ([], [], []), 0
    far, far_queries = np.sqrt(squares) + pivots.reach, np.sqrt(query_squares) + pivots.reach
    for first in range(0, len(queries), CHUNK_QUERIES):
        some = slice(first, first + CHUNK_QUERIES)
        query_inside, query_off = pivots.located(from_queries[some], query_squares[some])
        bounds = query_inside @ inside.T + np.outer(query_off, off) + 1e-9 * np.outer(far_queries[some], far) + 0.5
        bounds[query_ids[some][:, None] == ids[None, :]] = -np.inf
        for row, (query, query_id, low) in enumerate(zip(queries[some], query_ids[some], least[some])):
            candidates = np.flatnonzero(bounds[row] >= low) if low > -np.inf else np.flatnonzero(bounds[row] > -np.inf)
            order = candidates[np.argsort(-bounds[row][candidates], kind="stable")]
            exact = np.sqrt(query_squares[first + row] * squares.max()) < 2**53
            best_scores, best_ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for at in range(0, len(order), STEP):
                step = order[at : at + STEP]
                if len(best_scores) == k and bounds[row][step[0]] < best_scores[-1]:
                    break
                scored += len(step)
                scores, those = np.concatenate([best_scores, _scores(query, vectors[step], exact)]), np.concatenate([best_ids, ids[step]])
                top = np.lexsort((those, ~scores))  # ~ reverses the order of longs
                _, once = np.unique(those[top], return_index=True)  # an id counts once, with its best score
                top = top[np.sort(once)][:k]
                best_scores, best_ids = scores[top], those[top]
            for column, values in zip(out, ([query_id] * len(best_ids), best_ids, best_scores)):
                column.extend(values)
    return Found(out, scored)


_FOUND = "query_id long, vec_id long, score long"


def _found_table(found: Found) -> pa.Table:
    return pa.table({name: pa.array(c, pa.int64()) for name, c in zip(("query_id", "vec_id", "score"), found.columns)})


def _table(vectors: DataFrame, pivots, groups: int) -> DataFrame:
    """(id, v, d, size, grp): the vectors with their distances from the pivots and the number of the nearest one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.diff(batch.column(1).offsets.to_numpy())
            for size in np.unique(lengths):
                part = batch.filter(pa.array(lengths == size))
                own = pivots.value.get(int(size), _none(int(size)))
                far = own.distances(_matrix(part.column(1)))
                near = far[:, :groups].argmin(1) if far.shape[1] else np.zeros(len(part), np.int64)
                offsets = pa.array(np.arange(len(part) + 1, dtype=np.int32) * far.shape[1])
                arrays = [*part.columns, pa.ListArray.from_arrays(offsets, pa.array(far.ravel())), pa.array([size] * len(part), pa.int32()), pa.array(near.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "v", "d", "size", "grp"])

    return vectors.mapInArrow(run, "id long, v array<double>, d array<double>, size int, grp int")


def _asked(queries: DataFrame, blocks: DataFrame, pivots) -> DataFrame:
    """queries(id, v, d, least, block) once for each other block that may hold a score of at least least, and its slice."""
    names = [*_BLOCK, "slice", "id", "v", "d", "least"]
    known = blocks.toArrow()
    shared = queries.sparkSession.sparkContext.broadcast(known.to_batches(max_chunksize=len(known)) if len(known) else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        sizes = held[0].column("size").to_numpy() if held else np.zeros(0, np.int32)
        of_size = {}
        for size in np.unique(sizes):
            part = held[0].filter(pa.array(sizes == size))
            of_size[size] = part, *(_matrix(part.column(c)) for c in ("lo", "hi")), part.column("far").to_numpy(), part.column("grp").to_numpy(), part.column("piece").to_numpy()
        for batch in batches:
            lengths = batch.column("size").to_numpy()
            for size in np.intersect1d(lengths, list(of_size)):
                part, low, high, far, grp, piece = of_size[size]
                rows = batch.filter(pa.array(lengths == size))
                distances, squares = _matrix(rows.column("d")), (_matrix(rows.column("v")) ** 2).sum(1)
                least = rows.column("least").fill_null(_LONG.min).to_numpy().astype(float)
                reach = pivots.value.get(int(size), _none(int(size))).reach
                for row in range(len(rows)):
                    off = np.maximum(low - distances[row], distances[row] - high).max(1, initial=0.0)
                    bound = np.minimum((squares[row] + far**2 - off**2) / 2, np.sqrt(squares[row]) * far) + 1e-9 * (np.sqrt(squares[row]) + reach + far) ** 2 + 0.5
                    others = (grp != rows.column("grp")[row].as_py()) | (piece != rows.column("piece")[row].as_py())
                    open_ = np.flatnonzero(others & (bound >= least[row]))
                    for at in range(0, len(open_), CHUNK_ROWS):
                        chosen = part.take(pa.array(open_[at : at + CHUNK_ROWS]))
                        again = rows.take(pa.array([row] * len(chosen)))
                        yield pa.RecordBatch.from_arrays([*(chosen.column(c) for c in _BLOCK), *(again.column(c) for c in names[3:])], names=names)

    return queries.mapInArrow(run, "size int, grp int, piece int, slice int, id long, v array<double>, d array<double>, least long")


def exact_top_k(table: DataFrame, k: int = 5, scale: int = 256, query_step: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", scored=None) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose id is divisible by query_step against all rows.

    scored, an accumulator, is told how many pairs of a query and a vector were scored."""
    spark = small_batches(table.sparkSession)
    vectors = integer_vectors(table, id_col, vector_col, scale)
    is_query = F.pmod("id", F.lit(query_step)) == 0
    n = vectors.count()
    pivots = spark.sparkContext.broadcast(pick_pivots(vectors))
    located = written(_table(vectors, pivots, 1 + n // GROUP_VECTORS), "pivot-table")
    pieces = located.groupBy("size", "grp").agg(F.expr(f"int(ceil(count(*) / {BLOCK_VECTORS}))").alias("pieces"))
    # a number for each row, so that repeated rows go to all pieces
    blocked = located.withColumn("piece", F.monotonically_increasing_id()).join(pieces, ["size", "grp"])
    blocked = written(blocked.withColumn("piece", F.pmod(F.xxhash64("id", "piece"), F.col("pieces")).cast("int")).drop("pieces"), "pivot-blocks")

    def search(rows: pa.Table, asked: pa.Table, least: np.ndarray) -> pa.Table:
        vectors, queries = _matrix(rows.column("v")), _matrix(asked.column("v"))
        own = pivots.value.get(vectors.shape[1], _none(vectors.shape[1]))
        found = best_in_block(queries, asked.column("id").to_numpy(), _matrix(asked.column("d")), least, vectors, rows.column("id").to_numpy(), _matrix(rows.column("d")), own, k)
        if scored is not None:
            scored.add(found.scored)
        return _found_table(found)

    def search_own(rows: pa.Table) -> pa.Table:
        asked = rows.filter(pa.array(rows.column("id").to_numpy() % query_step == 0))
        return search(rows, asked, np.full(len(asked), -np.inf)) if len(asked) else _found_table(Found(([], [], []), 0))

    def search_other(asked: pa.Table, rows: pa.Table) -> pa.Table:
        if not len(asked) or not len(rows):
            return _found_table(Found(([], [], []), 0))
        return search(rows, asked, np.array([-np.inf if x is None else x for x in asked.column("least").to_pylist()]))

    first = written(blocked.groupBy(*_BLOCK).applyInArrow(search_own, _FOUND), "pivot-found")
    least = _ranked(first, k).groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("least"))
    slices = 1 + blocked.where(is_query).count() // BLOCK_QUERIES
    slice_of = F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int").alias("slice")
    queries = blocked.where(is_query).join(least.withColumnRenamed("query_id", "id"), "id", "left").select(*_BLOCK, slice_of, "id", "v", "d", "least")
    most = max((len(p.points) for p in pivots.value.values()), default=0)
    ends = [F.array(*(f(F.get("d", F.lit(i))) for i in range(most))).cast("array<double>").alias(name) for name, f in (("lo", F.min), ("hi", F.max))]
    longest = F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("far")
    summary = blocked.groupBy(*_BLOCK).agg(*ends, longest)
    sizes = F.create_map(*(F.lit(x) for s, p in pivots.value.items() for x in (s, len(p.points)))) if pivots.value else F.create_map().cast("map<int,int>")
    own_pivots = F.coalesce(F.try_element_at(sizes, F.col("size")), F.lit(0))
    summary = written(summary.withColumns({c: F.slice(c, F.lit(1), own_pivots) for c in ("lo", "hi")}), "pivot-intervals")
    found, chunks = first, 1 + summary.count() // CHUNK_BLOCKS
    for chunk in range(chunks):
        asked = _asked(queries, summary.where(F.pmod(F.xxhash64(*_BLOCK), F.lit(chunks)) == chunk), pivots)
        opened = asked.select(*(F.col(c).alias(f"{c}_to") for c in (*_BLOCK, "slice"))).distinct()
        rows = blocked.join(opened, (blocked["size"] == opened["size_to"]) & (blocked["grp"] == opened["grp_to"]) & (blocked["piece"] == opened["piece_to"])).select("size_to", "grp_to", "piece_to", "slice_to", "id", "v", "d")
        found = found.unionAll(asked.groupBy(*_BLOCK, "slice").cogroup(rows.groupBy("size_to", "grp_to", "piece_to", "slice_to")).applyInArrow(search_other, _FOUND))
    return _ranked(found, k).select("query_id", "rank", "vec_id", "score")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)


def op7_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
           WHERE len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.x, v.x)::BIGINT AS score
      FROM v q JOIN v ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id AND len(q.x) = len(v.x))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""

QUERIES = {"op7_pivot_search": op7_pivot_search}
ORACLES = {"op7_pivot_search": ORACLE}
