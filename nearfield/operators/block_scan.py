"""The best rows of each query among all pairs of a query and a row, measured block by block.

Rows and queries are packed into blocks of at most ROWS and QUERIES, Spark deals the blocks of rows out and pairs each with the blocks of queries,
and a task measures a pair of blocks as one matrix.  A task keeps, for each query that it met, the k best rows so far, whose last one rules out
most of what follows, so at most k rows a query and task are shuffled, and no pair of the rest ever leaves its task.  Time is that of all
pairs, as in any exact search; memory is that of a few blocks.

Matrix products only choose: with an allowance for their rounding, they name the pairs that are measured again term by term, in the order
in which the expressions of functions/vectors add, so that distances and ties are the same to the last bit.

Queries may name the lists that they read (wanted, an array of the rows' list numbers), may bound the distance by product codes
(reach), and may hold intervals of labels, which rows must meet, or which cost a penalty, or which are only noted.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS, QUERIES = 2048, 2048
#: Rows that are held against a block of queries at a time, pairs that are measured term by term at a time, and results that a task holds.
CHUNK, PIECE, HELD = 256, 1 << 15, 1 << 21
#: Bytes of queries that are broadcast.
BROADCAST_BYTES = 128 << 20
#: Squared lengths up to here don't overflow when they are added.
SAFE = 1e300


@dataclass(frozen=True)
class Scan:
    """What is asked.

    by: l2, cosine, or codes (distances by product codes).  filters: only (rows outside an interval drop out), penalty (they cost one), or noted (a
    column fits).  quantiser: for codes, and for queries with a reach.  centers: by list, what codes leave out of a vector.  once: repeated
    rows with the same id count once.
    """

    k: int
    by: str = "l2"
    labels: tuple[str, ...] = ()
    numbers: tuple[int, ...] = ()
    filters: str = "only"
    penalty: float = 0.0
    largest: bool = False
    quantiser: object = None
    centers: Mapping[int, np.ndarray] | None = None
    once: bool = False


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(flat), -1)


def _numbers(table: pa.Table, names: Sequence[str]) -> np.ndarray:
    """(names, rows) as doubles; null is NaN, which lies in no interval."""
    return np.stack([pc.cast(table.column(n), pa.float64()).to_numpy() for n in names]) if names else np.zeros((0, len(table)))


def _dot(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Row by row, added from the first component on."""
    terms = left * right
    out = np.zeros(len(terms))
    for i in range(terms.shape[1]):
        out += terms[:, i]
    return out


class _Rows:
    def __init__(self, raw: bytes, scan: Scan):
        table = pa.ipc.open_stream(raw).read_all()
        self.ids = table.column("id").combine_chunks()
        self.points = _matrix(table.column("vec"))
        self.labels = _numbers(table, scan.labels)
        self.list = table.column("list")[0].as_py() if "list" in table.column_names else None
        self.squares = (self.points**2).sum(1)
        self.coded = "codes" in table.column_names
        if self.coded:
            self.codes = pa.concat_arrays(table.column("codes").chunks).flatten().to_numpy().reshape(len(table), -1)
            self.err = table.column("err").to_numpy()
        self.unique = pc.count_distinct(self.ids).as_py() == len(self.ids)


class _Queries:
    """A block of queries with the best rows that a task has met so far."""

    def __init__(self, raw: bytes, scan: Scan):
        table = pa.ipc.open_stream(raw).read_all()
        self.scan, self.ids, self.points = scan, table.column("qid").combine_chunks(), _matrix(table.column("qvec"))
        self.low, self.high = (_numbers(table, [f"{side}_{i}" for i in scan.numbers]) for side in ("lo", "hi"))
        self.squares = (self.points**2).sum(1)
        self.reach = table.column("t").to_numpy() if "t" in table.column_names else None
        self.wanted = None
        if "wanted" in table.column_names:
            lists = pa.concat_arrays(table.column("wanted").chunks)
            owners, lists = lists.value_parent_indices(), lists.flatten()
            order = np.argsort(lists, kind="stable")
            keys, starts = np.unique(np.asarray(lists)[order], return_index=True)
            self.wanted = dict(zip(keys.tolist(), np.split(np.asarray(owners)[order], starts[1:])))
        self.last = np.full(len(table), np.inf)
        self.held: pa.Table | None = None
        self.tables: tuple[int | None, np.ndarray] | None = None

    def _codes(self, rows: _Rows, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tables of code distances of some queries, and by how much rounding may raise an entry's sum."""
        quantiser, center = self.scan.quantiser, self.scan.centers
        points = self.points[own] if center is None else self.points[own] - center[rows.list]
        most = max(float((c**2).sum(1).max(initial=0.0)) for c in quantiser.centers) * len(quantiser.centers)
        return quantiser.tables(points), 8e-16 * (points.shape[1] + 16) * ((points**2).sum(1) + most)

    def meet(self, rows: _Rows) -> int:
        """Takes in a block of rows; how many more results are held."""
        own = np.arange(len(self.ids)) if self.wanted is None else self.wanted.get(rows.list)
        if own is None or not len(own):
            return 0
        scan, before, found = self.scan, len(self.held) if self.held else 0, []
        every, all_tables, all_rounding = own, None, None
        if scan.by == "codes" or self.reach is not None:
            all_tables, all_rounding = self._codes(rows, own)
        for start in range(0, len(rows.ids), CHUNK):
            at = slice(start, start + CHUNK)
            other, sizes = rows.points[at], rows.squares[at]
            own, tables, rounding = every, all_tables, all_rounding
            if scan.filters == "only" and len(rows.labels):
                meets = self._meeting(rows, every, at)
                if not len(meets):
                    continue
                if len(meets) < len(every):
                    own = every[meets]
                    tables, rounding = (None, None) if tables is None else (tables[meets], rounding[meets])
            points, squares = self.points[own], self.squares[own]
            shape = len(own), len(other)
            fits = np.ones(shape, bool)
            for label, low, high in zip(rows.labels, self.low, self.high):
                fits &= (label[None, at] >= low[own, None]) & (label[None, at] <= high[own, None])
            take = fits if scan.filters == "only" else np.ones(shape, bool)
            if tables is not None:
                coded = np.zeros(shape)
                for i in range(tables.shape[1]):
                    coded += tables[:, i, rows.codes[at, i]]
                if self.reach is not None:
                    take = take & (np.sqrt(np.maximum(coded - rounding[:, None], 0)) - rows.err[None, at] * (1 + 1e-9) <= self.reach[own, None])
            if not take.any():
                continue
            near, slack = self._near(points, squares, other, sizes) if scan.by != "codes" else (coded, np.zeros(len(own)))
            if scan.filters == "penalty":
                near = near + np.where(fits, 0.0, scan.penalty)
                slack = slack + 1e-15 * scan.penalty
            near = np.where(take, near, np.inf)
            odd = take & ~np.isfinite(near) if max(squares.max(initial=0), sizes.max(initial=0)) > SAFE or scan.by == "cosine" else None
            hit = take & (near <= (self.last[own] + slack)[:, None])
            if hit.sum() > 2 * scan.k * len(own) and len(other) > scan.k and (rows.unique or not scan.once):
                nth = np.partition(near, scan.k - 1, axis=1)[:, scan.k - 1]
                hit &= near <= (nth + 2 * slack)[:, None]
            if odd is not None:
                hit |= odd
            a, b = np.nonzero(hit)
            if len(a):
                found.append(self._measured(rows, own, a, b, start, fits, coded if scan.by == "codes" else None))
                if sum(map(len, found)) > HELD // 8:
                    self._merge(found)
                    found = []
        self._merge(found)
        return (len(self.held) if self.held else 0) - before

    def _meeting(self, rows: _Rows, own: np.ndarray, at: slice) -> np.ndarray:
        """The queries whose intervals meet the extent of some rows' labels."""
        meets = np.ones(len(own), bool)
        for label, low, high in zip(rows.labels, self.low, self.high):
            values = label[at]
            values = values[~np.isnan(values)]
            meets &= (low[own] <= values.max()) & (high[own] >= values.min()) if len(values) else False
        return np.flatnonzero(meets)

    def _near(self, points: np.ndarray, squares: np.ndarray, other: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """About what pairs measure, and by how much that may be wrong."""
        with np.errstate(all="ignore"):
            out = points @ other.T
            if self.scan.by == "cosine":
                out /= -np.sqrt(squares)[:, None] * np.sqrt(sizes)[None, :]
                out += 1
                slack = np.full(len(points), 1e-15 * (points.shape[1] + 16) * 8)
            else:
                out *= -2
                out += squares[:, None]
                out += sizes[None, :]
                slack = 8e-16 * (points.shape[1] + 16) * (squares + sizes.max(initial=0))
            return (-out if self.scan.largest else out), slack

    def _exact(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            if self.scan.by == "cosine":
                return 1 - _dot(left, right) / (np.sqrt(_dot(left, left)) * np.sqrt(_dot(right, right)))
            return _dot(left - right, left - right)

    def _measured(self, rows: _Rows, own: np.ndarray, a: np.ndarray, b: np.ndarray, start: int, fits: np.ndarray, coded: np.ndarray | None) -> pa.Table:
        pieces = [self._exact(self.points[own[a[i : i + PIECE]]], rows.points[start + b[i : i + PIECE]]) for i in range(0, len(a), PIECE)]
        exact = np.concatenate(pieces)
        score = exact if coded is None else coded[a, b]
        if self.scan.filters == "penalty":
            score = score + np.where(fits[a, b], 0.0, self.scan.penalty)
        score = -score if self.scan.largest else score
        return pa.table({"q": pa.array(own[a].astype(np.int32)), "score": pa.array(score), "id": rows.ids.take(pa.array(start + b)), "exact": pa.array(exact), "fits": pa.array(fits[a, b])})

    def _merge(self, found: list[pa.Table]) -> None:
        if not found:
            return
        k = self.scan.k
        table = pa.concat_tables(([self.held] if self.held is not None else []) + found)
        own = table.column("score").to_numpy() <= self.last[table.column("q").to_numpy()]
        odd = np.isnan(table.column("score").to_numpy())
        table = table.filter(pa.array(own | odd))
        table = table.take(pc.sort_indices(table, sort_keys=[("q", "ascending"), ("score", "ascending"), ("id", "ascending")])).combine_chunks()
        q, score = table.column("q").to_numpy(), table.column("score").to_numpy()
        if self.scan.once and len(table) > 1:
            ids = table.column("id").combine_chunks()
            same = pc.fill_null(pc.equal(ids[1:], ids[:-1]), False).to_numpy(zero_copy_only=False) & (q[1:] == q[:-1]) & (score[1:] == score[:-1])
            table = table.filter(pa.array(np.concatenate([[True], ~same])))
            q, score = table.column("q").to_numpy(), table.column("score").to_numpy()
        first = np.searchsorted(q, q, side="left")
        place = np.arange(len(q)) - first
        self.held = table.filter(pa.array(place < k))
        nth = place == k - 1
        worst = np.where(np.isnan(score[nth]), np.inf, score[nth])
        self.last[q[nth]] = np.minimum(self.last[q[nth]], worst)

    def sent(self, names: Sequence[str]) -> pa.Table | None:
        held, self.held = self.held, None
        if held is None or not len(held):
            return None
        score = held.column("score").to_numpy()
        columns = {"qid": self.ids.take(held.column("q").combine_chunks()), "id": held.column("id"), "distance": pa.array(-score if self.scan.largest else score), "exact": held.column("exact"), "fits": held.column("fits")}
        return pa.table([columns[n] for n in names], names=list(names))


def small_batches(spark: SparkSession) -> None:
    """Blocks go to a task's Python in batches of a few."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name, str(2**31 - 1)).removesuffix("b") or 0) > 64 << 20:
        spark.conf.set(name, str(4 << 20))


def packed(frame: DataFrame, rows: int, name: str, by: str | None = None) -> DataFrame:
    """(name_block, name) of blocks of so many rows as Arrow streams; with by, rows of a block have one value of this column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, count = TaskContext.get().partitionId() << 33, [], 0
        # rows are gathered for longer where they are told apart
        most = rows if by is None else 8 * rows

        def blocks(table: pa.Table) -> Iterator[pa.Table]:
            if by is None:
                ends = [len(table)]
            else:
                table = table.sort_by(by)
                values = table.column(by).to_numpy()
                ends = [*(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(table)]
            for a, b in zip([0, *ends[:-1]], ends):
                for start in range(a, b, rows):
                    yield table.slice(start, min(rows, b - start))

        def sent() -> Iterator[pa.RecordBatch]:
            nonlocal number
            for block in blocks(pa.Table.from_batches(held)):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, block.schema) as out:
                    out.write_table(block.combine_chunks())
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=[f"{name}_block", name])
                number += 1

        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                if count + part.num_rows > most and held:
                    yield from sent()
                    held, count = [], 0
                held.append(part)
                count += part.num_rows
        if held:
            yield from sent()

    return frame.mapInArrow(run, f"{name}_block long, {name} binary")


def best(rows: DataFrame, queries: DataFrame, scan: Scan) -> DataFrame:
    """(qid, id, distance, and exact, where it is by codes, and fits, where filters don't drop rows): at least the k best rows of each query, from which
    top_k takes them.  rows(id, vec, labels..., list, codes, err) and queries(qid, qvec, lo_i, hi_i, wanted, t) have usable vectors, and the columns that are
    asked for."""
    spark = rows.sparkSession
    small_batches(spark)
    names = ["qid", "id", "distance", *(["exact"] if scan.by == "codes" else []), *(["fits"] if scan.filters != "only" else [])]
    kinds = {"qid": queries.schema["qid"].dataType, "id": rows.schema["id"].dataType, "fits": T.BooleanType()}
    coded = scan.quantiser is not None
    listed = "list" in rows.columns
    own = rows.select("id", "vec", *dict.fromkeys(scan.labels), *(["codes", "err"] if coded else []), *(["list"] if listed else []))
    asked = queries.select("qid", "qvec", *(f"{side}_{i}" for i in scan.numbers for side in ("lo", "hi")), *(c for c in ("wanted", "t") if c in queries.columns))
    tasks = 3 * spark.sparkContext.defaultParallelism
    bytes_ = asked.agg(F.sum(8 * F.size("qvec") + 8 * (F.size("wanted") if "wanted" in asked.columns else F.lit(0)) + 16 * len(asked.columns))).first()[0] or 0
    left = packed(own, ROWS, "rows", "list" if listed else None).repartition(tasks)
    right = packed(asked.repartition(1 + spark.sparkContext.defaultParallelism // 8), QUERIES, "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, _Queries] = {}
        last, own, held = None, None, 0

        def sent() -> Iterator[pa.RecordBatch]:
            for block in blocks.values():
                table = block.sent(names)
                if table is not None:
                    yield from table.combine_chunks().to_batches(1 << 16)

        for batch in batches:
            for number, raw, of, query in zip(*(batch.column(i) for i in range(4))):
                if number.as_py() != last:
                    last, own = number.as_py(), _Rows(raw.as_buffer(), scan)
                if of.as_py() not in blocks:
                    blocks[of.as_py()] = _Queries(query.as_buffer(), scan)
                held += blocks[of.as_py()].meet(own)
                if held > HELD:
                    yield from sent()
                    blocks, held = {}, 0
        yield from sent()

    schema = T.StructType([T.StructField(n, kinds.get(n, T.DoubleType())) for n in names])
    right = F.broadcast(right) if bytes_ <= BROADCAST_BYTES else right.hint("shuffle_replicate_nl")
    return left.crossJoin(right).mapInArrow(run, schema)
