"""Clustering and product quantisation.

Centres are fitted on ROWS_A_CENTRE rows for each centre, or on all rows where there are fewer: those with a small hash of their id, so that
runs repeat.  Up to SAMPLE rows are fitted on the driver.  More stay where they are: Lloyd's rounds add up each task's sums and counts by centre
in Arrow batches, and the start is chosen by k-means|| (each round takes about twice as many candidates as there are centres, in proportion to
their squared distances from those taken before; candidates weighted by the rows nearest to them are then clustered on the driver).
So the driver sees candidates and centres only: parameters of an index, whatever the number of rows.  Every row is encoded or assigned on
the executors.

Only usable vectors take part (see ``usable``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE, ROWS_A_CENTRE = 10_000, 256
#: Rounds of k-means|| and of Lloyd's steps over rows that stay on the executors.
START_ROUNDS, ROUNDS = 3, 12


def finite(vector: str | Column) -> Column:
    """Whether a vector holds numbers only, one at least: no nulls, NaN or infinities."""
    each = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(each & (F.size(vector) > 0), F.lit(False))


def usual_length(data: DataFrame, vector: str = "vec") -> int:
    """The commonest length of a table's finite vectors, the greater one on ties; 0 without any."""
    row = data.where(finite(vector)).groupBy(F.size(vector).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return row["n"] if row else 0


def usable(data: DataFrame, length: int, vector: str = "vec") -> DataFrame:
    """The rows with a finite vector of this length; all others are neither indexed nor found, and queries with others find nothing."""
    return data.where(finite(vector) & (F.size(vector) == length))


def sample_vectors(data: DataFrame, vector: str = "vec", key: str = "id", rows: int = SAMPLE) -> np.ndarray:
    taken = data.select(F.col(vector).cast("array<double>").alias("v"), F.xxhash64(key).alias("h"), F.col(key).alias("k")).orderBy("h", "k").limit(rows).select("v").toArrow()
    return np.array(taken.column("v").to_pylist(), dtype=float).reshape(len(taken), -1)


def fit_centres(data: DataFrame, clusters: int, parts: int = 1, vector: str = "vec", key: str = "id", seed: int = 0, cosine: bool = False, rows_a_centre: int = ROWS_A_CENTRE, local: int = SAMPLE, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Centres of each of a vector's equal parts (the last one filled up with zeros): clusters of them, or one for each row of fewer."""
    n = data.count()
    wanted = clusters * rows_a_centre
    if min(n, wanted) <= local:
        points = sample_vectors(data, vector, key, max(local, 1))
        return [k_means(p, clusters, seed + i, rounds, cosine) for i, p in enumerate(np.split(pad_parts(points, parts), parts, axis=1))]
    rows = data.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("vec"))
    if n > wanted:
        rows = rows.where(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 40)) < int(wanted / n * (1 << 40)))
    centres = _started(rows, clusters, parts, seed, cosine)
    for _ in range(rounds):
        sums, counts, _ = _summed(rows, centres, cosine)
        new = [np.where(c[:, None] > 0, s / np.maximum(c, 1)[:, None], old) for s, c, old in zip(sums, counts, centres)]
        done = all(np.allclose(a, b) for a, b in zip(new, centres))
        centres = new
        if done:
            break
    return centres


def _split(points: np.ndarray, parts: int, cosine: bool) -> list[np.ndarray]:
    if cosine:
        points = points / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-12)
    return np.split(pad_parts(points, parts), parts, axis=1)


def _summed(rows: DataFrame, centres: list[np.ndarray], cosine: bool) -> tuple[list[np.ndarray], list[np.ndarray], list[float]]:
    """By part: sums and counts of the rows nearest to each centre, and the rows' squared distances from them; a row for each task and centre
    is all that is shuffled."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        sums, counts, costs = [np.zeros_like(c) for c in own], [np.zeros(len(c)) for c in own], [0.0] * len(own)
        for _, points in (x for batch in batches for x in vector_batches([batch], 1)):
            for i, part in enumerate(_split(points, len(own), cosine)):
                at = nearest(part, own[i])
                np.add.at(sums[i], at, part)
                counts[i] += np.bincount(at, minlength=len(own[i]))
                costs[i] += float(((part - own[i][at]) ** 2).sum())
        for i in range(len(own)):
            hit = np.flatnonzero(counts[i])
            if len(hit):
                cost = np.zeros(len(hit))
                cost[0] = costs[i]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(hit) + 1, dtype=np.int32) * own[i].shape[1]), pa.array(sums[i][hit].ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), i, np.int32)), pa.array(hit.astype(np.int32)), pa.array(counts[i][hit]), pa.array(cost), lists], names=["part", "centre", "n", "cost", "total"])

    def add(table: pa.Table) -> pa.Table:
        n = len(table)
        total = table.column("total").combine_chunks().flatten().to_numpy().reshape(n, -1).sum(0)
        first = table.slice(0, 1).select(["part", "centre"])
        return first.append_column("n", pa.array([sum(table.column("n").to_pylist())])).append_column("cost", pa.array([sum(table.column("cost").to_pylist())])).append_column("total", pa.array([total.tolist()], pa.list_(pa.float64())))

    schema = "part int, centre int, n double, cost double, total array<double>"
    sums, counts, costs = [np.zeros_like(c) for c in centres], [np.zeros(len(c)) for c in centres], [0.0] * len(centres)
    for r in rows.mapInArrow(run, schema).groupBy("part", "centre").applyInArrow(add, schema).collect():  # a row for each centre
        sums[r.part][r.centre], counts[r.part][r.centre] = r.total, r.n
        costs[r.part] += r.cost
    return sums, counts, costs


def _started(rows: DataFrame, clusters: int, parts: int, seed: int, cosine: bool) -> list[np.ndarray]:
    """Centres to start from, by k-means||."""
    first = sample_vectors(rows, rows=min(clusters, 256))
    taken = [p.copy() for p in _split(first, parts, cosine)]
    for step in range(START_ROUNDS):
        _, _, costs = _summed(rows, taken, cosine)
        shared = rows.sparkSession.sparkContext.broadcast((taken, costs))

        def pick(batches: Iterator[pa.RecordBatch], shared=shared, step=step) -> Iterator[pa.RecordBatch]:
            own, costs = shared.value
            for batch, points in (x for whole in batches for x in vector_batches([whole], 1)):
                ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                for i, part in enumerate(_split(points, len(own), cosine)):
                    far = ((part - own[i][nearest(part, own[i])]) ** 2).sum(1)
                    chance = ids * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 1009 + step * 31 + i)
                    chance = (chance ^ chance >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
                    chance = (chance >> np.uint64(11)) / float(1 << 53)
                    hit = np.flatnonzero(chance < 2 * clusters * far / max(costs[i], 1e-300))
                    if len(hit):
                        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(hit) + 1, dtype=np.int32) * part.shape[1]), pa.array(part[hit].ravel()))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), i, np.int32)), lists], names=["part", "vec"])

        found = rows.mapInArrow(pick, "part int, vec array<double>").collect()  # about 2 * clusters a part
        for i in range(len(taken)):
            own = sorted(r.vec for r in found if r.part == i)  # whatever the order of rows
            taken[i] = np.concatenate([taken[i], np.array(own).reshape(-1, taken[i].shape[1])])
    _, counts, _ = _summed(rows, taken, cosine)
    return [k_means(t, clusters, seed + i, weights=c) for i, (t, c) in enumerate(zip(taken, counts))]


def nearest(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The number of the closest centre, the first one on ties; 0 where there is none."""
    if not len(centers):
        return np.zeros(len(points), int)
    return ((centers**2).sum(1)[None, :] - 2 * points @ centers.T).argmin(1)


def k_means(points: np.ndarray, clusters: int, seed: int = 0, rounds: int = 15, cosine: bool = False, weights: np.ndarray | None = None) -> np.ndarray:
    """Centres by Lloyd's rounds from points chosen far from each other (k-means++); an emptied cluster keeps its centre."""
    if cosine:
        points = points / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-12)
    if not len(points):
        return points.copy()
    weights = np.ones(len(points)) if weights is None else np.maximum(weights, 1e-9)
    rng = np.random.default_rng(seed)
    chosen = [int(rng.choice(len(points), p=weights / weights.sum()))]
    far = ((points - points[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(clusters, len(points)):
        share = weights * far
        if share.sum() <= 0:  # the rest are repeated points
            rest = np.setdiff1d(np.arange(len(points)), chosen)[: clusters - len(chosen)]
            chosen += rest.tolist()
            break
        chosen.append(int(np.searchsorted(np.cumsum(share), rng.random() * share.sum())))
        chosen[-1] = min(chosen[-1], len(points) - 1)
        far = np.minimum(far, ((points - points[chosen[-1]]) ** 2).sum(1))
    centers = points[chosen].copy()
    for _ in range(rounds):
        own = nearest(points, centers)
        sums, counts = np.zeros_like(centers), np.bincount(own, weights=weights, minlength=len(centers))
        np.add.at(sums, own, points * weights[:, None])
        new = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1e-12)[:, None], centers)
        if np.allclose(new, centers):
            break
        centers = new
    return centers


def balanced_groups(points: np.ndarray, groups: int, seed: int = 0, rounds: int = 10) -> np.ndarray:
    """A group for each point, with group sizes that differ by one at most: nearest centre that has room, closest pairs first."""
    groups = min(groups, len(points))
    centers, own = k_means(points, groups, seed), np.zeros(len(points), dtype=int)
    for _ in range(rounds):
        distances = (points**2).sum(1)[:, None] + (centers**2).sum(1)[None, :] - 2 * points @ centers.T
        room = np.full(groups, len(points) // groups)
        room[: len(points) % groups] += 1
        new, left = np.full(len(points), -1), len(points)
        for pair in np.argsort(distances, axis=None, kind="stable"):
            p, g = divmod(int(pair), groups)
            if new[p] < 0 and room[g]:
                new[p], room[g], left = g, room[g] - 1, left - 1
                if not left:
                    break
        if (new == own).all():
            break
        own = new
        centers = np.stack([points[own == g].mean(0) for g in range(groups)])
    return own


@dataclass
class ProductQuantiser:
    """centers[part]: the (codes, length) centres of one part of the vector; short vectors end in zeros."""

    centers: list[np.ndarray]

    @property
    def length(self) -> int:
        return self.centers[0].shape[1]

    @classmethod
    def fit(cls, data: DataFrame, parts: int, codes: int, vector: str = "vec", seed: int = 0, rounds: int = ROUNDS) -> ProductQuantiser:
        return cls(fit_centres(data, codes, parts, vector, seed=seed, rounds=rounds))

    def encode(self, points: np.ndarray) -> np.ndarray:
        return np.stack([nearest(p, c) for p, c in zip(np.split(pad_parts(points, len(self.centers)), len(self.centers), axis=1), self.centers)], axis=1)

    def tables(self, points: np.ndarray) -> np.ndarray:
        """(points, parts, codes): squared distances of each part to each of its centres."""
        parts = np.split(pad_parts(points, len(self.centers)), len(self.centers), axis=1)
        squares = [(p**2).sum(1)[:, None] + (c**2).sum(1)[None, :] - 2 * p @ c.T for p, c in zip(parts, self.centers)]
        return np.maximum(np.stack(squares, axis=1), 0)


def pad_parts(points: np.ndarray, parts: int) -> np.ndarray:
    return np.pad(points, ((0, 0), (0, -points.shape[1] % parts)))


def vector_batches(batches: Iterator[pa.RecordBatch], at: int, rows: int = 1024) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Pieces of the batches, of so many rows that the working arrays stay small, with their vectors as a matrix."""
    for whole in batches:
        for start in range(0, whole.num_rows, rows):
            batch = whole.slice(start, rows)
            yield batch, batch.column(at).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)


def _with_columns(data: DataFrame, vector: str, kinds: str, make) -> DataFrame:
    """data with columns (as a schema string) that make gives for the vectors of a batch."""
    at, added = data.columns.index(vector), T._parse_datatype_string(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, points in vector_batches(batches, at):
            yield pa.RecordBatch.from_arrays([*batch.columns, *make(points)], names=[*batch.schema.names, *added.names])

    return data.mapInArrow(run, T.StructType([*data.schema, *added]))


def with_codes(data: DataFrame, quantiser: ProductQuantiser, vector: str = "vec") -> DataFrame:
    """data with codes array<int> and err, the vector's distance from what the codes stand for."""

    def make(points: np.ndarray) -> list[pa.Array]:
        codes = quantiser.encode(points).astype(np.int32)
        coded = np.concatenate([c[codes[:, i]] for i, c in enumerate(quantiser.centers)], axis=1)
        err = np.linalg.norm(pad_parts(points, len(quantiser.centers)) - coded, axis=1)
        return [pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1, dtype=np.int32) * codes.shape[1]), pa.array(codes.ravel())), pa.array(err)]

    return _with_columns(data, vector, "codes array<int>, err double", make)


def with_tables(queries: DataFrame, quantiser: ProductQuantiser, vector: str = "qvec") -> DataFrame:
    """queries with lut array<array<double>>."""

    def make(points: np.ndarray) -> list[pa.Array]:
        return [pa.array(quantiser.tables(points).tolist(), pa.list_(pa.list_(pa.float64())))]

    return _with_columns(queries, vector, "lut array<array<double>>", make)


def with_nearest(data: DataFrame, centers: np.ndarray, name: str, vector: str = "vec", cosine: bool = False, far: str | None = None, rest: str | None = None) -> DataFrame:
    """data with the number of each vector's nearest centre; far names a column for its distance from it, rest one for the difference."""

    def make(points: np.ndarray) -> list[pa.Array]:
        if cosine:
            points = points / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-12)
        own = nearest(points, centers)
        left = points - centers[own]
        out = [pa.array(own.astype(np.int32))]
        if far:
            out.append(pa.array(np.linalg.norm(left, axis=1)))
        if rest:
            out.append(pa.ListArray.from_arrays(pa.array(np.arange(len(left) + 1, dtype=np.int32) * left.shape[1]), pa.array(left.ravel())))
        return out

    return _with_columns(data, vector, f"{name} int" + (f", {far} double" if far else "") + (f", {rest} array<double>" if rest else ""), make)


def code_tables(queries: DataFrame, centers: DataFrame, parts: int, vector: str = "qvec") -> DataFrame:
    """(qid, part, code, distance) by expressions only, for centres kept as a table (part, code, center)."""
    from nearfield.functions.vectors import squared_l2

    return queries.join(F.broadcast(centers)).select("qid", "part", "code", squared_l2(part_of(F.col(vector), F.col("part"), parts), F.col("center")).alias("distance"))


def part_of(vector: Column, part: Column, parts: int) -> Column:
    """One of equal parts of a vector, counted from 0."""
    length = (F.size(vector) / F.lit(parts)).cast("int")
    return F.slice(vector, part * length + 1, length)
