"""Strategies of filtered nearest-neighbour search over one contract.

``build(data)`` takes (id, vec, labels...) and writes the index; ``query(index, queries)`` takes (qid, qvec, lo_i, hi_i...) and returns
(qid, rank, neighbor, distance): the k nearest rows by squared L2 among those inside the query's intervals, nearest first, ties to
the smaller id, and fewer rows where fewer fit.

Every strategy gives the exact result at any settings, in two steps.  The first looks where its settings say: at so many lists, at so
many of the best candidates by code distance.  Its k-th distance t bounds the true one from above (and is infinite where fewer than k rows
fit).  The second step measures whatever t can't rule out: lists whose centre lies within t plus the list's radius and whose label box
meets the query's intervals, and in them rows whose code distance, less the row's own distance from its code, is at most t.  So
the settings decide how much is read, and never which rows are found.

An index is laid out in parts (sources/layout): what a step needs is looked up in its manifest, and only those parts are read.

Vectors that are null or empty, hold a null, NaN or infinite component, or have another length than most of the table's finite ones, are
no results, and queries with such a vector have none; ``exact`` and all strategies alike.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.functions.filters import inside, range_middle
from nearfield.functions.grids import coordinate, morton_code
from nearfield.functions.vectors import looked_up, squared_l2
from nearfield.operators.block_scan import Scan, best
from nearfield.operators.grid_counts import box_counts_from_changes, cell_counts, changes, prefix_sums
from nearfield.operators.quantise import (
    ProductQuantiser,
    balanced_groups,
    finite,
    fit_centres,
    k_means,
    nearest,
    usable,
    usual_length,
    vector_batches,
    with_codes,
    with_nearest,
    with_tables,
)
from nearfield.operators.range_join import against, bounded, label_extent, range_join
from nearfield.operators.topk import top_k
from nearfield.operators.zorder import z_intervals
from nearfield.sources.layout import LEAST_PARTS, ROWS_A_PART, Layout, manifest, numbers, only, read_parts, write_parts
from nearfield.sources.lineage import cut, new_folder

#: Against rounding: a bound may be off by this share.
SLACK = 1e-9


@dataclass(frozen=True)
class Params:
    """Settings of all strategies; each reads its own."""

    k: int = 10
    parts: int = 4
    codes: int = 256
    keep: float = 30  # candidates by code distance, as a multiple of k
    keep_soft: float = 30  # the same for the second cut of parafilter
    penalty: float = 0.5  # weight of a failed filter in parafilter
    label_clusters: int = 16
    label_probes: int = 5
    pass_ratio: float = 0.5
    max_cells: int = 64
    lists: int = 16
    probes: int = 8
    expected: float = 2  # lists are probed until so many times k rows are expected to fit
    clusters: int = 16
    sub_clusters: int = 4
    cluster_probes: int = 8
    sub_probes: int = 16
    widths: tuple[float, ...] = ()  # usual widths of the queries' intervals, by label
    grids: int = 4096
    levels: int = 4  # halvings of the grid's cube when boxes become Morton intervals
    label_mask: int = 0
    degree: int = 16
    i_degree: int = 24
    entries: int = 32
    frontier: int = 64
    width: int = 8
    rounds: int = 6
    beta: float = 4
    refine: float = 2
    iterations: int = 12  # rounds of k-means
    seed: int = 0
    files: int = 0  # parts of the index; 0: by its rows


class Index:
    """A folder with laid out tables (data, with a row for each vector, is one), tables of its own, their manifests among them, and what the
    strategy needs to know (extra: numbers, arrays, lists)."""

    def __init__(self, spark: SparkSession, path: str, files: int = LEAST_PARTS):
        self.spark, self.path, self.files = spark, path, files
        self.laid: dict[str, DataFrame] = {}
        self.tables: dict[str, DataFrame] = {}
        self.quantiser: ProductQuantiser | None = None
        self.extra: dict = {}

    @property
    def data(self) -> DataFrame:
        return self.laid["data"]

    def lay(self, name: str, rows: DataFrame, layout: Layout) -> DataFrame:
        """Writes a table in parts, with its manifest, and reads it again."""
        write_parts(rows, f"{self.path}/laid/{name}", layout, self.files)
        self.laid[name] = read_parts(self.spark, f"{self.path}/laid/{name}", rows.schema)
        self.keep(f"{name}_parts", manifest(self.laid[name], layout))
        return self.laid[name]

    def keep(self, name: str, table: DataFrame) -> DataFrame:
        table.write.mode("overwrite").parquet(f"{self.path}/tables/{name}")
        self.tables[name] = self.spark.read.schema(table.schema).parquet(f"{self.path}/tables/{name}")
        return self.tables[name]

    def close(self) -> Index:
        """Writes what load has to know."""
        arrays = lambda v: {"array": v.tolist()} if isinstance(v, np.ndarray) else v
        schemas = lambda tables: {name: table.schema.jsonValue() for name, table in tables.items()}
        about = {
            "files": self.files,
            "laid": schemas(self.laid),
            "tables": schemas(self.tables),
            "extra": {k: arrays(v) for k, v in self.extra.items()},
            "quantiser": [c.tolist() for c in self.quantiser.centers] if self.quantiser else None,
        }
        self.spark.createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/about")
        return self

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        about = json.loads(spark.read.parquet(f"{path}/about").first()[0])
        index = cls(spark, path, about["files"])
        index.extra = {k: np.array(v["array"]) if isinstance(v, dict) and "array" in v else v for k, v in about["extra"].items()}
        index.quantiser = ProductQuantiser([np.array(c) for c in about["quantiser"]]) if about["quantiser"] else None
        index.laid = {name: read_parts(spark, f"{path}/laid/{name}", T.StructType.fromJson(schema)) for name, schema in about["laid"].items()}
        index.tables = {name: spark.read.schema(T.StructType.fromJson(schema)).parquet(f"{path}/tables/{name}") for name, schema in about["tables"].items()}
        return index

    def of(self, wanted: DataFrame, name: str = "data") -> DataFrame:
        """The rows of the parts that wanted names."""
        return only(self.laid[name], numbers(wanted))


def ranked(pairs: DataFrame, k: int) -> DataFrame:
    return top_k(pairs, k).select("qid", "rank", F.col("id").alias("neighbor"), "distance")


def refined(candidates: DataFrame, data: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Exact ranking of candidate pairs (qid, id): vectors are fetched for the candidates alone; repeated pairs and rows count once."""
    pairs = candidates.select("qid", "id").join(data.select("id", "vec"), "id").join(queries.select("qid", "qvec"), "qid")
    return ranked(pairs.select("qid", "id", squared_l2("qvec", "vec").alias("distance")).distinct(), k)


def exact(data: DataFrame, queries: DataFrame, labels: Sequence[str], k: int) -> DataFrame:
    """The result itself: all pairs block by block, those inside the intervals ranked."""
    length = usual_length(data)
    rows, asked, numbers = usable(data, length), usable(queries, length, "qvec"), tuple(range(len(labels)))
    rows, _, _ = bounded(rows, asked, labels, numbers)
    return ranked(best(rows, asked, Scan(k, labels=tuple(labels), numbers=numbers)), k)


def scanned(data: DataFrame, queries: DataFrame, scan: Scan, score: Column, length: int | None = None) -> DataFrame:
    """(qid, id, distance, fits where it is noted) of all pairs' best rows, for vectors of any kind: score, which says the same as scan, measures those
    that aren't usable."""
    length = usual_length(data) if length is None else length
    is_usable = lambda v: F.coalesce(finite(v) & (F.size(v) == length), F.lit(False))
    fits = F.coalesce(inside(scan.labels, scan.numbers), F.lit(False))
    names = ["qid", "id", "distance", *(["fits"] if scan.filters != "only" else [])]
    out = best(data.where(is_usable("vec")), queries.where(is_usable("qvec")), scan).select(*names)
    odd_rows, odd_queries = data.where(~is_usable("vec")), queries.where(~is_usable("qvec"))
    for rows, asked in ((odd_rows, queries), (data.where(is_usable("vec")), odd_queries)):
        if not (odd_rows if rows is odd_rows else odd_queries).isEmpty():
            pairs = range_join(rows, asked, []).select("qid", "id", score.alias("distance"), fits.alias("fits"))
            out = out.unionByName(pairs.select(*names))
    return out


def post_filtered(data: DataFrame, queries: DataFrame, labels: Sequence[str], k: int, depth: int) -> DataFrame:
    """The k nearest by filtering after the search: the depth nearest first; queries of which fewer than k passed go on, to whatever depth it
    takes, by a search that tests rows as it meets them."""
    labels, numbers = tuple(labels), tuple(range(len(labels)))
    fits = F.coalesce(inside(labels), F.lit(False))
    near = cut(top_k(scanned(data, queries, Scan(depth, labels=labels, numbers=numbers, filters="noted"), squared_l2("qvec", "vec")), depth))
    per = near.groupBy("qid").agg(F.count("*").alias("seen"), F.count_if(F.col("fits")).alias("passed"))
    left = cut(per.where((F.col("passed") < k) & (F.col("seen") == depth)).select("qid"))
    done = near.where("fits").join(left, "qid", "left_anti").select("qid", "id", "distance")
    if left.isEmpty():
        return ranked(done, k)
    # the odd vectors' pairs are tested by the same condition
    rest = scanned(data, queries.join(left, "qid", "left_semi"), Scan(k, labels=labels, numbers=numbers), F.when(fits, squared_l2("qvec", "vec")))
    return ranked(done.unionByName(rest), k)


def reach_of(first: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, t): the k-th distance (not squared) of (qid, rank, distance), a little widened; infinite for queries with fewer rows."""
    found = first.where(F.col("rank") == k).select("qid", (F.sqrt("distance") * (1 + SLACK) + SLACK).alias("t"))
    return cut(queries.select("qid").distinct().join(found, "qid", "left").select("qid", F.coalesce("t", F.lit(float("inf"))).alias("t")))


def coded_distances(pairs: DataFrame, queries: DataFrame, quantiser: ProductQuantiser) -> DataFrame:
    """pairs without codes, with the squared code distance, of (qid, codes, ...)."""
    tables = with_tables(queries.select("qid", "qvec"), quantiser).select("qid", "lut")
    return pairs.join(tables, "qid").select(*(c for c in pairs.columns if c != "codes"), looked_up("lut", "codes").alias("distance"))


def not_ruled_out(scored: DataFrame, reach: DataFrame) -> DataFrame:
    """The pairs of scored(qid, id, distance, err) whose distance may be within the query's reach."""
    return scored.join(reach, "qid").where(F.sqrt("distance") - F.col("err") <= F.col("t")).select("qid", "id", *(c for c in scored.columns if c == "part"))


def listed(data: DataFrame, keys: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """(keys..., rows, radius, box_lo_i, box_hi_i) of the lists of data(keys..., far): one row for each list that has rows."""
    boxes = [f(F.when(~F.isnan(F.col(n).cast("double")), F.col(n).cast("double"))).alias(f"box_{side}_{i}") for i, n in enumerate(labels) for side, f in (("lo", F.min), ("hi", F.max))]
    return data.groupBy(*keys).agg(F.count("*").alias("rows"), F.max("far").alias("radius"), *boxes)


def meeting(labels: Sequence[str]) -> Column:
    """Whether the box of a list meets a query's intervals."""
    held = F.lit(True)
    for i in range(len(labels)):
        held = held & (F.col(f"hi_{i}") >= F.col(f"box_lo_{i}")) & (F.col(f"box_hi_{i}") >= F.col(f"lo_{i}"))
    return held


def within(distance: Column) -> Column:
    """Whether a list at this squared distance may hold rows within the query's reach."""
    return F.sqrt(distance) - F.col("radius") * (1 + SLACK) <= F.col("t")


def opened(queries: DataFrame, lists: DataFrame, labels: Sequence[str], reach: DataFrame) -> DataFrame:
    """queries beside the keys of each list(keys..., center, radius, box...) that may hold rows within reach."""
    near = against(lists, queries.join(reach, "qid"), meeting(labels)).where(within(squared_l2("qvec", "center")))
    return near.drop("qvec", "center", "radius", "rows", "t", *(f"box_{side}_{i}" for i in range(len(labels)) for side in ("lo", "hi")))


class Strategy:
    layout = Layout()

    def __init__(self, labels: Sequence[str], params: Params | None = None):
        self.labels, self.params = list(labels), params or Params()

    def build(self, data: DataFrame, path: str | None = None) -> Index:
        """The index, in a folder of its own: by default a new one of the session's shared folder.  ``Index.load`` reads it again."""
        spark, length = data.sparkSession, usual_length(data)
        data = usable(data, length)
        files = self.params.files or max(LEAST_PARTS, data.count() // ROWS_A_PART)
        index = Index(spark, path or new_folder(spark, "index"), files)
        index.extra["length"] = length
        self.made(index, data)
        return index.close()

    def made(self, index: Index, data: DataFrame) -> None:
        """Lays out the usable rows."""
        index.lay("data", self._coded(index, data), self.layout)

    def _coded(self, index: Index, data: DataFrame) -> DataFrame:
        p = self.params
        index.quantiser = ProductQuantiser.fit(data, p.parts, p.codes, seed=p.seed, rounds=p.iterations)
        return with_codes(data, index.quantiser)

    def query(self, index: Index, queries: DataFrame) -> DataFrame:
        return self.found(index, usable(queries, index.extra["length"], "qvec"))

    def found(self, index: Index, queries: DataFrame) -> DataFrame:
        raise NotImplementedError

    def _scored(self, index: Index, pairs: DataFrame, queries: DataFrame) -> DataFrame:
        """(qid, id, part, err, distance) of (qid, id, part, codes, err), written: both steps read it."""
        return cut(coded_distances(pairs.select("qid", "id", "part", "codes", "err"), queries, index.quantiser))

    def _asked(self, labels: Sequence[str], **more) -> dict:
        return {"labels": tuple(labels), "numbers": tuple(range(len(labels))), "once": True, **more}

    def _nearest_by_codes(self, index: Index, rows: DataFrame, queries: DataFrame, n: int, **asked) -> DataFrame:
        """(qid, id, distance, exact, fits, rank): the n best rows of each query by code distance, written."""
        return cut(top_k(best(rows, queries, Scan(n, "codes", quantiser=index.quantiser, **asked)).distinct(), n))

    def _reach(self, index: Index, rows: DataFrame, queries: DataFrame, keep: float, **asked) -> DataFrame:
        """The reach that the best rows by code distance give."""
        k = self.params.k
        near = self._nearest_by_codes(index, rows, queries, max(k, int(k * keep)), **asked)
        return reach_of(top_k(near.select("qid", "id", F.col("exact").alias("distance")), k), queries, k)

    def _nearest(self, index: Index, rows: DataFrame, queries: DataFrame, reach: DataFrame, **asked) -> DataFrame:
        """The k nearest of the rows that codes can't put beyond the reach."""
        found = best(rows, queries.join(reach, "qid"), Scan(self.params.k, quantiser=index.quantiser, **asked))
        return ranked(found.distinct(), self.params.k)

    def _first_reach(self, index: Index, scored: DataFrame, queries: DataFrame, keep: float) -> DataFrame:
        """The reach that the best of some scored pairs give."""
        k = self.params.k
        best = cut(top_k(scored, max(k, int(k * keep))))
        return reach_of(refined(best, index.of(best), queries, k), queries, k)

    def _measured(self, index: Index, scored: DataFrame, queries: DataFrame, reach: DataFrame | None = None) -> DataFrame:
        """The exact k nearest of scored pairs: the best by codes give a reach, unless one is known, and codes rule out the rest."""
        if reach is None:
            reach = self._first_reach(index, scored, queries, self.params.keep)
        left = cut(not_ruled_out(scored, reach))
        return refined(left, index.of(left), queries, self.params.k)


class Quantised(Strategy):
    """pq: code distances to all rows, without a filter; exact distances of those that codes can't rule out."""

    def found(self, index: Index, queries: DataFrame) -> DataFrame:
        asked = self._asked([])
        return self._nearest(index, index.data, queries, self._reach(index, index.data, queries, self.params.keep, **asked), **asked)


class PreFilter(Strategy):
    """prefilter: intervals, code distances of what lies inside, exact ranking."""

    def found(self, index: Index, queries: DataFrame) -> DataFrame:
        asked = self._asked(self.labels)
        rows, _, _ = bounded(index.data, queries, self.labels, range(len(self.labels)))
        return self._nearest(index, rows, queries, self._reach(index, rows, queries, self.params.keep, **asked), **asked)


class ParaFilter(Strategy):
    """parafilter: code distance plus a penalty for failing the filters ranks all rows; the best that pass give the reach."""

    def found(self, index: Index, queries: DataFrame) -> DataFrame:
        p = self.params
        soft = self._asked(self.labels, filters="penalty", penalty=p.penalty * 1e6)
        first = self._nearest_by_codes(index, index.data, queries, max(p.k, int(p.k * p.keep)), **soft).where("fits").drop("rank")
        kept = top_k(first, max(p.k, int(p.k * p.keep_soft))).select("qid", "id", F.col("exact").alias("distance"))
        return self._nearest(index, index.data, queries, reach_of(top_k(kept, p.k), queries, p.k), **self._asked(self.labels))


class Sorted(Strategy):
    """sorting: a copy for each label, in its order, without vectors.

    A query's interval of each label falls into a run of the copy's parts, which the manifest bounds and counts; the label with the fewest
    rows in its run is chosen, for each query by itself, and only that run is read.  The other labels are tested on what it holds, and vectors come
    from those parts of the data that hold what is left.
    """

    def made(self, index: Index, data: DataFrame) -> None:
        super().made(index, data)
        for i, name in enumerate(self.labels):
            own = F.col(name).cast("double")
            rows = index.data.where(own.isNotNull() & ~F.isnan(own)).select("id", "codes", "err", *self.labels, F.col("part").alias("home"))
            index.lay(f"by_{i}", rows, Layout((name,), (), name))

    def runs(self, index: Index, queries: DataFrame) -> DataFrame:
        """(qid, label, part): the parts of the chosen label's copy that a query's interval meets."""
        met = None
        for i in range(len(self.labels)):
            parts = index.tables[f"by_{i}_parts"].select("part", "low", "high", "rows")
            own = against(parts, queries.select("qid", F.col(f"lo_{i}").alias("lo"), F.col(f"hi_{i}").alias("hi")), F.expr("lo <= high AND hi >= low"))
            own = own.select("qid", F.lit(i).alias("label"), "part", "rows")
            met = own if met is None else met.unionAll(own)
        met = cut(met)
        sizes = queries.select("qid").join(F.broadcast(queries.sparkSession.range(len(self.labels)).select(F.col("id").cast("int").alias("label"))))
        sizes = sizes.join(met.groupBy("qid", "label").agg(F.sum("rows").alias("rows")), ["qid", "label"], "left")
        chosen = sizes.groupBy("qid").agg(F.min(F.struct(F.coalesce("rows", F.lit(0)).alias("rows"), "label")).alias("c")).select("qid", F.col("c.label").alias("label"))
        return cut(met.join(chosen, ["qid", "label"]).select("qid", "label", "part"))

    def found(self, index: Index, queries: DataFrame) -> DataFrame:
        if not self.labels:
            return self._measured(index, self._scored(index, range_join(index.data.drop("vec"), queries.select("qid"), []), queries), queries)
        runs, found = self.runs(index, queries), None
        for i in range(len(self.labels)):
            own = runs.where(F.col("label") == i).select("qid", "part")
            rows = index.of(own, f"by_{i}").join(own.join(queries.drop("qvec"), "qid"), "part").where(inside(self.labels))
            rows = rows.select("qid", "id", F.col("home").alias("part"), "codes", "err")
            found = rows if found is None else found.unionByName(rows)
        return self._measured(index, self._scored(index, found, queries), queries)


class TwoLevel(Strategy):
    """Rows belong to label sets and, in each, to the nearest of its vector lists; queries probe the nearest lists of the sets that their
    intervals meet, and then all lists within reach.  Subclasses say what the sets are.

    How many lists a query probes first follows from how many of their rows are expected to fit: each set keeps the quantiles of its labels,
    and the share of these inside a query's intervals is taken for the share of rows.
    """

    layout = Layout(("set_id", "list_id"), ("set_id", "list_id"), "id")
    QUANTILES = 32
    #: Rows of a set that one task assigns to its lists, and rows of a set that its lists are fitted on for each of them.
    PIECE, FIT = 50_000, 64

    def sets(self, index: Index, data: DataFrame) -> DataFrame:
        """data with the column set_id: as many rows for each of its own as there are sets that it belongs to."""
        raise NotImplementedError

    def chosen(self, index: Index, queries: DataFrame) -> DataFrame:
        """(qid, set_id) of the sets to probe first."""
        raise NotImplementedError

    def covering(self, index: Index, queries: DataFrame) -> DataFrame | None:
        """(qid, set_id) of sets that hold all rows that a query may find; none where any set may."""
        return None

    def made(self, index: Index, data: DataFrame) -> None:
        p = self.params
        placed = cut(self.sets(index, self._coded(index, data)))
        sizes = placed.groupBy("set_id").count().select("set_id", (F.col("count") / F.lit(self.PIECE)).cast("int").alias("more"), (F.lit(float(self.FIT * p.lists)) / F.col("count")).alias("share"))
        pieced = placed.join(sizes, "set_id").withColumn("piece", F.pmod(F.xxhash64("id"), F.col("more") + 1)).drop("more")
        sample = pieced.where(F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(1 << 30)) < F.col("share") * (1 << 30)).select("set_id", F.col("vec").cast("array<double>").alias("vec"))

        def fit(key, rows):
            import pandas as pd

            centres = k_means(np.stack(rows["vec"]), p.lists, p.seed)
            return pd.DataFrame({"set_id": key[0], "list_id": range(len(centres)), "center": list(centres)})

        # a set that the sample missed has one list, around its first row
        fitted = cut(sample.groupBy("set_id").applyInPandas(fit, "set_id bigint, list_id int, center array<double>"))
        alone = placed.join(fitted.select("set_id").distinct(), "set_id", "left_anti").groupBy("set_id").agg(F.min_by("vec", "id").cast("array<double>").alias("center"))
        centres = cut(fitted.unionByName(alone.withColumn("list_id", F.lit(0))))
        assigned = _assigned(pieced.drop("share"), centres)
        assigned = cut(assigned)
        index.lay("data", assigned.drop("far"), self.layout)
        index.keep("lists", listed(assigned, ["set_id", "list_id"], self.labels).join(centres, ["set_id", "list_id"]))
        shares = [i / self.QUANTILES for i in range(self.QUANTILES + 1)]
        clean = [F.when(~F.isnan(F.col(n).cast("double")), F.col(n).cast("double")) for n in self.labels]
        index.keep("quantiles", assigned.groupBy("set_id").agg(F.count("*").alias("rows"), *(F.percentile_approx(c, shares, 1000).alias(f"q_{i}") for i, c in enumerate(clean))))

    def _share(self) -> Column:
        """The share of a set's rows that is expected inside a query's intervals, by the set's quantiles."""
        share = F.lit(1.0)
        for i in range(len(self.labels)):
            held = F.size(F.filter(f"q_{i}", _between(i)))
            share = share * F.least(F.lit(1.0), (F.greatest(held, F.lit(0)) + 0.25) / (self.QUANTILES + 1))
        return share

    def probed(self, index: Index, queries: DataFrame) -> DataFrame:
        """(qid, set_id, list_id) of the nearest lists, as many as are expected to hold enough rows that fit, probes at most."""
        p, lists = self.params, index.tables["lists"]
        sets = self.chosen(index, queries).join(index.tables["quantiles"].drop("rows"), "set_id").join(queries, "qid")
        # each row meets all lists of a set: few bytes, which would be one task's, are much work
        sets = sets.select("qid", "qvec", "set_id", self._share().alias("share")).repartition(2 * index.spark.sparkContext.defaultParallelism, "qid")
        near = sets.join(lists.select("set_id", "list_id", "center", "rows"), "set_id")
        near = near.select("qid", "set_id", "list_id", squared_l2("qvec", "center").alias("distance"), (F.col("rows") * F.col("share")).alias("expected"), F.struct("set_id", "list_id").alias("id"))
        near = top_k(near, p.probes)
        before = F.sum("expected").over(Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
        return near.withColumn("before", F.coalesce(before, F.lit(0.0))).where(F.col("before") < p.expected * p.k).select("qid", "set_id", "list_id")

    def found(self, index: Index, queries: DataFrame) -> DataFrame:
        lists, keys = index.tables["lists"], ["set_id", "list_id"]

        def rows(wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
            """The rows of the parts that (qid, set_id, list_id) names, and the queries with the lists that each reads."""
            parts = index.tables["data_parts"].join(wanted.select(*keys).distinct(), keys)
            return index.of(parts).withColumn("list", _number()), wanting(queries, wanted.select("qid", _number().alias("list")))

        # a row of several sets counts once for each query
        asked = self._asked(self.labels)
        reach = self._reach(index, *rows(cut(self.probed(index, queries))), self.params.keep, **asked)
        reach = queries.select("qid").distinct().join(reach, "qid", "left").select("qid", F.coalesce("t", F.lit(float("inf"))).alias("t"))
        cover = self.covering(index, queries)
        if cover is None:
            near = opened(queries, lists, self.labels, reach).select("qid", *keys)
        else:
            near = cover.join(lists, "set_id").join(queries, "qid").where(meeting(self.labels)).join(reach, "qid").where(within(squared_l2("qvec", "center"))).select("qid", *keys)
        return self._nearest(index, *rows(cut(near)), reach, **asked)


def _number() -> Column:
    """One number for a set and a list."""
    return F.shiftleft(F.col("set_id").cast("bigint"), 24) + F.col("list_id")


def wanting(queries: DataFrame, lists: DataFrame) -> DataFrame:
    """queries with wanted, the lists of (qid, list) that each reads; those without any drop out."""
    return queries.join(lists.groupBy("qid").agg(F.collect_set(F.col("list").cast("bigint")).alias("wanted")), "qid")


def _between(i: int):
    return lambda x: (x >= F.col(f"lo_{i}")) & (x <= F.col(f"hi_{i}"))


def _assigned(data: DataFrame, centres: DataFrame) -> DataFrame:
    """data(set_id, piece, vec, ...) without piece, with the nearest list of each row's set and how far its centre is; a task has a piece of
    a set and the set's centres at a time."""
    schema = T.StructType([*(f for f in data.schema if f.name != "piece"), T.StructField("list_id", T.IntegerType()), T.StructField("far", T.DoubleType())])

    def assign(rows: pa.Table, own: pa.Table) -> pa.Table:
        rows = rows.drop_columns(["piece"])
        if not len(rows):
            return rows.append_column("list_id", pa.array([], pa.int32())).append_column("far", pa.array([], pa.float64()))
        own = own.sort_by("list_id")
        points = np.stack(own.column("center").to_pylist())
        at, far = [], []
        for batch in rows.to_batches():
            for _, vectors in vector_batches([batch], batch.schema.get_field_index("vec")):
                near = nearest(vectors, points)
                at.append(near.astype(np.int32))
                far.append(np.linalg.norm(vectors - points[near], axis=1))
        return rows.append_column("list_id", pa.array(np.concatenate(at))).append_column("far", pa.array(np.concatenate(far)))

    pieces = data.select("set_id", "piece").distinct().join(centres, "set_id").select(F.col("set_id").alias("of"), F.col("piece").alias("number"), "list_id", "center")
    return data.groupBy("set_id", "piece").cogroup(pieces.groupBy("of", "number")).applyInArrow(assign, schema)


class LabelClusters(TwoLevel):
    """ivf-ivf_pq: sets are clusters of the labels by cosine; a query takes the nearest ones first, as far as enough of their rows fit."""

    def sets(self, index: Index, data: DataFrame) -> DataFrame:
        least = [lo for lo, _ in label_extent(data, self.labels)]
        values = (F.col(n).cast("double") - F.lit(lo) for n, lo in zip(self.labels, least))
        moved = data.withColumn("__l", F.array(*(F.when(v.isNull() | F.isnan(v), 0.0).otherwise(v) for v in values)))
        (centres,) = fit_centres(moved, self.params.label_clusters, 1, "__l", seed=self.params.seed, cosine=True)
        index.extra.update(label_centers=centres, least=least)
        return with_nearest(moved, centres, "set_id", "__l", cosine=True).withColumn("set_id", F.col("set_id").cast("bigint")).drop("__l")

    def chosen(self, index: Index, queries: DataFrame) -> DataFrame:
        p = self.params
        middle = F.array(*(F.when(F.col(f"hi_{i}") == float("inf"), F.col(f"lo_{i}") - F.lit(lo)).otherwise(range_middle(i, lo)) for i, lo in enumerate(index.extra["least"])))
        table = index.spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(index.extra["label_centers"])], "set_id bigint, center array<double>")
        # both sides on the unit sphere: nearest by cosine is nearest by angle
        size = F.sqrt(F.greatest(F.aggregate(F.transform(middle, lambda x: x * x), F.lit(0.0), lambda a, x: a + x), F.lit(1e-24)))
        near = queries.select("qid", F.transform(middle, lambda x: x / size).alias("m")).join(F.broadcast(table))  # label_clusters rows
        near = top_k(near.select("qid", F.col("set_id").alias("id"), squared_l2("m", "center").alias("distance")), p.label_probes).select("qid", F.col("id").alias("set_id"))
        if p.pass_ratio <= 0:
            return near
        # by the quantiles of all rows of a set: rows are never held against queries here
        passing = near.join(index.tables["quantiles"], "set_id").join(queries.drop("qvec"), "qid").where(self._share() >= p.pass_ratio)
        return passing.select("qid", "set_id")


class GridCells(TwoLevel):
    """grid-ivf_pq: sets are overlapping cells of a grid over the labels, which a row is in two of along each label.

    Cell c of a label holds two strides from the c-th on, so a query whose intervals are a stride wide at most lies in one cell, and needs no
    other; a wider one takes every second cell, which hold each of its rows once.  With widths, the usual widths of the queries' intervals,
    strides are as wide as these.  The grid has at most max_cells cells: the labels get theirs one after another, the widest
    (in strides) last and as many as are left of the budget.
    """

    def sets(self, index: Index, data: DataFrame) -> DataFrame:
        extent = label_extent(data, self.labels)
        spans = [max(hi - lo, 1e-9) for lo, hi in extent]
        shape = self._shape(spans)
        index.extra.update(shape=shape, lefts=[lo for lo, _ in extent], spans=spans)
        out = data.withColumn("set_id", F.lit(0).cast("bigint"))
        for name, (lo, _), span, each in zip(self.labels, extent, spans, shape):
            at = F.coalesce(coordinate(F.col(name), lo, span, each), F.lit(0).cast("bigint"))
            # the cell that begins with the row's stride, and the one before
            out = out.withColumn("__c", F.explode(F.array_distinct(F.array(at, F.greatest(at - 1, F.lit(0).cast("bigint")))))).withColumn("set_id", F.col("set_id") * each + F.col("__c")).drop("__c")
        return out

    def _shape(self, spans: list[float]) -> list[int]:
        """Strides by label."""
        budget = max(1, self.params.max_cells)
        if not self.params.widths:
            return [max(1, int(budget ** (1 / max(1, len(spans))) + 1e-9))] * len(spans)
        wanted = [max(1, int(span / max(width, 1e-9))) for span, width in zip(spans, self.params.widths)]
        shape, left = [1] * len(spans), budget
        order = sorted(range(len(spans)), key=lambda i: wanted[i])
        for place, i in enumerate(order):
            fair = int(left ** (1 / (len(order) - place)) + 1e-9)
            shape[i] = max(1, min(wanted[i], fair))
            left = max(1, left // shape[i])
        return shape

    def chosen(self, index: Index, queries: DataFrame) -> DataFrame:
        x = index.extra
        out = queries.select("qid", F.lit(0).cast("bigint").alias("set_id"), *(f"{side}_{i}" for i in range(len(self.labels)) for side in ("lo", "hi")))
        for i, (left, span, each) in enumerate(zip(x["lefts"], x["spans"], x["shape"])):
            lo, hi = (coordinate(F.col(f"{side}_{i}"), left, span, each) for side in ("lo", "hi"))
            steps = F.when(lo <= hi, F.sequence(lo, F.greatest(lo, hi - 1), F.lit(2).cast("bigint")))
            # the last of every second cell may end a stride before the interval does
            steps = F.when(F.element_at(steps, -1) + 1 < hi, F.concat(steps, F.array(hi))).otherwise(steps)
            out = out.withColumn("__c", F.explode(steps)).withColumn("set_id", F.col("set_id") * each + F.col("__c")).drop("__c")
        return out.select("qid", "set_id")

    def covering(self, index: Index, queries: DataFrame) -> DataFrame | None:
        return self.chosen(index, queries)


class SuperGrid(Strategy):
    """super-grid: vector clusters and sub-clusters, each sub-cluster with counts by label cell and its rows in Morton order.

    Counts are kept as prefix sums by cell, of which only those are stored that differ from their neighbour's below.  A query's box is counted in
    each sub-cluster from its corners: clusters and sub-clusters with no row in it are never probed, however near, and of the nearest
    others as many are probed first as hold enough rows.  Rows are laid out by sub-cluster and Morton code: the box as Morton intervals
    meets some parts of the probed sub-clusters, and only these are read.  Sub-clusters beyond the probed ones follow as far as they lie within
    reach.
    """

    layout = Layout(("sub", "zcode"), ("sub",), "zcode")

    def made(self, index: Index, data: DataFrame) -> None:
        p = self.params
        coded = self._coded(index, data)
        (sub_centers,) = fit_centres(data, p.clusters * p.sub_clusters, seed=p.seed, rounds=p.iterations)
        of = balanced_groups(sub_centers, p.clusters, p.seed)
        centers = [sub_centers[of == g].mean(0) for g in range(of.max() + 1 if len(of) else 0)]
        active = [i for i in range(len(self.labels)) if not p.label_mask >> i & 1]
        extent = label_extent(data, [self.labels[i] for i in active])
        lefts = [float(np.floor(lo)) for lo, _ in extent]
        spans = [max(1.0, float(np.ceil(hi)) - left) for (_, hi), left in zip(extent, lefts)]
        shape = self._shape(spans)
        at = {f"c_{j}": coordinate(F.col(self.labels[i]), lefts[j], spans[j], shape[j]) for j, i in enumerate(active)}
        bits = max(1, int(np.ceil(np.log2(max(shape, default=1) + 1))))
        placed = with_nearest(coded, sub_centers, "sub", far="far")
        placed = placed.withColumns(at) if at else placed
        placed = cut(placed.withColumn("zcode", F.coalesce(morton_code([F.col(c) for c in at], bits), F.lit(0).cast("bigint")) if at else F.lit(0).cast("bigint")))
        index.extra.update(active=active, lefts=lefts, spans=spans, shape=shape, bits=bits)
        index.lay("data", placed.drop("far"), self.layout)
        table = index.spark.createDataFrame([(i, int(of[i]), [float(v) for v in c], [float(v) for v in centers[of[i]]]) for i, c in enumerate(sub_centers)], "sub int, cluster int, center array<double>, cluster_center array<double>")
        index.keep("subs", listed(placed, ["sub"], self.labels).join(table, "sub"))
        if at:
            # rows without a value of a label are in no cell, as they are in no interval
            counts = cell_counts(placed.where(" AND ".join(f"{c} IS NOT NULL" for c in at)), list(at), ["sub"])
            index.keep("sums", changes(prefix_sums(counts, list(at), shape, ["sub"]), list(at), ["sub"]))

    def _shape(self, spans: list[float]) -> list[int]:
        """Cells by label: the widest gets the root of the budget, the others share what is left."""
        if not spans:
            return []
        budget = self.params.grids
        if len(spans) == 1:
            return [int(max(1, min(budget, spans[0])))]
        main = max(1, int(np.sqrt(budget)))
        widest = int(np.argmax(spans))
        each, left, shape = max(1, int(main ** (1 / (len(spans) - 1)))), main, [0] * len(spans)
        for i in sorted((i for i in range(len(spans)) if i != widest), key=lambda i: spans[i]):
            shape[i] = int(max(1, min(left, spans[i], each)))
            left = max(1, left // shape[i])
        shape[widest] = main
        return shape

    def boxes(self, index: Index, queries: DataFrame) -> DataFrame:
        """queries with the corners of their boxes of cells."""
        x = index.extra
        for j, i in enumerate(x["active"]):
            for side in ("lo", "hi"):
                queries = queries.withColumn(f"c_{j}_{side}", coordinate(F.col(f"{side}_{i}"), x["lefts"][j], x["spans"][j], x["shape"][j]))
        return queries

    def held(self, index: Index, boxes: DataFrame) -> DataFrame:
        """(qid, sub, cluster, center, cluster_center, radius, cnt): sub-clusters with rows in a query's box, and how many."""
        names = [f"c_{j}" for j in range(len(index.extra["active"]))]
        subs = index.tables["subs"]
        near = against(subs.drop("cluster", "center", "cluster_center", "radius"), boxes.drop("qvec"), meeting(self.labels))
        if names:
            corners = [f"{n}_{side}" for n in names for side in ("lo", "hi")]
            found = box_counts_from_changes(index.tables["sums"], near.select("qid", "sub", *corners), names, "qid", ["sub"]).where("cnt > 0")
        else:
            found = near.select("qid", "sub", F.col("rows").alias("cnt"))
        return found.join(subs.select("sub", "cluster", "center", "cluster_center", "radius"), "sub")

    def intervals(self, index: Index, boxes: DataFrame) -> DataFrame | None:
        """(qid, z_lo, z_hi): each box as Morton intervals."""
        names = [f"c_{j}" for j in range(len(index.extra["active"]))]
        return cut(z_intervals(boxes, names, index.extra["bits"], self.params.levels)) if names else None

    def parts(self, index: Index, boxes: DataFrame, wanted: DataFrame, intervals: DataFrame | None) -> DataFrame:
        """(qid, sub, part): the parts of the wanted (qid, sub) that the Morton intervals of a query's box meet."""
        parts = index.tables["data_parts"]
        if intervals is None:
            return wanted.join(parts.select("sub", "part"), "sub")
        met = wanted.join(intervals, "qid").join(parts, "sub").where(F.expr("z_lo <= high AND z_hi >= low"))
        return met.select("qid", "sub", "part").distinct()

    def found(self, index: Index, queries: DataFrame) -> DataFrame:
        p = self.params
        boxes = cut(self.boxes(index, queries))
        held = cut(self.held(index, boxes).join(queries.select("qid", "qvec"), "qid").withColumn("distance", squared_l2("qvec", "center")).withColumn("of_cluster", squared_l2("qvec", "cluster_center")).drop("qvec", "center", "cluster_center"))
        clusters = held.groupBy("qid", F.col("cluster").alias("id")).agg(F.min("of_cluster").alias("distance"))
        probed = top_k(clusters, p.cluster_probes).select("qid", F.col("id").alias("cluster"))
        near = top_k(held.join(probed, ["qid", "cluster"]).select("qid", F.col("sub").alias("id"), "distance", "cnt"), p.sub_probes)
        before = F.sum("cnt").over(Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
        lists = near.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < p.expected * p.k).select("qid", F.col("id").alias("sub"))
        intervals = self.intervals(index, boxes)

        def rows(wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
            parts = cut(self.parts(index, boxes, wanted, intervals))
            return index.of(parts).withColumn("list", F.col("sub").cast("bigint")), wanting(queries, parts.select("qid", F.col("sub").alias("list")))

        asked = self._asked(self.labels)
        reach = self._reach(index, *rows(lists), p.keep, **asked)
        reach = queries.select("qid").distinct().join(reach, "qid", "left").select("qid", F.coalesce("t", F.lit(float("inf"))).alias("t"))
        rest = held.join(reach, "qid").where(within(F.col("distance"))).select("qid", "sub")
        return self._nearest(index, *rows(rest), reach, **asked)


class PostFilterLists(Strategy):
    """ivfpq-post: nearest vector lists, code distances, exact distances of the best, and only then the filters; the lists within the
    reach of what passed are read with the filters.

    Codes are of what is left of a vector without its list's centre, so a query has a table of distances for each list that it reads.
    """

    layout = Layout(("list_id",), ("list_id",), "id")

    def made(self, index: Index, data: DataFrame) -> None:
        p = self.params
        (centres,) = fit_centres(data, p.lists, seed=p.seed, rounds=p.iterations)
        placed = cut(with_nearest(data, centres, "list_id", far="far", rest="rest"))
        index.quantiser = ProductQuantiser.fit(placed, p.parts, p.codes, vector="rest", seed=p.seed, rounds=p.iterations)
        coded = with_codes(placed, index.quantiser, "rest").drop("rest")
        index.lay("data", coded.drop("far"), self.layout)
        table = index.spark.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(centres)], "list_id int, center array<double>")
        index.keep("lists", listed(placed, ["list_id"], self.labels).join(table, "list_id"))

    def _centers(self, index: Index) -> dict[int, np.ndarray]:
        """By list, of which there are as many as a parameter says."""
        return {r.list_id: np.array(r.center) for r in index.tables["lists"].select("list_id", "center").collect()}

    def _rows(self, index: Index, wanted: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The rows of the parts that hold the lists of wanted(qid, list_id), and the queries with the lists that each reads."""
        parts = index.tables["data_parts"].join(wanted.select("list_id").distinct(), "list_id")
        return index.of(parts).withColumn("list", F.col("list_id").cast("bigint")), wanting(queries, wanted.select("qid", F.col("list_id").alias("list")))

    def passed(self, index: Index, queries: DataFrame) -> DataFrame:
        """(qid, id, distance) of what is found before the filters and passes them."""
        p = self.params
        near = against(index.tables["lists"].select("list_id", "center"), queries, F.lit(True)).select("qid", F.col("list_id").alias("id"), squared_l2("qvec", "center").alias("distance"))
        probed = cut(top_k(near, p.probes).select("qid", F.col("id").alias("list_id")))
        noted = self._asked(self.labels, filters="noted", centers=self._centers(index))
        best_ = self._nearest_by_codes(index, *self._rows(index, probed, queries), int(p.k * p.refine * p.beta), **noted)
        return top_k(best_.select("qid", "id", F.col("exact").alias("distance"), "fits"), int(p.k * p.beta)).where("fits").select("qid", "id", "distance")

    def found(self, index: Index, queries: DataFrame) -> DataFrame:
        p = self.params
        reach = reach_of(top_k(self.passed(index, queries), p.k), queries, p.k)
        wanted = cut(opened(queries, index.tables["lists"], self.labels, reach).select("qid", "list_id"))
        return self._nearest(index, *self._rows(index, wanted, queries), reach, **self._asked(self.labels, centers=self._centers(index)))


class PostFilterGraph(PostFilterLists):
    """cagra-post: a graph of near neighbours, walked until no frontier changes, and only then the filters.

    The graph starts with each row's nearest ones of its own cell and of the next nearest cell (a cell has about CELL_ROWS rows; larger ones are
    cut into pieces by hash, so that the pairs looked at grow with the data and not with its square).  Rounds of descent follow: neighbours of a row's
    nearest neighbours, in either direction, take the place of farther ones, until each row has i_degree.  Of these, edges stay that the fewest
    detours replace (two nearer edges that lead to the same row), half of degree for each row, and their reverses fill it up.
    A walk starts from the rows nearest to a few centres of all and keeps the frontier's best by exact distance; each round is one equi-join with the
    edges, which name the part that the other row's vector is in.
    """

    CELL_ROWS, DESCENTS, JOINED = 512, 2, 8

    def made(self, index: Index, data: DataFrame) -> None:
        p = self.params
        super().made(index, data)
        points = index.data.select("id", "vec")
        n = points.count()
        (centres,) = fit_centres(data, max(p.lists, 1 + n // self.CELL_ROWS), seed=p.seed)
        cells = cut(_two_nearest(points, centres))
        pieces = cells.groupBy(F.col("near")[0].alias("cell")).agg(F.expr(f"int(ceil(count(*) / {4 * self.CELL_ROWS}))").alias("pieces"))
        piece = F.pmod(F.xxhash64("id"), F.col("pieces")).alias("piece")
        held = cells.select(F.col("near")[0].alias("cell"), "id", "vec").join(pieces, "cell").select("cell", piece, "id", "vec")
        asked = cells.select(F.explode(F.array_distinct("near")).alias("cell"), F.col("id").alias("qid"), F.col("vec").alias("qvec")).join(pieces, "cell")
        asked = asked.select("cell", F.pmod(F.xxhash64("qid"), F.col("pieces")).alias("piece"), "qid", "qvec")
        edges = cut(top_k(_nearest_of_cells(asked, held, p.i_degree), p.i_degree))
        for _ in range(self.DESCENTS):
            edges = cut(self._descended(edges, points))
        edges = cut(self._pruned(edges).join(index.data.select(F.col("id").alias("b"), F.col("part").alias("b_part")), "b"))
        index.keep("edges", edges)
        (spread,) = fit_centres(points, p.entries, seed=p.seed + 1)
        near = with_nearest(index.data.select("id", "part", "vec"), spread, "entry", far="far")
        index.keep("entries", near.groupBy("entry").agg(F.min(F.struct("far", "id", "part")).alias("e")).select("e.id", "e.part"))

    def _descended(self, edges: DataFrame, points: DataFrame) -> DataFrame:
        """(qid, id, distance, rank): the nearest of a row's neighbours and of theirs."""
        near = edges.where(F.col("rank") <= self.JOINED).select("qid", "id")
        back = edges.where(F.col("rank") <= self.JOINED).select(F.col("id").alias("qid"), F.col("qid").alias("id"))
        # a row that many hold as a neighbour sends some of them on: those chosen by hash, as the reverse edges of hubs grow with the data
        back = top_k(back.withColumn("distance", F.xxhash64("qid", "id")), self.JOINED).select("qid", "id")
        both = near.unionAll(back).distinct()
        # a row's vector goes to the rows that hold it, and no vector to a pair; far is what a row's new neighbour has to undercut
        far = edges.groupBy(F.col("qid").alias("id")).agg(F.when(F.count("*") >= self.params.i_degree, F.max("distance")).otherwise(float("inf")).alias("far"))
        held = both.join(points.join(far, "id", "left").select("id", "vec", F.coalesce("far", F.lit(float("inf"))).alias("far")), "id")
        fresh = _near_each_other(held.groupBy("qid").agg(F.collect_list("id").alias("ids"), F.collect_list("vec").alias("vecs"), F.collect_list("far").alias("fars")), edges.schema["id"].dataType)
        # one shuffle for both: pairs that are met more than once count once
        met = edges.select("qid", "id", "distance").unionByName(fresh).repartition("qid").groupBy("qid", "id").agg(F.min("distance").alias("distance"))
        return top_k(met, self.params.i_degree)

    def _pruned(self, edges: DataFrame) -> DataFrame:
        """(a, b): edges with the fewest detours, and reverses up to the degree."""
        half = max(1, self.params.degree // 2)
        # a row's neighbours, nearest first, go to each of them as one array; only detours come back
        lists = cut(edges.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "id"))).alias("all")).select("qid", F.col("all.id").alias("ids")))
        one = lists.select("qid", F.col("ids").alias("mine"), F.posexplode("ids").alias("first", "via"))
        two = lists.select(F.col("qid").alias("via"), F.col("ids").alias("theirs"))
        over = "filter(transform(mine, (x, i) -> struct(x AS id, i AS place, array_position(theirs, x) AS second)), c -> c.place > first AND c.second > 0 AND c.second - 1 < c.place)"
        detours = one.join(two, "via").select("qid", F.inline(F.expr(over))).groupBy("qid", "id").agg(F.count("*").alias("detours"))
        scored = edges.join(detours, ["qid", "id"], "left").select("qid", "id", (F.coalesce("detours", F.lit(0)) * 1000 + F.col("rank")).cast("double").alias("distance"))
        out = cut(top_k(scored, half).select("qid", "id", "rank"))
        back = top_k(out.select(F.col("id").alias("qid"), F.col("qid").alias("id"), F.col("rank").alias("distance")), half)
        return out.select("qid", "id").unionAll(back.select("qid", "id")).distinct().toDF("a", "b")

    def passed(self, index: Index, queries: DataFrame) -> DataFrame:
        walked = self.first(index, queries).join(index.data.select("id", *self.labels), "id").join(queries.drop("qvec"), "qid")
        return walked.where(inside(self.labels)).select("qid", "id", "distance")

    def first(self, index: Index, queries: DataFrame) -> DataFrame:
        """(qid, id, distance): what the walk finds before the filters."""
        p = self.params
        asked = queries.select("qid", "qvec")

        def measured(pairs: DataFrame) -> DataFrame:
            """(qid, id, distance) of written (qid, id, part): vectors come from those parts."""
            own = pairs.select("qid", "id").join(index.of(pairs).select("id", "vec"), "id").join(asked, "qid")
            return own.select("qid", "id", squared_l2("qvec", "vec").alias("distance"))

        entries = index.tables["entries"]
        seen = cut(measured(cut(asked.select("qid").join(F.broadcast(entries)))).withColumn("rank", F.lit(0)))  # entries are a parameter
        seen = cut(top_k(seen.drop("rank"), p.frontier).withColumn("walked", F.lit(False)))
        for _ in range(p.rounds):
            # the nearest rows of the frontier whose edges weren't followed yet
            step = cut(top_k(seen.where(~F.col("walked")).select("qid", "id", "distance"), p.width).select("qid", F.col("id").alias("a")))
            if step.isEmpty():
                break
            seen = seen.join(step.select("qid", F.col("a").alias("id"), F.lit(True).alias("now")), ["qid", "id"], "left").withColumn("walked", F.coalesce("now", "walked")).drop("now", "rank")
            reached = step.join(index.tables["edges"], "a").select("qid", F.col("b").alias("id"), F.col("b_part").alias("part")).distinct()
            fresh = measured(cut(reached.join(seen, ["qid", "id"], "left_anti"))).withColumn("walked", F.lit(False))
            seen = cut(top_k(seen.unionByName(fresh), p.frontier))
        return top_k(seen.select("qid", "id", "distance"), int(p.k * p.beta)).select("qid", "id", "distance")


def _nearest_of_cells(asked: DataFrame, held: DataFrame, k: int) -> DataFrame:
    """(qid, id, distance): of each asked(cell, piece, qid, qvec) the k nearest of held(cell, piece, id, vec) there, itself left out; a task has one piece
    of a cell at a time."""
    schema = T.StructType([T.StructField("qid", asked.schema["qid"].dataType), T.StructField("id", held.schema["id"].dataType), T.StructField("distance", T.DoubleType())])
    matrix = lambda column: column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [pa.table({"qid": left.column("qid").slice(0, 0), "id": right.column("id").slice(0, 0), "distance": pa.array([], pa.float64())})]
        if len(left) and len(right):
            points, ids = matrix(right.column("vec")), right.column("id").combine_chunks()
            for start in range(0, len(left), 512):
                part = left.slice(start, 512)
                far = _squares(matrix(part.column("qvec")), points)
                near = np.argpartition(far, k, axis=1)[:, : k + 1] if far.shape[1] > k + 1 else np.tile(np.arange(far.shape[1]), (len(part), 1))
                own = np.repeat(np.arange(len(part)), near.shape[1])
                pairs = pa.table({"qid": part.column("qid").combine_chunks().take(pa.array(own)), "id": ids.take(pa.array(near.ravel())), "distance": pa.array(far[own, near.ravel()])})
                found.append(pairs.filter(pc.not_equal(pairs.column("qid"), pairs.column("id"))))
        return pa.concat_tables(found)

    return asked.groupBy("cell", "piece").cogroup(held.groupBy("cell", "piece")).applyInArrow(find, schema)


def _squares(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of left (..., n, d) and right (..., m, d)."""
    out = -2 * left @ np.swapaxes(right, -1, -2)
    out += (left**2).sum(-1)[..., :, None]
    out += (right**2).sum(-1)[..., None, :]
    return np.maximum(out, 0)


def _near_each_other(groups: DataFrame, kind: T.DataType) -> DataFrame:
    """(qid, id, distance) of the pairs among each group's rows (ids, vecs, fars) that are nearer than the first one's far."""
    schema = T.StructType([T.StructField("qid", kind), T.StructField("id", kind), T.StructField("distance", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                sizes = pc.list_value_length(batch.column("ids")).to_numpy()
                ids, fars = batch.column("ids").flatten(), batch.column("fars").flatten().to_numpy()
                flat = batch.column("vecs").flatten()
                points = flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(flat), -1)
                first = np.cumsum(sizes) - sizes
                # groups of one size are measured together
                for size in np.unique(sizes[sizes > 1]):
                    at = first[sizes == size][:, None] + np.arange(size)
                    far = _squares(points[at], points[at])
                    g, a, b = np.nonzero(far < fars[at][:, :, None])
                    own = a != b
                    g, a, b = g[own], a[own], b[own]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(at[g, a])), ids.take(pa.array(at[g, b])), pa.array(far[g, a, b])], names=["qid", "id", "distance"])

    return groups.select("ids", "vecs", "fars").mapInArrow(run, schema)


def _two_nearest(data: DataFrame, centers: np.ndarray) -> DataFrame:
    """data with near array<int>: the numbers of each vector's two nearest centres."""
    at = data.columns.index("vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, points in vector_batches(batches, at):
            far = (centers**2).sum(1)[None, :] - 2 * points @ centers.T
            two = np.argsort(far, axis=1, kind="stable")[:, :2].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(two) + 1, dtype=np.int32) * two.shape[1]), pa.array(two.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "near"])

    return data.mapInArrow(run, T.StructType([*data.schema, T.StructField("near", T.ArrayType(T.IntegerType()))]))


def until_k_pass(pairs: DataFrame, queries: DataFrame, k: int, depth: int) -> DataFrame:
    """The k nearest that pass of (qid, id, distance, fits), by filtering after the search: the depth nearest first, and all rows that pass
    for the queries of which fewer than k of these did."""
    near = cut(top_k(pairs.join(queries.select("qid").distinct(), "qid", "left_semi"), depth))
    per = near.groupBy("qid").agg(F.count("*").alias("seen"), F.count_if(F.col("fits")).alias("passed"))
    left = cut(per.where((F.col("passed") < k) & (F.col("seen") == depth)).select("qid"))
    done = near.where("fits").join(left, "qid", "left_anti").select("qid", "id", "distance")
    rest = pairs.where("fits").join(left, "qid", "left_semi").select("qid", "id", "distance")
    return ranked(done.unionByName(rest), k)


STRATEGIES = {
    "pq": Quantised,
    "prefilter": PreFilter,
    "parafilter": ParaFilter,
    "sorting": Sorted,
    "ivf-ivf_pq": LabelClusters,
    "grid-ivf_pq": GridCells,
    "super-grid": SuperGrid,
    "cagra-post": PostFilterGraph,
    "ivfpq-post": PostFilterLists,
}


def search(algorithm: str, data: DataFrame, queries: DataFrame, labels: Sequence[str], params: Params | None = None) -> DataFrame:
    """Builds the named strategy's index over data and answers the queries."""
    if algorithm not in STRATEGIES:
        raise ValueError(f"unknown algorithm {algorithm!r}; known are {', '.join(STRATEGIES)}")
    strategy = STRATEGIES[algorithm](labels, params)
    return strategy.query(strategy.build(data), queries)
