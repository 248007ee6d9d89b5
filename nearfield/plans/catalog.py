"""All registered search queries with their DuckDB equivalents.

Vector queries run over the whole of ``embeddings``; its rows with a vec_id divisible by 100 are the queries, and three labels are
derived from vec_id and label alike in both engines.  Grid queries run over the whole of ``lineitem``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions.filters import Divide, Interval, IntervalMap, Shift, inside, range_middle, with_bounds
from nearfield.functions.grids import coordinate, flattened, morton_code, morton_coordinates, unflattened
from nearfield.functions.vectors import cosine_distance, looked_up, squared_l2
from nearfield.operators.block_scan import Scan, best
from nearfield.operators.grid_counts import box_counts, box_counts_from_sums, cell_counts, compressed, expanded, gathered, intersecting, prefix_sums
from nearfield.operators.metrics import recall
from nearfield.operators.quantise import ProductQuantiser, code_tables, pad_parts, part_of, usable, usual_length, with_codes
from nearfield.operators.range_join import label_extent, range_join
from nearfield.operators.sorted_places import ranks, with_places
from nearfield.operators.topk import merged_top_k, top_k
from nearfield.operators.zorder import z_intervals
from nearfield.plans.indexes import STRATEGIES, Index, Params, exact, opened, post_filtered, ranked, reach_of, scanned, search, wanting
from nearfield.sources.config import parse_filters, parse_settings
from nearfield.sources.lineage import cut, new_folder
from nearfield.sources.matrices import read_id_set, read_raw_results, write_raw_results
from nearfield.streaming.serving import serve

K = 10
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _register(name: str, sql: str | None = None):
    def keep(query: Query) -> Query:
        QUERIES[name] = query
        if sql:
            ORACLES[name] = sql
        return query

    return keep


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.col("label").cast("double").alias("l0"), F.expr("double(vec_id * 37 % 101)").alias("l1"), F.expr("double(vec_id div 50)").alias("l2"))


def asked(data: DataFrame) -> DataFrame:
    own = data.where(F.col("id") % 100 == 0)
    return own.select(F.col("id").alias("qid"), F.col("vec").alias("qvec"), (F.col("l0") + 1).alias("x0"), F.col("l1").alias("x1"), F.col("l2").alias("x2"), (F.col("l2") - 3).alias("x2_from"), (F.col("l2") + 4).alias("x2_to"))


INTERVALS = ((0, 2), (1, 3), (0, 5), (3, 3), (2, 6), (5, 9), (4, 7), (7, 8), (6, 9), (9, 9))
_CATEGORY = IntervalMap(tuple((float(a), float(b)) for a, b in INTERVALS))

#: Name: filters, their anchors, the labels they bound, and the same as SQL.
CASES = {
    "shift": ((Shift(15, 10),), ("x1",), ("l1",), "d.l1 BETWEEN q.l1 - 15 AND q.l1 + 10"),
    "map": ((_CATEGORY,), ("x0",), ("l0",), f"d.l0 BETWEEN {[a for a, _ in INTERVALS]}[q.l0::INT + 1] AND {[b for _, b in INTERVALS]}[q.l0::INT + 1]"),
    "div": ((Divide(10),), ("x1",), ("l1",), "d.l1 >= trunc(q.l1)::BIGINT // 10"),
    "range": ((Interval(),), (("x2_from", "x2_to"),), ("l2",), "d.l2 BETWEEN q.l2 - 3 AND q.l2 + 4"),
}
_MULTI = ((Shift(30, 30), _CATEGORY, Divide(2)), ("x1", "x0", "x2"), ("l1", "l0", "l2"))
_MULTI_SQL = f"d.l1 BETWEEN q.l1 - 30 AND q.l1 + 30 AND {CASES['map'][3]} AND d.l2 >= trunc(q.l2)::BIGINT // 2"
CASES["multi"] = (*_MULTI, _MULTI_SQL)

_L2 = "list_sum([(x::DOUBLE - {b}[i]::DOUBLE) * (x::DOUBLE - {b}[i]::DOUBLE) for x, i in {a}])"
_D = """d AS (SELECT vec_id AS id, embedding AS vec, label::DOUBLE AS l0, (vec_id * 37 % 101)::DOUBLE AS l1, (vec_id // 50)::DOUBLE AS l2 FROM embeddings),
q AS (SELECT id AS qid, vec AS qvec, l0, l1, l2 FROM d WHERE id % 100 = 0)"""
_DISTANCE = _L2.format(a="q.qvec", b="d.vec")


def _ranked_sql(pairs: str, k: int = K, where: str = "TRUE") -> str:
    return f"""SELECT qid, rank, id AS neighbor, round(distance, 6) AS distance FROM
(SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, id)::INTEGER AS rank FROM ({pairs}) WHERE {where}) WHERE rank <= {k}"""


def _exact_sql(condition: str) -> str:
    return f"WITH {_D} " + _ranked_sql(f"SELECT q.qid, d.id, {_DISTANCE} AS distance FROM q JOIN d ON {condition}")


def _rounded(result: DataFrame, *columns: str) -> DataFrame:
    return result.withColumns({c: F.round(c, 6) for c in columns or ("distance",)})


def _case(spark: SparkSession, sf_dir: str, name: str) -> tuple[DataFrame, DataFrame, tuple[str, ...]]:
    filters, anchors, labels, _ = CASES[name]
    data = vectors(spark, sf_dir)
    return data, with_bounds(asked(data), filters, anchors), labels


def _filtered(name: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        data, queries, labels = _case(spark, sf_dir, name)
        return _rounded(exact(data, queries, labels, K))

    return query


for _name, _spec in CASES.items():
    _register(f"filtered_topk_{_name}", _exact_sql(_spec[3]))(_filtered(_name))


@_register("unfiltered_topk", _exact_sql("TRUE"))
def unfiltered_topk(spark, sf_dir):
    data = vectors(spark, sf_dir)
    return _rounded(exact(data, asked(data), (), K))


@_register("cell_join_topk", _exact_sql(_MULTI_SQL))
def cell_join_topk(spark, sf_dir):
    """The equi-join on grid cells that many queries get."""
    data, queries, labels = _case(spark, sf_dir, "multi")
    pairs = range_join(data, queries, labels, max_broadcast=0)
    return _rounded(ranked(pairs.select("qid", "id", squared_l2("qvec", "vec").alias("distance")), K))


@_register("range_filter_counts", f"WITH {_D} SELECT q.qid, count(d.id) AS cnt FROM q LEFT JOIN d ON {_MULTI_SQL} GROUP BY q.qid")
def range_filter_counts(spark, sf_dir):
    data, queries, labels = _case(spark, sf_dir, "multi")
    found = range_join(data.drop("vec"), queries.drop("qvec"), labels).groupBy("qid").agg(F.count("*").alias("cnt"))
    return queries.select("qid").join(found, "qid", "left").select("qid", F.coalesce("cnt", F.lit(0)).alias("cnt"))


@_register("soft_filter_topk", f"WITH {_D} " + _ranked_sql(f"SELECT q.qid, d.id, {_DISTANCE} + 0.5 * CASE WHEN {_MULTI_SQL} THEN 0 ELSE 1e6 END AS distance FROM q, d"))
def soft_filter_topk(spark, sf_dir):
    data, queries, labels = _case(spark, sf_dir, "multi")
    fits = F.coalesce(inside(labels), F.lit(False))
    scan = Scan(K, labels=labels, numbers=tuple(range(len(labels))), filters="penalty", penalty=0.5 * 1e6)
    return _rounded(ranked(scanned(data, queries, scan, squared_l2("qvec", "vec") + 0.5 * F.when(fits, 0.0).otherwise(1e6)), K))


# A codebook kept as data, so that SQL can check quantised distances: the parts of the mean vectors of the label's values are the
# centres, over all rows.
_PARTS = 4


def centroids(data: DataFrame) -> DataFrame:
    """(code, center): the mean vector of each value of the first label."""
    each = data.select(F.col("l0").cast("int").alias("code"), F.posexplode("vec").alias("at", "x")).groupBy("code", "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return each.groupBy("code").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda c: c["x"]).alias("center"))


def codebook(data: DataFrame) -> DataFrame:
    """(part, code, center)."""
    parts = F.sequence(F.lit(0), F.lit(_PARTS - 1))
    return centroids(data).select("code", "center", F.explode(parts).alias("part")).select("part", "code", part_of(F.col("center"), F.col("part"), _PARTS).alias("center"))


def coded(data: DataFrame, centers: DataFrame) -> DataFrame:
    """(id, codes, err): the nearest centre of each part, the smaller code on ties, and the row's distance from what they stand for."""
    near = data.select("id", "vec").join(F.broadcast(centers)).select("id", "part", F.struct(squared_l2(part_of(F.col("vec"), F.col("part"), _PARTS), F.col("center")).alias("d"), "code").alias("c"))
    near = near.groupBy("id", "part").agg(F.min("c").alias("c")).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("part", "c.code"))).alias("all"), F.sqrt(F.sum("c.d")).alias("err"))
    return near.select("id", F.transform("all.code", lambda code: code).alias("codes"), "err")


def adc_pairs(data: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, id, distance, err) of all queries and rows by codes; the label's values must be 0, 1, 2..., which number the centres."""
    centers = codebook(data)
    rows = code_tables(queries, centers, _PARTS).groupBy("qid", "part").agg(F.sort_array(F.collect_list(F.struct("code", "distance"))).alias("row"))
    tables = rows.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("part", F.col("row.distance").alias("row")))).alias("all")).select("qid", F.col("all.row").alias("lut"))
    return range_join(coded(data, centers), tables, []).select("qid", "id", looked_up("lut", "codes").alias("distance"), "err")


_PART = "vec[part * len(vec) // 4 + 1:(part + 1) * len(vec) // 4]"
_CENTROIDS = """m AS (SELECT code, list(x ORDER BY place) AS vec FROM (SELECT l0::INTEGER AS code, place, avg(x::DOUBLE) AS x FROM (SELECT l0, unnest(vec) AS x, generate_subscripts(vec, 1) AS place FROM d) GROUP BY ALL) GROUP BY code)"""
_CB = f"""{_CENTROIDS}, c AS (SELECT code, part, {_PART} AS center FROM m, range(4) r(part)),
lut AS (SELECT qid, part, code, {_L2.format(a="own", b="center")} AS distance FROM (SELECT qid, part, qvec[part * len(qvec) // 4 + 1:(part + 1) * len(qvec) // 4] AS own FROM q, range(4) r(part)) JOIN c USING (part))"""
_ADC = f"""{_CB},
e AS (SELECT id, part, first(code ORDER BY dd, code) AS code FROM (SELECT v.id, part, code, {_L2.format(a="own", b="center")} AS dd
      FROM (SELECT id, part, {_PART} AS own FROM d, range(4) r(part)) v JOIN c USING (part)) GROUP BY id, part),
a AS (SELECT qid, id, sum(distance ORDER BY part) AS distance FROM e JOIN lut USING (part, code) GROUP BY qid, id)"""


@_register("pq_lut", f"WITH {_D}, {_CB} SELECT qid, part::INTEGER AS part, code::INTEGER AS code, round(distance, 6) AS distance FROM lut")
def pq_lut(spark, sf_dir):
    data = vectors(spark, sf_dir)
    return _rounded(code_tables(asked(data), codebook(data), _PARTS))


@_register("pq_adc_distances", f"WITH {_D}, {_ADC} SELECT qid, id, round(distance, 6) AS distance FROM a")
def pq_adc_distances(spark, sf_dir):
    data = vectors(spark, sf_dir)
    return _rounded(adc_pairs(data, asked(data)).drop("err"))


@_register("refine_topk", _exact_sql("TRUE"))
def refine_topk(spark, sf_dir):
    """The best by codes give a reach; all rows that their codes can't put beyond it are ranked by their exact distances."""
    data = vectors(spark, sf_dir)
    length = usual_length(data)
    data, queries = usable(data, length), usable(asked(data), length, "qvec")
    means = [r.center for r in centroids(data).orderBy("code").collect()]  # one row for each value of a label
    if not means:
        return _rounded(exact(data, queries, (), K))
    quantiser = ProductQuantiser(np.split(pad_parts(np.array(means), _PARTS), _PARTS, axis=1))
    rows = with_codes(data, quantiser)
    near = cut(top_k(best(rows, queries, Scan(5 * K, "codes", quantiser=quantiser)), 5 * K))
    reach = reach_of(top_k(near.select("qid", "id", F.col("exact").alias("distance")), K), queries, K)
    return _rounded(ranked(best(rows, queries.join(reach, "qid"), Scan(K, quantiser=quantiser)), K))


@_register("ivf_probe_topk", _exact_sql("TRUE"))
def ivf_probe_topk(spark, sf_dir):
    """The label's mean vectors are the lists' centres; a query reads its three nearest lists, and then those within reach."""
    data = vectors(spark, sf_dir)
    queries = asked(data)
    length = usual_length(data)
    data, queries = usable(data, length), usable(queries, length, "qvec")
    centers = cut(centroids(data).select(F.coalesce("code", F.lit(-1)).alias("list"), "center"))  # one row for each value of a label
    every = centers.agg(F.collect_list(F.struct("list", "center")).alias("centers"))
    own = F.array_min(F.transform("centers", lambda c: F.struct(squared_l2("vec", c["center"]).alias("d"), c["list"].cast("bigint").alias("list"))))
    lists = cut(data.crossJoin(F.broadcast(every)).withColumn("own", own).select("id", "vec", F.col("own.list").alias("list"), F.sqrt("own.d").alias("far")))
    near = queries.join(F.broadcast(centers)).select("qid", F.col("list").alias("id"), squared_l2("qvec", "center").alias("distance"))
    probes = top_k(near, 3).select("qid", F.col("id").alias("list"))
    reach = reach_of(ranked(best(lists, wanting(queries, probes), Scan(K)), K), queries, K)
    known = lists.groupBy("list").agg(F.max("far").alias("radius")).join(F.broadcast(centers), "list")
    rest = opened(queries.select("qid", "qvec"), known, [], reach).select("qid", "list")
    return _rounded(ranked(best(lists, wanting(queries, rest), Scan(K)), K))


@_register("cosine_topk", f"WITH {_D} " + _ranked_sql("SELECT q.qid, d.id, 1 - list_sum([x::DOUBLE * d.vec[i]::DOUBLE for x, i in q.qvec]) / (sqrt(list_sum([x::DOUBLE * x::DOUBLE for x in q.qvec])) * sqrt(list_sum([x::DOUBLE * x::DOUBLE for x in d.vec]))) AS distance FROM q, d").replace("round(distance, 6)", "abs(round(distance, 6))"))
def cosine_topk(spark, sf_dir):
    data = vectors(spark, sf_dir)
    # abs: a zero has no sign
    return _rounded(ranked(scanned(data, asked(data), Scan(K, by="cosine"), cosine_distance("qvec", "vec")), K)).withColumn("distance", F.abs("distance"))


@_register("postfilter_topk", _exact_sql(_MULTI_SQL))
def postfilter_topk(spark, sf_dir):
    """Four times k nearest rows first, filters after, and a deeper search for queries of which too few passed."""
    data, queries, labels = _case(spark, sf_dir, "multi")
    return _rounded(post_filtered(data, queries, labels, K, 4 * K))


@_register("farthest_topk", f"""WITH {_D} SELECT qid, rank, id AS neighbor, round(distance, 6) AS distance FROM
(SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance DESC, id)::INTEGER AS rank FROM (SELECT q.qid, d.id, {_DISTANCE} AS distance FROM q, d)) WHERE rank <= {K}""")
def farthest_topk(spark, sf_dir):
    """The k largest."""
    data = vectors(spark, sf_dir)
    pairs = scanned(data, asked(data), Scan(K, largest=True), squared_l2("qvec", "vec"))
    return _rounded(top_k(pairs, K, largest=True).select("qid", "rank", F.col("id").alias("neighbor"), "distance"))


@_register("sort_by_key", "SELECT row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS place, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem")
def sort_by_key(spark, sf_dir):
    """Each row's place in the order of a key, by ranges of the key: no task sees all rows."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return with_places(rows, rows.columns).drop("l_shipdate")


@_register("partial_topk_merge", _exact_sql("TRUE"))
def partial_topk_merge(spark, sf_dir):
    data = vectors(spark, sf_dir)
    queries = asked(data)
    parts = [exact(data.where(F.col("id") % 4 == i), queries, (), K) for i in range(4)]
    return _rounded(merged_top_k(parts, K, row="neighbor").select("qid", "rank", "neighbor", "distance"))


@_register("recall_at_k", f"""WITH {_D}, t AS ({_ranked_sql(f'SELECT q.qid, d.id, {_DISTANCE} AS distance FROM q JOIN d ON {_MULTI_SQL}')}),
f AS ({_ranked_sql(f'SELECT q.qid, d.id, {_DISTANCE} AS distance FROM q, d', 40)})
SELECT t.qid, count(f.neighbor) AS hits, count(*) AS expected, round(count(f.neighbor) / count(*), 6) AS recall FROM t LEFT JOIN f ON f.qid = t.qid AND f.neighbor = t.neighbor GROUP BY t.qid""")
def recall_at_k(spark, sf_dir):
    """Share of the filtered nearest that an unfiltered search of four times their number would have found."""
    data, queries, labels = _case(spark, sf_dir, "multi")
    return _rounded(recall(exact(data, queries, (), 4 * K), exact(data, queries, labels, K)), "recall")


@_register("range_mid_normalise", f"WITH {_D} SELECT qid, round((l1 - 15 + l1 + 10) / 2 - (SELECT min(l1) FROM d), 6) AS middle FROM q")
def range_mid_normalise(spark, sf_dir):
    data, queries, _ = _case(spark, sf_dir, "shift")
    return _rounded(queries.select("qid", range_middle(0, label_extent(data, ["l1"])[0][0]).alias("middle")), "middle")


@_register("sample_ratio_sets", f"""WITH {_D} SELECT q.qid, d.l0::INTEGER AS set_id, round(avg(CASE WHEN d.l1 BETWEEN q.l1 - 15 AND q.l1 + 10 THEN 1 ELSE 0 END), 6) AS ratio
FROM q, d GROUP BY q.qid, d.l0 HAVING avg(CASE WHEN d.l1 BETWEEN q.l1 - 15 AND q.l1 + 10 THEN 1 ELSE 0 END) > 0.2""")
def sample_ratio_sets(spark, sf_dir):
    """Label sets of which enough rows pass a query's filter."""
    data, queries, labels = _case(spark, sf_dir, "shift")
    pairs = range_join(data.drop("vec"), queries.drop("qvec"), [])
    out = pairs.groupBy("qid", F.col("l0").cast("int").alias("set_id")).agg(F.avg(inside(labels).cast("int")).alias("ratio"))
    return _rounded(out.where("ratio > 0.2"), "ratio")


# --- grids over lineitem -------------------------------------------------------------------------------------------------

_SHAPE = (10, 7, 16)
_AXES = ("c0", "c1", "c2")
_LEFT, _SPAN = (1.0, 1.0, 9131.0), (50.0, 7.0, 2500.0)


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem's keys with the grid coordinates of quantity, line number and ship date."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    values = (F.col("l_quantity"), F.col("l_linenumber"), F.unix_date(F.col("l_shipdate").cast("date")))
    at = {a: coordinate(v, left, span, size) for a, v, left, span, size in zip(_AXES, values, _LEFT, _SPAN, _SHAPE)}
    return rows.withColumns(at).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", *_AXES)


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box for each part: (qid, c_lo, c_hi for each axis)."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    low = [F.expr(f"bigint(p_partkey * {m} % {size})") for m, size in zip((3, 5, 7), _SHAPE)]
    high = [F.least(lo + F.expr(f"bigint(p_size % {m})"), F.lit(size - 1)) for lo, m, size in zip(low, (6, 5, 9), _SHAPE)]
    return part.select(F.col("p_partkey").alias("qid"), *(c.alias(f"{a}_{side}") for a, lo, hi in zip(_AXES, low, high) for side, c in (("lo", lo), ("hi", hi))))


def _at_sql(value: str, i: int) -> str:
    return f"least(floor((greatest({_LEFT[i]}, least({value}::DOUBLE, {_LEFT[i] + _SPAN[i]})) - {_LEFT[i]}) * {_SHAPE[i]}.0 / {_SPAN[i]})::BIGINT, {_SHAPE[i] - 1})"


_G = f"""g AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, {_at_sql("l_quantity", 0)} AS c0, {_at_sql("l_linenumber", 1)} AS c1,
{_at_sql("date_diff('day', DATE '1970-01-01', l_shipdate::DATE)", 2)} AS c2 FROM lineitem),
b AS (SELECT p_partkey AS qid, p_partkey * 3 % 10 AS c0_lo, least(p_partkey * 3 % 10 + p_size % 6, 9) AS c0_hi, p_partkey * 5 % 7 AS c1_lo, least(p_partkey * 5 % 7 + p_size % 5, 6) AS c1_hi,
p_partkey * 7 % 16 AS c2_lo, least(p_partkey * 7 % 16 + p_size % 9, 15) AS c2_hi FROM part)"""
_IN_BOX = "c0 BETWEEN c0_lo AND c0_hi AND c1 BETWEEN c1_lo AND c1_hi AND c2 BETWEEN c2_lo AND c2_hi"


_EXTENT_LABELS = ("l_quantity", "l_extendedprice", "l_discount")


# a zero has no sign: the data hold both
@_register("label_minmax", "SELECT " + ", ".join(f"coalesce(nullif({f}({n}), 0), 0) AS {side}_{i}" for i, n in enumerate(_EXTENT_LABELS) for side, f in (("lo", "min"), ("hi", "max"))) + " FROM lineitem")
def label_minmax(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    ends = {f"{side}_{i}": f(n) for i, n in enumerate(_EXTENT_LABELS) for side, f in (("lo", F.min), ("hi", F.max))}
    return rows.agg(*(c.alias(n) for n, c in ends.items())).select(*(F.when(F.col(n) != 0, F.col(n)).otherwise(F.lit(0.0)).alias(n) for n in ends))


@_register("grid_cell_counts", f"WITH {_G} SELECT c0, c1, c2, count(*) AS cnt FROM g GROUP BY ALL")
def grid_cell_counts(spark, sf_dir):
    return cell_counts(placed(spark, sf_dir), _AXES)


_DENSE = "x AS (SELECT a.c0, b.c1, c.c2 FROM range(10) a(c0), range(7) b(c1), range(16) c(c2)), n AS (SELECT c0, c1, c2, count(*) AS cnt FROM g GROUP BY ALL)"


@_register("grid_prefix_sum", f"WITH {_G}, {_DENSE} SELECT x.c0, x.c1, x.c2, coalesce(sum(n.cnt) FILTER (n.c0 = x.c0 AND n.c1 = x.c1 AND n.c2 = x.c2), 0)::BIGINT AS cnt, coalesce(sum(n.cnt), 0)::BIGINT AS cum FROM x LEFT JOIN n ON n.c0 <= x.c0 AND n.c1 <= x.c1 AND n.c2 <= x.c2 GROUP BY ALL")
def grid_prefix_sum(spark, sf_dir):
    return prefix_sums(cell_counts(placed(spark, sf_dir), _AXES), _AXES, _SHAPE)


@_register("grid_box_counts", f"WITH {_G}, n AS (SELECT c0, c1, c2, count(*) AS cnt FROM g GROUP BY ALL) SELECT qid, sum(n.cnt)::BIGINT AS cnt FROM b JOIN n ON {_IN_BOX} GROUP BY qid")
def grid_box_counts(spark, sf_dir):
    """By the corners of prefix sums; the SQL counts cells."""
    sums = prefix_sums(cell_counts(placed(spark, sf_dir), _AXES), _AXES, _SHAPE)
    # at most as many cells as _SHAPE has
    return box_counts_from_sums(F.broadcast(sums), boxes(spark, sf_dir), _AXES).where("cnt > 0")


@_register("nonempty_cells", f"WITH {_G}, n AS (SELECT l_returnflag, c0, c1, c2, count(*) AS cnt FROM g GROUP BY ALL) SELECT qid, l_returnflag, sum(n.cnt)::BIGINT AS cnt FROM b JOIN n ON {_IN_BOX} GROUP BY ALL")
def nonempty_cells(spark, sf_dir):
    """Groups that hold rows in a box, as the flagship prunes clusters."""
    # at most as many cells as _SHAPE has, for each flag
    return box_counts(F.broadcast(cell_counts(placed(spark, sf_dir), _AXES, ["l_returnflag"])), boxes(spark, sf_dir), _AXES, "qid", ["l_returnflag"])


@_register("grid_intersect", f"""WITH {_G}, r AS (SELECT DISTINCT c0, c1 FROM g),
k AS (SELECT c0 * 7 + c1 AS cell, c0 * 5.0 AS l0, c0 * 5.0 + 6 AS h0, c1 * 1.0 AS l1, c1 + 1.5 AS h1 FROM r),
i AS (SELECT s_suppkey AS qid, s_suppkey % 40 AS l0, s_suppkey % 40 + 4.0 AS h0, s_suppkey % 6 AS l1, s_suppkey % 6 + 0.25 AS h1 FROM supplier)
SELECT qid, cell FROM i JOIN k ON i.h0 >= k.l0 AND k.h0 >= i.l0 AND i.h1 >= k.l1 AND k.h1 >= i.l1""")
def grid_intersect(spark, sf_dir):
    """Overlapping cells against a box for each supplier."""
    cells = placed(spark, sf_dir).select("c0", "c1").distinct()
    cells = cells.select(flattened([F.col("c0"), F.col("c1")], _SHAPE[:2]).alias("cell"), (F.col("c0") * 5.0).alias("cell_lo_0"), (F.col("c0") * 5.0 + 6).alias("cell_hi_0"), (F.col("c1") * 1.0).alias("cell_lo_1"), (F.col("c1") + 1.5).alias("cell_hi_1"))
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("qid"), F.expr("double(s_suppkey % 40)").alias("lo_0"), F.expr("s_suppkey % 40 + 4.0D").alias("hi_0"), F.expr("double(s_suppkey % 6)").alias("lo_1"), F.expr("s_suppkey % 6 + 0.25D").alias("hi_1"))
    return intersecting(rows, F.broadcast(cells), 2).select("qid", "cell")


def _z_sql(columns: tuple[str, ...], bits: int = 4) -> str:
    return " | ".join(f"((({c} >> {b}) & 1) << {b * len(columns) + len(columns) - 1 - i})" for b in range(bits) for i, c in enumerate(columns))


@_register("morton_encode", f"WITH {_G} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ({_z_sql(_AXES)})::BIGINT AS zcode FROM g")
def morton_encode(spark, sf_dir):
    return placed(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", morton_code([F.col(a) for a in _AXES], 4).alias("zcode"))


@_register("morton_roundtrip", f"WITH {_G} SELECT c0, c1, c2, (c0 * 7 + c1) * 16 + c2 AS cell, count(*) AS cnt FROM g GROUP BY ALL")
def morton_roundtrip(spark, sf_dir):
    """Coordinates decoded from Morton codes, and from row-major cell numbers and back."""
    coded_rows = placed(spark, sf_dir).select(morton_code([F.col(a) for a in _AXES], 4).alias("z"))
    back = coded_rows.select(*(c.alias(a) for a, c in zip(_AXES, morton_coordinates(F.col("z"), 3, 4))))
    numbered = back.withColumn("cell", flattened([F.col(a) for a in _AXES], _SHAPE))
    return numbered.select(*(c.cast("bigint").alias(a) for a, c in zip(_AXES, unflattened(F.col("cell"), _SHAPE))), "cell").groupBy(*_AXES, "cell").agg(F.count("*").alias("cnt"))


@_register("zrange_candidates", f"""WITH {_G}, n AS (SELECT c0, c1, c2, {_z_sql(_AXES)} AS z, count(*) AS cnt FROM g GROUP BY ALL),
r AS (SELECT *, {_z_sql(tuple(f"{a}_lo" for a in _AXES))} AS z_lo, {_z_sql(tuple(f"{a}_hi" for a in _AXES))} AS z_hi FROM b)
SELECT qid, sum(cnt)::BIGINT AS in_range, coalesce(sum(cnt) FILTER ({_IN_BOX}), 0)::BIGINT AS in_box FROM r JOIN n ON z BETWEEN z_lo AND z_hi GROUP BY qid""")
def zrange_candidates(spark, sf_dir):
    """Rows between the Morton codes of a box's corners, and those of them in the box."""
    cells = cell_counts(placed(spark, sf_dir), _AXES).withColumn("z", morton_code([F.col(a) for a in _AXES], 4))
    ends = {f"z_{side}": morton_code([F.col(f"{a}_{side}") for a in _AXES], 4) for side in ("lo", "hi")}
    pairs = boxes(spark, sf_dir).withColumns(ends).join(F.broadcast(cells), F.expr("z BETWEEN z_lo AND z_hi"))
    return pairs.groupBy("qid").agg(F.sum("cnt").alias("in_range"), F.coalesce(F.sum(F.when(F.expr(_IN_BOX), F.col("cnt"))), F.lit(0)).alias("in_box"))


@_register("z_intervals", f"""WITH {_G}, c AS (SELECT qid, {_z_sql(_AXES)} AS z FROM (SELECT qid, c0, c1, unnest(range(c2_lo, c2_hi + 1)) AS c2 FROM (SELECT qid, c0, unnest(range(c1_lo, c1_hi + 1)) AS c1, c2_lo, c2_hi
  FROM (SELECT qid, unnest(range(c0_lo, c0_hi + 1)) AS c0, c1_lo, c1_hi, c2_lo, c2_hi FROM b)))),
r AS (SELECT qid, z, z - row_number() OVER (PARTITION BY qid ORDER BY z) AS run FROM c)
SELECT qid, min(z)::BIGINT AS z_lo, max(z)::BIGINT AS z_hi FROM r GROUP BY qid, run""")
def z_intervals_of_boxes(spark, sf_dir):
    """Each box as the fewest intervals of Morton codes."""
    return z_intervals(boxes(spark, sf_dir), _AXES, 4)


@_register("grid_compressed_sums", f"""WITH {_G}, {_DENSE}, p AS (SELECT x.c0, x.c1, x.c2, coalesce(sum(n.cnt), 0)::BIGINT AS cum FROM x LEFT JOIN n ON n.c0 <= x.c0 AND n.c1 <= x.c1 AND n.c2 <= x.c2 GROUP BY ALL)
SELECT * FROM p QUALIFY lag(cum) OVER (PARTITION BY c0, c1 ORDER BY c2) IS DISTINCT FROM cum""")
def grid_compressed_sums(spark, sf_dir):
    """The prefix sums without cells that repeat the one below."""
    return compressed(prefix_sums(cell_counts(placed(spark, sf_dir), _AXES), _AXES, _SHAPE), _AXES)


@_register("sorted_bound_counts", "SELECT q.lo, count(*) FILTER (value < q.lo) AS first, count(*) FILTER (value <= q.lo + 50) AS last FROM (SELECT DISTINCT p_size * 7.0::DOUBLE AS lo FROM part) q, events GROUP BY q.lo")
def sorted_bound_counts(spark, sf_dir):
    """Where an interval's ends fall in the sorted values, for an interval from each part size."""
    ends = spark.read.parquet(f"{sf_dir}/part.parquet").select((F.col("p_size") * F.lit(7.0)).alias("lo")).distinct()
    values = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("value").cast("double").alias("value"))
    both = ends.select("lo", F.explode(F.array(F.struct(F.col("lo").alias("end"), F.lit(False).alias("closed")), F.struct((F.col("lo") + 50).alias("end"), F.lit(True).alias("closed")))).alias("e")).select("lo", "e.*")
    counted = ranks(values, "value", both, "end", "closed")
    return counted.groupBy("lo").agg(F.max(F.when(~F.col("closed"), F.col("below"))).alias("first"), F.max(F.when(F.col("closed"), F.col("below"))).alias("last"))


@_register("segment_expand", "SELECT o_orderkey, unnest(range(o_custkey, o_custkey + o_orderkey % 5)) AS position FROM orders")
def segment_expand(spark, sf_dir):
    segments = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_custkey").alias("start"), F.expr("o_orderkey % 5").alias("length"))
    return expanded(segments).select("o_orderkey", "position")


@_register("segment_gather", "SELECT o_orderkey, c_custkey, c_acctbal FROM orders JOIN customer ON c_custkey >= o_custkey AND c_custkey < o_custkey + o_orderkey % 5")
def segment_gather(spark, sf_dir):
    """The customers of each order's segment of customer numbers."""
    segments = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_custkey").alias("start"), F.expr("o_orderkey % 5").alias("length"))
    return gathered(segments, spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_acctbal"), "c_custkey")


# --- strategies, at usual settings: the second step of each makes its result exact ---------------------------------------

_USUAL = Params(k=K, codes=64, keep=10, keep_soft=10, label_clusters=8, label_probes=3, max_cells=64, lists=8, probes=8, clusters=8, sub_clusters=4, cluster_probes=4, sub_probes=8, beta=6, frontier=128, rounds=4)


def _strategy(algorithm: str, params: Params) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        data, queries, labels = _case(spark, sf_dir, "multi")
        return _rounded(search(algorithm, data, queries, labels, params))

    return query


for _algorithm in STRATEGIES:
    _register("algo_" + _algorithm.replace("-", "_"), _exact_sql("TRUE" if _algorithm == "pq" else _MULTI_SQL))(_strategy(_algorithm, _USUAL))


@_register("saved_index", _exact_sql(_MULTI_SQL))
def saved_index(spark, sf_dir):
    """super-grid built once, written in its layout, and queried as read again."""
    data, queries, labels = _case(spark, sf_dir, "multi")
    path = new_folder(spark, "index")
    strategy = STRATEGIES["super-grid"](labels, _USUAL)
    strategy.build(data, path)
    return _rounded(strategy.query(Index.load(spark, path), queries))


# --- sources and serving over the given tables ---------------------------------------------------------------------------

_SETTINGS = """
topk = 10
pq_dim = 8
n_clusters = 32
clusters0 = 6
clusters1 = 6
n_list = 5
exps0 = 8
label_dim = 3
"""
_FILTERS = """
# one block for each label
l = 2
filter0:
    type = 0
    shift_val = [15, 10]

filter1:
    type = 2
    div_value = [4]
"""
_SETTINGS_SQL = "d.l1 BETWEEN q.l1 - 15 AND q.l1 + 10 AND d.l2 >= trunc(q.l2)::BIGINT // 4"


@_register("settings_files_topk", _exact_sql(_SETTINGS_SQL))
def settings_files_topk(spark, sf_dir):
    """A search as its settings and filter files say."""
    data = vectors(spark, sf_dir)
    queries = with_bounds(asked(data), parse_filters(_FILTERS), ["x1", "x2"])
    return _rounded(search("ivf-ivf_pq", data, queries, ["l1", "l2"], parse_settings(_SETTINGS, "ivf-ivf_pq").params))


@_register("raw_results_topk", f"""WITH {_D} SELECT dense_rank() OVER (ORDER BY qid) - 1 AS qid, rank, neighbor, round(distance, 4) AS distance FROM ({_ranked_sql(f"SELECT q.qid, d.id, {_DISTANCE} AS distance FROM q, d")})""")
def raw_results_topk(spark, sf_dir):
    """Results written to a folder of raw matrices and read again; there a query's number is its place, and distances are single."""
    data, folder = vectors(spark, sf_dir), new_folder(spark, "results")
    write_raw_results(exact(data, asked(data), (), K), folder, K)
    out = read_raw_results(spark, folder, K)
    return out.select("qid", F.col("rank").cast("int").alias("rank"), "neighbor", F.round(F.col("distance").cast("double"), 4).alias("distance"))


@_register("id_set_counts", f"WITH {_G} SELECT c1, count(*) AS cnt FROM g WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 20) GROUP BY c1")
def id_set_counts(spark, sf_dir):
    """Rows of a set of ids, which is kept as a text file."""
    path = new_folder(spark, "ids")
    spark.read.parquet(f"{sf_dir}/part.parquet").where("p_size < 20").select(F.col("p_partkey").cast("string")).write.text(path)
    rows = placed(spark, sf_dir)
    return rows.join(read_id_set(spark, path), rows["l_partkey"] == F.col("id"), "left_semi").groupBy("c1").agg(F.count("*").alias("cnt"))


@_register("served_topk", _exact_sql(_MULTI_SQL))
def served_topk(spark, sf_dir):
    """The queries as a stream, in batches of one file each, over an index that stays."""
    data, queries, labels = _case(spark, sf_dir, "multi")
    strategy, folder = STRATEGIES["prefilter"](labels, _USUAL), new_folder(spark, "served")
    index = strategy.build(data)
    queries.repartition(2, "qid").write.parquet(f"{folder}/queries")
    stream = spark.readStream.schema(queries.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/queries")
    serve(strategy, index, stream, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return _rounded(spark.read.parquet(f"{folder}/out").drop("batch"))
