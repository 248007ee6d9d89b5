import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.functions.filters import Divide, IntervalMap, Shift, with_bounds
from nearfield.operators.grid_counts import box_counts, box_counts_from_sums, cell_counts, compressed, expanded, gathered, prefix_sums
from nearfield.operators.quantise import ProductQuantiser, balanced_groups
from nearfield.operators import range_join as range_join_module
from nearfield.operators.range_join import label_extent, range_join
from nearfield.operators.sorted_places import ranks, with_places
from nearfield.operators.topk import merged_top_k, top_k
from nearfield.operators.zorder import z_intervals
from nearfield.plans.indexes import STRATEGIES, Index, Params, exact, opened, reach_of, search, until_k_pass
from nearfield.sources.matrices import dataset, key_types, read_id_set, read_matrix, read_raw_results, read_result, read_truth, write_clustered, write_result
from nearfield.streaming.serving import serve

LABELS = ["l0", "l1"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(12, 16))
    points = centers[rng.integers(0, 12, 600)] + 0.4 * rng.normal(size=(600, 16))
    data = [(i, [float(x) for x in p], float(rng.integers(0, 6)), float(rng.integers(0, 40))) for i, p in enumerate(points)]
    data += [(900, data[0][1], float("nan"), 3.0), (901, data[0][1], None, 3.0)]
    # vectors that can't be compared, with labels that fit
    nan, inf = float("nan"), float("inf")
    bad = [None, [], [nan] * 16, [0.0] * 15 + [nan], [inf] + [0.0] * 15, [0.0] * 15 + [None], [0.0] * 8]
    return data + [(910 + i, v, data[0][2], data[0][3]) for i, v in enumerate(bad)]


def comparable(v):
    return v is not None and len(v) == 16 and all(x is not None and abs(x) < float("inf") for x in v)


@pytest.fixture(scope="module")
def data(spark, rows):
    return spark.createDataFrame(rows, "id long, vec array<float>, l0 double, l1 double").cache()


@pytest.fixture(scope="module")
def queries(spark, rows):
    asked = spark.createDataFrame([(i, v, a + 1, b) for i, v, a, b in rows[:600:50]], "qid long, qvec array<float>, x0 double, x1 double")
    return with_bounds(asked, [IntervalMap(((0, 2), (0, 5), (2, 3), (1, 5), (3, 5), (0, 5))), Shift(12, 9)], ["x0", "x1"]).drop("x0", "x1").cache()


def brute_force(rows, queries, k):
    out = {}
    for q in queries.collect():
        own = sorted((sum((float(np.float32(a)) - float(np.float32(b))) ** 2 for a, b in zip(q.qvec, v)), i) for i, v, a, b in rows if comparable(v) and a is not None and q.lo_0 <= a <= q.hi_0 and q.lo_1 <= b <= q.hi_1)
        out.update({(q.qid, r + 1): i for r, (_, i) in enumerate(own[:k])})
    return out


def found(result):
    return {(r.qid, r.rank): r.neighbor for r in result.collect()}


def test_exact_equals_brute_force(rows, data, queries):
    assert found(exact(data, queries, LABELS, 7)) == brute_force(rows, queries, 7)


def test_cell_join_equals_broadcast_join(data, queries):
    pairs = [{(r.qid, r.id) for r in range_join(data, queries, LABELS, max_broadcast=n).select("qid", "id").collect()} for n in (0, 100)]
    assert pairs[0] == pairs[1] and pairs[0]


def test_hot_cells_and_wide_queries_are_split(spark, monkeypatch):
    """Nine rows of ten in one cell, and one query without bounds among narrow ones."""
    monkeypatch.setattr(range_join_module, "PIECE", 200)
    rng = random.Random(1)
    rows = [(i, 5.0, 5.0) if i % 10 else (i, rng.uniform(0, 100), rng.uniform(0, 100)) for i in range(5000)] + [(6000, None, 5.0), (6001, float("nan"), 5.0)]
    asked = [(q, 5.0 - q % 3, 5.0 + q % 5, 4.0, 5.0 + q % 7) for q in range(40)] + [(40, -1e9, float("inf"), -1e9, float("inf")), (41, 7.0, 3.0, 0.0, 9.0), (42, None, 9.0, 0.0, 9.0)]
    table = spark.createDataFrame(rows, "id long, a double, b double").repartition(4)
    queries = spark.createDataFrame(asked, "qid long, lo_0 double, hi_0 double, lo_1 double, hi_1 double")
    placed, boxes, keys = range_join_module.dealt_cells(table, queries, ["a", "b"], [0, 1])
    assert {r[0] for r in boxes.where("qid <> 40").select("__level").distinct().collect()} == {6}  # a wide one coarsens nothing
    assert placed.groupBy(*keys).count().agg(F.max("count")).first()[0] < 300
    assert boxes.groupBy("qid").count().agg(F.max("count")).first()[0] <= 256 * 24
    got = {(r.qid, r.id) for r in range_join(table, queries, ["a", "b"], max_broadcast=0).select("qid", "id").collect()}
    ok = lambda x, lo, hi: x is not None and x == x and lo is not None and lo <= x <= hi
    assert got == {(q, i) for i, a, b in rows for q, l0, h0, l1, h1 in asked if ok(a, l0, h0) and ok(b, l1, h1)}


#: Settings at which the first step of each strategy alone would lose most neighbours.
POOR = Params(k=7, codes=8, keep=1, keep_soft=1, label_clusters=3, label_probes=1, pass_ratio=0.9, max_cells=9, lists=3, probes=1, clusters=3, sub_clusters=2, cluster_probes=1, sub_probes=1, grids=30, beta=1, refine=1, frontier=8, rounds=1, entries=4)


def test_many_queries_come_in_blocks(data, queries):
    pairs = range_join(data, queries, [], max_broadcast=5)
    assert pairs.select("qid", "id").distinct().count() == pairs.count() == 12 * 609
    plan = pairs._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and plan.count("BroadcastNestedLoopJoin") >= 3


@pytest.mark.parametrize("name", [n for n in STRATEGIES if n != "pq"])
def test_strategies_are_exact_at_any_settings(rows, data, queries, name):
    assert found(search(name, data, queries, LABELS, POOR)) == brute_force(rows, queries, 7)


def test_code_distances_without_filter(data, queries):
    assert found(search("pq", data, queries, LABELS, POOR)) == found(exact(data, queries, [], 7))


def test_grid_cells_follow_the_widths_of_intervals(rows, data, queries):
    strategy = STRATEGIES["grid-ivf_pq"](LABELS, replace(POOR, max_cells=40, widths=(3.0, 2.5)))
    index = strategy.build(data)
    assert index.extra["shape"] == [1, 15]
    assert found(strategy.query(index, queries)) == brute_force(rows, queries, 7)


def test_reach_opens_few_lists(rows, data, queries):
    strategy = STRATEGIES["ivfpq-post"](LABELS, replace(POOR, lists=12, codes=32))
    index = strategy.build(data)
    near = exact(data, queries, [], 7)
    lists = index.tables["lists"]
    read = opened(queries, lists, LABELS, reach_of(near, queries, 7)).count()
    assert 0 < read < 0.6 * lists.count() * queries.count()
    # queries with fewer rows than k look everywhere that their intervals meet
    assert reach_of(near.where("rank < 3"), queries, 7).where("t = double('infinity')").count() == queries.count()


@pytest.mark.parametrize("name", ["super-grid", "sorting"])
def test_saved_indexes(spark, tmp_path, rows, data, queries, name):
    strategy = STRATEGIES[name](LABELS, POOR)
    strategy.build(data, str(tmp_path / "index"))
    again = Index.load(spark, str(tmp_path / "index"))
    assert found(strategy.query(again, queries)) == brute_force(rows, queries, 7)


def test_filtering_after_continues_until_k_pass(spark, data, queries):
    pairs = range_join(data, queries, []).select("qid", "id", F.expr("double(pmod(xxhash64(qid, id), 1000003))").alias("distance"), F.coalesce(F.expr("l0 = 3"), F.lit(False)).alias("fits"))
    want = top_k(pairs.where("fits"), 9).select("qid", "rank", F.col("id").alias("neighbor"), "distance")
    assert found(until_k_pass(pairs, queries, 9, 9)) == found(want)


def test_places_and_ranks(spark):
    chance = random.Random(8)
    values = [chance.choice([chance.uniform(-5, 5), float(chance.randrange(9)), 2.0]) for _ in range(3000)] + [float("nan"), None]
    table = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v double")
    ends = [(e, c) for e in [-9.0, 9.0, 2.0, 3.0, *(chance.uniform(-5, 9) for _ in range(40))] for c in (True, False)]
    got = {(r.e, r.c): r.below for r in ranks(table, "v", spark.createDataFrame(ends, "e double, c boolean"), "e", "c").collect()}
    known = [v for v in values if v is not None and v == v]
    assert got == {(e, c): sum(v <= e if c else v < e for v in known) for e, c in ends}
    many = spark.createDataFrame([(float(i % 500), True) for i in range(3000)] + [(None, False), (float("nan"), True), (-0.0, False)], "e double, c boolean")
    got = [(r.e, r.below) for r in ranks(table, "v", many, "e", "c").collect()]
    assert len(got) == 3003 and all(b == (0 if e is None else len(known) if e != e else sum(v < 0 for v in known) if str(e) == "-0.0" else sum(v <= e for v in known)) for e, b in got[:40] + got[-40:])
    few = ranks(table.limit(0), "v", spark.createDataFrame([(1.0, True)], "e double, c boolean"), "e", "c")
    assert [r.below for r in few.collect()] == [0]
    placed = {r.id: r.place for r in with_places(table.where("v > -100 AND NOT isnan(v)"), ["v", "id"]).collect()}
    order = sorted((v, i) for i, v in enumerate(values) if v is not None and v == v)
    assert placed == {i: n for n, (_, i) in enumerate(order)}


def test_long_rankings_leave_the_session_alone(spark, data, queries):
    name = "spark.sql.optimizer.windowGroupLimitThreshold"
    before = spark.conf.get(name)
    pairs = range_join(data, queries, []).select("qid", "id", F.col("id").cast("double").alias("distance"))
    assert top_k(pairs, 1500).count() == 12 * 609 and spark.conf.get(name) == before
    assert top_k(pairs.unionAll(pairs), 1003).where("rank = 1003").count() == 12


def test_results_keep_their_filters(data, queries):
    got = search("super-grid", data, queries, LABELS, Params(k=7)).join(data.withColumnRenamed("id", "neighbor"), "neighbor").join(queries, "qid")
    assert got.where("NOT (l0 BETWEEN lo_0 AND hi_0 AND l1 BETWEEN lo_1 AND hi_1)").count() == 0


@pytest.mark.parametrize("name", ["prefilter", "ivfpq-post"])
def test_queries_that_cannot_be_compared_find_nothing(spark, data, queries, name):
    nan = float("nan")
    bad = spark.createDataFrame([(i, v, 0.0, 9.0, 0.0, 99.0) for i, v in enumerate([None, [], [nan] * 16, [1.0] * 9, [None] * 16])], queries.schema)
    both = queries.unionAll(bad.withColumn("qid", F.col("qid") + 5000))
    assert found(search(name, data, both, LABELS, POOR)) == found(exact(data, both, LABELS, 7)) == found(exact(data, queries, LABELS, 7))
    assert search(name, data.where("id >= 910"), queries, LABELS, POOR).count() == 0


def test_empty(spark, data, queries):
    assert exact(data.limit(0), queries, LABELS, 3).count() == 0
    assert exact(data, queries.limit(0), LABELS, 3).count() == 0
    with pytest.raises(ValueError):
        search("none", data, queries, LABELS)


def test_top_k_ties_and_merging(spark):
    pairs = spark.createDataFrame([(0, i, float(i // 3)) for i in range(9)] + [(1, 5, None)], "qid int, id int, distance double")
    assert [(r.id, r.rank) for r in top_k(pairs, 4).orderBy("rank").collect()] == [(0, 1), (1, 2), (2, 3), (3, 4)]
    assert [r.id for r in top_k(pairs, 2, largest=True).orderBy("rank").collect()] == [6, 7]
    halves = [top_k(pairs.where(F.col("id") % 2 == i), 4) for i in (0, 1)]
    assert [r.id for r in merged_top_k(halves, 4).orderBy("rank").collect()] == [0, 1, 2, 3]


def test_box_counts(spark):
    chance = random.Random(5)
    points = [(g, chance.randrange(5), chance.randrange(4), chance.randrange(3)) for g in (0, 1) for _ in range(80)]
    counts = cell_counts(spark.createDataFrame(points, "g int, a long, b long, c long"), "abc", ["g"])
    asked = []
    for q in range(30):
        ends = [sorted(chance.randrange(n) for _ in range(2)) for n in (5, 4, 3)]
        asked.append((q, *(x for e in ends for x in e)))
    boxes = spark.createDataFrame(asked, "qid int, a_lo long, a_hi long, b_lo long, b_hi long, c_lo long, c_hi long")
    sums = prefix_sums(counts, "abc", (5, 4, 3), ["g"])
    direct = {(r.qid, r.g): r.cnt for r in box_counts(counts, boxes, "abc", "qid", ["g"]).collect()}
    assert {(r.qid, r.g): r.cnt for r in box_counts_from_sums(sums, boxes, "abc", "qid", ["g"]).where("cnt > 0").collect()} == direct
    small = compressed(sums, "abc", ["g"])
    assert small.count() <= sums.count()
    # the last kept sum at or below a cell is the cell's own
    joined = sums.alias("s").join(small.alias("t"), F.expr("s.g = t.g AND s.a = t.a AND s.b = t.b AND t.c <= s.c")).groupBy("s.g", "s.a", "s.b", "s.c", "s.cum").agg(F.max_by("t.cum", "t.c").alias("last"))
    assert joined.where("last <> cum").count() == 0 and joined.count() == sums.count()


def test_segments(spark):
    rows = spark.createDataFrame([(0, 5, 3), (1, 9, 0)], "s int, start long, length long")
    assert [(r.s, r.position) for r in expanded(rows).collect()] == [(0, 5), (0, 6), (0, 7)]


def test_segments_gather_and_id_sets(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"r{i}") for i in range(8)] + [(5, "again"), (None, "none")], "at long, name string")
    segments = spark.createDataFrame([(0, 5, 3), (1, 9, 2), (2, 0, 0), (3, 4, 2)], "s int, start long, length long")
    got = sorted((r.s, r.name) for r in gathered(segments, rows, "at").collect())
    assert got == [(0, "again"), (0, "r5"), (0, "r6"), (0, "r7"), (3, "again"), (3, "r4"), (3, "r5")]
    (tmp_path / "ids").write_text("3 4\t3\n\n 99 x 12.5\n18446744073709551615 7")
    assert sorted(r.id for r in read_id_set(spark, str(tmp_path / "ids")).collect()) == [3, 4, 7, 99]


def test_extent(spark):
    chance = random.Random(0)
    values = [chance.uniform(0, 114514) for _ in range(2639)]
    table = spark.createDataFrame([(v,) for v in [*values, float("nan")]], "v double")
    assert label_extent(table, ["v"]) == [(min(values), max(values))]
    assert label_extent(table.limit(1), ["v"]) == [(values[0], values[0])]


def test_quantiser_pads_and_groups_balance(spark):
    points = np.random.default_rng(0).normal(size=(50, 7))
    quantiser = ProductQuantiser([p[:5].copy() for p in np.split(np.pad(points, ((0, 0), (0, 1))), 2, axis=1)])
    assert quantiser.length == 4
    tables, codes = quantiser.tables(points[:3]), quantiser.encode(points[:3])
    assert np.allclose(tables[:, 0, :][np.arange(3), codes[:, 0]], tables[:, 0, :].min(1))
    sizes = np.bincount(balanced_groups(points, 8))
    assert sizes.sum() == 50 and sizes.max() - sizes.min() <= 1


def test_raw_files_and_results(spark, tmp_path, data, queries):
    values = np.arange(12, dtype=np.float32).reshape(3, 4)
    values.tofile(tmp_path / "train_vec")
    np.array([3, 4], dtype=np.int32).tofile(tmp_path / "train_vec_size")
    assert [(r.id, r.vec) for r in read_matrix(spark, str(tmp_path), "train_vec").orderBy("id").collect()] == [(i, list(map(float, v))) for i, v in enumerate(values)]
    assert [r.id for r in read_matrix(spark, str(tmp_path), "train_vec", start=1, stop=9).orderBy("id").collect()] == [1, 2]
    np.array([[1, -1], [2, 0]], dtype=np.int32).tofile(tmp_path / "neighbors")
    np.array([2, 2], dtype=np.int32).tofile(tmp_path / "neighbors_size")
    assert {tuple(r) for r in read_truth(spark, str(tmp_path)).collect()} == {(0, 1, 1), (1, 1, 2), (1, 2, 0)}
    result = exact(data, queries, LABELS, 3)
    write_result(result, str(tmp_path / "out"))
    assert found(read_result(spark, str(tmp_path / "out"))) == found(result)
    write_clustered(data.select("id", "l1"), str(tmp_path / "by_label"), "l1", files=4)
    plan = spark.read.parquet(str(tmp_path / "by_label")).where("l1 BETWEEN 3 AND 4")._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(l1,3" in plan


def test_raw_datasets_and_result_folders(spark, tmp_path):
    for key, values in (("train_vec", np.arange(6, dtype=np.float64).reshape(3, 2)), ("train_label", np.array([[1], [2], [3]], dtype=np.int32)), ("test_vec", np.ones((1, 2), dtype=np.float64)), ("test_label", np.array([[2]], dtype=np.int32))):
        values.tofile(tmp_path / key)
        np.array(values.shape, dtype=np.int32).tofile(tmp_path / f"{key}_size")
    (tmp_path / "keys").write_text("train_vec\ntrain_label\ntest_vec\ntest_label\n")
    (tmp_path / "dtypes").write_text("float64\nint32\nfloat64\nint32\n")
    data, tests = dataset(spark, str(tmp_path))
    assert sorted((r.id, r.vec, r.l0) for r in data.collect()) == [(0, [0, 1], 1), (1, [2, 3], 2), (2, [4, 5], 3)] and tests.first().x0 == 2
    (tmp_path / "dtypes").write_text("float64\n")
    with pytest.raises(ValueError):
        key_types(spark, str(tmp_path))
    out = tmp_path / "res"
    out.mkdir()
    for part, n in (("1", [[1, 2]]), ("0", [[3, 4], [5, 6]])):
        np.array(n, dtype=np.uint64).tofile(out / f"neighbors_{part}")
        (np.array(n, dtype=np.float32) / 2).tofile(out / f"distances_{part}")
    got = sorted(tuple(r) for r in read_raw_results(spark, str(out), 2).collect())
    assert got == [(0, 1, 3, 1.5), (0, 2, 4, 2.0), (1, 1, 5, 2.5), (1, 2, 6, 3.0), (2, 1, 1, 0.5), (2, 2, 2, 1.0)]


def test_few_levels_of_z_intervals_lose_no_cell(spark):
    chance = random.Random(4)
    rows = [(q, *(x for _ in range(2) for x in sorted(chance.randrange(16) for _ in range(2)))) for q in range(30)]
    asked = spark.createDataFrame(rows, "qid int, a_lo int, a_hi int, b_lo int, b_hi int")
    code = lambda a, b: sum((a >> i & 1) << 2 * i + 1 | (b >> i & 1) << 2 * i for i in range(4))
    for levels in (0, 2, 4):
        held = {q: set() for q in range(30)}
        for r in z_intervals(asked, ("a", "b"), 4, levels).collect():
            held[r.qid] |= set(range(r.z_lo, r.z_hi + 1))
        for q, a0, a1, b0, b1 in rows:
            box = {code(a, b) for a in range(a0, a1 + 1) for b in range(b0, b1 + 1)}
            assert box <= held[q] and (levels < 4 or box == held[q])


def test_streamed_queries(spark, tmp_path, data, queries):
    queries.write.parquet(str(tmp_path / "in"))
    strategy = STRATEGIES["prefilter"](LABELS, Params(k=5, codes=8))
    index = strategy.build(data)
    stream = spark.readStream.schema(queries.schema).parquet(str(tmp_path / "in"))
    serve(strategy, index, stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert found(spark.read.parquet(str(tmp_path / "out"))) == found(strategy.query(index, queries))


def test_plan_pushes_down_and_limits_early(spark, tmp_path, data, queries):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    data.drop("vec").write.parquet(str(tmp_path / "d"))
    pairs = range_join(spark.read.parquet(str(tmp_path / "d")), queries, LABELS).select("qid", "id", F.col("l1").alias("distance"))
    plan = top_k(pairs, 5)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(l0" in plan and "LessThanOrEqual(l1" in plan and "WindowGroupLimit" in plan
