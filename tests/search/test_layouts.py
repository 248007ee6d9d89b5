"""What is read, counted and fitted on the way to a result."""

import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.functions.vectors import squared_l2
from nearfield.operators.grid_counts import box_counts, box_counts_from_changes, cell_counts, changes, prefix_sums
from nearfield.operators.quantise import ProductQuantiser, fit_centres, k_means, nearest, sample_vectors, with_codes
from nearfield.operators.topk import top_k
from nearfield.plans.indexes import STRATEGIES, Index, Params, exact, refined
from nearfield.sources.layout import numbers

LABELS = ["l0", "l1"]
USUAL = Params(k=5, codes=16, lists=8, clusters=8, sub_clusters=2, cluster_probes=4, sub_probes=6, grids=256, files=24, keep=4)


@pytest.fixture(scope="module")
def data(spark):
    """2,000 rows in clusters; l0 goes with the cluster, l1 with nothing."""
    rng = np.random.default_rng(5)
    centers = 6 * rng.normal(size=(16, 8))
    own = rng.integers(0, 16, 2000)
    points = centers[own] + 0.3 * rng.normal(size=(2000, 8))
    rows = [(i, [float(x) for x in p], float(c), float(rng.integers(0, 100))) for i, (p, c) in enumerate(zip(points, own))]
    return spark.createDataFrame(rows, "id long, vec array<float>, l0 double, l1 double").cache()


def asked(data, where, w0, w1):
    return data.where(where).select(F.col("id").alias("qid"), F.col("vec").alias("qvec"), (F.col("l0") - w0).alias("lo_0"), (F.col("l0") + w0).alias("hi_0"), (F.col("l1") - w1).alias("lo_1"), (F.col("l1") + w1).alias("hi_1")).cache()


def found(result):
    return {(r.qid, r.rank): r.neighbor for r in result.collect()}


def folders(frame):
    return {r[0].rsplit("/", 1)[0] for r in frame.select(F.input_file_name()).distinct().collect()}


def test_super_grid_reads_few_parts(spark, tmp_path, data):
    strategy = STRATEGIES["super-grid"](LABELS, USUAL)
    strategy.build(data, str(tmp_path / "index"))
    index = Index.load(spark, str(tmp_path / "index"))
    queries = asked(data, "id IN (3, 700)", 0, 4)
    boxes = strategy.boxes(index, queries)
    held = strategy.held(index, boxes)
    # every row in a box is counted in its sub-cluster, whatever the shape of the grid
    direct = box_counts(cell_counts(index.data, ["c_0", "c_1"], ["sub"]), boxes, ["c_0", "c_1"], "qid", ["sub"])
    assert {tuple(r) for r in held.select("qid", "sub", "cnt").collect()} == {tuple(r) for r in direct.collect()}
    parts = strategy.parts(index, boxes, held.select("qid", "sub"), strategy.intervals(index, boxes))
    read = index.of(parts)
    plan = read._jdf.queryExecution().toString()
    assert "part#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert len(folders(read)) == len(numbers(parts)) < 0.35 * len(folders(index.data))
    met = data.join(queries, F.expr("l0 BETWEEN lo_0 AND hi_0 AND l1 BETWEEN lo_1 AND hi_1")).select("id")
    assert met.join(read.select("id"), "id", "left_anti").count() == 0
    assert found(strategy.query(index, queries)) == found(exact(data, queries, LABELS, 5))


def test_sorting_reads_runs_of_the_best_label(data):
    strategy = STRATEGIES["sorting"](LABELS, USUAL)
    index = strategy.build(data)
    # by l1 the first query is narrow, by l0 the second
    queries = asked(data, "id = 3", 20, 1).unionAll(asked(data, "id = 4", 0, 200)).cache()
    runs = strategy.runs(index, queries)
    assert {(r.qid, r.label) for r in runs.select("qid", "label").distinct().collect()} == {(3, 1), (4, 0)}
    for label in (0, 1):
        own = runs.where(F.col("label") == label)
        read = index.of(own, f"by_{label}")
        assert len(folders(read)) == own.count() < 0.35 * len(folders(index.laid[f"by_{label}"]))
    assert found(strategy.query(index, queries)) == found(exact(data, queries, LABELS, 5))


def test_equal_labels_lie_in_several_parts(data):
    index = STRATEGIES["sorting"](["l0"], USUAL).build(data.withColumn("l0", F.lit(1.0)))
    sizes = [r["rows"] for r in index.tables["by_0_parts"].collect()]
    assert len(sizes) == 24 and max(sizes) < 3 * 2000 / 24


def test_counts_from_compressed_sums(spark):
    chance = random.Random(5)
    points = [(g, chance.randrange(5), chance.randrange(4), chance.choice([0, 6, 7])) for g in (0, 1, 2) for _ in range(60)]
    counts = cell_counts(spark.createDataFrame(points, "g int, a long, b long, c long"), "abc", ["g"])
    rows = [(q, g, *(x for n in (5, 4, 9) for x in sorted(chance.randrange(n) for _ in range(2)))) for q in range(20) for g in range(3)]
    boxes = spark.createDataFrame(rows, "qid int, g int, a_lo long, a_hi long, b_lo long, b_hi long, c_lo long, c_hi long")
    runs = changes(prefix_sums(counts, "abc", (5, 4, 9), ["g"]), "abc", ["g"])
    assert runs.count() < 3 * 5 * 4 * 4
    got = {(r.qid, r.g): r.cnt for r in box_counts_from_changes(runs, boxes, "abc", "qid", ["g"]).where("cnt > 0").collect()}
    want = {(q, g): n for q, g, *e in rows if (n := sum(p[0] == g and e[0] <= p[1] <= e[1] and e[2] <= p[2] <= e[3] and e[4] <= p[3] <= e[5] for p in points))}
    assert got == want


def test_centres_of_all_rows(spark):
    """More centres than the driver's sample could give, fitted where the rows are."""
    rng = np.random.default_rng(2)
    own = 4 * rng.normal(size=(40, 6))
    points = own[rng.integers(0, 40, 6000)] + 0.2 * rng.normal(size=(6000, 6))
    table = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "id long, vec array<double>").repartition(4)
    inertia = lambda c: float(((points - c[nearest(points, c)]) ** 2).sum())
    (spread,) = fit_centres(table, 40, local=0)
    sample = k_means(sample_vectors(table, rows=300), 40)
    assert spread.shape == (40, 6) and inertia(spread) < 1.1 * inertia(k_means(points, 40)) and inertia(spread) < inertia(sample)
    parts = fit_centres(table, 300, 2, local=100, rows_a_centre=8, rounds=2)
    assert [p.shape for p in parts] == [(300, 3), (300, 3)]
    again = fit_centres(table.repartition(3), 300, 2, local=100, rows_a_centre=8, rounds=2)
    assert all(np.allclose(a, b) for a, b in zip(parts, again))


def test_residual_codes_are_nearer(data):
    """With centres taken off, codes lie nearer to their rows, and fewer rows are left to be measured."""
    strategy = STRATEGIES["ivfpq-post"](LABELS, replace(USUAL, lists=16))
    index = strategy.build(data)
    whole = with_codes(data, ProductQuantiser.fit(data, 4, 16)).agg(F.avg("err")).first()[0]
    assert index.data.agg(F.avg("err")).first()[0] < 0.7 * whole
    far = index.data.join(index.tables["lists"], "list_id").groupBy("list_id").agg(F.max(F.sqrt(squared_l2("vec", "center"))).alias("far"), F.max("radius").alias("radius"))
    assert far.where("abs(far - radius) > 1e-6").count() == 0
    queries = asked(data, "id % 400 = 0", 20, 200)
    assert found(strategy.query(index, queries)) == found(exact(data, queries, LABELS, 5))


def test_the_walk_alone_finds_most(data):
    p = Params(k=10, codes=8, lists=8, degree=16, i_degree=24, entries=24, frontier=48, width=6, rounds=12, beta=1)
    strategy = STRATEGIES["cagra-post"]([], p)
    index = strategy.build(data)
    degrees = index.tables["edges"].groupBy("a").count().agg(F.max("count"), F.count("*")).first()
    assert degrees[0] <= 16 and degrees[1] == 2000
    queries = asked(data, "id % 40 = 7", 0, 0)
    walked = {(r.qid, r.id) for r in strategy.first(index, queries).collect()}
    want = {(r.qid, r.neighbor) for r in exact(data, queries, [], 10).collect()}
    assert len(walked & want) >= 0.9 * len(want)


def test_descent_sends_a_vector_to_rows_and_not_to_pairs(spark, data, tmp_path):
    """The rounds of descent read the vectors once, and give nearly all of a row's nearest ones."""
    data.select("id", "vec").write.parquet(str(tmp_path / "points"))
    points = spark.read.parquet(str(tmp_path / "points"))
    strategy = STRATEGIES["cagra-post"]([], Params(k=10, i_degree=16))
    few = points.where("id < 600")
    pairs = few.crossJoin(few.toDF("qid", "qvec")).where("qid <> id").select("qid", "id", squared_l2("qvec", "vec").alias("distance")).localCheckpoint()
    chance = top_k(pairs.select("qid", "id", F.xxhash64("qid", "id").alias("distance")), 16).drop("distance")
    edges = top_k(chance.drop("rank").join(pairs, ["qid", "id"]), 16).localCheckpoint()
    once = strategy._descended(edges, points)
    assert once._jdf.queryExecution().analyzed().toString().count("parquet") == 1
    for _ in range(4):
        edges = strategy._descended(edges, points).localCheckpoint()
    both = edges.where("rank <= 8").join(top_k(pairs, 8).select("qid", "id", F.col("distance").alias("own")), ["qid", "id"])
    assert edges.groupBy("qid", "id").count().where("count > 1").count() == 0 and edges.where("qid = id").count() == 0
    assert both.count() > 0.8 * 600 * 8 and both.where("abs(distance - own) > 1e-6").count() == 0


def test_probes_follow_what_is_expected_to_fit(data):
    """Wide queries probe fewer lists than narrow ones, and for most the lists hold enough rows."""
    strategy = STRATEGIES["ivf-ivf_pq"](LABELS, replace(USUAL, label_clusters=4, label_probes=4, pass_ratio=0, probes=30))
    index = strategy.build(data)
    counts = {}
    for name, w1 in (("wide", 60), ("narrow", 8)):
        queries = asked(data, "id % 100 = 0", 20, w1)
        probed = strategy.probed(index, queries).cache()
        counts[name] = probed.count() / queries.count()
        rows = index.data.join(probed.join(queries.drop("qvec"), "qid"), ["set_id", "list_id"]).where("l0 BETWEEN lo_0 AND hi_0 AND l1 BETWEEN lo_1 AND hi_1")
        filled = rows.groupBy("qid").count().where("count >= 5").count()
        assert filled >= 0.7 * queries.count()
    assert counts["wide"] < counts["narrow"] < 30


def test_narrow_queries_meet_one_cell(data):
    strategy = STRATEGIES["grid-ivf_pq"](LABELS, replace(USUAL, max_cells=60, widths=(1.0, 20.0)))
    index = strategy.build(data)
    assert index.extra["shape"] == [12, 4] or np.prod(index.extra["shape"]) <= 60
    queries = asked(data, "id % 100 = 0", 0.5, 10)
    per = strategy.chosen(index, queries).groupBy("qid").count()
    assert per.agg(F.avg("count")).first()[0] < 1.5
    # each row comes once, though it is in several cells
    wide = asked(data, "id % 500 = 0", 30, 300)
    assert found(strategy.query(index, wide)) == found(exact(data, wide, LABELS, 5))
    assert index.data.count() > 3 * 2000 and refined(wide.select("qid", F.lit(3).alias("id")), index.data, wide, 5).count() == wide.count()
