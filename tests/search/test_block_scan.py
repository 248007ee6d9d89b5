from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.search.test_search import LABELS, POOR, brute_force, data, found, queries, rows  # noqa: F401

from nearfield.functions.filters import inside
from nearfield.functions.vectors import cosine_distance, squared_l2
from nearfield.operators import block_scan
from nearfield.operators.block_scan import Scan, best
from nearfield.operators.range_join import against, range_join
from nearfield.operators.topk import top_k
from nearfield.plans import indexes
from nearfield.plans.indexes import STRATEGIES, exact, post_filtered, scanned, until_k_pass


def rows_of(frame):
    return sorted(map(repr, frame.select("qid", "rank", "id", "distance").collect()))


@pytest.fixture(params=[(2048, 2048, 256, 1 << 21), (50, 5, 7, 40)])
def blocks(request, monkeypatch):
    for name, value in zip(("ROWS", "QUERIES", "CHUNK", "HELD"), request.param):
        monkeypatch.setattr(block_scan, name, value)


SCORES = {
    "l2": (Scan(6), lambda fits: squared_l2("qvec", "vec")),
    "farthest": (Scan(6, largest=True), lambda fits: squared_l2("qvec", "vec")),
    "cosine": (Scan(6, by="cosine"), lambda fits: cosine_distance("qvec", "vec")),
    "penalty": (Scan(6, labels=tuple(LABELS), numbers=(0, 1), filters="penalty", penalty=500.0), lambda fits: squared_l2("qvec", "vec") + F.when(fits, 0.0).otherwise(500.0)),
    "only": (Scan(6, labels=tuple(LABELS), numbers=(0, 1)), lambda fits: F.when(fits, squared_l2("qvec", "vec"))),
}


@pytest.mark.parametrize("name", SCORES)
def test_blocks_give_what_all_pairs_give(spark, rows, data, queries, blocks, name):  # noqa: F811
    """Ties (repeated vectors), vectors of another kind, and distances to the last bit."""
    scan, score = SCORES[name]
    measured = score(F.coalesce(inside(LABELS), F.lit(False)))
    again = data.union(data.where("id < 300").withColumn("id", F.col("id") + 5000)).where("coalesce(size(vec), 1) > 0").repartition(3)
    want = top_k(range_join(again, queries, []).select("qid", "id", measured.alias("distance")), 6, largest=scan.largest)
    assert rows_of(top_k(scanned(again, queries, scan, measured), 6, largest=scan.largest)) == rows_of(want)


def test_few_pairs_leave_their_task(spark, rows, data, queries):  # noqa: F811
    usable = data.where("id < 600")
    sent = best(usable, queries, Scan(6)).groupBy("qid").count().agg(F.max("count")).first()[0]
    assert sent <= 6 * 3 * spark.sparkContext.defaultParallelism < 600
    plan = exact(data, queries, [], 6)._jdf.queryExecution().toString()
    assert "squared" not in plan and "zip_with" not in plan.split("Physical")[-1]  # pairs aren't measured row by row


def test_large_and_odd_numbers(spark):
    chance = np.random.default_rng(0)
    points = [(i, [float(x) for x in v]) for i, v in enumerate(chance.normal(size=(80, 3)) * 10.0 ** chance.integers(-150, 156, (80, 1)))]
    data_ = spark.createDataFrame(points, "id long, vec array<double>")
    asked = data_.where("id % 9 = 0").toDF("qid", "qvec")
    pairs = asked.crossJoin(data_).select("qid", "id", squared_l2("qvec", "vec").alias("distance"))
    assert rows_of(top_k(best(data_, asked, Scan(5)), 5)) == rows_of(top_k(pairs, 5))


def test_filtering_after_takes_two_searches(spark, rows, data, queries, monkeypatch):  # noqa: F811
    """However few pass; it took one for each doubling of the depth."""
    written = []
    cut = indexes.cut
    monkeypatch.setattr(indexes, "cut", lambda frame: written.append(1) or cut(frame))
    want = brute_force(rows, queries, 7)
    assert found(post_filtered(data, queries, LABELS, 7, 8)) == want and len(written) <= 2
    written.clear()
    pairs = range_join(data.where("id < 600"), queries, []).select("qid", "id", squared_l2("qvec", "vec").alias("distance"), inside(LABELS).alias("fits"))
    assert found(until_k_pass(pairs, queries, 7, 8)) == want and len(written) <= 2


@pytest.mark.parametrize("name", ["pq", "parafilter", "ivf-ivf_pq", "grid-ivf_pq", "super-grid", "ivfpq-post"])
def test_strategies_write_no_pairs(data, queries, monkeypatch, name):  # noqa: F811
    """What a query writes is a few rows for each query, not the pairs of a query and a row that it scores."""
    strategy = STRATEGIES[name](LABELS, POOR)
    index = strategy.build(data)
    written, cut = [], indexes.cut

    def counted(frame):
        out = cut(frame)
        written.append(out.count())
        return out

    monkeypatch.setattr(indexes, "cut", counted)
    strategy.query(index, queries).collect()
    assert max(written) <= 12 * max(12, POOR.k * 2)


def test_corners_of_boxes_are_not_broadcast(spark, tmp_path):
    """They are 2^n for each box, and the planner takes them for few bytes."""
    from pyspark.sql.types import LongType, StructField, StructType

    from nearfield.operators.grid_counts import box_counts, box_counts_from_sums, cell_counts, prefix_sums

    schema = StructType([StructField(n, LongType()) for n in ("qid", "a_lo", "a_hi", "b_lo", "b_hi")])
    spark.createDataFrame([(i, i % 3, i % 3 + i % 2, i % 4, 4) for i in range(500)], schema).write.parquet(f"{tmp_path}/boxes")
    boxes = spark.read.parquet(f"{tmp_path}/boxes")
    counts = cell_counts(spark.range(3000).selectExpr("id % 4 AS a", "id % 5 AS b"), ["a", "b"])
    sums = prefix_sums(counts, ["a", "b"], (4, 5))
    want = sorted(box_counts(counts, boxes, ["a", "b"]).collect())
    for given, broadcasts in ((F.broadcast(sums), "BuildRight"), (sums, None)):
        got = box_counts_from_sums(given, boxes, ["a", "b"])
        assert sorted(got.where("cnt > 0").collect()) == want
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "BuildLeft" not in plan and (broadcasts is None or broadcasts in plan)


def test_rows_without_a_label_are_searched(spark, tmp_path):
    """Lists and codebooks made of a label's values; rows without one have a list too, and a NaN spoils no centre."""
    from nearfield.plans.catalog import QUERIES

    chance = np.random.default_rng(4)
    table = [(i, [float(x) for x in np.float32(v)], None if i % 7 == 0 else i % 3) for i, v in enumerate(chance.normal(size=(400, 8)))]
    spark.createDataFrame(table + [(401, [float("nan")] * 8, 1)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = {}
    for q in range(0, 400, 100):
        near = sorted((sum((a - b) ** 2 for a, b in zip(table[q][1], v)), i) for i, v, _ in table)
        want.update({(q, r + 1): i for r, (_, i) in enumerate(near[:10])})
    for name in ("ivf_probe_topk", "refine_topk"):
        assert found(QUERIES[name](spark, str(tmp_path))) == want


def test_boxes_that_are_alike_are_halved_once(spark, monkeypatch):
    from nearfield.operators import zorder

    halved, seen = zorder._halved, []
    monkeypatch.setattr(zorder, "_halved", lambda boxes, *more: seen.append(boxes.count()) or halved(boxes, *more))
    boxes = spark.range(600).selectExpr("id AS qid", "id % 3 AS a_lo", "id % 3 + 2 AS a_hi", "id % 2 AS b_lo", "3L AS b_hi")
    got = zorder.z_intervals(boxes, ["a", "b"], 3)
    one = {r.qid: 0 for r in boxes.collect()}
    for r in got.collect():
        one[r.qid] += r.z_hi - r.z_lo + 1
    assert seen == [6] and all(n == 3 * (4 - q % 2) for q, n in one.items())


def test_label_sets_are_chosen_without_reading_rows(data, queries):  # noqa: F811
    """Holding a share of the rows against all queries grew with rows times queries, in one task."""
    strategy = STRATEGIES["ivf-ivf_pq"](LABELS, replace(POOR, label_probes=3, pass_ratio=0.01))
    index = strategy.build(data)
    chosen = strategy.chosen(index, queries)
    assert chosen.count() and not any("/laid/" in f for f in chosen.inputFiles())


def test_few_rows_meet_many_queries_in_several_tasks(spark):
    lists = spark.range(6).coalesce(1).selectExpr("id AS list_id")
    asked = spark.range(1000).selectExpr("id AS qid")
    near = against(lists, asked, F.expr("list_id <= qid % 6"))
    assert near.rdd.getNumPartitions() > 1 and near.count() == sum(1 + q % 6 for q in range(1000))
