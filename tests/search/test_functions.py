import math
import random

import pytest
from pyspark.sql import functions as F

from nearfield.functions.filters import Divide, Interval, IntervalMap, Shift, inside, with_bounds
from nearfield.functions.grids import coordinate, flattened, morton_code, morton_coordinates, unflattened
from nearfield.functions.vectors import looked_up, squared_l2
from nearfield.plans.indexes import Params
from nearfield.sources.config import parse_filters, parse_settings


def bounds(spark, one, *anchor):
    names = tuple(f"x{i}" for i in range(len(anchor)))
    row = with_bounds(spark.createDataFrame([tuple(map(float, anchor))], [*names]), [one], [names if len(names) > 1 else names[0]]).first()
    return row.lo_0, row.hi_0


def test_bounds(spark):
    assert bounds(spark, Shift(604800, 0), 1_000_000) == (395200, 1_000_000 + 1e-7)
    assert bounds(spark, Shift(30, 30), 100) == (70, 130)
    intervals = IntervalMap(((1, 2), (1, 2), (3, 4), (3, 5), (4, 5)))
    assert [bounds(spark, intervals, x) for x in (1, 3, 5, 0, 6)] == [(1, 2), (3, 4), (4, 5), (None, None), (None, None)]
    assert bounds(spark, Divide(10), 57) == (5, math.inf)
    assert bounds(spark, Divide(10), -57.9) == (-5, math.inf)
    assert bounds(spark, Interval(), 2, 9) == (2, 9)
    with pytest.raises(ValueError):
        with_bounds(spark.range(1), [Shift(1, 1)], [])


def test_range_filter(spark):
    queries = spark.createDataFrame([(0, 1.0, 4.0, 2.0, 5.0), (1, 0.0, 3.0, 1.0, 2.0)], "qid int, lo_0 double, hi_0 double, lo_1 double, hi_1 double")
    rows = [(0, 0, 1.5, 4.5), (0, 1, 0.5, 2.5), (0, 2, 3.0, 4.0), (1, 0, 2.5, 3.5), (1, 1, 1.5, 5.5), (1, 2, 1.0, 3.5), (0, 3, float("nan"), 3.0), (0, 4, None, 3.0)]
    data = spark.createDataFrame(rows, "qid int, id int, a double, b double")
    assert {(r.qid, r.id) for r in data.join(queries, "qid").where(inside(["a", "b"])).collect()} == {(0, 0), (0, 2)}
    open_end = with_bounds(spark.createDataFrame([(0, 5.0)], "qid int, x double"), [Divide(1)], ["x"])
    assert open_end.join(data.where("id = 3").select("a", "b"), F.lit(True)).where(inside(["a"])).count() == 0


def test_quantised_distances(spark):
    codes = [(0, [0, 1]), (1, [2, 0]), (2, [1, 2]), (3, [2, 1])]
    tables = [(0, [[0.1, 0.2, 0.3], [0.4, 0.5, 0.6]]), (1, [[0.2, 0.3, 0.4], [0.5, 0.6, 0.7]]), (2, [[0.3, 0.4, 0.5], [0.6, 0.7, 0.8]])]
    pairs = spark.createDataFrame(codes, "id int, codes array<int>").join(spark.createDataFrame(tables, "qid int, lut array<array<double>>"))
    got = {(r.qid, r.id): round(r.d, 9) for r in pairs.select("qid", "id", looked_up("lut", "codes").alias("d")).collect()}
    want = [[0.6, 0.7, 0.8, 0.8], [0.8, 0.9, 1.0, 1.0], [1.0, 1.1, 1.2, 1.2]]
    assert got == {(q, i): want[q][i] for q in range(3) for i in range(4)}


def test_code_tables(spark):
    from nearfield.operators.quantise import code_tables

    centers = spark.createDataFrame([(0, 0, [1.0, 2.0]), (0, 1, [3.0, 4.0]), (1, 0, [5.0, 6.0]), (1, 1, [7.0, 8.0])], "part int, code int, center array<double>")
    queries = spark.createDataFrame([(0, [1.5, 2.5, 3.5, 4.5]), (1, [5.5, 6.5, 7.5, 8.5])], "qid int, qvec array<double>")
    got = {(r.qid, r.part, r.code): r.distance for r in code_tables(queries, centers, 2).collect()}
    assert got == {(0, 0, 0): 0.5, (0, 0, 1): 4.5, (0, 1, 0): 4.5, (0, 1, 1): 24.5, (1, 0, 0): 40.5, (1, 0, 1): 12.5, (1, 1, 0): 12.5, (1, 1, 1): 0.5}


def test_distances_of_unequal_lengths_are_null(spark):
    assert spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<double>, b array<double>").select(squared_l2("a", "b").alias("d")).first().d is None


def test_grid_numbers(spark):
    chance = random.Random(1)
    shape, rows = (5, 3, 7), [(chance.randrange(5), chance.randrange(3), chance.randrange(7)) for _ in range(50)]
    data = spark.createDataFrame(rows, "a long, b long, c long").withColumn("n", flattened([F.col(x) for x in "abc"], shape)).withColumn("z", morton_code([F.col(x) for x in "abc"], 3))
    back = data.select("*", *(c.alias(f"u{x}") for x, c in zip("abc", unflattened(F.col("n"), shape))), *(c.alias(f"m{x}") for x, c in zip("abc", morton_coordinates(F.col("z"), 3, 3))))
    assert all((r.a, r.b, r.c) == (r.ua, r.ub, r.uc) == (r.ma, r.mb, r.mc) and r.n == (r.a * 3 + r.b) * 7 + r.c for r in back.collect())
    with pytest.raises(ValueError):
        morton_code([F.lit(1)] * 5, 13)
    ends = spark.createDataFrame([(x,) for x in (-5.0, 0.0, 9.99, 10.0, 99.0, None)], "x double").select(coordinate(F.col("x"), 0, 10, 5).alias("c"))
    assert [r.c for r in ends.collect()][:5] == [0, 0, 4, 4, 4]


def test_settings_of_one_strategy():
    text = "n_list = 64\npq_bits = 5\nkmeans_n_iters = 9\nn_probes = 3\n"
    own, other = parse_settings(text, "ivfpq-post").params, parse_settings(text).params
    assert (own.lists, own.codes, own.iterations, own.probes) == (64, 32, 9, 3) and own.cluster_probes == Params().cluster_probes
    assert (other.lists, other.codes, other.probes, other.cluster_probes) == (Params().lists, Params().codes, 3, 64)
    assert parse_settings("i_degree = 48\ndegree = 12", "cagra-post").params.i_degree == 48


def test_settings():
    got = parse_settings('PQ_dim = 8\nlabel_dim = 1\n# no\ntopk = 100\npath = "a/b"\nexps0 = 30\nn_list = 64\nfilter_dim = 2\n')
    assert (got.params.parts, got.params.k, got.params.keep, got.params.cluster_probes, got.path, got.filter_dim) == (8, 100, 30.0, 64, "a/b", 2)
    text = "# c\nl = 4\nfilter0:\n\ttype = 0\n\tshift_val = [604800, 0]\nfilter1:\n\ttype = 1\n\tinterval_map = [1, 2, 3, 4]\n\nfilter2:\n type = 2\n div_value = [10]\nfilter3:\n type = 3\n"
    assert parse_filters(text) == [Shift(604800, 0), IntervalMap(((1, 2), (3, 4))), Divide(10), Interval()]
    with pytest.raises(ValueError):
        parse_filters("l = 2\nfilter0:\n type = 3\n")
