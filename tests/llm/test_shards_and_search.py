import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from tests.llm.corpora import odd_documents

from nearfield.llm import pivot_search, shuffle_shards
from nearfield.llm.pivot_search import ORACLE, exact_top_k
from nearfield.llm.shared_store import new_path
from nearfield.llm.shuffle_shards import write_shards


@pytest.mark.parametrize("bucket_bytes", [400, 16 << 20])
def test_shards(spark, monkeypatch, bucket_bytes):
    monkeypatch.setattr(shuffle_shards, "BUCKET_BYTES", bucket_bytes)
    documents = odd_documents(spark, [f"text {i} " + "w " * (i % 9) for i in range(100)])
    folder = new_path(spark, "shards")
    rows = write_shards(documents, folder).collect()
    again = write_shards(documents.repartition(3), new_path(spark, "shards"))
    assert Counter((r.doc_id, r.text, r.bucket, r.key) for r in rows) == Counter((r.doc_id, r.text, r.bucket, r.key) for r in documents.collect())
    assert all(r.size == len((r.text or "").encode()) + 1 and r.text_crc32 == zlib.crc32((r.text or "").encode()) for r in rows)
    counts = Counter(r.shard for r in rows)
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    for shard in counts:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(counts[shard]))
    assert Counter((r.doc_id, r.text, r.shard, r.slot) for r in again.collect()) == Counter((r.doc_id, r.text, r.shard, r.slot) for r in rows)
    order = [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot)) if r.doc_id is not None]
    assert abs(np.corrcoef(order, range(len(order)))[0, 1]) < 0.5


def plain_shards(rows, bucket_bytes, heavy_bytes, seed=shuffle_shards.SEED, shards=8):
    """{row: [(shard, slot)]} of (doc_id, text) rows, by the method's steps in plain Python."""
    size = lambda t: len((t or "").encode()) + 1
    signed = lambda h: h - (1 << 64) if h >> 63 else h

    def hashed(*parts):  # of ints with their widths, and texts
        h = 42
        for part, width in parts:
            if part is not None:
                h = xxhash.xxh64_intdigest(part.encode() if isinstance(part, str) else part.to_bytes(width, "little", signed=True), seed=h)
        return signed(h)

    buckets = max(shuffle_shards.MIN_BUCKETS, 1 + sum(size(t) for _, t in rows) // bucket_bytes)
    own = [hashed((seed, 4), (i, 8), (t, 0)) for i, t in rows]
    in_bucket, per_hash = Counter(), Counter()
    for h, (_, t) in zip(own, rows):
        in_bucket[h % buckets] += size(t)
        per_hash[h] += size(t)
    copies, placed = Counter(), {}
    for h, row in zip(own, rows):
        bucket = h % buckets
        if in_bucket[bucket] > 2 * max(bucket_bytes, sum(size(t) for _, t in rows) // buckets) and per_hash[h] > heavy_bytes and own.count(h) > 1:
            bucket = hashed((h, 8), (copies[row], 8)) % buckets
            copies[row] += 1
        placed.setdefault(bucket, []).append(row)
    order = []
    for bucket in sorted(placed):
        held = sorted(placed[bucket], key=lambda r: (r[0] is not None, r[0] or 0, size(r[1]), zlib.crc32((r[1] or "").encode())))
        order += [held[i] for i in np.random.Generator(np.random.PCG64([seed, bucket])).permutation(len(held))]
    out = {}
    for place, row in enumerate(order):
        shard = min(shards - 1, place * shards // len(order))
        out.setdefault(row, []).append((shard, place - -(-shard * len(order) // shards)))
    return {row: sorted(at) for row, at in out.items()}


@pytest.mark.parametrize("bucket_bytes, heavy_bytes", [(400, 200), (2000, 500), (16 << 20, 4 << 20)])
def test_shards_equal_plain_python(spark, monkeypatch, bucket_bytes, heavy_bytes):
    """The whole query, with one row in half of all rows."""
    monkeypatch.setattr(shuffle_shards, "BUCKET_BYTES", bucket_bytes)
    monkeypatch.setattr(shuffle_shards, "HEAVY_BYTES", heavy_bytes)
    monkeypatch.setattr(shuffle_shards, "DEALT", 7)
    rows = [(i, f"text {i} " + "w " * (i % 9)) for i in range(150)] + [(7, "one and the same")] * 150 + [(8, None)] * 3 + [(None, "x")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {}
    for r in write_shards(table, new_path(spark, "shards")).collect():
        got.setdefault((r.doc_id, r.text), []).append((r.shard, r.slot))
    assert {row: sorted(at) for row, at in got.items()} == plain_shards(rows, bucket_bytes, heavy_bytes)


def test_repeated_rows_fill_no_bucket(spark, monkeypatch):
    monkeypatch.setattr(shuffle_shards, "BUCKET_BYTES", 4000)
    monkeypatch.setattr(shuffle_shards, "HEAVY_BYTES", 1000)
    rows = spark.range(3000).selectExpr("if(id < 1500, 7, id) AS doc_id", "if(id < 1500, 'the same text', concat('text ', id)) AS text", "octet_length(if(id < 1500, 'the same text', concat('text ', id))) + 1L AS size")
    spread = shuffle_shards._spread(rows.selectExpr("*", "xxhash64(doc_id, text) AS __hash"), 64, 1000)
    sizes = sorted(r["count"] for r in spread.groupBy("__bucket").count().collect())
    assert sum(sizes) == 3000 and len(sizes) == 64 and sizes[-1] < 3 * sizes[32]


def test_no_shards_of_nothing(spark):
    assert write_shards(spark.createDataFrame([], "doc_id long, text string"), new_path(spark, "shards")).count() == 0


def vectors(n, size=8, seed=4):
    chance = random.Random(seed)
    out = [(i, [chance.gauss(0, 0.4) for _ in range(size)], "x") for i in range(n)]
    out += [(10_000 + i, out[i % 7][1], "x") for i in range(40)]  # ties
    out += [(50_000, None, "x"), (50_050, [], "x"), (50_100, [None] * size, "x"), (50_150, [float("nan")] * size, "x"), (50_200, [float("inf")] * size, "x"), (50_250, [0.5, 0.5], "x"), (50_251, [0.1, 0.9], "x"), (50_300, [0.0] * size, "x")]
    return out


def test_top_k_equals_sql(spark, monkeypatch):
    rows = vectors(900)
    table = spark.createDataFrame([*rows, (None, [0.1] * 8, "x")], "vec_id long, embedding array<float>, v string")
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings(vec_id BIGINT, embedding FLOAT[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", [r[:2] for r in rows])
    want = sorted(con.execute(f"SELECT query_id, rank, vec_id, score FROM ({ORACLE})").fetchall())
    assert sorted(tuple(r) for r in exact_top_k(table).collect()) == want
    monkeypatch.setattr(pivot_search, "BLOCK_VECTORS", 100)
    monkeypatch.setattr(pivot_search, "GROUP_VECTORS", 100)
    monkeypatch.setattr(pivot_search, "CHUNK_BLOCKS", 7)
    monkeypatch.setattr(pivot_search, "BLOCK_QUERIES", 5)
    assert sorted(tuple(r) for r in exact_top_k(table).collect()) == want
    twice = exact_top_k(table.unionAll(table))
    assert sorted(tuple(r) for r in twice.collect()) == want


def test_pivots_eliminate(spark):
    """Of vectors without clusters as of clustered ones, most are never scored, and blocks of other clusters are never opened."""
    rng = np.random.default_rng(0)
    centers = rng.normal(size=(8, 64))
    for rows, most in ((rng.normal(size=(3000, 64)), 0.25), (centers[np.arange(3000) % 8] + rng.normal(size=(3000, 64)) / 50, 0.1)):
        rows /= np.linalg.norm(rows, axis=1, keepdims=True)
        table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<float>")
        scored = spark.sparkContext.accumulator(0)
        whole = np.floor(256 * rows.astype(np.float32).astype(float)).astype(np.int64)
        want = []
        for q in range(0, 3000, 50):
            own = whole @ whole[q]
            own[q] = -(1 << 40)
            best = np.lexsort((np.arange(3000), -own))[:5]
            want += [(q, r + 1, int(x), int(own[x])) for r, x in enumerate(best)]
        assert sorted(tuple(r) for r in exact_top_k(table, scored=scored).collect()) == want
        assert 0 < scored.value < most * 60 * 3000, scored.value


def test_any_finite_component(spark):
    """Scores beyond 2^53 are exact, and one beyond a long is the nearest long."""
    chance = random.Random(3)
    rows = [(i, [chance.choice([1e5, 3e8, -2e7, 1e-3, 7.0]) * chance.random() for _ in range(4)]) for i in range(120)] + [(500, [1e20, 0.0, 0.0, 1.0]), (501, [1e20, 1.0, 0.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    exact = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows}
    want = []
    for q in exact:
        if q % 50 == 0:
            scores = [(-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(exact[q], v)))), i) for i, v in exact.items() if i != q]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:5])]
    assert sorted(tuple(r) for r in exact_top_k(table).collect()) == sorted(want)


def test_no_vectors(spark):
    assert exact_top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
