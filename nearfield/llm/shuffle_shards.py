"""Operator 9: shards of a uniformly shuffled corpus, by a two-pass external shuffle.

Pass 1 scatters the rows into buckets by a seeded hash of doc_id and text; there are so many buckets that each is
about BUCKET_BYTES.  Rows that repeat so often that they would fill a bucket by themselves are counted instead, as they can't be told
apart, and made again with a number each that goes into the hash: so they spread over all buckets too.  Pass 2 takes one bucket after another into memory, puts its rows into a defined order, permutes
them by a Fisher-Yates shuffle seeded by the bucket, and writes them.  Buckets one after another are the shuffled
corpus; the shards are equal runs of it, so that their row counts differ by at most one (law ``rows``).  The number of tasks grows with that of buckets.

The buckets' row counts give each bucket its place in the order before anything is written.  They are broadcast: at
most MAX_BUCKETS rows (16 MB), for which buckets grow beyond BUCKET_BYTES at sizes above MAX_BUCKETS of them.

Defined cases: a null text has size 1 and the checksum of an empty text; a null doc_id is a value like any other;
repeated rows get slots of their own, spread over all
shards however many they are; texts of any length are taken whole (a bucket holds one longer than BUCKET_BYTES beside its others); an empty table gives no rows; input columns named like an added one are replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.llm.rows import all_columns, numbered
from nearfield.llm.shared_store import new_path, small_batches, written

#: Bytes of equal rows beyond which each gets a number; numbers that are dealt out at a time.
HEAVY_BYTES, DEALT = 4 << 20, 10_000
BUCKET_BYTES, MIN_BUCKETS, MAX_BUCKETS, SEED = 16 << 20, 64, 1 << 20, 20240501
#: Buckets that one task shuffles, one after another, on average at most.
TASK_BUCKETS = 4


def _permuted(rows: list[pa.RecordBatch], seed: int, slot: int) -> pa.RecordBatch:
    table = pa.Table.from_batches(rows).combine_chunks()
    # numpy's permutation is the Fisher-Yates shuffle
    order = np.random.Generator(np.random.PCG64([seed, table.column("__bucket")[0].as_py()])).permutation(len(table))
    table = table.take(pa.array(order))
    places = pa.array(table.column("__first").to_numpy() + np.arange(len(table)), pa.int64())
    return table.drop_columns(["__bucket", "__first"]).append_column(slot, places).to_batches(max_chunksize=len(table))[0]


def _spread(rows: DataFrame, buckets: int, usual: int) -> DataFrame:
    """rows with __hash and __bucket, where rows that repeat too often for one bucket are dealt out by a number.

    Only buckets of twice the usual bytes are looked into; equal rows in them are found by their hash, and are at most as many
    different ones as there are HEAVY_BYTES of text.
    """
    rows = rows.withColumn("__bucket", F.pmod("__hash", F.lit(buckets)).cast("int"))
    full = rows.groupBy("__bucket").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > 2 * usual).select("__bucket")  # at most MAX_BUCKETS
    full = written(full, "full")
    if full.isEmpty():
        return rows
    heavy = rows.join(F.broadcast(full), "__bucket", "left_semi").groupBy("__hash").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).where((F.col("bytes") > HEAVY_BYTES) & (F.col("n") > 1)).select("__hash")
    heavy = written(heavy, "heavy")
    if heavy.isEmpty():
        return rows
    names = rows.columns
    same = rows.join(F.broadcast(heavy), "__hash", "left_semi").groupBy(*names).agg(F.count("*").alias("__n"))
    dealt = same.withColumn("__from", F.explode(F.expr(f"sequence(0, __n - 1, {DEALT})"))).repartition("__hash", "__from")
    numbered_rows = dealt.withColumn("__number", F.explode(F.expr(f"sequence(__from, least(__from + {DEALT - 1}, __n - 1))")))
    numbered_rows = numbered_rows.withColumn("__bucket", F.pmod(F.xxhash64("__hash", "__number"), F.lit(buckets)).cast("int"))
    return rows.join(F.broadcast(heavy), "__hash", "left_anti").select(*names).unionByName(numbered_rows.select(*names))


def write_shards(documents: DataFrame, folder: str, shards: int = 8, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes all rows and columns to folder/shard=<n>/ with size, text_crc32 and slot; returns the table as written."""
    spark = small_batches(documents.sparkSession)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = documents.select(all_columns(documents, ("size", "text_crc32", "shard", "slot")))
    rows = numbered(kept)
    own_id, text = (F.col(f"c{kept.columns.index(c)}") for c in (id_col, text_col))
    rows = rows.withColumn("size", F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1)
    rows = rows.withColumn("text_crc32", F.coalesce(F.crc32(text), F.lit(0).cast("long")))
    total = rows.agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).first()
    n, buckets = total["n"], min(MAX_BUCKETS, max(MIN_BUCKETS, 1 + (total["bytes"] or 0) // BUCKET_BYTES))
    rows = _spread(rows.withColumn("__hash", F.xxhash64(F.lit(seed), own_id, text)), buckets, max(BUCKET_BYTES, (total["bytes"] or 0) // buckets)).drop("__hash")
    # a window over one row for each bucket, at most MAX_BUCKETS
    before = F.coalesce(F.sum("count").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = rows.groupBy("__bucket").count().select("__bucket", before.cast("long").alias("__first"))
    scattered = rows.join(F.broadcast(firsts), "__bucket").repartition(min(buckets, max(partitions, buckets // TASK_BUCKETS)), "__bucket").sortWithinPartitions("__bucket", own_id, "size", "text_crc32")

    def shuffle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            of = batch.column("__bucket").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for start, stop in zip(cuts, cuts[1:]):
                if held and stop > start and held[-1].column("__bucket")[0].as_py() != of[start]:
                    yield _permuted(held, seed, "__place")
                    held = []
                if stop > start:
                    held.append(batch.slice(start, stop - start))
        if held:
            yield _permuted(held, seed, "__place")

    schema = T.StructType([*[f for f in scattered.schema if f.name not in ("__bucket", "__first")], T.StructField("__place", T.LongType())])
    placed = scattered.mapInArrow(shuffle, schema)
    # shard s holds the places from ceil(s * n / shards) on
    shard = F.expr(f"least({shards - 1}, __place * {shards} div {max(n, 1)})")
    slot = F.expr(f"__place - (shard * {n} + {shards - 1}) div {shards}")
    out = placed.withColumn("shard", shard.cast("int")).withColumn("slot", slot).drop("__place").toDF(*kept.columns, "size", "text_crc32", "shard", "slot")
    out.write.partitionBy("shard").parquet(folder)
    return spark.read.schema(out.schema).parquet(folder) if n else out.limit(0)


def op9_shuffle_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), new_path(spark, "shards"))
    return shards.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op9_shuffle_shards": op9_shuffle_shards}
ORACLES: dict[str, str] = {}
