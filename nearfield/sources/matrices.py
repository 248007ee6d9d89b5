"""Reading and writing vectors, labels, results and ground truth.

Parquet is the format of everything written.  The raw layout that older datasets have is read too: a headerless row-major
binary file for each key beside ``<key>_size`` with its rows and columns as two 32-bit integers.  A file is read in row ranges, each
by a task of its own through its file system's client, so its size doesn't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Type names of the raw layout.
DTYPES = {
    "float": np.float32, "float32": np.float32, "float64": np.float64, "double": np.float64,
    "int8": np.int8, "int16": np.int16, "int32": np.int32, "int": np.int32, "int64": np.int64, "long": np.int64,
    "uint8": np.uint8, "char": np.uint8, "bool": np.uint8, "uint16": np.uint16, "uint32": np.uint32, "uint64": np.uint64,
}

ROWS_PER_TASK_BYTES = 32 << 20


def located(spark: SparkSession, folder: str) -> str:
    """The folder as a URI: a plain path belongs to the session's default file system."""
    if "://" in folder:
        return folder
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
    return f"{default.rstrip('/') if not default.startswith('file:') else 'file://'}{folder}"


def matrix_size(folder: str, key: str) -> tuple[int, int]:
    store, path = fs.FileSystem.from_uri(f"{folder}/{key}_size")
    with store.open_input_stream(path) as file:
        rows, columns = np.frombuffer(file.read(8), dtype="<i4")
    return int(rows), int(columns)


def read_matrix(spark: SparkSession, folder: str, key: str, dtype: str = "float32", start: int = 0, stop: int | None = None) -> DataFrame:
    """(id, vec array<double>) of the rows start to stop - 1; id is the row's place in the file.  Rows beyond the end are none."""
    if dtype not in DTYPES:
        raise ValueError(f"unknown element type {dtype!r}")
    folder = located(spark, folder)
    rows, columns = matrix_size(folder, key)
    return _rows(spark, f"{folder}/{key}", columns, np.dtype(DTYPES[dtype]), start, rows if stop is None else min(stop, rows))


def _rows(spark: SparkSession, file: str, columns: int, kind: np.dtype, start: int, stop: int) -> DataFrame:
    """(id, vec) of the rows start to stop - 1 of a headerless file."""
    step = max(1, ROWS_PER_TASK_BYTES // max(1, columns * kind.itemsize))
    ranges = spark.range(start, max(start, stop), step, numPartitions=max(1, -(-(stop - start) // step)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(file)
        for batch in batches:
            for first in batch.column(0).to_pylist():
                count = min(step, stop - first)
                with store.open_input_file(path) as source:
                    values = np.frombuffer(source.read_at(count * columns * kind.itemsize, first * columns * kind.itemsize), dtype=kind).astype(float)
                offsets = pa.array(np.arange(count + 1, dtype=np.int32) * columns)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + count)), pa.ListArray.from_arrays(offsets, pa.array(values))], names=["id", "vec"])

    return ranges.mapInArrow(read, "id long, vec array<double>")


def _lines(folder: str, name: str) -> list[str]:
    store, path = fs.FileSystem.from_uri(f"{folder}/{name}")
    if store.get_file_info(path).type == fs.FileType.NotFound:
        return []
    with store.open_input_stream(path) as file:
        return [line.strip() for line in file.read().decode().splitlines() if line.strip()]


def key_types(spark: SparkSession, folder: str) -> dict[str, str]:
    """The element type of each key of a raw dataset: line by line those of its files keys and dtypes; none without such files."""
    keys, kinds = (_lines(located(spark, folder), name) for name in ("keys", "dtypes"))
    if len(kinds) < len(keys):
        raise ValueError(f"{len(keys)} keys with {len(kinds)} element types")
    return dict(zip(keys, kinds))


def dataset(spark: SparkSession, folder: str, dtype: str = "float32") -> tuple[DataFrame, DataFrame]:
    """(id, vec, l0...) and (qid, qvec, x0...) of a raw dataset's train and test keys."""
    kinds = key_types(spark, folder)
    read = lambda key: read_matrix(spark, folder, key, kinds.get(key, dtype))
    columns = matrix_size(located(spark, folder), "train_label")[1]
    anchors = matrix_size(located(spark, folder), "test_label")[1]
    data = read("train_vec").join(read("train_label").select("id", *(F.col("vec")[i].alias(f"l{i}") for i in range(columns))), "id")
    tests = read("test_vec").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    labels = read("test_label").select(F.col("id").alias("qid"), *(F.col("vec")[i].alias(f"x{i}") for i in range(anchors)))
    return data, tests.join(labels, "qid")


def read_truth(spark: SparkSession, folder: str, key: str = "neighbors") -> DataFrame:
    """(qid, rank, neighbor) of a raw ground-truth matrix; negative entries stand for none and are left out."""
    rows = read_matrix(spark, folder, key, "int32").select(F.col("id").alias("qid"), F.posexplode("vec").alias("rank", "neighbor"))
    return rows.select("qid", (F.col("rank") + 1).alias("rank"), F.col("neighbor").cast("bigint").alias("neighbor")).where("neighbor >= 0")


def read_id_set(spark: SparkSession, path: str) -> DataFrame:
    """(id) of text files of whole numbers with white space between them, each once; what isn't one is left out."""
    words = spark.read.text(path).select(F.explode(F.split("value", r"\s+")).alias("word"))
    return words.select(F.expr("try_cast(word AS bigint)").alias("id")).where("id IS NOT NULL").distinct()


def write_result(result: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One table of (qid, rank, neighbor, distance)."""
    result.write.mode(mode).parquet(path)


def read_result(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_raw_results(spark: SparkSession, folder: str, k: int) -> DataFrame:
    """(qid, rank, neighbor, distance) of a folder of raw results: neighbors* (uint64) and distances* (float32) with k entries a query, the
    files of each kind one after another in the order of their names."""
    folder = located(spark, folder)
    store, path = fs.FileSystem.from_uri(folder)
    out = []
    for kind, dtype in (("neighbors", np.uint64), ("distances", np.float32)):
        files = sorted((f.base_name, f.size) for f in store.get_file_info(fs.FileSelector(path)) if f.is_file and f.base_name.startswith(kind))
        whole, before = None, 0
        for name, size in files:
            n = size // (k * np.dtype(dtype).itemsize)
            rows = _rows(spark, f"{folder}/{name}", k, np.dtype(dtype), 0, n).select((F.col("id") + before).alias("qid"), F.posexplode("vec").alias("rank", kind))
            whole, before = rows if whole is None else whole.unionAll(rows), before + n
        if whole is None:
            raise ValueError(f"no {kind} files in {folder}")
        out.append(whole)
    both = out[0].join(out[1], ["qid", "rank"])
    return both.select("qid", (F.col("rank") + 1).alias("rank"), F.col("neighbors").cast("bigint").alias("neighbor"), F.col("distances").alias("distance"))


def write_raw_results(result: DataFrame, folder: str, k: int, files: int = 4) -> None:
    """Writes (qid, rank, neighbor, distance) as read_raw_results reads it: k entries a query in the order of qid, each task its own pair of
    files.  Queries with fewer results end in the largest number and an infinite distance, which read_raw_results leaves as they are."""
    spark = result.sparkSession
    folder = located(spark, folder)
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path)
    rows = result.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "neighbor", "distance"))).alias("found"))  # k entries a query
    rows = rows.select("qid", F.col("found.neighbor").alias("neighbor"), F.col("found.distance").alias("distance")).repartitionByRange(files, "qid").sortWithinPartitions("qid")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        found = [(n, d) for batch in batches for n, d in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        if found:
            neighbors, distances = np.full((len(found), k), np.iinfo(np.uint64).max, np.uint64), np.full((len(found), k), np.inf, np.float32)
            for i, (n, d) in enumerate(found):
                neighbors[i, : len(n)], distances[i, : len(d)] = n, d
            own, at = fs.FileSystem.from_uri(folder)
            for kind, values in (("neighbors", neighbors), ("distances", distances)):
                with own.open_output_stream(f"{at}/{kind}_{number:06d}") as file:
                    file.write(values.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([len(found)], pa.int64())], names=["n"])

    rows.mapInArrow(write, "n long").agg(F.sum("n")).collect()


def write_clustered(data: DataFrame, path: str, *columns: str, files: int = 32) -> None:
    """Rows in files by ranges of the columns and sorted by them, so that scans skip by the columns' statistics."""
    data.repartitionByRange(files, *columns).sortWithinPartitions(*columns).write.mode("overwrite").parquet(path)
