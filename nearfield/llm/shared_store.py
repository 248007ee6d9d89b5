"""What the operators ask of the session: tables and files that every executor can read, in the folder that spark.checkpoint.dir
names, and small Arrow batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nearfield.sources.lineage import new_folder

#: Bytes of rows after which an Arrow batch to a Python worker ends.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> SparkSession:
    """The session, set so that the Arrow batches of long texts are bounded by their bytes and not only by their rows.

    The JVM and the worker each hold a batch or two for each task; a setting of the user's own stays.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":  # Spark's default
        spark.conf.set(name, str(BATCH_BYTES))
    return spark


def new_path(spark: SparkSession, name: str) -> str:
    return new_folder(spark, name)


def written(frame: DataFrame, name: str) -> DataFrame:
    """The frame, written to the shared folder and read again: its lineage ends there, and a lost executor loses nothing."""
    spark = frame.sparkSession
    path = new_path(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
