"""How good a result is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recall(result: DataFrame, truth: DataFrame) -> DataFrame:
    """(qid, hits, expected, recall) of (qid, neighbor) tables; truth rows with a NULL or negative neighbor don't count."""
    wanted = truth.where("neighbor >= 0").select("qid", "neighbor").distinct()
    got = result.select("qid", "neighbor", F.lit(1).alias("hit")).distinct()
    return wanted.join(got, ["qid", "neighbor"], "left").groupBy("qid").agg(F.count("hit").alias("hits"), F.count("*").alias("expected")).withColumn("recall", F.col("hits") / F.col("expected"))
