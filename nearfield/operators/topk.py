"""The k best rows of each query."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Spark limits each partition's rows before the shuffle for limits up to its setting's default; beyond, each query's rows are
#: first ranked in so many pieces.
GROUP_LIMIT, PIECES = 1000, 64


def top_k(pairs: DataFrame, k: int, score: str = "distance", query: str = "qid", row: str = "id", largest: bool = False) -> DataFrame:
    """pairs with rank 1 to k within each query, by score and then by row; rows without a score drop out.

    Only each partition's, or each piece's, k best rows of a query reach the last ranking.
    """
    order = [F.desc(score) if largest else F.asc(score), F.asc(row)]
    pairs = pairs.where(F.col(score).isNotNull())
    if k > GROUP_LIMIT:
        piece = F.pmod(F.xxhash64(row), F.lit(PIECES))
        pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy(query, piece).orderBy(*order))).where(F.col("rank") <= k)
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(*order))).where(F.col("rank") <= k)


def merged_top_k(parts: list[DataFrame], k: int, **names) -> DataFrame:
    """The k best of each query over several partial results."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return top_k(whole.drop("rank"), k, **names)
