"""Answering a stream of queries over an index that stays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from nearfield.plans.indexes import Index, Strategy


def serve(strategy: Strategy, index: Index, queries: DataFrame, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Writes each micro-batch's results to out/batch=<n>; a batch that is run again after a failure replaces its own folder.

    queries is a streaming DataFrame of (qid, qvec, lo_i, hi_i...).  index is best one that was saved and loaded: of one that was only
    built, each batch assigns and encodes the data again.
    """

    def answer(batch: DataFrame, number: int) -> None:
        strategy.query(index, batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return queries.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
