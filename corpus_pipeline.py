"""Cleaning and tokenising a corpus: stages over documents, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs, and each
works on all that the one before it kept:

1. toxicity: documents that score 0.7 or more go.
2. near_duplicates: of each group of documents that the n-gram Jaccard join links, one row with its smallest doc_id stays; repeated
   rows are a group too.
3. repeated_passages: words covered by 50-word windows that a document with a smaller doc_id holds too are cut; a text that loses
   words becomes the words left, joined by one space, and n_chars its length.  A text that loses all becomes empty.
4. benchmark: documents in which a benchmark item is found go.  Like the stages before, it judges rows, not ids: a document that shares
   its doc_id with another is judged by its own text.
5. tokens: SentencePiece ids of each text with the end id, and the digests of op1.

Rows with a null doc_id pass stages 2 and 3 as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.ngram_join import one_of_each_group
from nearfield.llm.rows import all_columns, quoted
from nearfield.llm.seed_decontamination import decontaminate
from nearfield.llm.sentencepiece_codec import default_vocabulary, sentencepiece_digests
from nearfield.llm.shared_store import written
from nearfield.llm.substring_dedup import substring_dedup
from nearfield.llm.toxicity import fit, without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each_group(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rest = all_columns(docs, ("doc_id", "text"))  # in one column, whatever their names
    cut = substring_dedup(docs.select("doc_id", "text", F.struct(F.lit(0).alias("none"), *rest).alias("rest")))
    lost, changed = F.col("n_removed") > 0, {"text": F.col("kept_text"), "n_chars": F.length("kept_text")}
    out = []
    for name in docs.columns:
        own = F.col(name) if name in ("doc_id", "text") else F.expr(f"rest.{quoted(name)}")
        out.append((F.when(lost, changed[name].cast(docs.schema[name].dataType)).otherwise(own) if name in changed else own).alias(name))
    return cut.select(out)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_digests(docs, default_vocabulary(), with_ids=True)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark", benchmark),
    ("tokens", tokens),
]

#: SentencePiece and the learnt toxicity model are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
