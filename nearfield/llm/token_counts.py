"""Operator 3: token counts without token ids.

A document's token count is the sum over its pre-tokens of their piece counts.  Each document yields its
pre-token frequencies; the pre-tokens' pieces are counted once for each distinct pre-token; a join on the
pre-token and a sum by document give the result.

The join is done in two ways by how common a pre-token is.  The most common ones of a sample, at most
HEAD_SIZE, are counted once on the driver and broadcast (a few MB by that bound), so that no common
pre-token is ever shuffled.  All others meet by pre-token hash: one row for each slice of text and bucket
carries the slice's frequencies, and the task that owns the bucket counts each distinct pre-token once.  The
sample decides only which of the two ways a pre-token goes; both count it alike, so no result depends on it.

Defined cases: a null text counts as an empty one (0 bytes, 0 tokens); each input row gives one result row,
also if its doc_id is null or repeated; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.merge_vocabulary import vocabulary
from nearfield.llm.sentencepiece_codec import default_vocabulary
from nearfield.llm.shared_store import small_batches
from nearfield.llm.text_kernels import mix, slices, word_hashes

#: Documents looked at, and the pre-tokens taken from them, for the broadcast side of the join.
SAMPLE_DOCUMENTS, SAMPLE_BYTES, HEAD_SIZE = 4000, 20_000, 1 << 17
#: Text for which there is one task after a shuffle; a worker keeps the distinct pre-tokens of one of its four buckets.
TASK_BYTES = 64 << 20

_ENTRY = "bucket int, pretokens array<binary>, doc_ids array<long>, keys array<long>, freqs array<int>, sizes array<long>, tokens array<long>"


def piece_counts(path: str, pretokens: list[bytes]) -> np.ndarray:
    """Pieces of each pre-token, as the sentencepiece library gives them."""
    library = _library(path)
    return np.array([len(x) for x in library.encode([p.decode() for p in pretokens], num_threads=1)], dtype=np.int64)


_LIBRARIES: dict[str, object] = {}


def _library(path: str):
    if path not in _LIBRARIES:
        _LIBRARIES[path] = vocabulary(path).library(dummy_prefix=False)
    return _LIBRARIES[path]


def common_pretokens(documents: DataFrame, path: str) -> dict[bytes, int]:
    """Piece counts of the most common pre-tokens of a bounded sample."""
    sample = documents.where(F.octet_length("text").between(1, SAMPLE_BYTES)).select("text").limit(SAMPLE_DOCUMENTS)
    seen: Counter[bytes] = Counter()
    for batch in sample.toArrow().to_batches():
        for part in slices(batch, "text"):
            for pair in pc.value_counts(vocabulary(path).pretokens(part.column(0))[0]).to_pylist():
                seen[pair["values"]] += pair["counts"]
    common = [p for p, _ in seen.most_common(HEAD_SIZE)]
    return dict(zip(common, piece_counts(path, common).tolist()))


def token_counts(documents: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each document."""
    spark = small_batches(documents.sparkSession)
    texts = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + total // TASK_BYTES)
    buckets = 4 * partitions
    head = spark.sparkContext.broadcast(common_pretokens(texts, path))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, common = vocabulary(path), head.value
        for batch in batches:
            for part in slices(batch, "text"):
                tokens, ranges, sizes = vocab.pretokens(part.column(2))
                coded = pc.dictionary_encode(tokens)
                names, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
                rows = len(part)
                known = np.array([common.get(p, -1) for p in names] + [0], dtype=np.int64)
                counted = np.concatenate([[0], np.cumsum(np.maximum(known[codes], 0))])
                local = np.diff(counted[ranges])
                rare = np.flatnonzero(known[codes] < 0)
                owner = np.repeat(np.arange(rows), np.diff(ranges))[rare]
                pairs, freqs = np.unique(codes[rare] * rows + owner, return_counts=True)
                code, owner = np.divmod(pairs, max(rows, 1))
                # the documents themselves come first, then their rare pre-tokens
                values = coded.dictionary.cast(pa.binary())
                hashes = _pretoken_hashes(names)
                bucket = np.concatenate([np.arange(rows) % buckets, (hashes[code] % np.uint64(buckets)).astype(np.int64)])
                order = np.argsort(bucket, kind="stable")
                at = np.flatnonzero(np.diff(bucket[order], prepend=-1))
                offsets = pa.array(np.append(at, len(order)), pa.int32())
                whole = lambda a, b: np.concatenate([a, b])
                own = whole(np.arange(rows), owner)[order]
                index = pa.array(whole(np.zeros(rows, np.int64), code)[order], mask=(order < rows))
                zeros = np.zeros(len(code), np.int64)
                lists = [
                    values.take(index),
                    part.column(0).take(pa.array(own)),
                    part.column(1).take(pa.array(own)),
                    pa.array(whole(np.zeros(rows, np.int64), freqs)[order].astype(np.int32)),
                    pa.array(whole(sizes, zeros)[order]),
                    pa.array(whole(local, zeros)[order]),
                ]
                arrays = [pa.array(bucket[order][at].astype(np.int32)), *(pa.ListArray.from_arrays(offsets, x) for x in lists)]
                yield pa.RecordBatch.from_arrays(arrays, names=["bucket", "pretokens", "doc_ids", "keys", "freqs", "sizes", "tokens"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}  # of the bucket that the last batch ended with: rows come bucket by bucket
        for batch in batches:
            flat = [batch.column(i).flatten() for i in range(1, 7)]
            coded = pc.dictionary_encode(flat[0])
            names = coded.dictionary.to_pylist()
            new = [p for p in names if p not in known]
            known.update(zip(new, piece_counts(path, new).tolist()))
            pieces = np.array([known[p] for p in names] + [0], dtype=np.int64)
            last = batch.column(0)[len(batch) - 1].as_py() if len(batch) else -1
            known = _of_bucket(known, last, buckets)
            codes = pc.fill_null(coded.indices, len(names)).to_numpy().astype(np.int64)
            tokens = flat[5].to_numpy() + pieces[codes] * flat[3].to_numpy()
            copies = np.asarray(flat[0].is_null().to_numpy(zero_copy_only=False), dtype=np.int64)
            sums = _by_document(pa.table([flat[1], flat[2], pa.array(copies), flat[4], pa.array(tokens)], names=_SUM_COLUMNS))
            # one row for each batch and bucket of documents
            ids = pc.fill_null(sums.column("doc_id"), 0).to_numpy().view(np.uint64)
            bucket = (mix(ids ^ mix(sums.column("key").to_numpy().view(np.uint64))) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            at = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            offsets = pa.array(np.append(at, len(order)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, c) for c in sums.take(pa.array(order)).combine_chunks().to_batches()[0].columns] if len(order) else []
            if lists:
                yield pa.RecordBatch.from_arrays([pa.array(bucket[order][at]), *lists], names=["bucket", *_SUM_COLUMNS])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            held.append(pa.table([batch.column(i).flatten() for i in range(1, 6)], names=_SUM_COLUMNS))
            if sum(map(len, held)) > 1 << 20:
                held = [_by_document(pa.concat_tables(held))]
        if held:
            yield from _by_document(pa.concat_tables(held)).to_batches(max_chunksize=1 << 16)

    keyed = texts.select("doc_id", F.xxhash64("text").alias("key"), "text")
    counts = keyed.mapInArrow(frequencies, _ENTRY).repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(counted, _SUMS)
    by_document = counts.repartition(partitions, "bucket").mapInArrow(summed, ", ".join(f"{c} long" for c in _SUM_COLUMNS))
    each = by_document.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    n_tokens = F.expr("tokens div copies")
    return each.select(F.col("doc_id").alias(id_col), "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit"))


_SUM_COLUMNS = ["doc_id", "key", "copies", "n_bytes", "tokens"]
_SUMS = "bucket int, " + ", ".join(f"{c} array<long>" for c in _SUM_COLUMNS)


def _by_document(rows: pa.Table) -> pa.Table:
    """One row for each (doc_id, key): copies and tokens added up."""
    sums = rows.group_by(["doc_id", "key"]).aggregate([("copies", "sum"), ("n_bytes", "max"), ("tokens", "sum")])
    return sums.select(["doc_id", "key", "copies_sum", "n_bytes_max", "tokens_sum"]).rename_columns(_SUM_COLUMNS)


def _of_bucket(known: dict[bytes, int], bucket: int, buckets: int) -> dict[bytes, int]:
    names = list(known)
    own = np.flatnonzero(_pretoken_hashes(names) % np.uint64(buckets) == bucket) if names else []
    return {names[i]: known[names[i]] for i in own}


def _pretoken_hashes(pretokens: list[bytes]) -> np.ndarray:
    """A hash of each pre-token that is the same in all tasks."""
    sizes = np.array([len(p) for p in pretokens], dtype=np.int64)
    ends = np.cumsum(sizes)
    return word_hashes(np.frombuffer(b"".join(pretokens), dtype=np.uint8), ends - sizes, ends)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_vocabulary())


QUERIES = {"op3_token_counts": op3_token_counts}
ORACLES: dict[str, str] = {}
