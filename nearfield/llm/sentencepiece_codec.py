"""Operator 1: SentencePiece encoding and decoding for merge-type vocabularies.

Encoding uses a score-ordered agenda of adjacent symbol pairs (merge_vocabulary.MergeVocabulary.encode),
run once for each distinct pre-token that a worker meets.  Each Arrow batch's newly met pre-tokens are
encoded by the sentencepiece library too; a difference fails the task rather than passing wrong ids on.
Nothing is shuffled: documents stay where the scan puts them, and memory holds one slice of texts and a
bounded store of encoded pre-tokens.

Defined cases: a null or empty text has the end id alone and decodes to an empty text; rows with a null
or a repeated doc_id are encoded like any other, one result row for each; an empty table gives no rows;
input columns other than the named ones are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.merge_vocabulary import Generations, MergeVocabulary, vocabulary
from nearfield.llm.shared_store import small_batches
from nearfield.llm.text_kernels import ragged_positions, slices

#: Encoded pre-tokens that a worker keeps (twice as many at most, and none of more than 64 bytes).
STORE_SIZE = 150_000

_STORES: dict[str, tuple[Generations, object]] = {}


def _store(path: str) -> tuple[Generations, object]:
    if path not in _STORES:
        _STORES[path] = Generations(STORE_SIZE), vocabulary(path).library(dummy_prefix=False)
    return _STORES[path]


def _distinct_ids(vocab: MergeVocabulary, path: str, pretokens: list[bytes]) -> list[np.ndarray]:
    """Ids of each pre-token, from the store or by the agenda and then checked against the library."""
    store, library = _store(path)
    found = [store.get(p) for p in pretokens]
    new = [i for i, x in enumerate(found) if x is None]
    texts = [pretokens[i].decode() for i in new]
    for i, text, expected in zip(new, texts, library.encode(texts, num_threads=1)):
        ids = vocab.encode(text)
        if ids != expected:
            raise AssertionError(f"agenda and library differ on {text!r}: {ids} and {expected}")
        found[i] = np.array(ids, dtype=np.int32)
        store.put(pretokens[i], found[i])
    return found


def encode_column(column: pa.Array, path: str, add_end: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the column's texts in one array, and the len + 1 offsets of the texts in it."""
    vocab = vocabulary(path)
    tokens, ranges, _ = vocab.pretokens(column)
    coded = pc.dictionary_encode(tokens)
    table = _distinct_ids(vocab, path, coded.dictionary.to_pylist())
    table.append(np.array([vocab.end_id], dtype=np.int32))
    lengths = np.array([len(x) for x in table], dtype=np.int64)
    order = coded.indices.to_numpy().astype(np.int64)
    if add_end:
        order = np.insert(order, ranges[1:], len(table) - 1)
        ranges = ranges + np.arange(len(ranges))
    counts = lengths[order]
    offsets = np.concatenate([[0], np.cumsum(counts)])[ranges]
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    return np.concatenate(table)[ragged_positions(starts[order], counts)], offsets


def sentencepiece_encode(documents: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>): the ids of each text with the end id last."""
    small_batches(documents.sparkSession)
    schema = f"{id_col} {documents.schema[id_col].dataType.simpleString()}, ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                ids, offsets = encode_column(part.column(1), path)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=[id_col, "ids"])

    return documents.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def sentencepiece_decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text): what the library's decode gives for each list of ids; null ids give an empty text."""
    schema = f"{id_col} {encoded.schema[id_col].dataType.simpleString()}, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = vocabulary(path).library(dummy_prefix=True)
        for batch in batches:
            texts = [library.decode(x.as_py() or []) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return encoded.select(id_col, F.col(ids_col).alias("ids")).mapInArrow(run, schema)


def sentencepiece_digests(documents: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), and the ids if asked for: encodes and decodes each text in one pass over it."""
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 5 if with_ids else 4]
    small_batches(documents.sparkSession)
    schema = f"{id_col} {documents.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        library = vocab.library(dummy_prefix=True)
        digits = [str(i).encode() for i in range(len(vocab.model.pieces))]
        for batch in batches:
            for part in slices(batch, "text"):
                ids, offsets = encode_column(part.column(1), path)
                id_sums, text_sums = [], []
                for start, stop in zip(offsets[:-1], offsets[1:]):
                    own = ids[start:stop].tolist()
                    id_sums.append(hashlib.sha256(b" ".join([digits[i] for i in own])).hexdigest())
                    text_sums.append(hashlib.sha256(library.decode(own).encode()).hexdigest())
                arrays = [part.column(0), pa.array(np.diff(offsets), pa.int64()), pa.array(id_sums, pa.string()), pa.array(text_sums, pa.string())]
                if with_ids:
                    arrays.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return documents.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_vocabulary())


QUERIES = {"op1_sentencepiece": op1_sentencepiece}
ORACLES: dict[str, str] = {}
