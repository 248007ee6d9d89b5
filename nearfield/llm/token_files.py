"""Operator 5: token ids in Arrow stream files of fixed-size lists.

Layout of one file pair, written by one task for one range of documents:

* ``tokens-<part>-<attempt>.arrows``: an Arrow stream of record batches with the columns ``ids``
  (fixed_size_list<uint16 or uint32>[length]) and ``mask`` (fixed_size_list<bool>[length]).  Documents follow
  each other without gaps, each closed by the end id; only the last sequence of a file is padded, with id 0 and
  mask false.  Batches aren't compressed, so a reader maps the file and takes sequence i of a batch without
  copying.
* ``documents-<part>-<attempt>.arrows``: doc_id and n_tokens of the file's documents in their order.

Documents are range-partitioned by doc_id, so files in part order hold all documents in ascending doc_id order.
A manifest table (one row for each file pair) names the files of the attempts that succeeded, so a retried or
lost task leaves at most an unnamed file behind.

Encoding uses the tokenizers library; a worker asks it once for each distinct run of white space and letters
that it meets, which gives the library's ids because its pattern never joins text across those cuts.  Texts that
hold a special string or white space outside ASCII go to the library whole, and so do all texts if the vocabulary normalises texts
or splits them by another pattern than the plain byte-level one.

Defined cases: a null or empty text is the end id alone; rows with a null doc_id come first; rows that share a
doc_id follow each other in the order of a hash of their texts, one result row for each; an empty table gives no file and no rows;
other columns are ignored.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearfield.llm.merge_vocabulary import Generations
from nearfield.llm.shared_store import new_path, small_batches, written
from nearfield.llm.text_kernels import ragged_positions, slices, text_bytes

SEQUENCE_LENGTH, SEQUENCES_PER_BATCH = 2048, 256
#: Runs whose ids a worker keeps (twice as many at most), and bytes of text that it encodes at a time.
STORE_SIZE, ENCODE_BYTES, TASK_BYTES = 450_000, 8 << 20, 64 << 20

_ASCII_SPACE = np.zeros(256, dtype=bool)
_ASCII_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
#: White space outside ASCII's plain six, where the cuts below would not be certain.
_OTHER_SPACE = r"[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


class _Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.store = Generations(STORE_SIZE)
        form = json.loads(self.library.to_str())
        splitter = form.get("pre_tokenizer") or {}
        # the cuts are certain for the plain byte-level pattern alone; texts go to the library whole with any other
        self.cuts = form.get("normalizer") is None and splitter.get("type") == "ByteLevel" and splitter.get("use_regex", True) and not splitter.get("add_prefix_space")
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.dtype = np.uint16 if self.library.get_vocab_size() <= 1 << 16 else np.uint32

    def _library_ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, dtype=self.dtype) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _stored_ids(self, runs: list[bytes]) -> list[np.ndarray]:
        found = [self.store.get(r) for r in runs]
        new = [i for i, x in enumerate(found) if x is None]
        for i, ids in zip(new, self._library_ids([runs[i].decode() for i in new])):
            found[i] = ids
            self.store.put(runs[i], ids)
        return found

    def encode(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text closed by end_id, and the len + 1 offsets of the texts among them."""
        column = pc.fill_null(column, "")
        whole = pc.match_substring_regex(column, _OTHER_SPACE)
        for special in self.special:
            whole = pc.or_(whole, pc.match_substring(column, special))
        whole = np.asarray(whole.to_numpy(zero_copy_only=False), dtype=bool) | (not self.cuts)
        data, offsets = text_bytes(pc.if_else(pa.array(~whole), column, ""))
        table, order = [], np.zeros(0, np.int64)
        ranges = np.zeros(len(offsets), np.int64)
        if len(data):
            cut = np.empty(len(data), dtype=bool)
            space = _ASCII_SPACE[data]
            cut[0] = True
            cut[1:] = (space[1:] & ~space[:-1]) | (_MARK[data[1:]] & _LETTER[data[:-1]])
            cut[offsets[:-1][offsets[:-1] < len(data)]] = True
            starts = np.flatnonzero(cut)
            bounds = np.append(starts, len(data)).astype(np.int64)
            runs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
            coded = pc.dictionary_encode(runs)
            table = self._stored_ids(coded.dictionary.to_pylist())
            order = coded.indices.to_numpy().astype(np.int64)
            ranges = np.searchsorted(starts, offsets)
        # texts that went to the library whole come in as one run each
        at = np.flatnonzero(whole)
        if len(at):
            order = np.insert(order, ranges[at], len(table) + np.arange(len(at)))
            table += self._library_ids([column[int(i)].as_py() for i in at])
            ranges = ranges + np.concatenate([[0], np.cumsum(whole)])
        order = np.insert(order, ranges[1:], len(table))
        ranges = ranges + np.arange(len(ranges))
        table.append(np.array([end_id], dtype=self.dtype))
        lengths = np.array([len(x) for x in table], dtype=np.int64)
        counts = lengths[order]
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        return np.concatenate(table)[ragged_positions(starts[order], counts)], np.concatenate([[0], np.cumsum(counts)])[ranges]


_ENCODERS: dict[str, _Encoder] = {}


def _encoder(path: str) -> _Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = _Encoder(path)
    return _ENCODERS[path]


def _lists(values: np.ndarray, length: int) -> pa.FixedSizeListArray:
    return pa.FixedSizeListArray.from_arrays(pa.array(values), length)


def write_token_files(documents: DataFrame, path: str, folder: str, end_id: int = 0, length: int = SEQUENCE_LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files into folder; returns the manifest (part, tokens_file, documents_file, n_documents, n_tokens)."""
    total = documents.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    partitions = max(int(small_batches(documents.sparkSession).conf.get("spark.sql.shuffle.partitions")), 1 + total // TASK_BYTES)
    filesystem, _ = fs.FileSystem.from_uri(folder)
    filesystem.create_dir(fs.FileSystem.from_uri(folder)[1])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, attempt = _encoder(path), TaskContext.get().partitionId(), uuid.uuid4().hex[:8]
        names = [f"{folder}/{kind}-{part:06d}-{attempt}.arrows" for kind in ("tokens", "documents")]
        value = pa.from_numpy_dtype(encoder.dtype)
        schemas = [
            pa.schema([("ids", pa.list_(value, length)), ("mask", pa.list_(pa.bool_(), length))], metadata={"end_id": str(end_id)}),
            pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())]),
        ]
        left, n_documents, n_tokens, writers = np.zeros(0, encoder.dtype), 0, 0, []
        full = length * SEQUENCES_PER_BATCH
        for batch in batches:
            for some in slices(batch, "text", ENCODE_BYTES):
                if not writers:
                    files = [f.open_output_stream(p) for f, p in map(fs.FileSystem.from_uri, names)]
                    writers = [pa.ipc.new_stream(f, s) for f, s in zip(files, schemas)]
                ids, offsets = encoder.encode(some.column(1), end_id)
                writers[1].write_batch(pa.RecordBatch.from_arrays([some.column(0), pa.array(np.diff(offsets))], schema=schemas[1]))
                n_documents, n_tokens = n_documents + len(some), n_tokens + len(ids)
                left = np.concatenate([left, ids])
                while len(left) >= full:
                    writers[0].write_batch(pa.RecordBatch.from_arrays([_lists(left[:full], length), _lists(np.ones(full, bool), length)], schema=schemas[0]))
                    left = left[full:]
        if writers:
            if len(left):
                padding = -len(left) % length
                mask = np.arange(len(left) + padding) < len(left)
                writers[0].write_batch(pa.RecordBatch.from_arrays([_lists(np.concatenate([left, np.zeros(padding, left.dtype)]), length), _lists(mask, length)], schema=schemas[0]))
            for x in [*writers, *files]:
                x.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "tokens_file": names[:1], "documents_file": names[1:], "n_documents": [n_documents], "n_tokens": [n_tokens]})

    texts = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # rows that share a doc_id, or have none, are dealt by their texts too
    ranged = texts.withColumn("key", F.xxhash64("text")).repartitionByRange(partitions, "doc_id", "key").sortWithinPartitions("doc_id", "key", "text").drop("key")
    manifest = ranged.mapInArrow(write, "part int, tokens_file string, documents_file string, n_documents long, n_tokens long")
    return written(manifest, "token-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files, start counted over all files in part order."""
    partitions = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # one row for each file pair: their running total is a small single-partition window
    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.withColumn("base", F.coalesce(before, F.lit(0).cast("long"))).repartition(partitions, "part")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                (at, tokens), (also, listed) = map(fs.FileSystem.from_uri, (row["tokens_file"], row["documents_file"]))
                with at.open_input_file(tokens) as ids_file, also.open_input_file(listed) as documents_file:
                    sequences, start, ids = pa.ipc.open_stream(ids_file), row["base"], np.zeros(0, np.uint16)
                    for some in pa.ipc.open_stream(documents_file):
                        counts = some.column(1).to_numpy()
                        pieces, have = [ids], len(ids)
                        while have < counts.sum():
                            chunk = sequences.read_next_batch()
                            values = chunk.column(0).flatten().to_numpy()
                            used = int(np.count_nonzero(chunk.column(1).flatten().to_numpy(zero_copy_only=False)))
                            pieces.append(values[:used])
                            have += used
                        ids = np.concatenate(pieces) if len(pieces) > 1 else ids
                        ends = np.cumsum(counts)
                        wide = ids[: ends[-1]].astype("<u4") if len(ends) else ids
                        sums = [zlib.crc32(wide[a:b]) for a, b in zip(ends - counts, ends)]
                        yield pa.RecordBatch.from_arrays([some.column(0), pa.array(start + ends - counts), some.column(1), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                        start, ids = start + int(ends[-1]), ids[ends[-1] :]

    return files.select("tokens_file", "documents_file", "base").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_token_files(write_token_files(documents, public_tokenizers.path("byte_bpe_50k.json"), new_path(spark, "tokens")))


QUERIES = {"op5_token_files": op5_token_files}
ORACLES: dict[str, str] = {}
