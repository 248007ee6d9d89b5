r"""Operator 2: substring dedup with a count-min prefilter.

Words are ``[^\x20\x09-\x0D]+``; a window is WINDOW consecutive words of one document.  A word goes if a window that covers
it also starts, word for word, in a document with a smaller doc_id.

1. Prefilter.  A window's key is the smallest hash of the KEY_WORDS-word runs inside it, so equal windows have equal keys, and
   neighbouring windows mostly share one: a document has about one key for 20 windows.  Each task sketches the keys of its
   documents; the merged sketch overestimates how many documents hold a window's key, hence how many hold the window.
2. Grouping.  Only windows whose key is estimated in two documents or more are grouped, by two 64-bit hashes of their words that
   share nothing: windows that agree in both are taken for equal.  Documents lie in blocks, repeated rows spread over all; a block sends each such window once, with its smallest doc_id, in one row for each hash bucket, and gets
   back the windows that a smaller doc_id elsewhere holds.  So a window that a third of all documents share sends one entry for
   each block, and the grouping of a bucket is a sort of bounded size.
3. Each block joins what came back with its own windows and cuts the covered words.

The documents are shuffled once, by block.  The sketch's size is bounded (count_min); beyond that size more windows are grouped,
and none is lost.

Defined cases: a null text has no words; a row with a null doc_id loses nothing and causes no loss; rows that share a doc_id are
judged one by one and don't count against each other; an empty table gives no rows; input columns are kept, whatever their
names (those named like an added one are replaced).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from nearfield.llm import count_min
from nearfield.llm.rows import all_columns, numbered
from nearfield.llm.shared_store import small_batches
from nearfield.llm.text_kernels import release, slices, text_bytes, window_hashes, word_hashes, word_spans

WINDOW, KEY_WORDS, DEPTH, BLOCK_BYTES = 50, 9, 2, 8 << 20

_NO_DOC = np.iinfo(np.int64).max


def window_keys(hashes: np.ndarray) -> np.ndarray:
    """The key of the window that starts at each word."""
    least, size, width = window_hashes(hashes, KEY_WORDS, seed=7), 1, WINDOW - KEY_WORDS + 1
    if len(hashes) < WINDOW:
        return np.zeros(0, np.uint64)
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    rest = width - size
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


class _Windows:
    """Words of some texts and those of their windows that lie in one text whose doc_id isn't null."""

    def __init__(self, part: pa.RecordBatch, text: int, doc: int):
        self.data, self.offsets = text_bytes(part.column(text))
        self.starts, self.ends, self.ranges = word_spans(self.data, self.offsets)
        self.hashes = word_hashes(self.data, self.starts, self.ends)
        self.other_hashes = None
        self.keys = window_keys(self.hashes)
        ids = part.column(doc)
        sizes = np.diff(self.ranges)
        usable = np.where(ids.is_valid().to_numpy(zero_copy_only=False), np.maximum(sizes - WINDOW + 1, 0), 0)
        self.row = np.repeat(np.arange(len(sizes)), usable)
        ends = np.cumsum(usable)
        self.at = np.arange(len(self.row)) + np.repeat(self.ranges[:-1] - (ends - usable), usable)
        self.docs = ids.fill_null(0).to_numpy().astype(np.int64)

    def suspects(self, sketch: count_min.Sketch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash, hash, doc_id, first word) of the windows whose key is estimated in two documents or more."""
        keys = self.keys[self.at]
        new = np.flatnonzero(np.diff(keys, prepend=keys[:1] ^ np.uint64(1)) != 0) if len(keys) else np.zeros(0, np.int64)
        run = np.diff(np.append(new, len(keys)))
        kept = np.repeat(sketch.at_least(keys[new], 2), run)
        at = self.at[kept]
        if not len(at):
            empty = np.zeros(0, np.uint64)
            return empty, empty, np.zeros(0, np.int64), at
        if self.other_hashes is None:
            self.other_hashes = word_hashes(self.data, self.starts, self.ends, seed=1)
        return window_hashes(self.hashes, WINDOW, 1)[at], window_hashes(self.other_hashes, WINDOW, 2)[at], self.docs[self.row[kept]], at


def _smallest(h1: np.ndarray, h2: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries ordered by window, the first of each window, and each ordered entry's smallest doc_id of its window."""
    order = np.lexsort((docs, h2, h1))
    h1, h2 = h1[order], h2[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    first = np.flatnonzero(new)
    return order, first, np.repeat(docs[order][first], np.diff(np.append(first, len(order))))


_ENTRIES = "bucket int, __block int, h1 binary, h2 binary, docs binary"


def _entry_rows(names: list[str], cut: np.ndarray, other: int, h1: np.ndarray, h2: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
    """One row for each value of cut, with its entries as little-endian arrays."""
    order = np.argsort(cut, kind="stable")
    values, starts = np.unique(cut[order], return_index=True)
    parts = [[p.tobytes() for p in np.split(x[order], starts[1:])] if len(values) else [] for x in (h1, h2, docs)]
    arrays = [pa.array(values.astype(np.int32)), pa.array([other] * len(values), pa.int32()), *(pa.array(p, pa.binary()) for p in parts)]
    return pa.RecordBatch.from_arrays(arrays, names=names)


def _entries(table: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(table.column(c).to_pylist()), dtype=d) for c, d in (("h1", np.uint64), ("h2", np.uint64), ("docs", np.int64))]


def key_sketch(documents: DataFrame, text_bytes_total: int) -> count_min.Sketch:
    """The merged sketch of the window keys of (doc_id, text), each counted once for each document."""
    width = count_min.width_for(text_bytes_total / 100)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for part in slices(batch, "text"):
                own = _Windows(part, 1, 0)
                keys = own.keys[own.at]
                new = np.ones(len(keys), dtype=bool)
                new[1:] = (keys[1:] != keys[:-1]) | (own.row[1:] != own.row[:-1])
                keys, row = keys[new], own.row[new]
                order = np.lexsort((row, keys))
                keys, row = keys[order], row[order]
                new = np.ones(len(keys), dtype=bool)
                new[1:] = (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])
                held.append(keys[new])
            if sum(map(len, held)) > 1 << 21:
                yield from count_min.partial_rows(np.concatenate(held), width, DEPTH, 2)
                held = []
        if held:
            yield from count_min.partial_rows(np.concatenate(held), width, DEPTH, 2)

    return count_min.merged(documents.mapInArrow(sketch, count_min.PARTIAL), width, DEPTH, (2,))


def _kept(own: _Windows, gone: np.ndarray) -> pa.Array:
    """Each text's words that aren't gone, joined by one space."""
    kept = ~gone
    count = np.concatenate([[0], np.cumsum(kept)])[own.ranges]
    last = np.zeros(len(kept), dtype=bool)
    places = np.flatnonzero(kept)
    ends = count[1:][np.diff(count) > 0]
    last[places[ends - 1]] = True
    mark = np.zeros(len(own.data) + 2, dtype=np.int8)
    mark[own.starts[kept]] += 1
    mark[own.ends[kept] + ~last[kept]] -= 1
    out = np.where(np.cumsum(mark[:-2], dtype=np.int8).astype(bool), 1, 0).astype(bool)
    text = own.data.copy()
    text[own.ends[kept & ~last]] = 0x20
    bytes_before = np.concatenate([[0], np.cumsum(np.where(kept, own.ends - own.starts, 0))])[own.ranges]
    sizes = np.diff(bytes_before) + np.maximum(np.diff(count) - 1, 0)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(text[out]))


def substring_dedup(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with n_words, n_removed and kept_text (the words left, joined by one space)."""
    spark = small_batches(documents.sparkSession)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = documents.select(all_columns(documents, ("n_words", "n_removed", "kept_text")))
    doc_at, text_at = kept.columns.index(id_col), kept.columns.index(text_col)
    rows = numbered(kept)
    doc_name, text_name = rows.columns[doc_at], rows.columns[text_at]
    texts = rows.select(F.col(doc_name).cast("long").alias("doc_id"), F.col(text_name).cast("string").alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(partitions, 1 + total // BLOCK_BYTES)
    buckets = 2 * blocks
    sketch = spark.sparkContext.broadcast(key_sketch(texts, total))
    blocked = rows.withColumn("__block", F.pmod(F.xxhash64(doc_name, text_name, F.monotonically_increasing_id()), F.lit(blocks)).cast("int")).repartition(blocks, "__block")
    block_at = len(rows.columns)

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = batch.column(block_at).to_numpy()
            for block in np.unique(of):
                own = batch.filter(pa.array(of == block))
                for part in slices(own, text_name):
                    h1, h2, docs, _ = _Windows(part, text_at, doc_at).suspects(sketch.value)
                    order, first, _ = _smallest(h1, h2, docs)
                    once = order[first]
                    h1, h2, docs = h1[once], h2[once], docs[once]
                    yield _entry_rows(["bucket", "__block", "h1", "h2", "docs"], (h1 % np.uint64(buckets)).astype(np.int64), int(block), h1, h2, docs)

    def answers(table: pa.Table) -> pa.Table:
        release(table.nbytes)
        h1, h2, docs = _entries(table)
        counts = np.array([len(x) // 8 for x in table.column("docs").to_pylist()])
        block = np.repeat(table.column("__block").to_numpy(), counts)
        order, _, least = _smallest(h1, h2, docs)
        other = least < docs[order]
        at = order[other]
        return pa.Table.from_batches([_entry_rows(["__block", "bucket", "h1", "h2", "docs"], block[at], 0, h1[at], h2[at], least[other])])

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        release(left.nbytes + right.nbytes)
        held, found = [], []
        for batch in left.combine_chunks().to_batches():
            for part in slices(batch, text_name):
                own = _Windows(part, text_at, doc_at)
                held.append((part, own.ranges, len(own.starts)))
                found.append(own.suspects(sketch.value))
        if not held:
            return to_arrow_schema(schema).empty_table()
        came = _entries(right)
        h1, h2, docs = (np.concatenate([*(x[i] for x in found), came[i]]) for i in range(3))
        order, _, least = _smallest(h1, h2, docs)
        covered = np.zeros(len(order), dtype=bool)
        covered[order] = least < docs[order]
        out, at = [], 0
        for (part, _, n), own_found in zip(held, found):
            own = _Windows(part, text_at, doc_at)
            firsts = own_found[3][covered[at : at + len(own_found[3])]]
            at += len(own_found[3])
            edge = np.zeros(n + WINDOW + 1, dtype=np.int32)
            edge[firsts] += 1
            edge[firsts + WINDOW] -= 1
            gone = np.cumsum(edge)[:n] > 0
            removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[own.ranges])
            columns = [c for i, c in enumerate(part.columns) if i != block_at]
            arrays = [*columns, pa.array(np.diff(own.ranges).astype(np.int64)), pa.array(removed.astype(np.int64)), _kept(own, gone)]
            out.append(pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema]))
        return pa.Table.from_batches(out)

    schema = T.StructType([*rows.schema, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])
    returned = blocked.mapInArrow(suspects, _ENTRIES).groupBy("bucket").applyInArrow(answers, "__block int, bucket int, h1 binary, h2 binary, docs binary")
    out = blocked.groupBy("__block").cogroup(returned.groupBy("__block")).applyInArrow(cut, schema)
    return out.toDF(*kept.columns, "n_words", "n_removed", "kept_text")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return substring_dedup(documents).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT doc_id, len(w) AS n, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50),
h AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS h FROM s),
m AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY h) AS first FROM h),
g AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(p, p + 50)) AS p FROM m WHERE first < doc_id) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE
           list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""

QUERIES = {"op2_substring_dedup": op2_substring_dedup}
ORACLES = {"op2_substring_dedup": ORACLE}
