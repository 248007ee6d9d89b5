import hashlib
import random
import zlib
from collections import Counter

import public_tokenizers
import pytest
from tests.llm.corpora import odd_documents
from tokenizers import Tokenizer

from nearfield.llm.merge_vocabulary import vocabulary
from nearfield.llm.sentencepiece_codec import sentencepiece_decode, sentencepiece_digests, sentencepiece_encode
from nearfield.llm.shared_store import new_path
from nearfield.llm.token_counts import token_counts
from nearfield.llm.token_files import read_token_files, write_token_files

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def more():
    chance = random.Random(3)
    alphabet = ["the", "tion", "ing", " ", "  ", "\n", ".", ",", "é", "ß", "9", "'s", "*", " ", "日", "x" * 9]
    return ["".join(chance.choice(alphabet) for _ in range(chance.randint(1, 300))) for _ in range(150)]


def test_agenda_equals_library(more):
    vocab = vocabulary(PIECES)
    library = vocab.library(dummy_prefix=False)
    for text in more:
        assert vocab.encode(text) == library.encode(text)


def test_encoding_and_decoding(spark, more):
    documents = odd_documents(spark, more)
    library = vocabulary(PIECES).library(dummy_prefix=True)
    expected = Counter()
    for row in documents.collect():
        ids = library.encode(row.text or "", add_eos=True)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        expected[row.doc_id, len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids))] += 1
    assert Counter(tuple(r) for r in sentencepiece_digests(documents, PIECES).collect()) == expected
    encoded = sentencepiece_encode(documents, PIECES)
    assert Counter(tuple(r.ids) for r in encoded.collect()) == Counter(tuple(library.encode(r.text or "", add_eos=True)) for r in documents.collect())
    back = {r.doc_id: r.text for r in sentencepiece_decode(encoded, PIECES).collect()}
    assert all(back[r.doc_id] == (r.text or "").replace("▁", " ") for r in documents.collect())


def test_token_counts(spark, more):
    documents = odd_documents(spark, more)
    library = vocabulary(PIECES).library(dummy_prefix=True)
    expected = Counter((r.doc_id, len((r.text or "").encode()), len(n := library.encode(r.text or "")), len(n) > 40) for r in documents.collect())
    assert Counter(tuple(r) for r in token_counts(documents, PIECES, limit=40).collect()) == expected


def test_token_counts_without_common_pretokens(spark, more, monkeypatch):
    """The shuffled side of the join alone gives the same counts."""
    import nearfield.llm.token_counts as module

    documents = odd_documents(spark, more)
    usual = Counter(tuple(r) for r in token_counts(documents, PIECES).collect())
    monkeypatch.setattr(module, "common_pretokens", lambda *_: {})
    assert Counter(tuple(r) for r in token_counts(documents, PIECES).collect()) == usual


@pytest.mark.parametrize("length", [8, 2048])
def test_token_files(spark, more, length):
    documents = odd_documents(spark, more)
    library = Tokenizer.from_file(BYTES)
    expected, start = [], 0
    for row in sorted(documents.collect(), key=lambda r: (-1 if r.doc_id is None else r.doc_id)):
        ids = [*library.encode(row.text or "", add_special_tokens=False).ids, 0]
        crc = zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
        expected.append((row.doc_id, start, len(ids), crc))
        start += len(ids)
    manifest = write_token_files(documents, BYTES, new_path(spark, "tokens"), length=length)
    assert Counter(tuple(r) for r in read_token_files(manifest).collect()) == Counter(expected)


def test_files_give_random_access(spark):
    """A mapped file's sequences are views of the file, of equal length, with the padding masked."""
    import pyarrow as pa

    documents = spark.createDataFrame([(i, f"text number {i}") for i in range(50)], "doc_id long, text string")
    for row in write_token_files(documents, BYTES, new_path(spark, "tokens"), length=16).collect():
        before = pa.total_allocated_bytes()
        batches = list(pa.ipc.open_stream(pa.memory_map(row.tokens_file.removeprefix("file:"))))
        assert pa.total_allocated_bytes() - before < 1000
        assert all(len(b["ids"][i]) == 16 for b in batches for i in range(b.num_rows))
        assert sum(sum(m.as_py()) for b in batches for m in b["mask"]) == row.n_tokens


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert sentencepiece_digests(none, PIECES).count() == 0
    assert token_counts(none, PIECES).count() == 0
    assert read_token_files(write_token_files(none, BYTES, new_path(spark, "tokens"))).count() == 0
