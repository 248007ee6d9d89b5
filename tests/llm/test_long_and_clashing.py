"""Texts beyond the size that the kernels take at a time, rows that share a doc_id, and input columns named like added ones."""

import hashlib
import random
import zlib
from collections import Counter

import public_tokenizers
import pytest

from nearfield.llm.merge_vocabulary import vocabulary
from nearfield.llm.seed_decontamination import benchmark_matches
from nearfield.llm.sentencepiece_codec import default_vocabulary, sentencepiece_digests
from nearfield.llm.shared_store import new_path
from nearfield.llm.shuffle_shards import write_shards
from nearfield.llm.substring_dedup import substring_dedup
from nearfield.llm.text_kernels import SLICE_BYTES
from nearfield.llm.token_counts import token_counts
from nearfield.llm.token_files import read_token_files, write_token_files
from nearfield.llm.toxicity import Model, fit, toxicity_scores

ADDED = {"n_words": 1, "N_removed": 2, "kept_text": 3, "size": 4, "Shard": 5, "slot": 6, "n_tokens": 7, "score": 8, "predicted": 9, "held_out": 10, "k0": 11, "words": 12, "at": 13, "key": 14, "bucket": 15, "cell": 16, "x": 17, "__row": 18, "ids": 19}


@pytest.fixture(scope="module")
def rows():
    chance = random.Random(12)
    word = lambda: "".join(chance.choices("abcdefghijklmnop", k=chance.randint(2, 9)))
    long = " ".join(word() for _ in range(800_000))
    assert len(long) > SLICE_BYTES
    part = " ".join(long.split()[400_000:400_080])
    short = " ".join(word() for _ in range(90))
    return [(1, long), (2, f"{short} {part} end"), (2, "another text of the same id"), (2, "another text of the same id"), (3, part), (3, short), (None, short), (4, None)]


@pytest.fixture(scope="module")
def documents(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    return frame.selectExpr("*", *(f"{v} AS `{k}`" for k, v in ADDED.items()), "'d' AS `a.b`").cache()


def test_encoding(rows, documents):
    library = vocabulary(default_vocabulary()).library(dummy_prefix=True)
    want = Counter((i, len(ids := library.encode(t or "", add_eos=True)), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()) for i, t in rows)
    got = sentencepiece_digests(documents, default_vocabulary()).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in got) == want


def test_token_counts(rows, documents):
    library = vocabulary(default_vocabulary()).library(dummy_prefix=True)
    want = Counter((i, len((t or "").encode()), len(library.encode(t or ""))) for i, t in rows)
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts(documents, default_vocabulary()).collect()) == want


def test_token_files(spark, rows, documents):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    ids = [(i, [*library.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in rows]
    want = Counter((i, len(x), zlib.crc32(b"".join(v.to_bytes(4, "little") for v in x))) for i, x in ids)
    got = sorted(read_token_files(write_token_files(documents, path, new_path(spark, "tokens"))).collect(), key=lambda r: r.start)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:n]) for n in range(len(got))]
    known = [r.doc_id for r in got if r.doc_id is not None]
    assert known == sorted(known)


def test_unfit_tokenizer_is_asked_for_whole_texts(spark, tmp_path):
    """One whose pattern joins text across the cuts."""
    from tokenizers import Tokenizer, normalizers

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.normalizer = normalizers.Replace(" ", "")
    library.save(str(tmp_path / "joined.json"))
    texts = [(1, "two words joined"), (2, "it's (a.b) c"), (3, "")]
    manifest = write_token_files(spark.createDataFrame(texts, "doc_id long, text string"), str(tmp_path / "joined.json"), new_path(spark, "tokens"))
    got = {r.doc_id: r.n_tokens for r in read_token_files(manifest).collect()}
    assert got == {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts}


def test_substring_dedup(rows, documents):
    out = substring_dedup(documents)
    assert out.columns == [c for c in documents.columns if c not in ("n_words", "N_removed", "kept_text")] + ["n_words", "n_removed", "kept_text"]
    got = out.collect()
    count = lambda i, t: [(r.n_words, r.n_removed) for r in got if r.doc_id == i and r.text == t]
    assert count(1, rows[0][1]) == [(800_000, 0)] and count(2, rows[1][1]) == [(171, 80)]
    assert count(3, rows[4][1]) == [(80, 80)] and count(3, rows[5][1]) == [(90, 90)] and count(None, rows[6][1]) == [(90, 0)]
    assert {(r["a.b"], r["at"], r["size"]) for r in got} == {("d", 13, 4)}


def test_shards(spark, rows, documents):
    out = write_shards(documents, new_path(spark, "shards"))
    assert {"size", "shard", "slot", "text_crc32", "a.b"} <= set(out.columns) and "Shard" not in out.columns
    got = out.collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert {r["a.b"] for r in got} == {"d"}


def test_toxicity(spark, documents):
    scored = toxicity_scores(documents, fit(documents, spark.createDataFrame([(1, 1), (2, 0), (4, 1)], "doc_id long, toxic int"))).collect()
    assert len(scored) == 8 and all(0 <= r.score <= 1 for r in scored)
    assert {r.score for r in toxicity_scores(documents, Model()).collect()} == {0.5}


def test_decontamination(spark, rows, documents):
    words = rows[0][1].split()
    items = spark.createDataFrame([(7, " ".join(words[790_000:790_030]), 1), (8, "another text", 2)], "item_id long, text string, words int")
    assert {tuple(r) for r in benchmark_matches(documents, items).collect()} == {(1, 7), (2, 8)}
