import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from tests.llm.corpora import odd_documents

from nearfield.llm import count_min, text_kernels
from nearfield.llm.substring_dedup import WINDOW, substring_dedup, window_keys


def brute_force(rows):
    words = [re.findall(r"[^\x20\x09-\x0D]+", r.text or "") for r in rows]
    first = defaultdict(lambda: None)
    for row, own in zip(rows, words):
        for i in range(len(own) - WINDOW + 1) if row.doc_id is not None else ():
            w = tuple(own[i : i + WINDOW])
            first[w] = row.doc_id if first[w] is None else min(first[w], row.doc_id)
    out = Counter()
    for row, own in zip(rows, words):
        gone = set()
        for i in range(len(own) - WINDOW + 1) if row.doc_id is not None else ():
            if first[tuple(own[i : i + WINDOW])] < row.doc_id:
                gone.update(range(i, i + WINDOW))
        out[row.doc_id, len(own), len(gone), " ".join(w for i, w in enumerate(own) if i not in gone)] += 1
    return out


@pytest.fixture(scope="module")
def texts():
    chance = random.Random(2)
    word = lambda: chance.choice(["the", "é", "of"]) if chance.random() < 0.4 else "".join(chance.choices("abcdefgh", k=3))
    passages = [[word() for _ in range(n)] for n in (49, 50, 51, 70, 200)]
    out = []
    for _ in range(160):
        own = [word() for _ in range(chance.randint(0, 150))]
        for _ in range(chance.randint(0, 2)):
            at = chance.randint(0, len(own))
            own[at:at] = chance.choice(passages)
        out.append(chance.choice([" ", "\n", " \t "]).join(own))
    return [*out, *out[:20], "same " * 120, "same " * 60]


def test_equals_brute_force(spark, texts):
    documents = odd_documents(spark, texts)
    got = substring_dedup(documents)
    assert got.columns == [*documents.columns, "n_words", "n_removed", "kept_text"]
    want = brute_force(documents.collect())
    assert Counter(tuple(r) for r in got.select("doc_id", "n_words", "n_removed", "kept_text").collect()) == want
    assert sum(k[2] > 0 for k in want) > 60


def test_full_sketch_loses_nothing(spark, texts, monkeypatch):
    """With far too few cells everything is estimated repeated, and the result is the same."""
    monkeypatch.setattr(count_min, "width_for", lambda *_: 64)
    monkeypatch.setattr(text_kernels, "SLICE_BYTES", 500)
    documents = odd_documents(spark, texts).select("doc_id", "text")
    assert Counter(tuple(r) for r in substring_dedup(documents).select("doc_id", "n_words", "n_removed", "kept_text").collect()) == brute_force(documents.collect())


def test_estimates_never_fall_short():
    keys = np.random.default_rng(0).integers(0, 3000, 5000).astype(np.uint64)
    counts = Counter(keys.tolist())
    total = {}
    for part in np.array_split(keys, 7):
        for batch in count_min.partial_rows(part, 1 << 20, 2, 3):
            for r in batch.to_pylist():
                cells = total.setdefault((r["row"], r["block"]), np.zeros(count_min.BLOCK, int))
                cells += np.bincount(text_kernels.unpack_sorted(r["cells"]), minlength=count_min.BLOCK)
    sketch = count_min.Sketch({t: np.stack([np.packbits(total[r, 0] >= t) for r in range(2)]) for t in (2, 3)}, 1 << 20)
    for t in (2, 3):
        names = np.array(sorted(counts), dtype=np.uint64)
        estimated = sketch.at_least(names, t)
        assert all(e or counts[int(k)] < t for k, e in zip(names, estimated))
        assert sum(estimated) - sum(c >= t for c in counts.values()) < 40


def test_key_is_of_the_window_only():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 1 << 62, 400).astype(np.uint64)
    keys = window_keys(hashes)
    assert len(keys) == 400 - WINDOW + 1
    for i in range(len(keys)):
        assert window_keys(hashes[i : i + WINDOW])[0] == keys[i]


def test_empty(spark):
    assert substring_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
