import random
from collections import namedtuple

import public_tokenizers
from tests.llm import test_ngram_join, test_seed_decontamination, test_substring_dedup

import corpus_pipeline
from nearfield.llm.merge_vocabulary import vocabulary
from nearfield.llm.toxicity import fit, toxicity_scores

Row = namedtuple("Row", "doc_id text")


def make_corpus(spark, folder):
    chance = random.Random(21)
    word = lambda: "".join(chance.choices(["the", "an", "re", "ti", "on", "es", "nd", "ou"], k=chance.randint(1, 3)))
    passage, item = [word() for _ in range(60)], [word() for _ in range(30)]
    texts, labels = [], []
    for i in range(700):
        toxic = chance.random() < 0.25
        words = [word() for _ in range(chance.randint(30, 120))]
        if toxic:
            for _ in range(14):
                words[chance.randrange(len(words))] = chance.choice(["grumbo", "vexlot"]) + chance.choice(["the", "an"])
        elif i % 10 == 0:
            words[5:5] = passage
        elif i % 17 == 0:
            words[9:9] = item
        elif i % 11 == 0 and texts:
            words = (chance.choice(texts) or "").split()
            if i % 22 and len(words) > 20:
                words[3] = "changed"
        texts.append(" ".join(words))
        # copies of toxic texts are labelled as these are
        labels.append((i, int(chance.random() < 0.5), int(any(w.startswith(("grumbo", "vexlot")) for w in words))))
    texts += ["", None, "  two  words ", texts[0], texts[1]]
    rows = [(i, t, "en", f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)] + [(None, texts[2], "en", None, 3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, " ".join(item)), (1, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return item


def test_pipeline_equals_plain_stages(spark, tmp_path):
    folder = str(tmp_path)
    item = make_corpus(spark, folder)
    documents, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    scores = toxicity_scores(documents, fit(documents, labels)).collect()
    toxic = {r.doc_id for r in scores if r.predicted}
    kept = [Row(r.doc_id, r.text) for r in documents.collect() if r.doc_id not in toxic]
    assert 40 < len(toxic) < 250, len(toxic)
    first = {k[0]: k[2] for k in test_ngram_join.brute_force(kept)}
    fewer = [r for r in kept if r.doc_id is None or first[r.doc_id] == r.doc_id]
    assert len(fewer) < len(kept)
    cut = {k[0]: k for k in test_substring_dedup.brute_force(fewer)}
    assert any(k[2] for k in cut.values())
    rest = [Row(r.doc_id, cut[r.doc_id][3] if cut[r.doc_id][2] else r.text) for r in fewer]
    found = {d for d, _ in test_seed_decontamination.brute_force(rest, [(0, " ".join(item))])}
    assert found
    library = vocabulary(public_tokenizers.path("piece_bpe_32k.model")).library(dummy_prefix=True)
    want = {r.doc_id: library.encode(r.text or "", add_eos=True) for r in rest if r.doc_id not in found}
    got = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id: r.ids for r in got} == want and len(got) == len(want)
    assert all(r.n_tokens == len(r.ids) for r in got)


def test_stages_judge_rows(spark, tmp_path):
    """Rows that share a doc_id with another text are judged by their own; repeated rows leave one; odd column names survive."""
    folder = str(tmp_path)
    item = make_corpus(spark, folder)
    chance = random.Random(5)
    text = lambda: " ".join("".join(chance.choices("abcdefgh", k=4)) for _ in range(60))
    a, b, c, d, long = text(), text(), text(), text(), " ".join(text() for _ in range(17_000))
    rows = [(1, a), (2, a), (2, b), (3, c), (3, c), (3, c), (4, d), (4, f"{d} {' '.join(item)}"), (5, ""), (5, ""), (6, None), (None, a), (None, f"{d} {' '.join(item)}"), (7, long), (8, long + " more"), (7, b + " tail")]
    docs = spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t in rows], "doc_id long, text string, `a.b` string, N_words int, Kept_Text int, k0 int")
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["near_duplicates"](spark, docs, folder)
    assert kept.columns == docs.columns
    want = [(1, a), (2, b), (3, c), (4, d), (4, rows[7][1]), (5, ""), (5, ""), (6, None), (None, a), (None, rows[12][1]), (7, long)]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=key) == sorted(want, key=key)
    clean = stages["benchmark"](spark, docs, folder)
    assert clean.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in clean.collect()), key=key) == sorted((r for r in rows if " ".join(item) not in (r[1] or "")), key=key)
    cut = stages["repeated_passages"](spark, docs, folder)
    assert cut.columns == docs.columns and cut.count() == len(rows)
    assert {(r["a.b"], r.N_words, r.Kept_Text, r.k0) for r in cut.collect()} == {("x", 1, 2, 3)}
    assert sum(r.text == "" for r in cut.collect() if r.doc_id == 2) == 1
    assert stages["toxicity"](spark, docs, folder).count() <= len(rows)
    assert stages["tokens"](spark, docs, folder).count() == len(rows)


def test_pipeline_of_nothing(spark, tmp_path):
    folder = str(tmp_path)
    make_corpus(spark, folder)
    empty = str(tmp_path / "empty")
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_stages_keep_the_columns(spark, tmp_path):
    folder = str(tmp_path)
    make_corpus(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).schema.simpleString() == docs.schema.simpleString()
        assert stage(spark, docs.limit(0), folder).count() == 0
