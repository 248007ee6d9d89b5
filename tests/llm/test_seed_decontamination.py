import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F
from tests.llm.corpora import odd_documents

import nearfield.llm.seed_decontamination as module
from nearfield.llm.seed_decontamination import MASKS, SPAN, WHOLE, benchmark_matches, decontaminate


def test_masks_lose_nothing():
    for length in range(WHOLE, SPAN + 1):
        for wrong in itertools.combinations(range(length), length - math.ceil(0.8 * length)):
            assert any(not any(o + i in wrong for i in mask) for mask in MASKS for o in range(length - mask[-1]))


def brute_force(documents, items):
    found = set()
    for doc_id, text in documents:
        words = (text or "").lower().split()
        for item_id, item in items:
            own = (item or "").lower().split()
            span = min(SPAN, len(own))
            need = len(own) if len(own) < WHOLE else math.ceil(0.8 * span)
            if not own or not set(own) & set(words):
                continue
            for shift in range(-len(own), len(words)):
                both = range(max(0, -shift), min(len(own), len(words) - shift))
                same = {i for i in both if words[shift + i] == own[i]}
                if len(same) >= need and any(len(same.intersection(range(o, o + span))) >= need for o in range(len(own) - span + 1)):
                    found.add((doc_id, item_id))
                    break
    return found


def cases():
    chance = random.Random(11)
    word = lambda: chance.choice("the of and to in".split()) if chance.random() < 0.3 else "".join(chance.choices("abcdefg", k=3))
    items = [(i, " ".join(word() for _ in range(chance.randint(5, 45)))) for i in range(25)] + [(90, None), (91, ""), (92, "short one")]
    documents = []
    for i in range(120):
        own = [word() for _ in range(chance.randint(0, 120))]
        _, item = items[chance.randrange(25)]
        part = item.split()
        cut = chance.randint(0, max(0, len(part) - 8))
        part = part[cut : cut + chance.randint(8, 40)] if chance.random() < 0.5 else part
        part = [w if chance.random() > 0.18 else "changed" for w in part]
        at = chance.randint(0, len(own))
        documents.append((i, " ".join([*own[:at], *part, *own[at:]]).upper() if i % 7 == 0 else "\n".join([*own[:at], *part, *own[at:]])))
    return documents, items


def short_cases():
    """Documents and items of any length, a null item_id, a long item, and rows that share a doc_id with different texts."""
    documents, items = cases()
    texts = [t for _, t in documents]
    texts += ["x y seven words in a row stand z", "seven words in a row stand", "tail is lone", "lone", "two words here", "words two", " ".join(items[24][1].split() * 80)]
    items = [*items, (93, "lone"), (94, "two words"), (95, "seven words in a row stand"), (None, items[3][1]), (96, " ".join(f"w{i}" for i in range(1500)))]
    texts += [" ".join(f"w{i}" if i % 6 else "changed" for i in range(700, 730)), " ".join(f"w{i}" for i in range(490, 512))]
    return texts, items


@pytest.mark.parametrize("broadcast_words", [module.BROADCAST_WORDS, 0])
def test_equals_brute_force(spark, monkeypatch, broadcast_words):
    """With the benchmark broadcast, and with a larger one than may be."""
    monkeypatch.setattr(module, "BROADCAST_WORDS", broadcast_words)
    texts, items = short_cases()
    docs = odd_documents(spark, texts).unionByName(odd_documents(spark, texts[:40]).selectExpr("doc_id + 3 AS doc_id", "* EXCEPT (doc_id)"))
    bench = spark.createDataFrame([(a, b, "w") for a, b in items], "item_id long, text string, words string")
    rows = docs.collect()
    want = brute_force([(r.doc_id, r.text) for r in rows], items)
    assert len(want) > 40 and {None, 93, 94, 95, 96} <= {i for _, i in want}
    got = [tuple(r) for r in benchmark_matches(docs, bench).collect()]
    assert set(got) == want and len(got) == len(want)
    # rows are judged by their own text, whatever other rows of the same doc_id hold
    kept = decontaminate(docs.withColumn("a.b", F.lit(1)), bench)
    assert kept.columns == [*docs.columns, "a.b"]
    clean = [r for r in rows if not brute_force([(r.doc_id, r.text)], items)]
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text is None, r.text or "")
    assert sorted(map(key, kept.collect())) == sorted(map(key, clean))


def test_documents_are_read_a_fixed_number_of_times(spark, monkeypatch, tmp_path):
    texts, items = short_cases()
    odd_documents(spark, texts).select("doc_id", "text").write.parquet(str(tmp_path / "d"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.read.parquet(str(tmp_path / "d"))
    for limit, scans in ((module.BROADCAST_WORDS, 2), (300, 2)):  # one of them for items of one word; two for seeds and words
        monkeypatch.setattr(module, "BROADCAST_WORDS", limit)
        plan = benchmark_matches(docs, bench.where("length(text) > 6"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("doc_id#") and len(re.findall(r"Relation \[doc_id", plan)) <= scans


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string")
    assert benchmark_matches(none, items).count() == 0
    assert benchmark_matches(items.withColumnRenamed("item_id", "doc_id"), items.limit(0)).count() == 0


def test_a_text_that_holds_an_item_over_and_over(spark):
    """A position takes the words around it, not the whole text: with all words of this text at each of its hits, they are 20 GB."""
    item = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, " ".join([item] * 500)), (2, item.replace("w9", "x")), (3, "w1 w2 w3 w4")], "doc_id long, text string")
    bench = spark.createDataFrame([(i, item if i else item.upper()) for i in range(3)], "item_id long, text string")
    assert {tuple(r) for r in benchmark_matches(docs, bench).collect()} == {(d, i) for d in (1, 2) for i in range(3)}
    assert [r.doc_id for r in decontaminate(docs, bench).collect()] == [3]


@pytest.mark.parametrize("broadcast_words", [module.BROADCAST_WORDS, 0])
def test_chunks_of_texts_lose_nothing(spark, monkeypatch, broadcast_words):
    """However short the chunks, and with words longer than any of the benchmark's."""
    monkeypatch.setattr(module, "BROADCAST_WORDS", broadcast_words)
    monkeypatch.setattr(module, "CHUNK", 5)
    documents, items = cases()
    documents += [(200 + i, t.replace("\n", " " + "long" * 300 + " ", 1)) for i, (_, t) in enumerate(documents[:30])]
    got = benchmark_matches(spark.createDataFrame(documents, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(got) > 40 and {tuple(r) for r in got} == brute_force(documents, items)
