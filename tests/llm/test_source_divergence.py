import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from nearfield.llm import source_divergence as module
from nearfield.llm.source_divergence import ORACLE, op12_source_divergence, source_divergence

SCHEMA = "doc_id long, text string, lang string, source string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def documents(n=400, seed=3):
    chance = random.Random(seed)
    words = ["the", "The", "a-b", "it's", "É", "é", "日本語", "x1y", "🤖", "rare"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)]
    rows = []
    for i in range(n):
        lang, source = chance.choice(["en", "en", "en", "fr", None, ""]), chance.choice(["s0", "s0", "s0", "s1", "s2", "", None, "Z", "é"])
        rows.append((i, " ".join(chance.choices(words, [1 / (k + 1) for k in range(len(words))], k=chance.randrange(0, 60))), lang, source))
    rows += [(1000 + i, t, "xx", "only") for i, t in enumerate(["", None, "1 2 3", "one"])] + [(2000, "one", "xx", "other")]
    rows += [rows[0]] * 3 + [(None, "the " * 9000, "en", "long"), (7, "x" * 5000, "en", "s1")]
    return rows


def expected(rows, least, top=50):
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = [t.translate({c: c + 32 for c in range(65, 91)}) for t in TERM.findall(text or "")]
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in docs:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[k] for k in kept) + 5 * len(kept)) for t in kept}
        p = {s: share(c) for (g, s), c in counts.items() if g == lang}
        q = share(sum((c for (g, _), c in counts.items() if g == lang), Counter()))
        for source in p:
            pairs = [(sum(abs(p[source][t] - p[o][t]) for t in kept), o) for o in p if o != source]
            marked = [(p[source][t] - q[t], t) for t in kept if counts[lang, source][t] and p[source][t] > q[t]]
            for part, found in (("pair", pairs), ("term", marked)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, source, part, item, value, rank) for rank, (value, item) in enumerate(found, 1) if part == "pair" or rank <= top]
    return sorted(out)


@pytest.mark.parametrize("least, held", [(30, 400_000), (1, 50), (10_000, 400_000)])
def test_equals_plain_sums(spark, monkeypatch, least, held):
    monkeypatch.setattr(module, "HELD_ENTRIES", held)
    rows = documents()
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS term", "1 AS cnt", "2 AS docs", "0 AS salt").repartition(5)
    got = source_divergence(frame, min_documents=least)
    assert sorted(tuple(r) for r in got.collect()) == expected(rows, least)


def test_top_terms(spark):
    rows = documents(200)
    got = source_divergence(spark.createDataFrame(rows, SCHEMA), top=3, min_documents=5)
    assert sorted(tuple(r) for r in got.collect()) == expected(rows, 5, 3)


def test_query_equals_sql(spark, tmp_path):
    rows = documents(600, seed=5)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = sorted(tuple(r) for r in op12_source_divergence(spark, str(tmp_path)).collect())
    assert got == sorted(con.sql(ORACLE).fetchall()) == expected(rows, 30)


def test_large_counts_are_exact(spark):
    """Beyond what nine digits more of a long would hold."""
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([(10**13 + 7, 3 * 10**13 + 1, 12345)], "c long, n long, v long")
    got = frame.select(module._share(F.col("c"), F.col("n"), F.col("v"), 5)).first()[0]
    assert got == 1 + 10**9 * (10**13 + 12) // (3 * 10**13 + 1 + 5 * 12345)


def test_nothing(spark):
    assert source_divergence(spark.createDataFrame([], SCHEMA)).count() == 0
