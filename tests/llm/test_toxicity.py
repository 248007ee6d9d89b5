import random
import zlib

import numpy as np
import pytest
from tests.llm.corpora import odd_documents

from nearfield.llm import toxicity
from nearfield.llm.toxicity import ORDER, fit, kneser_ney, toxicity_scores, without_toxic


def plain_ratio(counts, gram):
    """log P_1 / P_0 of the last letter of gram after the others, straight from the definition."""
    full = [{k: dict(own.get(k, {})) for k in range(1, ORDER + 1)} for own in counts]
    for own in full:
        for k in range(ORDER - 1, 0, -1):
            for g, n in own[k + 1].items():
                if n > 0:
                    own[k][g[1:]] = own[k].get(g[1:], 0) + 1

    def p(c, g):
        own = full[c][len(g)]
        after = {x: n for x, n in own.items() if x[:-1] == g[:-1] and n > 0}
        total = sum(after.values())
        if len(g) == 1:
            pooled = {x: full[0][1].get(x, 0) + full[1][1].get(x, 0) for x in {*full[0][1], *full[1][1]}}
            below = (pooled.get(g, 0) + 1) / (sum(pooled.values()) + len(pooled) + 1)
        else:
            below = p(c, g[1:])
        return max(own.get(g, 0) - 0.75, 0) / total + 0.75 * len(after) / total * below if total else below

    return np.log(p(1, gram) / p(0, gram))


def test_model_equals_definition():
    chance = random.Random(1)
    words = [["".join(chance.choices("abc" if c else "abd", k=chance.randint(1, 9))) for _ in range(60)] for c in (0, 1)]
    counts = [{}, {}]
    for c in (0, 1):
        for word in words[c]:
            marked = f"^{word}$"
            for i in range(1, len(marked)):
                g = marked[max(0, i - ORDER + 1) : i + 1]
                own = counts[c].setdefault(len(g), {})
                own[g] = own.get(g, 0) + 1
    names = sorted({g for own in counts for grams in own.values() for g in grams})
    packed = lambda g: int.from_bytes(g.encode(), "big")
    table = np.array([[counts[c].get(len(g), {}).get(g, 0) for c in (0, 1)] for g in names])
    model = kneser_ney(np.array([packed(g) for g in names], dtype=np.uint64), np.array([len(g) for g in names]), table)
    probes = [*names, "abcabc", "^a", "zzz", "cbz", "dddddd", "z", "^ddcab"]
    got = model.letter_ratios(np.array([packed(g) for g in probes], dtype=np.uint64), np.array([len(g) for g in probes]))
    assert np.allclose(got, [plain_ratio(counts, g) for g in probes])


@pytest.fixture(scope="module")
def corpus():
    chance = random.Random(7)
    syllables = ["the", "an", "re", "ti", "on", "es", "nd", "ou"]
    rows, labels = [], []
    for i in range(1500):
        toxic = chance.random() < 0.2
        words = ["".join(chance.choices(syllables, k=chance.randint(1, 3))) for _ in range(chance.randint(20, 150))]
        for _ in range(len(words) // 15 + 1 if toxic else 0):
            words[chance.randrange(len(words))] = chance.choice(["grumbo", "vexlot"]) + chance.choice(syllables)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark, corpus):
    rows, labels = corpus
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([*labels, (None, 1), (3, 7)], "doc_id long, toxic int")
    model = fit(documents, known)
    got = {r.doc_id: r for r in toxicity_scores(documents, model).collect()}
    truth = dict(labels)
    held = [r for r in got.values() if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1}
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    kept = {r.doc_id for r in without_toxic(documents, model).collect()}
    assert kept == {i for i, r in got.items() if r.predicted == 0}
    # held-out labels are never looked at
    hidden = spark.createDataFrame([(i, t if zlib.crc32(str(i).encode()) % 3 != 1 else 1 - t) for i, t in labels], "doc_id long, toxic int")
    again = {r.doc_id: r.score for r in toxicity_scores(documents, fit(documents, hidden)).collect()}
    assert again == {i: r.score for i, r in got.items()}


def test_odd_cases(spark, corpus):
    rows, labels = corpus
    documents = odd_documents(spark)
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    scored = toxicity_scores(documents, fit(spark.createDataFrame(rows, "doc_id long, text string"), known)).collect()
    assert len(scored) == documents.count() and all(0 <= r.score <= 1 for r in scored)
    assert not any(r.predicted for r in scored if r.doc_id in (0, 1, 2))
    unlabelled = toxicity_scores(documents, fit(documents, known.where("toxic = 5"))).collect()
    assert {r.score for r in unlabelled} == {0.5}
    assert toxicity_scores(documents.limit(0), toxicity.Model()).count() == 0


def test_both_folds_are_counted(spark, corpus):
    rows, labels = corpus
    fold = {i: zlib.crc32(str(i).encode()) % 3 for i, _ in labels}
    # a word that the toxic texts of one fold alone hold
    for only in (0, 2):
        own = [(i, f"{t} {'zaxquib ' * 5 if y and fold[i] == only else ''}") for (i, t), (_, y) in zip(rows, labels)]
        model = fit(spark.createDataFrame(own, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
        probe = "zaxquib$"[2:8]
        ratio = model.letter_ratios(np.array([int.from_bytes(probe.encode(), "big")], dtype=np.uint64), np.array([ORDER]))
        assert ratio[0] > 0 and int.from_bytes(probe.encode(), "big") in model.known[ORDER][0]


def test_expressions_beyond_the_broadcast_count_too(spark, corpus, monkeypatch):
    rows, labels = corpus
    documents = spark.createDataFrame([*rows, (None, "an vexlotti zq"), (1, rows[1][1]), (9001, ""), (9002, None)], "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    scores = lambda model: np.array(sorted((r.doc_id is None, r.doc_id or 0, r.score) for r in toxicity_scores(documents, model).collect()))
    whole = fit(documents, known)
    monkeypatch.setattr(toxicity, "MAX_GRAMS", 300)
    model = fit(documents, known)
    assert sum(len(keys) for keys, _ in whole.known.values()) > 600
    want = scores(whole)
    assert len(want) == len(rows) + 4
    assert np.allclose(scores(model), want, atol=1e-6)
    plain = lambda m: sorted(str(r) for r in without_toxic(documents, m).collect())
    assert plain(model) == plain(whole)


def brute_force(documents, labels):
    """Every step of the query in plain Python: counts, both models, the cross-fitted comparison, and the curve's equations."""
    text_words = lambda t: "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
    fold = lambda i: zlib.crc32(str(i).encode()) % 3
    cells = {}
    for i, t in documents:
        if i in labels and fold(i) != 1:
            cell = cells.setdefault(labels[i] + fold(i), {})
            for word in text_words(t):
                marked = f"^{word}$"
                for at in range(1, len(marked)):
                    g = marked[max(0, at - ORDER + 1) : at + 1]
                    cell[g] = cell.get(g, 0) + 1

    def model(c0, c1):
        full = []
        for own in (c0, c1):
            by_size = {k: {g: n for g, n in own.items() if len(g) == k} for k in range(1, ORDER + 1)}
            for k in range(ORDER - 1, 0, -1):
                for g in by_size[k + 1]:
                    by_size[k][g[1:]] = by_size[k].get(g[1:], 0) + 1
            after = {}
            for own_size in by_size.values():
                for g, n in own_size.items():
                    total, kinds = after.get((len(g), g[:-1]), (0, 0))
                    after[len(g), g[:-1]] = total + n, kinds + 1
            full.append((by_size, after))
        pooled = {x: sum(f[0][1].get(x, 0) for f in full) for x in {*full[0][0][1], *full[1][0][1]}}

        def p(c, g):
            by_size, after = full[c]
            total, kinds = after.get((len(g), g[:-1]), (0, 0))
            below = p(c, g[1:]) if len(g) > 1 else (pooled.get(g, 0) + 1) / (sum(pooled.values()) + len(pooled) + 1)
            return max(by_size[len(g)].get(g, 0) - 0.75, 0) / total + 0.75 * kinds / total * below if total else below

        return p

    def difference(p, t):
        words, total = text_words(t), 0.0
        for word in words:
            marked = f"^{word}$"
            for at in range(toxicity.FIRST, len(marked)):
                g = marked[max(0, at - ORDER + 1) : at + 1]
                total += np.log(p(1, g) / p(0, g))
        return total / (len(words) + toxicity.FEW_WORDS) if words else 0.0

    add = lambda a, b: {g: a.get(g, 0) + b.get(g, 0) for g in {*a, *b}}
    final = model(add(cells[0], cells[2]), add(cells[1], cells[3]))
    other = {0: model(cells[2], cells[3]), 2: model(cells[0], cells[1])}
    seen = [(difference(other[fold(i)], t), labels[i]) for i, t in documents if i in labels and fold(i) != 1]
    return [(i, difference(final, t)) for i, t in documents], seen


@pytest.mark.parametrize("max_labels", [toxicity.MAX_LABELS, 10])
def test_whole_query_equals_brute_force(spark, corpus, monkeypatch, max_labels):
    """With the labels broadcast, and with more of them than may be."""
    monkeypatch.setattr(toxicity, "MAX_LABELS", max_labels)
    rows, labels = corpus[0][:160], dict(corpus[1][:150])
    rows = [*rows, (500, None), (501, ""), (502, "a x, -- b"), rows[3]]
    model = fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(list(labels.items()), "doc_id long, toxic int"))
    differences, seen = brute_force(rows, labels)
    x, y = map(np.array, zip(*seen))
    curve = lambda x: 1 / (1 + np.exp(-(model.slope * x + model.bend * np.maximum(x - model.knee, 0) + model.offset)))
    assert model.slope >= 0 and model.slope + model.bend >= 0
    p, scale = curve(x), np.std(x)
    # the curve of the weakly penalised likelihood: its gradient is zero for what it uses
    for value, by in ((model.slope, x), (model.bend, np.maximum(x - model.knee, 0))):
        assert value == 0 or abs(((y - p) * by / scale).sum() - 1e-2 * value * scale) < 1e-4
    assert abs((y - p).sum() - 1e-6 * model.offset) < 1e-4
    got = sorted((r.doc_id, r.score) for r in toxicity_scores(spark.createDataFrame(rows, "doc_id long, text string"), model).collect())
    want = sorted((i, curve(d)) for i, d in differences)
    assert [i for i, _ in got] == [i for i, _ in want] and np.allclose([s for _, s in got], [s for _, s in want], atol=1e-9)


def test_curve_rises_and_bends():
    """Most of one class lies among the other, and few beyond: those are told, and the curve never falls."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 1, 4000), rng.normal(0, 1, 250), rng.normal(8, 1, 250)])
    y = np.concatenate([np.zeros(4000), np.ones(500)])
    slope, offset, bend, knee = toxicity.fit_curve(x, y, np.ones(len(x)))
    p = 1 / (1 + np.exp(-(slope * x + bend * np.maximum(x - knee, 0) + offset)))
    assert slope >= 0 and slope + bend >= 0 and (p[-250:] >= 0.7).mean() > 0.95 and (p[:4000] >= 0.7).mean() < 0.01
    assert toxicity.fit_curve(-x, y, np.ones(len(x)))[0] >= 0 or toxicity.fit_curve(-x, y, np.ones(len(x)))[2] == 0
