import random
import re
from collections import Counter

import numpy as np
import pytest
from tests.llm.corpora import odd_documents

from nearfield.llm import count_min, ngram_join
from nearfield.llm.components import connected_components
from nearfield.llm.ngram_join import one_of_each_group, similar_groups


def token_set(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_force(rows):
    sets = [token_set(r.text) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and None not in (rows[i].doc_id, rows[j].doc_id) and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    smallest = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            smallest[find(i)] = min(smallest.get(find(i), r.doc_id), r.doc_id)
    return Counter((r.doc_id, len(s), None if r.doc_id is None else smallest[find(i)]) for i, (r, s) in enumerate(zip(rows, sets)))


def corpus(seed):
    chance = random.Random(seed)
    word = lambda: "".join(chance.choices("abcdefghij", k=3))
    passage = [word() for _ in range(60)]
    out = []
    for _ in range(12):  # chains of near copies that drift away from where they began
        own = [word() for _ in range(chance.choice([6, 20, 60, 150]))]
        for _ in range(chance.randint(1, 14)):
            own = list(own)
            for _ in range(chance.randint(0, 3)):
                own[chance.randrange(len(own))] = word()
            out.append(" ".join(own))
    out += [" ".join([*passage, *(word() for _ in range(chance.randint(0, 60)))]) for _ in range(40)]
    out += [" ".join(word() for _ in range(chance.randint(0, 80))) for _ in range(60)]
    out += [chance.choice(out).upper() for _ in range(30)]
    chance.shuffle(out)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    documents = odd_documents(spark, corpus(seed))
    want = brute_force(documents.collect())
    assert Counter(tuple(r) for r in similar_groups(documents).collect()) == want


def test_parts_and_full_sketch_lose_nothing(spark, monkeypatch):
    """Tiny parts and a sketch that knows nothing give the same result."""
    monkeypatch.setattr(count_min, "width_for", lambda *_, **__: 64)
    monkeypatch.setattr(ngram_join, "PART_SETS", 3)
    monkeypatch.setattr(ngram_join, "HUBS", 1)
    documents = odd_documents(spark, corpus(3))
    assert Counter(tuple(r) for r in similar_groups(documents).collect()) == brute_force(documents.collect())
    kept = one_of_each_group(documents)
    assert kept.columns == documents.columns
    want = {k[0] for k in brute_force(documents.collect()) if k[0] is None or k[0] == k[2]}
    assert {r.doc_id for r in kept.collect()} == want


def test_empty(spark):
    assert similar_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert similar_groups(spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string").select("doc_id", "text")).count() == 2


def test_components(spark):
    chance = random.Random(0)
    pairs = [(i, i + 1) for i in range(60) if i % 13] + [(100, j) for j in range(101, 160)] + [(chance.randint(200, 300), chance.randint(200, 300)) for _ in range(70)]
    want = {}
    for a, b in pairs:
        want.setdefault(a, a), want.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(want[a], want[b])
            changed |= want[a] != low or want[b] != low
            want[a] = want[b] = low
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {n: r for n, r in want.items() if n in got} and all(n == r for n, r in want.items() if n not in got)


def packed(tokens):
    return np.unique(np.array(tokens, dtype=np.uint64)).tobytes()


def make_sets(spark, rows):
    """A table of sets of (group, tokens), each token in the prefix, in parts."""
    out = [(i.to_bytes(16, "big"), len(set(t)), packed(t), [int(x) for x in sorted(set(t))], str(g).encode()) for i, (g, t) in enumerate(rows)]
    return ngram_join._in_parts(spark.createDataFrame(out, "set binary, n long, tokens binary, prefix array<long>, grp binary"))


def test_near_copies_connect_without_pairs_of_parts(spark, monkeypatch):
    """A group of many parts whose sets are near copies: what is compared grows with the group, and no set asks its own group."""
    monkeypatch.setattr(ngram_join, "PART_SETS", 8)
    sets = make_sets(spark, [("hot", [*range(50), 1000 + i]) for i in range(200)] + [(f"g{i}", [*range(10), *range(5000 + 100 * i, 5040 + 100 * i)]) for i in range(30)])
    near = ngram_join._links_in_parts(sets)
    light = ngram_join._regrouped(sets, near)
    hot = light.where("NOT alone")
    assert hot.count() == 200 and hot.select("grp").distinct().count() == 1
    parts, unions = ngram_join._matrix(light, sets.select("set", "tokens"))
    asked = ngram_join._candidates(light, parts).join(light.select("set", "grp"), "set")
    assert asked.where("grp = part.grp").count() == 0
    assert unions.where("one IS NULL").count() == parts.where("members > 1").count() > 20


def test_bound_is_asked_before_parts_are_opened(spark, monkeypatch):
    """Of the parts that queries ask, only those whose union holds enough of a query are opened."""
    chance = random.Random(2)
    groups = [[chance.randrange(1 << 40) for _ in range(60)] for _ in range(12)]
    rows = [(g, [*own[: 56 + i % 4], 7]) for g, own in enumerate(groups) for i in range(4)]  # token 7 is in all
    rows += [(f"q{g}", [*own[:30], *(chance.randrange(1 << 40) for _ in range(40)), 7]) for g, own in enumerate(groups)]
    rows += [(f"r{g}", [*own[:55], 7, 8]) for g, own in enumerate(groups[:3])]
    sets = make_sets(spark, rows)
    seen = {}
    real = ngram_join.written
    monkeypatch.setattr(ngram_join, "written", lambda frame, name: seen.setdefault(name, real(frame, name)))
    light = ngram_join._regrouped(sets, ngram_join._links_in_parts(sets))
    links = {(bytes(r.a), bytes(r.b)) for r in ngram_join._links_across(light, sets.select("set", "tokens")).collect()}
    linked = {int.from_bytes(a, "big") for pair in links for a in pair}
    assert {60, 61, 62} <= linked and not linked & set(range(48, 60))
    asked, opened = seen["asked-parts"].count(), seen["qualified"].where("link IS NULL").count()
    assert asked > 100 and opened == 3
