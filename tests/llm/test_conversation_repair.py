import hashlib
import heapq
import random
import zlib

import duckdb
import pytest

from nearfield.llm import conversation_repair
from nearfield.llm.conversation_repair import ORACLES, Repaired, damaged, prepared

BLANKS = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest(turns):
    """(cost, audit, lines) by search in the order of cost and then audit; turns are (role, text, fault)."""
    follow = {"": "u", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}
    queue, done = [(0, "", (), 0, "")], set()
    while queue:
        cost, audit, lines, at, state = heapq.heappop(queue)
        if at == len(turns) and state in ("", "a"):
            return cost, audit, lines
        # audits of one length and state can be told apart by what they are; shorter ones aren't better
        if (at, state, len(audit)) in done:
            continue
        done.add((at, state, len(audit)))
        after = follow[state]
        if audit[-3:] != "III":
            heapq.heappush(queue, (cost + 5, audit + "I", (*lines, names[after] + ":"), at, after))
        if at < len(turns):
            role, text, fault = turns[at]
            heapq.heappush(queue, (cost + 2, audit + "D", lines, at + 1, state))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                heapq.heappush(queue, (cost + 1 + more, audit + "R", (*lines, f"{names[after]}:{text}"), at + 1, after))
                if role[:1] == after or (state, role[:1]) == ("", "s"):
                    heapq.heappush(queue, (cost + more, audit + "K", (*lines, f"{role}:{text}"), at + 1, role[:1]))


def expected(rows, damage=False):
    by = {}
    for conv, turn, role, text in rows:
        own = by.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        text = "" if kind == 1 else text.translate(str.maketrans("", "", ".!?")) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, own in by.items():
        own.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        seen, turns = set(), []
        for _, role, text in own:
            shown = text.rstrip(BLANKS)
            turns.append((role, text, "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else ""))
            seen.add((role, text))
        at = {t for t, _, _ in own if t is not None}
        cost, audit, lines = cheapest(turns)
        faults = [sum(t[2] == f for t in turns) for f in ("blank", "duplicate", "truncated")]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        out[conv] = (max(at) - min(at) + 1 - len(at) if at else 0, *faults, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def conversations(n=60, seed=7):
    chance = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "cut off", " \t\r\n", "", None, "two\nlines.", "ends so. \x0b", "日本語。", "Long " * 300 + "."]
    roles = ["system", "user", "assistant", "tool", None, "", "User"]
    rows = []
    for conv in [*range(n), None]:
        for turn in range(chance.randrange(1, 12)):
            turn = None if chance.random() < 0.05 else turn + 2 * (chance.random() < 0.1)
            role = chance.choices(roles, [1, 6, 6, 1, 0.5, 0.5, 0.5])[0]
            row = (conv, turn, role, chance.choices(texts, [4, 4, 4, 2, 1, 1, 1, 2, 1, 1, 1])[0] if chance.random() < 0.5 else f"Own {conv} {turn}{chance.choice('.?! ')}")
            rows += [row] * chance.choices((1, 2, 4), (12, 2, 1))[0]
    return rows


def results(frame):
    return {r[0]: tuple(r)[1:] for r in frame.collect()}


@pytest.mark.parametrize("most", [(4096, 4096), (5, 3), (0, 1)])
@pytest.mark.parametrize("damage", [False, True])
def test_equals_search(spark, monkeypatch, most, damage):
    """Whole conversations, and longer ones in segments, down to one turn each."""
    monkeypatch.setattr(conversation_repair, "MAX_TURNS", most[0])
    monkeypatch.setattr(conversation_repair, "SEGMENT", most[1])
    rows = conversations(40 if most[1] == 1 else 60)
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS copies", "'x' AS fault", "2 AS place").repartition(3)
    repaired = Repaired(damaged(frame) if damage else prepared(frame))
    assert results(repaired.digests()) == expected(rows, damage)


def test_turns_give_the_digest(spark, monkeypatch):
    monkeypatch.setattr(conversation_repair, "MAX_TURNS", 6)
    monkeypatch.setattr(conversation_repair, "SEGMENT", 4)
    repaired = Repaired(prepared(spark.createDataFrame(conversations(), SCHEMA)))
    lines = {}
    for r in sorted(repaired.repaired_turns().collect(), key=lambda r: (r.place, r.slot)):
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    digests = {r.conv_id: r.repaired_sha256 for r in repaired.digests().collect()}
    assert digests == {c: hashlib.sha256("\n".join(lines.get(c, [])).encode()).hexdigest() for c in digests}
    roles = {c: "".join(x[0] for x in own) for c, own in lines.items()}
    assert all(r in ("",) or r.lstrip("s").replace("ua", "") == "" for r in roles.values())


def test_one_conversation_with_most_rows(spark, monkeypatch):
    """A conversation of 3,000 turns, a third of which say the same, in segments of 100."""
    monkeypatch.setattr(conversation_repair, "MAX_TURNS", 50)
    monkeypatch.setattr(conversation_repair, "SEGMENT", 100)
    rows = [(1, t, ("user", "assistant")[t % 2], "Same." if t % 3 == 0 else f"Turn {t}{'.' if t % 7 else ''}") for t in range(3000)]
    rows += [(1, 5, "user", "Repeated.")] * 500 + [(2, 0, "user", "Hello."), (2, 1, "assistant", "Hello.")]
    frame = prepared(spark.createDataFrame(rows, SCHEMA))
    got = results(Repaired(frame).digests())
    monkeypatch.setattr(conversation_repair, "MAX_TURNS", 10_000)
    assert got == results(Repaired(frame).digests())
    assert got[1][6].count("D") >= 499 and got[2][5:7] == (0, "KK")


def test_nothing(spark):
    assert Repaired(prepared(spark.createDataFrame([], SCHEMA))).digests().count() == 0


def test_query_equals_sql(spark, tmp_path):
    rows = conversations(80, seed=11)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    name = "op11_conversation_repair"
    got = results(conversation_repair.QUERIES[name](spark, str(tmp_path)))
    assert got == {r[0]: r[1:] for r in con.sql(ORACLES[name]).fetchall()} == expected(rows, True)
