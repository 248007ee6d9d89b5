"""Operator 11: the cheapest repair of a conversation's turns into ``(system? (user assistant)+)?``.

Edits are Keep (0), Rerole to user or assistant (1), Delete (2, and the only one for blank and duplicate turns) and Insert of an empty
user or assistant turn (5); a truncated turn that isn't deleted costs 5 more.  A backward pass gives, for each turn and each state of
the grammar, the least cost to the end; a forward walk then takes, of the edits that this cost allows, the one with the ASCII-least
initial, which gives the least of all cheapest audits.  The state decides the role that Rerole and Insert give.

A conversation of at most MAX_TURNS turns and MAX_BYTES of text is repaired as a whole, one after another in Arrow batches sorted by
conversation.  A longer one is never held by a task: equal turns of it become one row with a number, rows are numbered in their order and
cut into segments of SEGMENT rows, and the segments are solved apart from each other.  A segment gives a table of the least cost from each state
to each state; composing these from the end gives what each segment costs to the end; with that, a segment's walk from each of the four
states is known, and composing from the start picks one.  What is composed is a row for each segment.  Only the SHA-256 of the whole repaired
text has to be taken by one task, which streams over the text in order and holds none of it.

Defined cases.  Turns are in the order of turn (nulls first), then role, then text.  A null role or text is one space, so the text is
blank and the role has to be changed; a null conv_id is a conversation of its own, and a null turn counts nowhere in gaps.  Repeated rows
are turns of their own, of which the later ones are duplicates; an empty role has no initial, so it is in no legal pair.  Texts
of any length are taken whole; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.rows import MAX_BROADCAST_KEYS, column, fingerprint
from nearfield.llm.shared_store import small_batches, written
from nearfield.llm.text_kernels import release
from nearfield.operators.sorted_places import with_places

MAX_TURNS, MAX_BYTES, SEGMENT = 4096, 8 << 20, 4096
#: Text for which there is one task after a shuffle.
TASK_BYTES = 32 << 20
BLANKS = " \t\n\x0b\x0c\r"

FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
DELETE, REROLE, INSERT, OPEN_END = 2, 1, 5, 5
START, SYSTEM, USER, ASSISTANT = STATES = range(4)
#: The state after a turn that is given the only role that may follow, and the state that a kept role leads to.
NEXT = (USER, USER, ASSISTANT, USER)
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ROLES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = ("su", "ua", "au")
FAR = 1 << 60
#: Cost to the end behind the last turn.
END = (0, FAR, FAR, 0)

#: A turn as the walk sees it: initial of the role, fault, and how many equal turns follow each other here.
Turn = tuple[str, int, int]


def _inserted(base: Sequence[int]) -> tuple[int, ...]:
    """Least costs where turns may be inserted first: two at most, as a third would lead back."""
    user, assistant = min(base[USER], INSERT + base[ASSISTANT]), min(base[ASSISTANT], INSERT + base[USER])
    return min(base[START], INSERT + user), min(base[SYSTEM], INSERT + user), user, assistant


def cost_to_go(turns: Sequence[Turn], end: Sequence[int] = END) -> list[tuple[int, ...]]:
    """For each turn, and behind the last one, the least cost to the end by state."""
    out = [_inserted(end)]
    for initial, fault, number in reversed(turns):
        after = out[-1]
        if fault in (BLANK, DUPLICATE):
            out.append(tuple(DELETE * number + x for x in after))
            continue
        rest, base = DELETE * (number - 1), []  # equal turns that follow are duplicates
        more = OPEN_END if fault == TRUNCATED else 0
        for state in STATES:
            kept = KEPT.get((state, initial))
            base.append(rest + min(DELETE + after[state], REROLE + more + after[NEXT[state]], FAR if kept is None else more + after[kept]))
        out.append(_inserted(base))
    return out[::-1]


def walk(turns: Sequence[Turn], costs: Sequence[Sequence[int]], state: int, last: bool) -> tuple[int, list[str]]:
    """The state behind the turns, and what is done at each: u and a insert a turn before it, D deletes it, K keeps it, U and A change its
    role.  At the last turn of a conversation, turns inserted behind it follow."""
    out = []

    def insert() -> str:
        nonlocal state
        state = NEXT[state]
        return ROLES[state][0]

    for at, (initial, fault, number) in enumerate(turns):
        done, after = "", costs[at + 1]
        dropped = fault in (BLANK, DUPLICATE)
        more, rest = (OPEN_END if fault == TRUNCATED else 0), DELETE * (0 if dropped else number - 1)
        while True:
            now = costs[at][state]
            if now == DELETE * (number if dropped else 1) + rest + after[state]:
                done += "D" * (number if dropped else 1)
            elif now == INSERT + costs[at][NEXT[state]]:
                done += insert()
                continue
            elif (kept := KEPT.get((state, initial))) is not None and now == more + rest + after[kept]:
                state, done = kept, done + "K"
            else:
                state = NEXT[state]
                done += ROLES[state][0].upper()
            break
        out.append(done + "D" * (0 if dropped else number - 1))
    while last and costs[-1][state] >= INSERT:
        out[-1:] = [(out[-1] if out else "") + insert()]
    return state, out


AUDIT = str.maketrans("uaUAKD", "IIRRKD")


def _illegal(initials: Sequence[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


def prepared(conversations: DataFrame, copies: Column | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, copies): the turns of a table; a turn with 0 copies is only there to name its conversation."""
    conv, turn, role, text = (column(conversations, c) for c in (conv_col, turn_col, role_col, text_col))
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    return conversations.select(conv.alias("conv_id"), turn.cast("long").alias("turn"), blank(role).alias("role"), blank(text).alias("text"), (F.lit(1) if copies is None else copies).cast("long").alias("copies"))


def _faulty(rows: DataFrame) -> DataFrame:
    """rows with fault, as far as a turn shows it by itself."""
    shown = F.rtrim("text", F.lit(BLANKS))
    return rows.withColumn("fault", F.when(shown == "", BLANK).when(F.right(shown, F.lit(1)).isin(".", "!", "?"), FINE).otherwise(TRUNCATED))


_REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _whole(rows: DataFrame, partitions: int) -> DataFrame:
    """(conv_id, report..., repaired array<struct<role, text>>) of conversations that a task can hold one of."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, {_REPORT}, repaired array<struct<role string, text string>>"
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired"]
    made = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def solved(turns: list[tuple]) -> tuple:
        seen, own, said = set(), [], []
        for turn, role, text, copies, fault in turns:
            for _ in range(copies):
                now = DUPLICATE if fault != BLANK and (role, text) in seen else fault
                seen.add((role, text))
                own.append((role[:1], now, 1))
                said.append((turn, role, text))
        at = {t for t, _, _ in said if t is not None}
        costs = cost_to_go(own)
        _, done = walk(own, costs, START, True)
        repaired = []
        for codes, (_, role, text) in zip(done, said):
            for code in codes:
                if code in "ua":
                    repaired.append({"role": "user" if code == "u" else "assistant", "text": ""})
                elif code != "D":
                    repaired.append({"role": role if code == "K" else "user" if code == "U" else "assistant", "text": text})
        count = lambda fault: sum(f == fault for _, f, _ in own)
        gaps = max(at) - min(at) + 1 - len(at) if at else 0
        return gaps, count(BLANK), count(DUPLICATE), count(TRUNCATED), _illegal([i for i, _, _ in own]), costs[0][START], "".join(done).translate(AUDIT), repaired

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, out, size = [], [], 0
        now, turns, begun = None, [], False
        id_type = None

        def flush() -> pa.RecordBatch:
            columns = [pa.array(c, made if n == "repaired" else pa.string() if n == "audit" else pa.int64()) for n, c in zip(names, zip(*out))]
            return pa.RecordBatch.from_arrays([pa.array(ids, id_type), *columns], names=["conv_id", *names])

        for batch in batches:
            id_type = batch.schema.field(0).type
            release(batch.nbytes, settled=False)
            for conv, *turn in zip(*(c.to_pylist() for c in batch.columns)):
                if begun and conv != now:
                    ids.append(now)
                    out.append(solved(turns))
                    turns = []
                    if size > 2 << 20:
                        yield flush()
                        ids, out, size = [], [], 0
                now, begun = conv, True
                turns.append(turn)
                size += 200 + len(turn[2])
        if begun:
            ids.append(now)
            out.append(solved(turns))
            yield flush()

    own = _faulty(rows).select("conv_id", "turn", "role", "text", "copies", "fault")
    return own.repartition(partitions, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, schema)


def _placed(rows: DataFrame) -> DataFrame:
    """(conv_id, place, segment, turn, role, text, number, fault): the different turns in their order; first holds of a text's first turn."""
    same = ["conv_id", "turn", "role", "text"]
    one = _faulty(rows.where("copies > 0").groupBy(*same).agg(F.sum("copies").alias("number")))
    one = one.withColumns(dict(zip(("h", "g"), fingerprint(F.col("text")))))
    # nulls first: the struct's first field is false for them
    first = one.where(F.col("fault") != BLANK).groupBy("conv_id", "role", "h", "g").agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first"))
    first = first.select(*(F.col(c).alias(f"f_{c}") for c in ("conv_id", "role", "h", "g")), F.col("first.turn").alias("f_turn"), F.lit(True).alias("new"))
    # with the turn, each key is there once on either side
    met = F.lit(True)
    for c in ("conv_id", "role", "h", "g", "turn"):
        met = met & one[c].eqNullSafe(first[f"f_{c}"])
    flagged = one.join(first, met, "left").withColumn("fault", F.when((F.col("fault") != BLANK) & F.col("new").isNull(), DUPLICATE).otherwise(F.col("fault")))
    placed = with_places(flagged.select(*same, "number", "fault"), same)
    return written(placed.withColumn("segment", F.expr(f"place div {SEGMENT}")), "turns")


def _ordered(rows: DataFrame, *order: Column) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def _long(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, report...) without audit, and (conv_id, place, turn, role, text, number, fault, done) of conversations of any length."""
    import pandas as pd

    placed = _placed(rows)
    kind = rows.schema["conv_id"].dataType.simpleString()
    light = placed.select("conv_id", "segment", "place", F.substring("role", 1, 1).alias("initial"), "fault", "number")

    def turns_of(part: pd.DataFrame) -> list[Turn]:
        part.sort_values("place", inplace=True)
        return list(zip(part["initial"], part["fault"].tolist(), part["number"].tolist()))

    def priced(part: pd.DataFrame) -> pd.DataFrame:
        turns = turns_of(part)
        costs = [cost_to_go(turns, [0 if s == end else FAR for s in STATES])[0] for end in STATES]
        illegal = _illegal([t[0] for t in turns]) + sum(t[2] - 1 for t in turns)
        return pd.DataFrame({"conv_id": part["conv_id"].iloc[:1], "segment": part["segment"].iloc[:1], "costs": [[min(c, FAR) for own in costs for c in own]], "opens": turns[0][0], "closes": turns[-1][0], "illegal": illegal})

    prices = light.groupBy("conv_id", "segment").applyInPandas(priced, f"conv_id {kind}, segment long, costs array<long>, opens string, closes string, illegal long")
    prices = written(prices, "prices")

    def backwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, behind, opens = (), END, None
        for batch in batches:
            ends, starts, illegal, last = [], [], [], []
            for conv, _, costs, first, closes, inside in zip(*(c.to_pylist() for c in batch.columns)):
                if (conv,) != now:
                    now, behind, opens = (conv,), END, None
                last.append(opens is None)
                illegal.append(inside + (opens is not None and closes + opens not in LEGAL))
                ends.append(list(behind))
                behind = [min(FAR, *(costs[4 * end + state] + behind[end] for end in STATES)) for state in STATES]
                starts.append(behind[START])
                opens = first
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ends, pa.list_(pa.int64())), pa.array(starts, pa.int64()), pa.array(illegal, pa.int64()), pa.array(last)], names=["conv_id", "segment", "ends", "cost", "illegal", "last"])

    behind = written(_ordered(prices, F.desc("segment")).mapInArrow(backwards, f"conv_id {kind}, segment long, ends array<long>, cost long, illegal long, last boolean"), "behind")

    def walked(part: pd.DataFrame) -> pd.DataFrame:
        turns, last = turns_of(part), bool(part["last"].iloc[0])
        costs = cost_to_go(turns, list(part["ends"].iloc[0]))
        ways = [walk(turns, costs, state, last) if costs[0][state] < FAR else (0, []) for state in STATES]
        return pd.DataFrame({"conv_id": part["conv_id"].iloc[:1].values, "segment": part["segment"].iloc[:1].values, "leads": [[w[0] for w in ways]], "ways": [[w[1] for w in ways]], "places": [part["place"].tolist()]})

    found = light.join(behind.select("conv_id", "segment", "ends", "last").toDF("b_conv", "b_segment", "ends", "last"), F.col("segment").eqNullSafe(F.col("b_segment")) & F.col("conv_id").eqNullSafe(F.col("b_conv"))).drop("b_conv", "b_segment")
    ways = found.groupBy("conv_id", "segment").applyInPandas(walked, f"conv_id {kind}, segment long, leads array<int>, ways array<array<string>>, places array<long>")

    def forwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = (), START
        for batch in batches:
            chosen = []
            for conv, leads, own in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if (conv,) != now:
                    now, state = (conv,), START
                chosen.append(own[state])
                state = leads[state]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(4), pa.array(chosen, pa.list_(pa.string()))], names=["conv_id", "places", "done"])

    done = _ordered(written(ways, "ways"), F.asc("segment")).mapInArrow(forwards, f"conv_id {kind}, places array<long>, done array<string>")
    done = done.select(F.explode(F.arrays_zip("places", "done")).alias("x")).select(F.col("x.places").alias("d_place"), F.col("x.done").alias("done"))
    turns = written(placed.join(done, F.col("place") == F.col("d_place")).drop("d_place", "segment"), "repaired")

    known = F.col("turn").isNotNull()
    times = turns.where(known).groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    faults = turns.groupBy("conv_id").agg(
        F.sum(F.when(F.col("fault") == BLANK, F.col("number")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("fault") == DUPLICATE, F.col("number")).when(F.col("fault") == BLANK, 0).otherwise(F.col("number") - 1)).alias("duplicate"),
        F.sum((F.col("fault") == TRUNCATED).cast("long")).alias("truncated"),
    )
    # the first segment's cost to the end is that of the whole
    whole = behind.groupBy("conv_id").agg(F.sum("illegal").alias("illegal"), F.min_by("cost", "segment").alias("cost"))
    key = lambda x, name: x.withColumnRenamed("conv_id", name)
    report = faults.join(key(whole, "w"), F.col("conv_id").eqNullSafe(F.col("w"))).join(key(times, "t"), F.col("conv_id").eqNullSafe(F.col("t")), "left").drop("w", "t")
    return report.withColumn("gaps", F.coalesce("gaps", F.lit(0))), turns


#: What a turn's codes make of it, as the repaired turns (role, text) in order.
_MADE = "transform(filter(split(done, ''), c -> c NOT IN ('D', '')), c -> struct(CASE WHEN c = 'K' THEN role WHEN c IN ('u', 'U') THEN 'user' ELSE 'assistant' END AS role, if(c IN ('u', 'a'), '', text) AS text))"


class Repaired:
    """The repaired conversations of a table of prepared() turns: whole ones a row each, longer ones a row for each turn."""

    def __init__(self, rows: DataFrame):
        spark = small_batches(rows.sparkSession)
        sizes = rows.groupBy("conv_id").agg(F.sum("copies").alias("turns"), F.sum(F.octet_length("text") * F.col("copies")).alias("bytes"))
        total = sizes.agg(F.sum("bytes").alias("bytes"), F.count_if((F.col("turns") > MAX_TURNS) | (F.col("bytes") > MAX_BYTES)).alias("long")).first()
        partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + (total["bytes"] or 0) // TASK_BYTES)
        self.report = self.turns = None
        if total["long"]:
            long = written(sizes.where((F.col("turns") > MAX_TURNS) | (F.col("bytes") > MAX_BYTES)).select(F.col("conv_id").alias("long_id")), "long")
            long = F.broadcast(long) if total["long"] <= MAX_BROADCAST_KEYS else long
            met = F.col("conv_id").eqNullSafe(F.col("long_id"))
            self.report, self.turns = _long(rows.join(long, met, "left_semi"))
            rows = rows.join(long, met, "left_anti")
        self.whole = _whole(rows, partitions)

    def repaired_turns(self) -> DataFrame:
        """(conv_id, place, slot, role, text): the turns that are left, in the order of place and slot."""
        out = self.whole.select("conv_id", F.lit(0).cast("long").alias("place"), F.posexplode("repaired").alias("slot", "turn"))
        if self.turns is not None:
            out = out.unionAll(self.turns.select("conv_id", "place", F.posexplode(F.expr(_MADE)).alias("slot", "turn")))
        return out.select("conv_id", "place", "slot", "turn.role", "turn.text")

    def digests(self) -> DataFrame:
        """(conv_id, report..., repaired_sha256): the repaired turns as role:text lines."""
        line = lambda turn: F.concat(turn["role"], F.lit(":"), turn["text"])
        names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
        out = self.whole.select(*names, F.sha2(F.array_join(F.transform("repaired", line), "\n"), 256).alias("repaired_sha256"))
        if self.turns is None:
            return out
        kind = self.turns.schema["conv_id"].dataType.simpleString()

        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, audit, sha, begun = (), [], None, False
            made: list[tuple] = []
            id_type = None
            for batch in batches:
                id_type = batch.schema.field(0).type
                release(batch.nbytes, settled=False)
                for conv, done, piece in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                    if (conv,) != now:
                        if sha is not None:
                            made.append((now[0], "".join(audit), sha.hexdigest()))
                        now, audit, sha, begun = (conv,), [], hashlib.sha256(), False
                    audit.append(done.translate(AUDIT))
                    if piece is not None:
                        sha.update(("\n" + piece if begun else piece).encode())
                        begun = True
            if sha is not None:
                made.append((now[0], "".join(audit), sha.hexdigest()))
                a, b, c = zip(*made)
                yield pa.RecordBatch.from_arrays([pa.array(a, id_type), pa.array(b), pa.array(c)], names=["h", "audit", "repaired_sha256"])

        lines = F.transform(F.expr(_MADE), line)
        pieces = self.turns.select("conv_id", "place", "done", F.when(F.size(lines) > 0, F.array_join(lines, "\n")).alias("piece"))
        long = _ordered(pieces, F.asc("place")).mapInArrow(hashed, f"h {kind}, audit string, repaired_sha256 string")
        long = self.report.join(long, F.col("conv_id").eqNullSafe(F.col("h"))).select(*names, "repaired_sha256")
        return out.unionAll(long)


def damaged(conversations: DataFrame) -> DataFrame:
    """The turns of a table with one fault in four of twenty, by the checksum of conversation and turn: some go, are emptied, lose the marks
    that end a sentence, stand twice, or are said to be the user's."""
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    rows = prepared(conversations, F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)).withColumn("kind", kind)
    said = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.withColumns({"text": said, "role": F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))}).drop("kind")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return Repaired(damaged(rows)).digests()



def _oracle() -> str:
    """Backward over each conversation's turns: for each state the least (cost, audit), and the lines that go with it."""
    state = dict(zip("zsua", ("[{k}]",) * 4))
    after = {"z": "u", "s": "u", "u": "a", "a": "u"}
    keeps = {"z": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    roles = {"u": "user", "a": "assistant"}
    put = lambda cost, letter, line, to: f"{{'c': {cost} + v{to}.c, 'a': '{letter}' || v{to}.a, 'r': list_prepend({line}, v{to}.r)}}"
    base, far = [], "{'c': 1000000000, 'a': '', 'r': []::VARCHAR[]}"
    for at in state:
        kept = "".join(f" WHEN t.i = '{i}' THEN {put('t.x', 'K', 't.role || chr(58) || t.text', to)}" for i, to in keeps[at].items())
        deleted = f"{{'c': 2 + v{at}.c, 'a': 'D' || v{at}.a, 'r': v{at}.r}}"
        changed = put("1 + t.x", "R", f"'{roles[after[at]]}:' || t.text", after[at])
        base.append(f"CASE WHEN t.fault IN (1, 2) THEN {deleted} ELSE list_min([{deleted}, {changed}, CASE{kept} ELSE {far} END]) END AS b{at}")
    insert = lambda to, of: f"{{'c': 5 + {of}{to}.c, 'a': 'I' || {of}{to}.a, 'r': list_prepend('{roles[to]}:', {of}{to}.r)}}"
    closed = f"list_min([bu, {insert('a', 'b')}]) AS vu, list_min([ba, {insert('u', 'b')}]) AS va"
    first = f"list_min([bz, {insert('u', 'v')}]) AS vz, list_min([bs, {insert('u', 'v')}]) AS vs"
    zero = "{'c': 0, 'a': '', 'r': []::VARCHAR[]}"
    relaxed = lambda frm: f"SELECT conv_id, n, vu, va, {first} FROM (SELECT *, {closed} FROM ({frm}))"
    return f"""WITH RECURSIVE crc AS (SELECT list(t ORDER BY n) AS table FROM (SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS t FROM range(256) x(n))),
e AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
k AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda c: ascii(c)::BIGINT)), lambda c, b: xor(c // 256, crc.table[xor(c, b) % 256 + 1])), 4294967295) % 20 AS kind FROM e, crc),
d AS (SELECT row_number() OVER () AS row, conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE kind WHEN 0 THEN []::INT[] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM k),
s AS (SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS shown FROM d),
f AS (SELECT conv_id, turn, role, text, left(role, 1) AS i, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, row, copy) AS n, count(*) OVER (PARTITION BY conv_id) AS last,
  CASE WHEN shown = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, row, copy) > 1 THEN 2 WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
  lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, row, copy) || left(role, 1) AS pair FROM s),
t AS (SELECT *, CASE fault WHEN 3 THEN 5 ELSE 0 END AS x FROM f),
v AS ({relaxed(f"SELECT conv_id, max(n) + 1 AS n, {zero} AS bz, {far} AS bs, {far} AS bu, {zero} AS ba FROM t GROUP BY conv_id")}
  UNION ALL {relaxed(f"SELECT t.conv_id, t.n, {', '.join(base)} FROM v JOIN t ON t.conv_id IS NOT DISTINCT FROM v.conv_id AND t.n = v.n - 1")}),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
  count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM t GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(v.vz.c, 0)::BIGINT AS cost, coalesce(v.vz.a, '') AS audit, sha256(coalesce(array_to_string(v.vz.r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN v ON v.conv_id IS NOT DISTINCT FROM c.conv_id AND v.n = 1"""


QUERIES = {"op11_conversation_repair": op11_conversation_repair}
ORACLES = {"op11_conversation_repair": _oracle()}
