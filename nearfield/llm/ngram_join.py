r"""Operator 6: n-gram Jaccard join with a token-group matrix, and the components of its links.

A document's set holds the distinct SHINGLE-word shingles of its lower-cased (A-Z) words ``[^\x20\x09-\x0D]+``; two
documents link when 100 * |intersection| >= 80 * |union|.

The bound of a token-group matrix, |q & U(G)| >= overlap of q with any member of the group G, whose tokens' union is U(G), is
used on two levels:

1. G is the whole corpus.  A merged count-min sketch (bounded size, see count_min) says which tokens occur in two documents or
   more, never missing one.  A document of which fewer than 80 % of the tokens do can link to nothing, and is done.
2. The remaining documents, one for each different set, are partitioned into groups of similar ones (_similar), held in parts of
   bounded size.
   a. A part's members are compared with each other, and in a group of several parts with HUBS sets of the whole group too.  What links
      here is one group from now on, cut into parts again; sets that linked with nothing keep their group.
   b. The matrix: each part's token union is stored.  A set's prefix is the first n - ceil(0.8 n) + 1 of its tokens in an order that puts
      rare ones first; linked sets share a prefix token.  A query asks the parts of other groups that share one with it and whose sets'
      sizes allow a link, one of two groups asking the other; sets of one group are known to be connected and never ask each other.
   c. The bound: a query whose overlap with a part's union is under 80 % of the query is done with it.  The union of a part of one
      set is that set, so its overlap decides the link.
   d. Only parts that qualify for some query are opened: their members are sent to the queries that qualified, and the overlaps with all
      members are counted at once along the union's lists of holders.

   A part's queries are dealt by hash into slices of about the size that a part may have, so that a task's work is bounded however many
   queries a part has.  Pairs of documents exist only inside a task, which returns a spanning forest of the links it found.  In a group of
   near copies nearly all sets connect in step a, with work in proportion to the group.

Sets are compared by 64-bit hashes of their shingles, and are one by a 128-bit hash; these aren't verified word for word.

Defined cases: an empty or null text has no shingles and links with nothing; a row with a null doc_id gets its n_shingles and
a null component_id, and links nothing; rows that share a doc_id are separate rows that may link; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearfield.llm import count_min
from nearfield.llm.components import connected_components
from nearfield.llm.rows import MAX_BROADCAST_KEYS, all_columns, column, fingerprint, quoted, without
from nearfield.llm.shared_store import small_batches, written
from nearfield.llm.text_kernels import LOWER, ragged_positions, release, slices, text_bytes, window_hashes, word_hashes, word_spans

SHINGLE, PERCENT, COMMON, LEAST, HUBS = 5, 80, 32, 4, 16
#: Sets and tokens in a part of a group, at most (a larger set is alone in its part).
PART_SETS, PART_TOKENS = 1024, 250_000


def least_overlap(n):
    """ceil(PERCENT / 100 * n): tokens that a set of n must share with a linked one, at least."""
    return (PERCENT * n + 99) // 100


def shingle_sets(part: pa.RecordBatch, text: int) -> Iterator[np.ndarray]:
    """The ascending distinct shingle hashes of each text."""
    data, offsets = text_bytes(part.column(text))
    data = LOWER[data]
    starts, ends, ranges = word_spans(data, offsets)
    hashes = word_hashes(data, starts, ends)
    shingles = window_hashes(hashes, SHINGLE)
    for start, stop in zip(ranges[:-1].tolist(), ranges[1:].tolist()):
        if stop - start >= SHINGLE:
            own = np.sort(shingles[start : stop - SHINGLE + 1])
            yield own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif stop > start:
            yield window_hashes(hashes[start:stop], stop - start, seed=stop - start)
        else:
            yield np.zeros(0, np.uint64)


def token_sketch(texts: DataFrame, text_bytes_total: int) -> count_min.Sketch:
    """How many documents hold each token, estimated as far as 2 and COMMON."""
    width = count_min.width_for(text_bytes_total / 6.5, load=1.0)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                for own in shingle_sets(part, 1):
                    held.append(own)
                    size += len(own)
                if size > 1 << 21:
                    yield from count_min.partial_rows(np.concatenate(held), width, 1, COMMON)
                    held, size = [], 0
        if held:
            yield from count_min.partial_rows(np.concatenate(held), width, 1, COMMON)

    return count_min.merged(texts.mapInArrow(sketch, count_min.PARTIAL), width, 1, (2, COMMON))


def _sets(texts: DataFrame, sketch) -> DataFrame:
    """(doc_id, k0, k1, n, set, tokens, prefix, least); the last three are null for documents that can't link to another set.

    texts holds doc_id, text, and the text's fingerprint k0, k1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sizes, names, tokens, prefixes, least = [], [], [], [], []
                sets = list(shingle_sets(part, 1))
                every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                shared, common = (sketch.value.at_least(every, t) for t in (2, COMMON))
                at = 0
                for own in sets:
                    n, mine = len(own), slice(at, at + len(own))
                    at += n
                    sizes.append(n)
                    names.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if n else None)
                    if not n or np.count_nonzero(shared[mine]) < least_overlap(n):
                        tokens.append(None)
                        prefixes.append(None)
                        least.append(None)
                        continue
                    # tokens of one document alone come first, common ones last
                    order = np.argsort(shared[mine].astype(np.int8) + common[mine], kind="stable")[: n - least_overlap(n) + 1]
                    tokens.append(own.tobytes())
                    prefixes.append(own[order][shared[mine][order]].view(np.int64))
                    least.append(own[:LEAST].view(np.int64))
                arrays = [part.column(0), part.column(2), part.column(3), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.array(tokens, pa.binary()), *(pa.array(x, pa.list_(pa.int64())) for x in (prefixes, least))]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "k0", "k1", "n", "set", "tokens", "prefix", "least"])

    return texts.mapInArrow(run, "doc_id long, k0 long, k1 long, n long, set binary, tokens binary, prefix array<long>, least array<long>")


def _array(packed) -> np.ndarray:
    return np.frombuffer(packed.as_buffer(), dtype=np.uint64)


def _similar(sets: DataFrame) -> DataFrame:
    """(set, grp): the group of each set.

    Of a set's LEAST smallest tokens, the one that most sets have among theirs names its group; sets that share most of their
    tokens mostly choose alike.
    """
    least = sets.select("set", F.explode("least").alias("token"))
    popular = least.groupBy("token").agg(F.count("*").alias("holders"))
    chosen = least.join(popular, "token").groupBy("set").agg(F.max(F.struct("holders", "token")).alias("c"))
    return chosen.select("set", F.encode(F.concat(F.lit("token "), F.col("c.token").cast("string")), "utf-8").alias("grp"))


def _in_parts(sets: DataFrame) -> DataFrame:
    """sets(set, n, grp...) with part, a bounded piece of its group, and the number of pieces of the group."""
    pieces = sets.groupBy("grp").agg(F.greatest(F.expr(f"ceil(count(*) / {PART_SETS})"), F.expr(f"ceil(sum(n) / {PART_TOKENS})")).alias("pieces"))
    return sets.join(pieces, "grp").withColumn("part", F.struct("grp", F.pmod(F.xxhash64("set"), F.col("pieces")).alias("piece")))


def _spanning(left: list[bytes], right: list[bytes], links: list[tuple[int, int]]) -> pa.Table:
    """Links (i of left, j of right) as a forest: as few edges as give the same components."""
    root: dict[bytes, bytes] = {}

    def find(x: bytes) -> bytes:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    edges = []
    for i, j in links:
        a, b = find(left[i]), find(right[j])
        if a != b:
            root[a] = b
            edges.append((left[i], right[j]))
    return pa.table({"a": pa.array([e[0] for e in edges], pa.binary()), "b": pa.array([e[1] for e in edges], pa.binary())})


def search_part(queries: list[np.ndarray], members: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """(query, members that link to it), for the queries that open the part."""
    sizes = np.array([len(m) for m in members])
    every = np.concatenate(members)
    order = np.argsort(every, kind="stable")
    owner = np.repeat(np.arange(len(members)), sizes)[order]
    union, starts, holders = np.unique(every[order], return_index=True, return_counts=True)
    for i, query in enumerate(queries):
        at = np.minimum(np.searchsorted(union, query), len(union) - 1)
        at = at[union[at] == query]
        if len(at) < least_overlap(len(query)):
            continue  # the union of the part's tokens holds too few of the query's: no member can link
        common = np.bincount(owner[ragged_positions(starts[at], holders[at])], minlength=len(members))
        yield i, np.flatnonzero(100 * common >= PERCENT * (len(query) + sizes - common))


def _links_in_parts(sets: DataFrame) -> DataFrame:
    """(a, b): links between sets of one part, and between them and their group's hubs."""
    counts = sets.groupBy("part").agg(F.count("*").alias("members"))
    members = sets.join(counts, "part").where("members > 1 OR pieces > 1").select("part", "set", "tokens")
    cut = sets.where("pieces > 1")
    first = F.row_number().over(Window.partitionBy("grp").orderBy("set"))
    hubs = cut.withColumn("at", first).where(F.col("at") <= HUBS).select("grp", "set", "tokens")
    sent = cut.select("part", "grp").distinct().join(hubs, "grp").select("part", "set", "tokens")

    def link(table: pa.Table) -> pa.Table:
        release(table.nbytes)
        names, held = table.column("set").to_pylist(), [_array(x) for x in table.column("tokens")]
        return _spanning(names, names, [(i, int(j)) for i, found in search_part(held, held) for j in found])

    return members.unionAll(sent).groupBy("part").applyInArrow(link, "a binary, b binary")


def _matrix(light: DataFrame, tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(part, members, least, most): the parts; and (part, union, one) with each part's token union, and its only set if it has one."""
    parts = written(light.groupBy("part").agg(F.count("*").alias("members"), F.min("n").alias("least"), F.max("n").alias("most")), "parts")

    def union(table: pa.Table) -> pa.Table:
        release(table.nbytes)
        every = np.unique(np.concatenate([_array(x) for x in table.column("tokens")]))
        return pa.table({"part": table.column("part").slice(0, 1), "union": pa.array([every.tobytes()], pa.binary()), "one": pa.array([None], pa.binary())})

    held = light.select("part", "set").join(parts.select("part", "members"), "part").join(tokens, "set")
    stored = held.where("members > 1").select("part", "tokens").groupBy("part").applyInArrow(union, f"part {_PART}, union binary, one binary")
    single = held.where("members = 1").select("part", F.col("tokens").alias("union"), F.col("set").alias("one"))
    return parts, written(stored, "token-groups").unionAll(single)


_PART = "struct<grp:binary,piece:bigint>"


def _candidates(light: DataFrame, parts: DataFrame) -> DataFrame:
    """(set, n, part): the parts that each query asks."""
    groups = light.groupBy("grp").agg(F.count("*").alias("size"))
    held = light.select("grp", "part", F.explode("prefix").alias("token")).distinct()
    tokens = held.select("grp", "token").distinct().join(groups, "grp")
    asking = light.join(groups, "grp").select("set", "n", F.col("grp").alias("own"), F.col("size").alias("own_size"), F.col("part.piece").alias("own_piece"), "alone", "before", F.explode("prefix").alias("token"))
    # of two groups the smaller one asks; sets that are alone ask the other pieces of their group too
    pairs = asking.join(tokens, "token").where("struct(own_size, own) < struct(size, grp) OR (own = grp AND alone AND before > 1)").select("set", "n", "own", "own_piece", "grp", "token")
    asked = pairs.join(held, ["grp", "token"]).where("own <> grp OR own_piece <= part.piece").select("set", "n", "part").distinct()
    return asked.join(parts, "part").where(f"100 * most >= {PERCENT} * n AND 100 * n >= {PERCENT} * least").select("set", "n", "part")


def _links_across(light: DataFrame, tokens: DataFrame) -> DataFrame:
    """(a, b): links between sets of different groups, or of different pieces of a group, as many as keep their components."""
    parts, unions = _matrix(light, tokens)
    asked = written(_candidates(light, parts), "asked-parts")
    slices_of = F.greatest(F.expr(f"ceil(count(*) / {PART_SETS})"), F.expr(f"ceil(sum(n) / {PART_TOKENS})"))
    load = asked.groupBy("part").agg(slices_of.alias("slices"))
    # another seed than that of _in_parts, so that one part's sets go to all slices
    own_slice = F.pmod(F.xxhash64("set", F.lit(1)), F.col("slices"))
    queries = asked.join(load, "part").select("part", own_slice.alias("slice"), "set").join(tokens, "set").select("part", "slice", "set", "tokens")
    bounds = unions.join(load, "part").select("part", F.explode(F.expr("sequence(0, slices - 1)")).alias("slice"), "union", "one")

    def bound(left: pa.Table, right: pa.Table) -> pa.Table:
        release(left.nbytes + right.nbytes)
        at, links = [], []
        if len(left) and len(right):
            union, one = _array(right.column("union")[0]), right.column("one")[0].as_py()
            for i, query in enumerate(_array(x) for x in left.column("tokens")):
                common = _overlap(union, query)
                if common >= least_overlap(len(query)) and (one is None or 100 * common >= PERCENT * (len(query) + len(union) - common)):
                    at.append(i)
                    links.append(one)
        chosen = left.select(["part", "slice", "set"]).take(pa.array(at, pa.int64()))
        return chosen.append_column("link", pa.array(links, pa.binary()))

    qualified = written(queries.groupBy("part", "slice").cogroup(bounds.groupBy("part", "slice")).applyInArrow(bound, f"part {_PART}, slice bigint, set binary, link binary"), "qualified")
    direct = qualified.where("link IS NOT NULL").select(F.col("set").alias("a"), F.col("link").alias("b"))
    opening = qualified.where("link IS NULL").select("part", "slice", "set")
    opened = light.select("part", "set").join(opening.select("part", "slice").distinct(), "part").join(tokens, "set")
    # columns of their own: both sides come from the same tables
    opened = opened.select(*(F.col(c).alias(f"{c}_in") for c in ("part", "slice", "set", "tokens")))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        release(left.nbytes + right.nbytes)
        names, owned = left.column("set").to_pylist(), right.column("set_in").to_pylist()
        links = []
        if names and owned:
            for i, found in search_part([_array(x) for x in left.column("tokens")], [_array(x) for x in right.column("tokens_in")]):
                links += ((i, int(j)) for j in found)
        return _spanning(names, owned, links)

    return direct.unionAll(opening.join(tokens, "set").select("part", "slice", "set", "tokens").groupBy("part", "slice").cogroup(opened.groupBy("part_in", "slice_in")).applyInArrow(search, "a binary, b binary"))


def _overlap(union: np.ndarray, query: np.ndarray) -> int:
    at = np.minimum(np.searchsorted(union, query), len(union) - 1)
    return int(np.count_nonzero(union[at] == query))


def _regrouped(sets: DataFrame, near: DataFrame) -> DataFrame:
    """(set, n, prefix, before, alone, grp, part, pieces): one group for what near links, and the old ones of before pieces for the rest."""
    roots = connected_components(near).select(F.col("node").alias("set"), "root")
    light = sets.select("set", "n", "prefix", "grp", F.col("pieces").alias("before")).join(roots, "set", "left")
    return _in_parts(light.select("set", "n", "prefix", "before", F.col("root").isNull().alias("alone"), F.coalesce("root", "grp").alias("grp")))


def _components(sets: DataFrame) -> DataFrame:
    """(node, root) of all sets that link with another one."""
    sets = written(_in_parts(sets.join(_similar(sets), "set")).drop("least"), "set-groups")
    tokens = sets.select("set", "tokens")
    near = written(_links_in_parts(sets), "links-in-parts")
    light = written(_regrouped(sets, near), "set-parts")
    return connected_components(near.unionAll(_links_across(light, tokens)))


def _grouped_rows(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, k0, k1, n, first) for each row: first is the least (doc_id, k0, k1) of its component."""
    spark = small_batches(documents.sparkSession)
    text = column(documents, text_col).cast("string")
    hashes = fingerprint(column(documents, text_col))
    texts = documents.select(column(documents, id_col).cast("long").alias("doc_id"), text.alias("text"), *(h.alias(f"k{i}") for i, h in enumerate(hashes)))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = written(_sets(texts, spark.sparkContext.broadcast(token_sketch(texts, total))), "sets")
    identified = rows.where("doc_id IS NOT NULL")
    one = [F.first(c).alias(c) for c in ("n", "tokens", "prefix", "least")]
    sets = identified.where("size(prefix) > 0").groupBy("set").agg(*one)
    roots = _components(sets)
    groups = roots.select(F.col("node").alias("set"), F.col("root").alias("grp"))
    firsts = identified.where("n > 0").groupBy("set").agg(F.min(F.struct("doc_id", "k0", "k1")).alias("first")).join(groups, "set", "left").withColumn("grp", F.coalesce("grp", "set"))
    smallest = firsts.groupBy("grp").agg(F.min("first").alias("first"))
    components = firsts.select("set", "grp").join(smallest, "grp").select("set", "first")
    return rows.select("doc_id", "k0", "k1", "n", "set").join(components, "set", "left").drop("set")


def similar_groups(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row."""
    rows = _grouped_rows(documents, id_col, text_col)
    component = F.when(F.col("n") > 0, F.col("first.doc_id")).otherwise(F.col("doc_id"))
    return rows.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))


def one_of_each_group(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without the rows that another row of their component stands for.

    Of a component one row stays, one with its smallest doc_id: where rows of that doc_id differ in their texts, the one whose text's
    fingerprint is least, and where they don't, any one of these repeated rows.  Rows without doc_id or words stay.
    """
    linked = _grouped_rows(documents, id_col, text_col).where("n > 0 AND doc_id IS NOT NULL")
    keys = linked.groupBy("doc_id", "k0", "k1").agg(F.count("*").alias("rows"), F.any_value("first").alias("first"))
    chosen = F.expr("doc_id = first.doc_id AND k0 = first.k0 AND k1 = first.k1")
    gone = written(keys.where(~chosen | (F.col("rows") > 1)).select("doc_id", "k0", "k1", chosen.alias("repeated")), "linked-rows")
    own = [column(documents, id_col).cast("long"), *fingerprint(column(documents, text_col))]
    kept = without(documents, own, gone.drop("repeated"))
    repeated = gone.where("repeated").select(*(F.col(c).alias(f"__{c}") for c in ("doc_id", "k0", "k1")))
    n = repeated.count()
    if not n:
        return kept
    if n <= MAX_BROADCAST_KEYS:
        repeated = F.broadcast(repeated)
    names = [repeated[c] for c in repeated.columns]
    again = documents.join(repeated, (own[0] == names[0]) & (own[1] == names[1]) & (own[2] == names[2]))
    again = again.select(*(c.alias(f"k{i}") for i, c in enumerate(names)), F.struct(*all_columns(documents)).alias("row"))
    # each task sends one row of each key
    one = again.groupBy("k0", "k1", "k2").agg(F.first("row").alias("row"))
    return kept.unionAll(one.select(*(F.expr(f"row.{quoted(c)}").alias(c) for c in documents.columns)))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [md5(array_to_string(w, ' '))]
      ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: md5(array_to_string(w[i:i + 4], ' ')))) END AS s FROM d),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS token FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b USING (token) WHERE a.doc_id < b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT doc_id, doc_id AS reached FROM s UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reached)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id FROM s JOIN (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id) USING (doc_id)
"""

QUERIES = {"op6_ngram_join": op6_ngram_join}
ORACLES = {"op6_ngram_join": ORACLE}
