r"""Operator 10: benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Texts are lower-cased and split into words ``[^\x20\x09-\x0D]+``.  An item is found in a document when the two,
aligned without gaps, agree in at least 80 % of SPAN consecutive item words (of all its words, if it has fewer).
An item of fewer than WHOLE words is found where all its words stand one after another.

Each mask reads five words and ignores the positions between them.  MASKS is lossless for this rule: for every
span of 8 to 20 words and every placing of the substitutions that the rule allows, one of the masks fits somewhere
without touching a substituted word (the tests go through all of them).  The hash of the masked words of every
document position is looked up among the benchmark's; around each hit the words of both are compared.  An item of fewer
than WHOLE words is one seed, of all its words.  All seeds start with two neighbouring words, so positions whose two words begin no
seed are dropped first; items of one word are looked up by it.

Items with the same words are one, which is named again by all their ids in the end.  They are cut into pieces of at most PIECE words,
which overlap so that each span lies whole in one.  A benchmark of at most BROADCAST_WORDS words in pieces (about 60 MB of seeds) is
broadcast, and the documents aren't shuffled: only the found pairs are, to drop repetitions.  A larger benchmark meets the documents'
seeds in one shuffle by seed; the hits, as one row for each document, piece and shift, then fetch the words of both and are compared in
the same way.  Either way the documents are read a fixed number of times.

No position carries its whole text: texts are cut into chunks of CHUNK words and those around them, and a position takes the words that a
span through it can reach.  Spark holds all rows that a row of input gives, so memory would else grow with the square of a text.  Words
longer than any of the benchmark's are blanked there.

Defined cases: null and empty texts, on either side, match nothing; repeated rows give one pair; a null doc_id or
item_id is a value like any other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.rows import column, fingerprint, without
from nearfield.llm.shared_store import written

MASKS = ((0, 1, 2, 4, 5), (0, 1, 4, 6, 7), (0, 1, 2, 3, 4))
SPAN, WHOLE, PIECE, BROADCAST_WORDS = 20, 8, 512, 200_000
#: Positions of a chunk, and items whose ids are broadcast.
CHUNK, BROADCAST_IDS = 1024, 1_000_000


def words_of(text: Column) -> Column:
    """The lower-cased words of a text; none for null and empty ones."""
    trimmed = F.btrim(F.lower(text.cast("string")), F.lit(" \t\n\x0b\f\r"))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))


def _seed(words: str, at: str, mask: tuple[int, ...]) -> Column:
    """Hash of the masked words from position at; null where the mask passes the end."""
    read = ", ".join(f"{words}[{at} + {i}]" for i in mask)
    return F.when(F.expr(f"{at} + {mask[-1]} < size({words})"), F.expr(f"xxhash64({read})"))


def _seeds(words: str, at: str, masks: dict[int, tuple[int, ...]]) -> Column:
    """One row for each mask that ends within the words."""
    seeds = F.array(*(F.struct(F.lit(number).alias("mask"), _seed(words, at, mask).alias("seed")) for number, mask in masks.items()))
    return F.explode_outer(F.filter(seeds, lambda s: s["seed"].isNotNull()))


def _pieces(benchmark: DataFrame, item_id: str, item_text: str) -> tuple[DataFrame, DataFrame]:
    """(piece, item, m, span, need, item_words): the pieces of all different items, m being the words of the whole item; and (item, item_id)."""
    items = benchmark.select(column(benchmark, item_id).alias("item_id"), words_of(column(benchmark, item_text)).alias("words")).where(F.size("words") > 0)
    different = written(items.select("words").distinct().withColumn("item", F.monotonically_increasing_id()), "benchmark-items")
    names = written(items.join(different, "words").select("item", "item_id").distinct(), "benchmark-ids")
    cut = different.select("item", "words", F.explode(F.expr(f"sequence(0, greatest(size(words) - {SPAN}, 0), {PIECE - SPAN + 1})")).alias("start"))
    span = F.least(F.lit(SPAN), F.col("m"))
    cut = cut.select("item", F.size("words").alias("m"), F.expr(f"slice(words, start + 1, {PIECE})").alias("item_words"))
    cut = cut.withColumn("span", span).withColumn("need", F.expr(f"if(m < {WHOLE}, m, (4 * span + 4) div 5)"))
    return written(cut.withColumn("piece", F.monotonically_increasing_id()), "benchmark-pieces"), names


def _positions(texts: DataFrame, keys: list[str], longest: int) -> DataFrame:
    """(keys..., chunk, place, at, begin): the positions of all texts but the last of each, at their place in a chunk of the text's words."""
    around, reach = "greatest(i - {0}, 0)".format(SPAN - 1), CHUNK + SPAN - 1
    own = f"transform(slice(words, {around} + 1, i + {reach} - {around}), w -> if(octet_length(w) <= {longest}, w, ''))"
    # the outer form keeps Spark from splitting every text a second time in a filter below it
    chunks = texts.select(*keys, F.explode_outer(F.expr(f"transform(sequence(0, greatest(size(words) - 1, 0), {CHUNK}), i -> struct(i, i - {around} AS before, {own} AS chunk))")).alias("c"))
    places = chunks.select(*keys, "c.*").select(*keys, "i", "before", "chunk", F.posexplode_outer("chunk").alias("place", "word"))
    places = places.where(f"place >= before AND place < before + {CHUNK} AND place + 1 < size(chunk)")
    return places.select(*keys, "chunk", "place", F.expr("i - before + place").alias("at"), F.expr("xxhash64(word, chunk[place + 1])").alias("begin"))


def _matches(texts: DataFrame, keys: list[str], benchmark: DataFrame, item_id: str, item_text: str) -> tuple[DataFrame, DataFrame]:
    """(keys..., item): the distinct pairs of texts(keys..., words) and items found in them; and (item, item_id)."""
    pieces, names = _pieces(benchmark, item_id, item_text)
    longest = F.max(F.expr("array_max(transform(item_words, w -> octet_length(w)))"))
    known = pieces.agg(F.sum(F.size("item_words")).alias("words"), longest.alias("longest"), F.collect_set(F.when(F.col("m") < WHOLE, F.col("m"))).alias("short")).first()
    small = (known["words"] or 0) <= BROADCAST_WORDS
    hint = F.broadcast if small else lambda frame: frame
    masks = {**dict(enumerate(MASKS)), **{-m: tuple(range(m)) for m in sorted(known["short"]) if m > 1}}

    placed = pieces.where("m > 1").select("piece", "m", "item_words", F.posexplode("item_words").alias("item_at", "item_word")).where(f"m >= {WHOLE} OR item_at = 0")
    seeds = placed.select("piece", "m", "item_at", F.expr("xxhash64(item_words[item_at], get(item_words, item_at + 1))").alias("begin"), _seeds("item_words", "item_at", masks).alias("s"))
    seeds = seeds.select("piece", "item_at", "begin", "m", "s.*").where(f"seed IS NOT NULL AND if(m < {WHOLE}, mask = -m, mask >= 0)" if known["short"] else "seed IS NOT NULL").drop("m")
    positions = _positions(texts, keys, known["longest"] or 0)
    if small:
        positions = positions.join(F.broadcast(seeds.select("begin").distinct()), "begin", "left_semi")
        # a span that holds a position starts at most SPAN - 1 words before it
        carried = [*keys, F.expr(f"slice(chunk, greatest(place - {SPAN - 2}, 1), {2 * SPAN - 1})").alias("words"), F.expr(f"least(place, {SPAN - 1})").alias("at")]
        positions = positions.select(*carried)
        hashed = positions.select(*keys, "words", "at", _seeds("words", "at", masks).alias("s")).select(*keys, "words", "at", "s.*").where("seed IS NOT NULL")
    else:
        hashed = positions.select(*keys, "at", _seeds("chunk", "place", masks).alias("s")).select(*keys, "at", "s.*").where("seed IS NOT NULL")
    hits = hashed.join(hint(seeds.drop("begin")), ["mask", "seed"])
    if small:
        hits = hits.join(F.broadcast(pieces), "piece")
        hits = hits.withColumn("first", F.expr("greatest(0, item_at - span + 1)")).withColumn("last", F.expr("least(size(item_words), item_at + span) - 1"))
        hits = hits.withColumn("shift", F.expr("at - item_at"))
    else:
        shifts = hits.select(*keys, "piece", F.expr("at - item_at").alias("shift")).distinct().join(pieces, "piece")
        same = F.lit(True)
        for key in keys:
            same = same & F.col(key).eqNullSafe(F.col(f"own_{key}"))
        hits = shifts.join(texts.select(*(F.col(key).alias(f"own_{key}") for key in keys), "words"), same)
        hits = hits.withColumn("first", F.lit(0)).withColumn("last", F.expr("size(item_words) - 1"))
    found = (
        hits.withColumn("same", F.expr("transform(sequence(first, last), i -> int(coalesce(get(words, shift + i) = item_words[i], false)))"))
        .where("aggregate(same, 0, (n, x) -> n + x) >= need")
        .where("exists(sequence(0, size(same) - span), o -> aggregate(slice(same, o + 1, span), 0, (n, x) -> n + x) >= need)")
        .select(*keys, "item")
    )
    if 1 in known["short"]:
        single = pieces.where("m = 1").select("item", F.expr("item_words[0]").alias("word"))
        found = found.unionAll(texts.select(*keys, F.explode(F.array_distinct("words")).alias("word")).join(hint(single), "word").select(*keys, "item"))
    return found.distinct(), names


def benchmark_matches(documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id): the distinct pairs of documents and the items found in them."""
    texts = documents.select(column(documents, doc_id).alias("doc_id"), words_of(column(documents, text)).alias("words"))
    found, names = _matches(texts, ["doc_id"], benchmark, item_id, item_text)
    if names.count() <= BROADCAST_IDS:
        names = F.broadcast(names)
    return found.join(names, "item").select(F.col("doc_id").alias(doc_id), F.col("item_id").alias(item_id)).distinct()


def decontaminate(documents: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows in whose text no item is found, judged one by one, whatever their doc_id."""
    own = fingerprint(column(documents, text))
    texts = documents.select(own[0].alias("k0"), own[1].alias("k1"), words_of(column(documents, text)).alias("words"))
    gone = written(_matches(texts, ["k0", "k1"], benchmark, "item_id", "text")[0].select("k0", "k1").distinct(), "contaminated")
    return without(documents, own, gone)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: Brute force: all pairs of equal words, counted by alignment.
ORACLE = r"""
WITH d AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p
           FROM (SELECT doc_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM documents)),
i AS (SELECT item_id, len(w) AS m, unnest(w) AS word, generate_subscripts(w, 1) AS q
      FROM (SELECT item_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM benchmark)),
e AS (SELECT doc_id, item_id, CASE WHEN m < 8 THEN m ELSE (4 * least(20, m) + 4) // 5 END AS need, p - q AS diagonal, q FROM d JOIN i USING (word)),
c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, item_id, diagonal) AS n FROM e),
r AS (SELECT *, count(*) OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY q RANGE BETWEEN CURRENT ROW AND 19 FOLLOWING) AS inside
      FROM c WHERE n >= need)
SELECT DISTINCT doc_id, item_id FROM r WHERE inside >= need
"""

QUERIES = {"op10_decontamination": op10_decontamination}
ORACLES = {"op10_decontamination": ORACLE}
