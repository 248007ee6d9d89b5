"""Operator 12: how far the sources of a language differ in the words they use, exactly and without dense tables.

Every (lang, source) group gives each kept term of its language a smoothed share p.  The distance of two groups is the sum of abs(p - q)
over all V kept terms, though most of them occur in few groups.  It is taken apart by supports, the terms that a group holds:

* one-sided terms: were the other group without a term, it would give it one constant, so a group's whole support costs as much as its
  histogram of counts against that constant (a row for each different count, not for each term);
* overlaps: a term that both hold was priced twice by that, once from each side; a join of the postings (lang, term) corrects these;
* terms that neither holds: a constant, times V less both supports, plus the overlap by inclusion and exclusion.

Counting runs in Arrow batches: each task adds up its own documents by group and term, and sends a row for each; all else are
joins and sums.  Joins by language alone are salted, as one language may hold most groups.

Shares are integers: 1 + floor(1e9 * (count + 5) / (N + 5 * V)), in decimals that hold them exactly.

Defined cases: null text, lang and source are empty ones; a group without kept terms still takes part, with count 0 everywhere; where a
language keeps no term, its pairs have the value 0 and no term is listed; repeated rows count as often as they stand there; equal values
rank by the item's UTF-8 bytes; texts of any length are taken whole, one row at a time; an empty table gives no rows; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearfield.llm.rows import column
from nearfield.llm.shared_store import small_batches, written
from nearfield.llm.text_kernels import release

MIN_DOCUMENTS, PRIOR, TOP = 30, 5, 50
#: Distinct (group, term) entries that a task holds before it sends them.
HELD_ENTRIES = 400_000
#: Pieces into which the groups of one language are dealt where they meet by language alone.
SALTS = 32

#: Terms are runs of ASCII letters and of all that isn't ASCII; only A-Z are lower-cased.
_TO_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def term_counts(documents: DataFrame, text: Column, lang: Column, source: Column) -> DataFrame:
    """(lang, source, term, cnt, docs): occurrences and documents; each group also has a row with a null term."""
    small_batches(documents.sparkSession)
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    rows = documents.select(blank(lang).alias("lang"), blank(source).alias("source"), F.coalesce(text.cast("binary"), F.lit(b"")).alias("text"))

    def send(held: dict) -> Iterator[pa.RecordBatch]:
        for (one, other), (cnt, docs) in held.items():
            n = len(docs) + 1
            terms = pa.array([None, *docs], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([one] * n), pa.array([other] * n), terms, pa.array([0, *(cnt[t] for t in docs)], pa.int64()), pa.array([0, *docs.values()], pa.int64())], names=["lang", "source", "term", "cnt", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, entries = defaultdict(lambda: (Counter(), Counter())), 0
        for batch in batches:
            for one, other, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                cnt, docs = held[one, other]
                before = len(docs)
                own = Counter(raw.as_py().translate(_TO_TERMS).split())
                cnt.update(own)
                docs.update(own.keys())
                entries += len(docs) - before
            release(batch.nbytes, settled=False)
            if entries > HELD_ENTRIES:
                yield from send(held)
                held.clear()
                entries = 0
        yield from send(held)

    partial = rows.mapInArrow(run, "lang string, source string, term string, cnt long, docs long")
    return partial.groupBy("lang", "source", "term").agg(F.sum("cnt").alias("cnt"), F.sum("docs").alias("docs"))


def _share(count: Column, total: Column, kept: Column, prior: int) -> Column:
    """1 + floor(1e9 * (count + prior) / (total + prior * kept)), exactly; null where no term is kept."""
    up = F.lit(1_000_000_000).cast("decimal(10,0)") * (count + prior).cast("decimal(19,0)")
    down = (total + F.lit(prior) * kept).cast("decimal(19,0)")
    return F.when(kept > 0, F.lit(1) + F.call_function("div", up, down))


def _apart(a: str, b: str) -> Column:
    return F.abs(F.col(a) - F.col(b))


def _by_language(left: DataFrame, right: DataFrame, spread: Column) -> DataFrame:
    """left beside the rows of right with its lang; left's rows of a language are dealt into SALTS pieces, each of which meets right's."""
    salted = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("salt", F.col("salt").cast("long"))
    return left.withColumn("salt", F.pmod(spread, F.lit(SALTS))).join(salted, ["lang", "salt"]).drop("salt")


class SourceDivergence:
    """Groups, kept terms and postings of a corpus; what is asked of them are frames."""

    def __init__(self, documents: DataFrame, min_documents: int = MIN_DOCUMENTS, prior: int = PRIOR, text_col: str = "text", lang_col: str = "lang", source_col: str = "source"):
        counts = written(term_counts(documents, *(column(documents, c) for c in (text_col, lang_col, source_col))), "terms")
        kept = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("cnt").alias("lang_cnt")).where(F.col("docs") >= min_documents)
        own = counts.where("term IS NOT NULL").join(kept, ["lang", "term"]).select("lang", "source", "term", "cnt", "lang_cnt")
        own = written(own, "kept")
        # a row for each language, and one for each group: sums by key, far fewer than terms
        langs = own.select("lang", "term", "lang_cnt").distinct().groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_cnt").alias("lang_n"))
        sizes = own.groupBy("lang", "source").agg(F.sum("cnt").alias("n"), F.count("*").alias("held"))
        groups = counts.where("term IS NULL").select("lang", "source").distinct().join(langs, "lang", "left").join(sizes, ["lang", "source"], "left")
        groups = groups.na.fill(0, ["v", "lang_n", "n", "held"])
        #: (lang, source, v, lang_n, n, held, zero): zero is the share of a term that the group lacks.
        self.groups = written(groups.withColumn("zero", _share(F.lit(0), F.col("n"), F.col("v"), prior)), "groups")
        shared = own.join(self.groups.select("lang", "source", "v", "lang_n", "n", "zero"), ["lang", "source"])
        #: (lang, source, term, cnt, p, q, zero) of each kept term that the group holds: the group's share and its language's.
        self.postings = written(shared.select("lang", "source", "term", "cnt", _share(F.col("cnt"), F.col("n"), F.col("v"), prior).alias("p"), _share(F.col("lang_cnt"), F.col("lang_n"), F.col("v"), prior).alias("q"), "zero"), "postings")

    def pairs(self) -> DataFrame:
        """(lang, source, item, value) for each group and each other source of its language."""
        groups = self.groups.select("lang", "source", "v", "held", "zero")
        other = groups.select("lang", F.col("source").alias("item"), F.col("held").alias("item_held"), F.col("zero").alias("item_zero"))
        both = _by_language(groups, other, F.xxhash64("source")).where("source <> item")
        constant = both.select("lang", "source", "item", F.coalesce((F.col("v") - F.col("held") - F.col("item_held")) * _apart("zero", "item_zero"), F.lit(0)).alias("value"))
        histogram = self.postings.groupBy("lang", "source", "p").agg(F.count("*").alias("terms"))
        sided = _by_language(histogram, other.drop("item_held"), F.xxhash64("source", "p")).where("source <> item")
        sided = sided.groupBy("lang", "source", "item").agg(F.sum(F.col("terms") * _apart("p", "item_zero")).alias("value"))
        left = self.postings.select("lang", "term", "source", "p", "zero")
        right = left.select("lang", "term", *(F.col(c).alias(f"item_{c}") for c in ("source", "p", "zero")))
        shared = left.join(right, ["lang", "term"]).where("source < item_source")
        over = _apart("p", "item_p") - _apart("p", "item_zero") - _apart("zero", "item_p") + _apart("zero", "item_zero")
        shared = shared.groupBy("lang", "source", F.col("item_source").alias("item")).agg(F.sum(over).alias("value"))
        swapped = lambda x: x.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
        parts = constant.unionAll(sided).unionAll(swapped(sided)).unionAll(shared).unionAll(swapped(shared))
        return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    def terms(self) -> DataFrame:
        """(lang, source, item, value) of the terms that a group holds and gives a larger share than its language does."""
        return self.postings.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))


def _ranked(part: str, rows: DataFrame, most: int | None = None) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item")))
    out = rows.withColumn("rank", rank)
    out = out.where(F.col("rank") <= most) if most else out
    return out.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")


def source_divergence(documents: DataFrame, top: int = TOP, **settings) -> DataFrame:
    """(lang, source, part, item, value, rank): all other sources of the language by distance, and the top terms that mark the group."""
    found = SourceDivergence(documents, **settings)
    return _ranked("pair", found.pairs()).unionAll(_ranked("term", found.terms(), top))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_SHARE_SQL = "1 + (1000000000::HUGEINT * ({c} + 5)) // ({n} + 5 * {v})"

ORACLE = f"""WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{80}}-\\x{{10FFFF}}]+') AS terms FROM documents),
o AS (SELECT row, lang, source, unnest(terms) AS term FROM d),
k AS (SELECT lang, term, count(*) AS lang_c FROM o GROUP BY ALL HAVING count(DISTINCT row) >= 30),
l AS (SELECT lang, count(*) AS v, sum(lang_c) AS lang_n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS c FROM o SEMI JOIN k USING (lang, term) GROUP BY ALL),
s AS (SELECT g.lang, g.source, coalesce(sum(c.c), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.c, 0) AS c, {_SHARE_SQL.format(c="coalesce(c.c, 0)", n="s.n", v="l.v")} AS p, {_SHARE_SQL.format(c="k.lang_c", n="l.lang_n", v="l.v")} AS q
  FROM s JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE c > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM r QUALIFY part = 'pair' OR rank <= 50"""

QUERIES = {"op12_source_divergence": op12_source_divergence}
ORACLES = {"op12_source_divergence": ORACLE}
