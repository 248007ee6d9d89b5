"""The letter model of toxicity.py as Spark tables, for more expressions than one process should hold.

The same counts, probabilities and fallback weights as kneser_ney's, by grouped sums and equi-joins over all expressions.  A key is
an expression of k letters, or a context of k letters, with k (or 8 + k) in its highest byte.  The model that is broadcast holds the
ratios of the most frequent expressions only; each document's other expressions are looked up in the tables by joins, so
that which of the two ways an expression goes changes no score.  Looked-up ratios are added in units of 1 / UNIT: their sums
don't depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.llm.shared_store import small_batches, written
from nearfield.llm.text_kernels import ragged_positions, slices

UNIT = 1 << 32
_CONTEXT = 8


@dataclass
class TableModel:
    """Ascending keys with the ratios of the most frequent expressions; the table (key, value) of all expressions and contexts, and
    its part of at most two letters, which is at most 66,048 rows."""

    keys: np.ndarray
    ratios: np.ndarray
    table: DataFrame
    short: DataFrame
    unknown: float
    slope: float = 0.0
    offset: float = 0.0
    bend: float = 0.0
    knee: float = 0.0

    def score(self, x: Column) -> Column:
        y = F.lit(self.slope) * x + F.lit(self.bend) * F.greatest(x - F.lit(self.knee), F.lit(0.0)) + F.lit(self.offset)
        return 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), y))))


def _last(gram: str, k: int) -> str:
    return f"(({gram}) & {(1 << 8 * k) - 1}L)"


def _key(gram: str, k: int, kind: int = 0) -> str:
    return f"({_last(gram, k)} | {(kind + k) << 56}L)"


def _letters(key: str) -> Column:
    return F.expr(f"shiftright({key}, 56) & 7")


def _least_uses(counted: DataFrame, head: int) -> int:
    """The least power of two of uses that at most head of the expressions reach."""
    total, powers = 0, counted.groupBy(F.floor(F.log2("uses")).cast("int").alias("power")).count().collect()
    for power, n in sorted(powers, reverse=True):
        total += n
        if total > head:
            return 1 << power + 1
    return 1


def table_model(counts: DataFrame, order: int, discount: float, first: int, head: int) -> TableModel:
    """The model of (gram, size, c0, c1), each distinct (gram, size) once and with occurrences of both classes among them."""
    levels = {}
    for k in range(order, 0, -1):
        own = counts.where((F.col("size") == k) & (F.col("c0") + F.col("c1") > 0)).selectExpr("gram", "double(c0) AS n0", "double(c1) AS n1")
        if k < order:
            kinds = levels[k + 1].selectExpr(f"{_last('gram', k)} AS gram", "double(n0 > 0) AS n0", "double(n1 > 0) AS n1")
            own = own.unionAll(kinds).groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        levels[k] = written(own, f"letters{k}")
    pooled = levels[1].selectExpr("sum(n0 + n1) AS total", "count(*) AS letters").first()
    lower, parts, unknown = None, [], 0.0
    for k in range(1, order + 1):
        own = levels[k].withColumn("context", F.shiftright("gram", 8))
        sums = [f for c in (0, 1) for f in (F.sum(f"n{c}").alias(f"t{c}"), F.count_if(F.col(f"n{c}") > 0).alias(f"f{c}"))]
        contexts = own.groupBy("context").agg(*sums)
        for c in (0, 1):
            contexts = contexts.withColumn(f"w{c}", F.expr(f"if(t{c} > 0, {discount}D * f{c} / greatest(t{c}, 1D), 1D)"))
        if k == 1:
            (row,) = contexts.collect()
            unknown = float(np.log(row.w1 / row.w0))
            shared = F.expr(f"(n0 + n1 + 1) / {pooled.total + pooled.letters + 1!r}D")
            joined = own.join(F.broadcast(contexts), "context").withColumn("q0", shared).withColumn("q1", shared)
        else:
            parts.append(contexts.selectExpr(f"{_key('context', k - 1, _CONTEXT)} AS key", "ln(w1 / w0) AS value"))
            joined = own.join(contexts, "context").withColumn("suffix", F.expr(_last("gram", k - 1))).join(lower.selectExpr("gram AS suffix", "p0 AS q0", "p1 AS q1"), "suffix")
        p = [F.expr(f"greatest(n{c} - {discount}D, 0D) / greatest(t{c}, 1D) + w{c} * q{c}").alias(f"p{c}") for c in (0, 1)]
        lower = written(joined.select("gram", *p), f"ratios{k}")
        parts.append(lower.selectExpr(f"{_key('gram', k)} AS key", "ln(p1 / p0) AS value"))
    table = written(reduce(DataFrame.unionAll, parts), "letters")
    common = counts.where(F.col("size") > first).selectExpr("gram | shiftleft(size, 56) AS key", "c0 + c1 AS uses").where("uses > 0")
    common = common.where(F.col("uses") >= _least_uses(common, head)).join(table, "key").select("key", "value").toArrow()
    keys = common.column("key").to_numpy().astype(np.uint64)
    at = np.argsort(keys)
    return TableModel(keys[at], common.column("value").to_numpy()[at], table, table.where(_letters("key") <= 2), unknown)


def looked_up(wanted: DataFrame, model: TableModel, order: int) -> DataFrame:
    """(key, ratio): the ratio of each distinct key of an expression, in units; without a row it is the unknown one's."""
    asked = []
    for k in range(1, order + 1):
        asked.append(f"struct({k} AS k, true AS known, {_key('key', k)} AS at)")
        if k > 1:
            asked.append(f"struct({k} AS k, false AS known, {_key('shiftright(key, 8)', k - 1, _CONTEXT)} AS at)")
    steps = wanted.select("key", F.explode(F.expr(f"filter(array({', '.join(asked)}), s -> s.k <= shiftright(key, 56))")).alias("s")).select("key", "s.*")
    tables = model.table.selectExpr("key AS at", "value"), F.broadcast(model.short.selectExpr("key AS at", "value"))
    found = steps.where(_letters("at") > 2).join(tables[0].where(_letters("at") > 2), "at").unionAll(steps.where(_letters("at") <= 2).join(tables[1], "at"))
    found = found.groupBy("key").agg(F.expr("max(if(known, struct(k, value), NULL))").alias("best"), F.expr("sort_array(collect_list(if(known, NULL, struct(k, value))))").alias("others"))
    missed = "aggregate(filter(others, s -> s.k > coalesce(best.k, 0)), 0D, (sum, s) -> sum + s.value)"
    return found.select("key", F.expr(f"bigint(round((coalesce(best.value, {model.unknown!r}D) + {missed}) * {UNIT}D))").alias("ratio"))


def compared(documents: DataFrame, model: TableModel, keep: list[str], expressions, order: int, few_words: int) -> tuple[DataFrame, DataFrame]:
    """The columns keep of each row of documents with a number __row, and (__row, x): its log-likelihood difference.

    expressions(texts) gives the distinct words' bounds, the code of each word, each text's range among the words, and positions
    whose letter counts, with their keys."""
    spark = small_batches(documents.sparkSession)
    shared = spark.sparkContext.broadcast((model.keys, model.ratios))
    kept = T.StructType([documents.schema[c] for c in keep])
    schema = T.StructType([*kept, *T._parse_datatype_string("__sum double, __words long, __keys array<long>, __uses array<long>")])
    place, at_text = [documents.columns.index(c) for c in keep], documents.columns.index("text")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ratios = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                bounds, codes, ranges, at, wanted = expressions(part.column(at_text))
                rows, words = len(part), len(bounds) - 1
                found = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
                hit = keys[found] == wanted if len(keys) else np.zeros(len(wanted), dtype=bool)
                word_of = np.searchsorted(bounds, at, side="right") - 1
                by_word = np.bincount(word_of[hit], ratios[found[hit]], words) if hit.any() else np.zeros(words)
                owner = np.repeat(np.arange(rows), np.diff(ranges))
                sums = np.bincount(owner, by_word[codes], rows)
                # the other expressions of each document's distinct words
                rest, per = wanted[~hit], np.bincount(word_of[~hit], minlength=words)
                pairs, uses = np.unique(owner * max(words, 1) + codes, return_counts=True)
                doc, word = np.divmod(pairs, max(words, 1))
                many = per[word] if words else np.zeros(0, np.int64)
                index = ragged_positions((np.cumsum(per) - per)[word] if words else many, many)
                offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(np.repeat(doc, many), minlength=rows))]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.int64))) for v in (rest[index], np.repeat(uses, many))]
                arrays = [*(part.column(i) for i in place), pa.array(sums, pa.float64()), pa.array(np.diff(ranges).astype(np.int64)), *lists]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    stored = written(documents.mapInArrow(split, schema).withColumn("__row", F.monotonically_increasing_id()), "compared")
    rest = stored.select("__row", F.explode(F.arrays_zip("__keys", "__uses")).alias("s")).selectExpr("__row", "s.__keys AS key", "s.__uses AS uses")
    ratio = F.coalesce(F.col("ratio"), F.lit(round(model.unknown * UNIT)).cast("long"))
    sums = rest.join(looked_up(rest.select("key").distinct(), model, order), "key", "left").groupBy("__row").agg(F.sum(F.col("uses") * ratio).alias("rest"))
    x = F.expr(f"if(__words = 0, 0D, (__sum + coalesce(rest, 0) / {UNIT}D) / (__words + {few_words}))")
    return stored.select("__row", *keep), stored.select("__row", "__sum", "__words").join(sums, "__row", "left").select("__row", x.alias("x"))
