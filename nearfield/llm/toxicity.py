"""Operator 4: toxicity by class-conditional Kneser-Ney models.

Two interpolated Kneser-Ney models of the letters (bytes) of words, one of toxic and one of ordinary texts, score a text by the
difference of its log-likelihoods under them, divided by its number of words plus FEW_WORDS, so that a handful of words can't say much.  A letter's probability after the ORDER - 1
letters before it in its word is

    P_c(x | v) = max(n_c(v x) - D, 0) / n_c(v) + D * followers_c(v) / n_c(v) * P_c(x | v without its first letter)

where shorter contexts count the different letters before an expression instead of its occurrences.  The shortest one falls
back to counts shared by both classes: so an expression that is rare, or known to neither class, says little either way.
A word's letters count from the third on, given the first two: these mostly tell the language, which isn't the question.
A logistic curve on the difference, with a steeper slope beyond a knee, fitted on labelled texts that the counts haven't seen, gives the score.

Counts come from the whole texts of all labelled documents whose crc32(doc_id as text) mod 3 is 0 or 2, by a Spark aggregation
that grows with the input; those with remainder 1 are held out.  The curve, four numbers, is cross-fitted: a bounded sample of each
of the two folds, the CALIBRATION documents of each class with the smallest hash of their doc_id, is compared by the counts of the
other fold alone.  Where one of these has no labels of both classes to count, only the other fold's counts compare, and
without such a comparison for both classes every score is 0.5.  Texts meet their labels where they lie: at most MAX_LABELS labels
(72 MB) are broadcast, and only of more labels the two folds' texts are shuffled to a join.  A model of at most
MAX_GRAMS expressions (about 100 MB by that bound) is broadcast whole.  A larger one is kept in Spark tables (letter_tables.py): its
most frequent expressions, MAX_GRAMS at most, are broadcast, and the documents' other ones meet all the rest in joins; both ways
score alike.
With the whole model broadcast, every document is scored in the scan's own
partitions, over all of its words, each distinct word of a slice of texts once.  Nothing but the text enters a score.

Defined cases: a text without words, empty or null, gets the curve's value at no difference; labels with a null doc_id or a
toxic other than 0 and 1 are ignored, and of conflicting ones the toxic one counts; a null doc_id is scored and isn't held out;
repeated rows are scored one by one; without labels of both classes every score is 0.5; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.letter_tables import TableModel, compared, table_model
from nearfield.llm.rows import numbered
from nearfield.llm.shared_store import small_batches, written
from nearfield.llm.text_kernels import LOWER, ragged_positions, slices, text_bytes, word_hashes, word_spans

CALIBRATION, MAX_GRAMS, MAX_LABELS, DISCOUNT = 4000, 3_000_000, 8_000_000, 0.75
FEW_WORDS, KNEE = 25, 0.8
#: Letters of an expression, and the first place in a marked word whose letter counts.
ORDER, FIRST = 6, 3
#: Folds that are counted; fold + toxic numbers the four cells that labelled documents are counted in.
FOLDS, _CELLS = (0, 2), ("c0", "c1", "c2", "c3")

#: Everything in ASCII but letters and digits stands between words; two of those bytes mark a word's ends.
_BETWEEN = np.zeros(256, dtype=bool)
_BETWEEN[[i for i in range(128) if not chr(i).isalnum()]] = True
_BEGIN, _END = ord("^"), ord("$")


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(3))


def distinct_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased distinct words with a mark at each end, as bytes and their len + 1 offsets; the code of each word of the texts;
    each text's range among these (len + 1)."""
    data, offsets = text_bytes(column)
    data = LOWER[data]
    starts, ends, ranges = word_spans(data, offsets, _BETWEEN)
    coded = pa.array(word_hashes(data, starts, ends)).dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int64)
    example = np.zeros(len(coded.dictionary), dtype=np.int64)
    example[codes[::-1]] = np.arange(len(codes))[::-1]
    sizes = ends[example] - starts[example]
    bounds = np.concatenate([[0], np.cumsum(sizes + 2)])
    marked = np.empty(bounds[-1], dtype=np.uint8)
    marked[bounds[:-1]], marked[bounds[1:] - 1] = _BEGIN, _END
    inner = np.ones(len(marked), dtype=bool)
    inner[bounds[:-1]] = inner[bounds[1:] - 1] = False
    marked[inner] = data[ragged_positions(starts[example], sizes)]
    return marked, bounds, codes, ranges


def grams(marked: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte, the last ORDER bytes of its word up to it in one integer, and how many there are."""
    place = np.arange(len(marked)) - np.repeat(bounds[:-1], np.diff(bounds))
    out = marked.astype(np.uint64)
    for k in range(1, ORDER):
        more = np.zeros(len(marked), dtype=np.uint64)
        more[k:] = marked[:-k].astype(np.uint64) << np.uint64(8 * k)
        out += np.where(place >= k, more, np.uint64(0))
    return out, np.minimum(place + 1, ORDER)


def _last(gram: np.ndarray, k: int) -> np.ndarray:
    return gram & np.uint64((1 << 8 * k) - 1)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each is among the ascending keys, and whether it is."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), dtype=bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


@dataclass
class Model:
    """By length k: ascending expressions with log P_1 / P_0, and ascending contexts of k letters with the log ratio of their
    fallback weights."""

    known: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    fallback: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    unknown: float = 0.0
    slope: float = 0.0
    offset: float = 0.0
    bend: float = 0.0
    knee: float = 0.0

    def letter_ratios(self, gram: np.ndarray, size: np.ndarray) -> np.ndarray:
        out = np.zeros(len(gram))
        if not self.known:
            return out
        left = np.arange(len(gram))
        for k in range(ORDER, 0, -1):
            at_k = left[size[left] >= k]
            keys, ratios = self.known[k]
            at, hit = _find(keys, _last(gram[at_k], k))
            out[at_k[hit]] += ratios[at[hit]]
            missed = at_k[~hit]
            if k > 1:
                keys, ratios = self.fallback[k - 1]
                at, hit = _find(keys, _last(gram[missed] >> np.uint64(8), k - 1))
                out[missed[hit]] += ratios[at[hit]]
            else:
                out[missed] += self.unknown
            left = np.concatenate([left[size[left] < k], missed])
        return out

    def differences(self, column: pa.Array) -> np.ndarray:
        """Log-likelihood difference of each text over its (padded) number of words; 0 without words."""
        marked, bounds, codes, ranges = distinct_words(column)
        out = np.zeros(len(ranges) - 1)
        if len(codes):
            gram, size = grams(marked, bounds)
            place = np.arange(len(marked)) - np.repeat(bounds[:-1], np.diff(bounds))
            at = np.flatnonzero(place >= FIRST)
            ratios = np.zeros(len(marked))
            ratios[at] = self.letter_ratios(gram[at], size[at])
            words = np.add.reduceat(ratios, bounds[:-1])
            filled = np.diff(ranges) > 0
            out[filled] = np.add.reduceat(words[codes], ranges[:-1][filled]) / (np.diff(ranges)[filled] + FEW_WORDS)
        return out

    def scores(self, column: pa.Array) -> np.ndarray:
        x = self.differences(column)
        return 1 / (1 + np.exp(-np.clip(self.slope * x + self.bend * np.maximum(x - self.knee, 0) + self.offset, -40, 40)))


def kneser_ney(gram: np.ndarray, size: np.ndarray, counts: np.ndarray) -> Model:
    """The model of distinct expressions (gram, size) with their occurrences (len, 2) by class: those of ORDER letters, and
    the shorter ones with which words begin."""
    by_size = {k: (gram[size == k], counts[size == k].astype(float)) for k in range(1, ORDER + 1)}
    for k in range(ORDER - 1, 0, -1):
        longer, its_counts = by_size[k + 1]
        kinds = (its_counts > 0).astype(float)
        every = np.concatenate([by_size[k][0], _last(longer, k)])
        keys, inverse = np.unique(every, return_inverse=True)
        weights = np.concatenate([by_size[k][1], kinds])
        by_size[k] = keys, np.stack([np.bincount(inverse, weights[:, c], len(keys)) for c in (0, 1)], axis=1)
    order = np.argsort(by_size[ORDER][0])
    by_size[ORDER] = by_size[ORDER][0][order], by_size[ORDER][1][order]
    model, lower = Model(), None
    for k in range(1, ORDER + 1):
        keys, n = by_size[k]
        contexts, inverse = np.unique(keys >> np.uint64(8), return_inverse=True)
        p, weight = np.empty((len(keys), 2)), np.ones((len(contexts), 2))
        if k == 1:
            pooled = n.sum(1)
            shared, none = (pooled + 1) / (pooled.sum() + len(keys) + 1), 1 / (pooled.sum() + len(keys) + 1)
        for c in (0, 1):
            total = np.bincount(inverse, n[:, c], len(contexts))
            followers = np.bincount(inverse, n[:, c] > 0, len(contexts))
            weight[:, c] = np.where(total > 0, DISCOUNT * followers / np.maximum(total, 1), 1)
            below = shared if k == 1 else lower[1][np.searchsorted(lower[0], _last(keys, k - 1)), c]
            p[:, c] = np.maximum(n[:, c] - DISCOUNT, 0) / np.maximum(total, 1)[inverse] + weight[inverse, c] * below
        model.known[k] = keys, np.log(p[:, 1] / p[:, 0])
        if k == 1:
            model.unknown = float(np.log((weight[0, 1] * none) / (weight[0, 0] * none)))
        else:
            model.fallback[k - 1] = contexts, np.log(weight[:, 1] / weight[:, 0])
        lower = keys, p
    return model


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float, float, float]:
    """Slope, offset, bend and knee of a rising logistic curve, by Newton's steps with a weak penalty on the slopes.

    Most differences lie close together, whatever the class, and few beyond them tell it: so the slope may rise at the knee, the KNEE quantile of x.
    """
    scale = float(np.std(x)) or 1.0
    order = np.argsort(x, kind="stable")
    knee = float(x[order][min(len(x) - 1, np.searchsorted(np.cumsum(weight[order]), KNEE * weight.sum()))])
    columns = [x / scale, np.maximum(x - knee, 0) / scale, np.ones(len(x))]
    for used in ((0, 1, 2), (1, 2), (0, 2)):  # a curve that falls anywhere is fitted with one slope
        points, theta = np.stack([columns[i] for i in used], axis=1), np.zeros(len(used))
        penalty = np.diag([*[1e-2] * (len(used) - 1), 1e-6])
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(points @ theta, -40, 40)))
            step = np.linalg.solve((points * (weight * p * (1 - p))[:, None]).T @ points + penalty, points.T @ (weight * (y - p)) - penalty @ theta)
            theta += np.clip(step, -4, 4)
            if np.abs(step).max() < 1e-9:
                break
        by = dict(zip(used, theta))
        slope, bend = by.get(0, 0.0) / scale, by.get(1, 0.0) / scale
        if slope >= 0 and slope + bend >= 0:
            break
    return float(slope), float(by[2]), float(bend), knee


def _labelled(documents: DataFrame, labels: DataFrame):
    """Rows of all labelled documents that aren't held out, and what makes batches of them (cell, text), with cell = toxic + fold: a worker
    does both that and the counting, so that a task needs one worker only."""
    counted = fold(F.col("doc_id")) != 1
    cells = labels.where(counted).select("doc_id", (F.col("toxic") + fold(F.col("doc_id"))).cast("byte").alias("cell"))
    if cells.count() > MAX_LABELS:
        return documents.where(counted).join(cells, "doc_id").select(F.col("cell").cast("int").alias("cell"), "text"), iter
    known = cells.toArrow()
    order = np.argsort(known.column("doc_id").to_numpy())
    shared = documents.sparkSession.sparkContext.broadcast(tuple(known.column(c).to_numpy()[order] for c in ("doc_id", "cell")))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, own = shared.value
        for batch in batches:
            at, hit = _find(ids, batch.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(own[at[hit]].astype(np.int32)), batch.column(1).filter(pa.array(hit))], names=["cell", "text"])

    return documents.where(counted).select("doc_id", "text"), choose


def _calibration(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(cell, text) of at most CALIBRATION labelled documents of each class of each fold that is counted."""
    chosen = None
    for part in FOLDS:
        for toxic in (0, 1):
            own = labels.where((F.col("toxic") == toxic) & (fold(F.col("doc_id")) == part)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(CALIBRATION)
            own = own.select("doc_id", F.lit(part + toxic).alias("cell"))
            chosen = own if chosen is None else chosen.unionAll(own)
    # at most 4 * CALIBRATION rows of two integers
    return documents.join(F.broadcast(chosen), "doc_id").select("cell", "text")


def _count_grams(rows: DataFrame, chosen) -> DataFrame:
    """(gram, size, c0, c1, c2, c3) over the (cell, text) that chosen makes of rows: occurrences by cell of the expressions that kneser_ney
    takes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chosen(batches):
            for part in slices(batch, "text"):
                marked, bounds, codes, ranges = distinct_words(part.column(1))
                cell = np.repeat(part.column(0).to_numpy().astype(np.int64), np.diff(ranges))
                words = len(bounds) - 1
                uses = [np.repeat(np.bincount(codes[cell == c], minlength=words), np.diff(bounds)) for c in range(4)]
                gram, size = grams(marked, bounds)
                at = np.flatnonzero(size > 1)
                tagged, inverse = np.unique(gram[at] | size[at].astype(np.uint64) << np.uint64(56), return_inverse=True)
                sums = [np.bincount(inverse, u[at], len(tagged)).astype(np.int64) for u in uses]
                arrays = [_last(tagged, 7).view(np.int64), (tagged >> np.uint64(56)).astype(np.int64), *sums]
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()) for a in arrays], names=["gram", "size", *_CELLS])

    return rows.mapInArrow(count, "gram long, size long, " + ", ".join(f"{c} long" for c in _CELLS)).groupBy("gram", "size").agg(*(F.sum(c).alias(c) for c in _CELLS))


def _counting(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What letter_tables.compared asks of texts."""
    marked, bounds, codes, ranges = distinct_words(column)
    gram, size = grams(marked, bounds)
    at = np.flatnonzero(np.arange(len(marked)) - np.repeat(bounds[:-1], np.diff(bounds)) >= FIRST)
    return bounds, codes, ranges, at, gram[at] | size[at].astype(np.uint64) << np.uint64(56)


def _compared(documents: DataFrame, model: TableModel, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    return compared(documents, model, keep, _counting, ORDER, FEW_WORDS)


def _table_model(counted: DataFrame, toxic: str, ordinary: str) -> Model | TableModel:
    own = counted.selectExpr("gram", "size", f"{ordinary} AS c0", f"{toxic} AS c1")
    sums = own.agg(F.sum("c0"), F.sum("c1")).first()
    return table_model(own, ORDER, DISCOUNT, FIRST, MAX_GRAMS) if all(sums) else Model()


def _model(gram: np.ndarray, size: np.ndarray, counts: np.ndarray) -> Model:
    """kneser_ney of the expressions that occur; an empty model unless both classes have some."""
    occurs = counts.sum(1) > 0
    return kneser_ney(gram[occurs], size[occurs], counts[occurs]) if counts.sum(0).all() else Model()


def _fit_whole(counted: DataFrame, calibration: DataFrame) -> tuple[Model, pa.Table]:
    """The model without its curve, and (cell, x) of the calibration texts, each compared by the counts of the other fold."""
    kept = counted.toArrow()
    gram, size = kept.column("gram").to_numpy().view(np.uint64), kept.column("size").to_numpy()
    cells = np.stack([kept.column(c).to_numpy() for c in _CELLS], axis=1)
    model = _model(gram, size, cells[:, :2] + cells[:, 2:])
    shared = calibration.sparkSession.sparkContext.broadcast([_model(gram, size, cells[:, own : own + 2]) for own in reversed(FOLDS)])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                cell = part.column(0).to_numpy()
                for own, other in zip(FOLDS, shared.value):
                    at = pa.array(np.flatnonzero(cell - cell % 2 == own))
                    if len(at) and other.known:
                        yield pa.RecordBatch.from_arrays([part.column(0).take(at), pa.array(other.differences(part.column(1).take(at)))], names=["cell", "x"])

    return model, calibration.mapInArrow(compare, "cell int, x double").toArrow()


def _fit_tables(counted: DataFrame, calibration: DataFrame) -> tuple[Model | TableModel, pa.Table]:
    """What _fit_whole gives, with models in tables."""
    seen = [pa.table({"cell": pa.array([], pa.int32()), "x": pa.array([], pa.float64())})]
    for own, other in zip(FOLDS, reversed(FOLDS)):
        model = _table_model(counted, f"c{other + 1}", f"c{other}")
        if isinstance(model, TableModel):
            rows, x = _compared(calibration.where(F.col("cell").isin(own, own + 1)), model, ["cell"])
            seen.append(rows.join(x, "__row").select("cell", "x").toArrow())
    return _table_model(counted, "c1 + c3", "c0 + c2"), pa.concat_tables([t.cast(seen[0].schema) for t in seen])


def fit(documents: DataFrame, labels: DataFrame) -> Model | TableModel:
    """The model of (doc_id, text) documents with (doc_id, toxic) labels."""
    small_batches(documents.sparkSession)
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    counted = written(_count_grams(*_labelled(documents, known)), "expressions")
    model, seen = (_fit_whole if counted.count() <= MAX_GRAMS else _fit_tables)(counted, _calibration(documents, known))
    share = {r["cell"]: r["count"] for r in known.groupBy((F.col("toxic") + fold(F.col("doc_id"))).alias("cell"), fold(F.col("doc_id")).alias("part")).count().where("part <> 1").collect()}
    x, cell = seen.column("x").to_numpy(), seen.column("cell").to_numpy()
    order = np.lexsort((x, cell))  # so that sums don't depend on the order of rows
    x, cell = x[order], cell[order]
    y = cell % 2
    if len(np.unique(y)) < 2 or not isinstance(model, TableModel) and not model.known:
        return Model()
    sampled = np.bincount(cell, minlength=4)
    weight = np.array([share[c] / sampled[c] if sampled[c] else 0.0 for c in range(4)])[cell]
    model.slope, model.offset, model.bend, model.knee = fit_curve(x, y.astype(float), weight / weight.mean())
    return model


def toxicity_scores(documents: DataFrame, model: Model | TableModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row."""
    texts = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if isinstance(model, TableModel):
        rows, x = _compared(texts, model, ["doc_id"])
        return _predicted(rows.join(x, "__row").select("doc_id", model.score(F.col("x")).alias("score")), id_col, threshold)
    shared = small_batches(documents.sparkSession).sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shared.value.scores(part.column(1)))], names=["doc_id", "score"])

    return _predicted(texts.mapInArrow(score, "doc_id long, score double"), id_col, threshold)


def _predicted(out: DataFrame, id_col: str, threshold: float) -> DataFrame:
    held_out = F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False))
    return out.select(F.col("doc_id").alias(id_col), held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(documents: DataFrame, model: Model | TableModel, threshold: float = 0.7) -> DataFrame:
    """The documents that score below the threshold; with the whole model broadcast, in one pass without a shuffle."""
    own, at = numbered(documents), documents.columns.index("text")
    if isinstance(model, TableModel):
        rows, x = _compared(own.withColumn("text", F.col(f"c{at}")), model, own.columns)
        kept = rows.join(x.where(model.score(F.col("x")) >= threshold), "__row", "left_anti").select(own.columns)
        return kept.toDF(*documents.columns)
    shared = small_batches(documents.sparkSession).sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, f"c{at}"):
                yield part.filter(pc.less(pa.array(shared.value.scores(part.column(at))), threshold))

    return own.mapInArrow(keep, own.schema).toDF(*documents.columns)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return toxicity_scores(documents, fit(documents, spark.read.parquet(f"{sf_dir}/labels.parquet")))


QUERIES = {"op4_toxicity": op4_toxicity}
ORACLES: dict[str, str] = {}
