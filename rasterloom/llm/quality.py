"""Quality classifier: a sparse ensemble of tree-path rules over text statistics.

Trees are boosted on a bounded sample of labelled documents, every path becomes a
conjunctive rule, an L1-penalised logistic regression keeps few of them, and those are
compiled into one Spark column, so that scoring the corpus is a single scan. The statistics
are counted on Arrow batches, which hold no string for each word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import common, trees

#: Labelled rows that a model is fitted on at most: those with the smallest hash of their id.
TRAIN_ROWS = 20_000
THRESHOLD = 0.3

#: Groups of characters that are counted.
SIGNS = "#$%&*~^<>{}[]=_@\\"
DIGITS = "0123456789"
STOPS = ".,;:!?"

STATS = ["n_chars", "n_words", "word_chars", "distinct_share", "repeat_share", "bar_share", "sign_share", "digit_share", "stop_share", "line_words"]


#: Bytes by what they count as: 1 to 5 for |, SIGNS, DIGITS, STOPS and line feeds, 6 for what goes on with a character.
CLASSES = np.zeros(256, np.uint8)
for k, chars in enumerate(("|", SIGNS, DIGITS, STOPS, "\n"), 1):
    CLASSES[[ord(c) for c in chars]] = k
CLASSES[0x80:0xC0] = 6


def stats_of(texts: pa.Array) -> np.ndarray:
    """The statistics STATS of each whole text, a row for each; of a null or empty text all are 0."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    codes, offsets, dictionary = common.words_of(texts, lower=False)
    n = np.diff(offsets)
    doc = np.repeat(np.arange(len(texts)), n)
    used = common.distinct(doc * max(1, len(dictionary)) + codes) // max(1, len(dictionary))
    distinct = np.bincount(used, minlength=len(texts))
    again = np.flatnonzero((codes[1:] == codes[:-1]) & (doc[1:] == doc[:-1])) + 1
    repeats = np.bincount(doc[again], minlength=len(texts))
    places = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[places[0] : places[-1]] if data is not None and len(texts) else np.empty(0, np.uint8)
    kinds = CLASSES[data]
    count = lambda k: np.diff(np.searchsorted(np.flatnonzero(kinds == k), places - places[0]))
    bars, signs, digits, stops, lines, inner = (count(k) for k in range(1, 7))
    chars = np.diff(places) - inner
    words, letters = np.maximum(n, 1), np.maximum(chars, 1)
    full = chars > 0
    return np.stack([chars, n, chars / words, distinct / words, repeats / words, bars / words, signs / letters, digits / letters, stops / words, np.where(full, words / (lines + 1), 0)], 1).astype(float)


def with_stats(docs: DataFrame) -> DataFrame:
    """The columns of docs, renamed _own0, _own1, ..., and the statistics STATS of `text`."""
    own = [f"_own{i}" for i in range(len(docs.columns))]
    named = docs.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(docs.columns, own, strict=True)], F.col("text").cast("string").alias("_text"))
    schema = StructType([*named.schema.fields[:-1], *(StructField(x, DoubleType()) for x in STATS)])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.batches(it, "_text"):
            stats = stats_of(batch.column("_text"))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(x) for x in stats.T)], [*own, *STATS])

    return named.mapInArrow(common.lean(run), schema)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """Labelled documents outside the held-out fold, at most `most` of them: (doc_id, text, y)."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~common.held_out(F.col("doc_id")))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(most)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id")


class RuleEnsemble:
    """score = logistic(intercept + sum of the weights of the rules that hold)."""

    def __init__(self, intercept: float, rules: list[tuple], weights: np.ndarray):
        self.intercept, self.rules, self.weights = intercept, rules, weights

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, penalty: float = 5e-4) -> RuleEnsemble:
        """Without rows the score is 0.5 everywhere; with one class only, near that class."""
        if len(y) == 0:
            return cls(0.0, [], np.empty(0))
        found = trees.rules(trees.boosted(x, y), STATS)
        hold = np.array([trees.holds(r, x, STATS) for r in found], float).reshape(len(found), len(y)).T
        keep = (hold.mean(0) > 0) & (hold.mean(0) < 1)
        found, hold = [r for r, k in zip(found, keep, strict=True) if k], hold[:, keep]
        if not found:
            p = (y.sum() + 0.5) / (len(y) + 1)
            return cls(float(np.log(p / (1 - p))), [], np.empty(0))
        b, w = trees.lasso_logistic(hold, y, penalty)
        used = np.flatnonzero(np.abs(w) > 1e-6)
        return cls(b, [found[i] for i in used], w[used])

    def column(self) -> Column:
        terms = [F.when(trees.rule_column(r), float(w)).otherwise(0.0) for r, w in zip(self.rules, self.weights, strict=True)]
        return 1 / (1 + F.exp(-trees.total([F.lit(float(self.intercept)), *terms])))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = TRAIN_ROWS) -> RuleEnsemble:
    known = with_stats(training_rows(docs, labels, label, most).select("y", "text"))
    rows = np.array([tuple(r) for r in known.select("_own0", *STATS).collect()], float).reshape(-1, 1 + len(STATS))
    rows = rows[np.lexsort(rows.T[::-1])]  # the order in which Spark returns them decides nothing
    return RuleEnsemble.fit(rows[:, 1:], rows[:, 0])


def scored(docs: DataFrame, model: RuleEnsemble) -> DataFrame:
    """The columns of docs as _own0, _own1, ..., and _score."""
    made = with_stats(docs)
    return made.select(*made.columns[: len(docs.columns)], model.column().alias("_score"))


def score(docs: DataFrame, model: RuleEnsemble) -> DataFrame:
    """All columns of docs and `score` (`quality_score` where docs has one); every row is scored on its whole text, however long.

    A null or empty text has all statistics 0 and the score that follows from them. Repeated
    rows and ties are scored each; an empty table gives an empty result. Columns of docs with the
    names of statistics keep their values.
    """
    return scored(docs, model).toDF(*docs.columns, "score" if "score" not in docs.columns else "quality_score")


def accepted(docs: DataFrame, model: RuleEnsemble, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score at least threshold, with the columns of docs whatever their names."""
    return scored(docs, model).where(F.col("_score") >= threshold).drop("_score").toDF(*docs.columns)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, common.table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
