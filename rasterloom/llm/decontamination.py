"""Benchmark decontamination: every training passage queries a BM25 index of the test items.

Test items are the indexed documents, passages the queries. A term's weight in an item is
its BM25 weight as a share of the item's score for its own words, so that one threshold
serves all items; document frequencies and lengths are those of the whole list. Every term
has an inverted list of the blocks of items that hold it, with its largest weight in each.
A passage whose terms' largest weights of all do not reach the threshold is dropped; for
another one its terms' lists are merged, and a block is a pivot where the maxima that meet
there reach the threshold (block-max WAND: the threshold stays as it is, since everything
above it is retrieved, so one merge finds all pivots). Only the items of pivots are scored.
Then an item's question must overlap the passage by 5-word shingles and its answer by words.

Passages are windows of two segments, each as long as the longest items of a length class
(powers of two), so that any item lies within one window whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

K1, B = 1.2, 0.75
THRESHOLD = 0.7
N, OVERLAP = 5, 0.75
BLOCK = 8
SHORTEST = 32
#: Passages times blocks whose inverted lists are merged at once.
MERGED = 1 << 16
#: Test items of one index; more items are searched in several passes over the documents.
ITEMS = 20_000
SIGNS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def words_of(text: str | None) -> list[str]:
    """Lower-case words without the signs at their ends."""
    return [w for w in (x.strip(SIGNS) for x in "".join(c.lower() if c.isascii() else c for c in (text or "")).translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ")) if w]


def question_and_answer(text: str | None) -> tuple[list[str], list[str]]:
    """The last sentence is the answer; of a single sentence the last fifth of its words."""
    parts = [w for w in (text or "").translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ") if w]
    all_ = words_of(text)
    ends = [i for i, w in enumerate(parts[:-1]) if w[-1] in ".?!:"]
    answer = len(words_of(" ".join(parts[ends[-1] + 1 :]))) if ends else max(1, len(all_) // 5)
    cut = len(all_) - min(answer, len(all_) - 1)
    return all_[:cut], all_[cut:]


class Index:
    """Items of one length class: weights by term and item, and their maxima by block."""

    def __init__(self, items: list[tuple[int, list[str]]], segment: int, idf: dict[str, float], mean: float):
        self.segment = segment
        items = sorted(items, key=lambda x: (sorted(x[1])[:1], x[0]))
        self.ids = [i for i, _ in items]
        self.terms: dict[str, int] = {}
        weights: list[dict[int, float]] = []
        for _, words in items:
            own: dict[int, float] = {}
            for w in set(words):
                tf = words.count(w)
                own[self.terms.setdefault(w, len(self.terms))] = idf[w] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean))
            total = sum(own.values())
            weights.append({t: v / total for t, v in own.items()})
        self.blocks = [range(a, min(a + BLOCK, len(items))) for a in range(0, len(items), BLOCK)]
        # weights by block: rows of the terms that the block has, one column per item
        self.rows, self.tables = [], []
        lists: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for k, block in enumerate(self.blocks):
            has = sorted({t for i in block for t in weights[i]})
            table = np.zeros((len(has) + 1, len(block)))
            place = {t: r for r, t in enumerate(has)}
            for c, i in enumerate(block):
                for t, v in weights[i].items():
                    table[place[t], c] = v
            self.rows.append(np.array(has))
            self.tables.append(table)
            lists.append((self.rows[-1], np.full(len(has), k), table[:-1].max(1)))
        # inverted lists, one after the other: the blocks of a term, in order, and its largest weight in each
        term, block, most = (np.concatenate(x) for x in zip(*lists, strict=True)) if lists else (np.empty(0, np.int64),) * 3
        order = np.argsort(term, kind="stable")
        self.list_blocks, self.list_most = block[order], most[order]
        self.starts = np.searchsorted(term[order], np.arange(len(self.terms) + 1))
        self.top = np.zeros(len(self.terms) + 1)
        np.maximum.at(self.top, term, most)

    def pivots(self, window: np.ndarray, term: np.ndarray, windows: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """(window, block) where the largest weights of the window's terms reach the threshold: their inverted lists, merged."""
        lengths = self.starts[term + 1] - self.starts[term]
        ends = np.cumsum(lengths)
        at = np.repeat(self.starts[term] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)
        place = np.repeat(window, lengths) * len(self.blocks) + self.list_blocks[at]
        return np.divmod(np.flatnonzero(np.bincount(place, self.list_most[at], windows * len(self.blocks)) >= threshold - 1e-9), len(self.blocks))

    def search(self, codes: np.ndarray, offsets: np.ndarray, names: pa.Array, threshold: float) -> Iterator[tuple[int, int, int, int, float]]:
        """(document, first word, end, item, score) of every window and item at or above the threshold."""
        term = pc.fill_null(pc.index_in(names, value_set=pa.array(self.terms, names.type)), -1).to_numpy(zero_copy_only=False)[codes].astype(np.int64)
        counts = np.diff(offsets)
        segments = np.maximum(1, -(-counts // self.segment))
        base = np.concatenate([[0], np.cumsum(segments)])
        doc = np.repeat(np.arange(len(counts)), counts)
        at = np.flatnonzero(term >= 0)
        seg = base[doc[at]] + (at - offsets[doc[at]]) // self.segment
        pair = common.distinct(seg * len(self.terms) + term[at])
        seg, t = pair // len(self.terms), pair % len(self.terms)
        used, starts = np.unique(seg, return_index=True)
        if len(used) == 0:
            return
        one = np.zeros(base[-1] + 1)
        one[used] = np.add.reduceat(self.top[t], starts)
        follows = np.ones(base[-1], bool)
        follows[base[1:] - 1] = False  # the last segment of a document stands alone
        hopeful = np.flatnonzero(one[:-1] + np.where(follows, one[1:], 0) >= threshold - 1e-9)
        # the terms of each segment, none for those without
        ends = np.append(starts, [len(seg), len(seg)])
        slot = np.full(base[-1] + 1, len(used))
        slot[used] = np.arange(len(used))
        each = max(1, MERGED // len(self.blocks))
        for c in range(0, len(hopeful), each):
            w = hopeful[c : c + each]
            half = np.concatenate([slot[w], np.where(follows[w], slot[w + 1], len(used))])
            lengths = ends[half + 1] - ends[half]
            stop = np.cumsum(lengths)
            at = np.repeat(ends[half] - stop + lengths, lengths) + np.arange(stop[-1])
            pair = common.distinct(np.repeat(np.tile(np.arange(len(w)), 2), lengths) * len(self.terms) + t[at])
            window, term = np.divmod(pair, len(self.terms))
            bounds = np.searchsorted(window, np.arange(len(w) + 1))
            for i, k in zip(*(x.tolist() for x in self.pivots(window, term, len(w), threshold)), strict=True):
                own, rows = term[bounds[i] : bounds[i + 1]], self.rows[k]
                place = np.minimum(np.searchsorted(rows, own), len(rows) - 1)
                score = self.tables[k][place[rows[place] == own]].sum(0)
                for item in np.flatnonzero(score >= threshold).tolist():
                    d = int(np.searchsorted(base, w[i], side="right") - 1)
                    first = int(offsets[d] + (w[i] - base[d]) * self.segment)
                    yield d, first, int(min(first + 2 * self.segment, offsets[d + 1])), self.ids[self.blocks[k][item]], float(score[item])


def statistics(items: Iterable[str | None]) -> tuple[dict[str, float], float]:
    """Inverse document frequencies and mean length of the whole list of test items."""
    df: dict[str, int] = {}
    count = length = 0
    for text in items:
        words = words_of(text)
        if words:
            count, length = count + 1, length + len(words)
            for w in set(words):
                df[w] = df.get(w, 0) + 1
    return {w: float(np.log(1 + (count - c + 0.5) / (c + 0.5))) for w, c in df.items()}, length / max(1, count)


def indexes(items: list[tuple[int, list[str]]], idf: dict[str, float], mean: float) -> list[Index]:
    classes: dict[int, list] = {}
    for item in items:
        size = SHORTEST
        while size < len(item[1]):
            size *= 2
        classes.setdefault(size, []).append(item)
    return [Index(own, size, idf, mean) for size, own in sorted(classes.items())]


def overlap(own: list[str], words: list[str], n: int) -> float:
    """Share of the n-word shingles of own (n at most its length) that words has."""
    n = max(1, min(n, len(own)))
    have = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}
    mine = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)}
    return sum(x in have for x in mine) / max(1, len(mine))


#: The indexes, one for each length class, and the item_id, question and answer of each item.
Tests = tuple[list[Index], dict[int, tuple[int, list[str], list[str]]]]


def tests_of(benchmark: DataFrame) -> Iterator[Tests]:
    """The list of test items in parts of about ITEMS, all under the statistics of the whole list; an item_id is in one part."""
    found = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    parts = max(1, -(-found.count() // ITEMS))
    idf, mean = statistics(r["text"] for r in found.select("text").toLocalIterator())
    for k in range(parts):
        part = found.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k).orderBy("item_id", "text").collect()
        items = [(n, r["item_id"], r["text"]) for n, r in enumerate(part) if words_of(r["text"])]
        yield indexes([(n, words_of(t)) for n, _, t in items], idf, mean), {n: (i, *question_and_answer(t)) for n, i, t in items}


def hits(texts: pa.Array, tests: Tests, threshold: float, share: float) -> dict[tuple[int, int], tuple[float, float, float]]:
    """Of each text (by its place) and item that it holds: score and overlaps of the best passage."""
    tables, answers = tests
    codes, offsets, dictionary = common.words_of(texts)
    names = pc.utf8_trim(dictionary, SIGNS)
    full = pc.greater(pc.binary_length(names), 0).to_numpy(zero_copy_only=False)
    if not full.all():  # words of signs alone are no words here
        keep = full[codes]
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        codes = codes[keep]
    best: dict[tuple[int, int], tuple] = {}
    for index in tables:
        for d, a, b, n, score in index.search(codes, offsets, names, threshold):
            item, question, answer = answers[n]
            words = names.take(pa.array(codes[a:b])).to_pylist()
            q, r = overlap(question, words, N), overlap(answer, words, 1)
            if q >= share and r >= share:
                best[d, item] = max(best.get((d, item), (0.0, 0.0, 0.0)), (score, q, r))
    return best


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, share: float = OVERLAP) -> DataFrame:
    """Documents with a passage that holds a test item: (doc_id, item_id, score, question_overlap, answer_overlap).

    One row per document row and item, with its best passage. Null or empty texts hold nothing, null
    or wordless items are found nowhere, repeated documents are found each, repeated item_ids stand
    for one item each and the best of them is kept; a text of any length is searched whole; empty
    tables give no rows; other columns are ignored. The benchmark is sent to every task in parts of
    about ITEMS items, a pass over the documents for each.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def found(shared: Broadcast) -> DataFrame:
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in common.batches(it, "text"):
                best = hits(batch.column("text"), shared.value, threshold, share)
                ids = batch.column("doc_id").to_pylist()
                rows = [(ids[d], item, *x) for (d, item), x in sorted(best.items(), key=lambda x: (x[0][0], x[0][1] is None, x[0][1] or 0))]
                columns = zip(*rows, strict=True) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 2 + [pa.float64()] * 3, strict=True)], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        return texts.mapInArrow(common.lean(run), "doc_id long, item_id long, score double, question_overlap double, answer_overlap double")

    return reduce(DataFrame.union, (found(spark.sparkContext.broadcast(tests)) for tests in tests_of(benchmark)))


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, share: float = OVERLAP) -> DataFrame:
    """The rows of docs that hold no test item, as contaminated() finds them; each row is judged by its own text."""
    spark = docs.sparkSession
    own = [f"_own{i}" for i in range(len(docs.columns))]
    named = docs.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(docs.columns, own, strict=True)], F.col("text").cast("string").alias("_text"))

    def kept(rows: DataFrame, shared: Broadcast) -> DataFrame:
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in common.batches(it, "_text"):
                keep = np.ones(batch.num_rows, bool)
                keep[[d for d, _ in hits(batch.column("_text"), shared.value, threshold, share)]] = False
                yield batch.filter(pa.array(keep))

        return rows.mapInArrow(common.lean(run), rows.schema)

    for tests in tests_of(benchmark):
        named = kept(named, spark.sparkContext.broadcast(tests))
    return named.drop("_text").toDF(*docs.columns)


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
