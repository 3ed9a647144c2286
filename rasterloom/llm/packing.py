"""Best-fit packing of tokenised documents by non-negative least squares over length patterns.

Documents are tokenised and cut into pieces of at most ``capacity`` tokens. Only the
histogram of piece lengths (``capacity`` counts) reaches the driver. Patterns of a few
lengths that fill a sequence exactly are enumerated, their repeat counts are fitted to
the histogram by non-negative least squares and rounded down, and what the patterns
leave is packed best-fit decreasing, run by run. The plan is a table of rank intervals
per length; every piece finds its place by its rank among the pieces of its length, so
no group of pieces ever meets in one task.
"""

from __future__ import annotations

import bisect
import itertools
import os
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

CAPACITY, END_ID = 2048, 0
#: Words whose ids one Python worker remembers; beyond it the memory starts anew.
REMEMBERED = 400_000
#: Words that the tokenizer gets as one line.
JOINED = 300
#: Bytes of text that are tokenised at once.
AT_ONCE = 2 << 20
#: Plans of up to so many rows are broadcast, larger ones joined by a shuffle.
BROADCAST_ROWS = 200_000

PIECES = "uid long, part int, k long, doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokenizer:
    """Token ids of whole texts through a memory of the ids of word parts.

    Valid for tokenizers that lower-case, drop white space, mark word ends and never join
    Latin letters with the ASCII punctuation that follows them. A word of Latin-1 letters and
    closing punctuation is two parts; any other word is one and goes to the tokenizer whole.
    """

    LETTERS = "".join(chr(c) for c in [*range(65, 91), *range(97, 123), *range(0xC0, 0x100)] if c not in (0xD7, 0xF7))
    SIGNS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.encode = Tokenizer.from_file(path)
        vocabulary = self.encode.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {"": 0}
        self.ids, self.used = np.empty(1 << 20, np.uint32), 0
        self.starts, self.lengths = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def store(self, parts: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        n, total = len(self.index), len(ids)
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while n + len(parts) > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
        self.ids[self.used : self.used + total] = ids
        self.lengths[n : n + len(parts)] = lengths
        self.starts[n : n + len(parts)] = self.used + np.cumsum(lengths) - lengths
        self.used += total
        self.index.update(zip(parts, range(n, n + len(parts)), strict=True))

    def known(self, parts: pa.Array, joined: bool) -> np.ndarray:
        """The place of each part; fresh ones are encoded, joined ones many at once, and word ends split their ids. Every part is looked up once."""
        coded = parts.dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False)
        places = np.fromiter(map(self.index.get, names, itertools.repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(places < 0)
        fresh = names[new].tolist()
        places[new] = np.arange(len(self.index), len(self.index) + len(new))  # where store() puts them
        if fresh and joined:
            lines = [" ".join(fresh[k : k + JOINED]) for k in range(0, len(fresh), JOINED)]
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.encode.encode_batch_fast(lines, add_special_tokens=False)])
            self.store(fresh, ids, np.diff(np.flatnonzero(self.ends[ids]), prepend=-1))
        elif fresh:
            each = [e.ids for e in self.encode.encode_batch_fast(fresh, add_special_tokens=False)]
            self.store(fresh, np.array([i for x in each for i in x], np.uint32), np.array([len(x) for x in each]))
        return places[coded.indices.to_numpy()]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, offset of each text)."""
        codes, offsets, words = common.words_of(texts, lower=False)
        if len(self.index) + len(words) > REMEMBERED:
            self.clear()
        stems, signs = pc.utf8_rtrim(words, self.SIGNS), pc.utf8_ltrim(words, self.LETTERS)
        plain = pc.and_(pc.match_substring_regex(stems, f"^[{self.LETTERS}]+$"), pc.equal(pc.add(pc.binary_length(stems), pc.binary_length(signs)), pc.binary_length(words)))
        flags = plain.to_numpy(zero_copy_only=False)
        parts = np.zeros((len(words), 2), np.int64)
        parts[flags, 0] = self.known(pc.utf8_lower(stems.filter(plain)), joined=True)
        parts[flags, 1] = self.known(signs.filter(plain), joined=False)
        parts[~flags, 0] = self.known(words.filter(pc.invert(plain)), joined=False)
        at = parts[codes].ravel()
        lengths = self.lengths[at]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        take = np.repeat(self.starts[at] - ends[:-1], lengths) + np.arange(ends[-1])
        return self.ids[take], ends[offsets * 2]


def pieces_of(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """Token pieces: a document's ids, then end_id, cut every capacity tokens."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, counts, tokenizer = TaskContext.get().partitionId(), 0, {}, WordTokenizer(path)
        for batch in common.batches(it, "text", AT_ONCE):
            rows: list[tuple] = []
            ids, offsets = tokenizer(batch.column("text"))
            for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                own = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                for piece, start in enumerate(range(0, len(own), capacity)):
                    data = own[start : start + capacity].tobytes()
                    length = len(data) // 4
                    k = counts.get(length, 0)
                    counts[length] = k + 1
                    rows.append((part << 40 | n, part, k, doc_id, piece, start, length, zlib.crc32(data), data))
                    n += 1
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["uid", "part", "k", "doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(common.lean(run), PIECES)


#: Shares of the fitted repeats that are tried.
SHARES = (1.0, 0.95, 0.8, 0.6, 0.4, 0.2, 0.0)


def patterns_of(counts: np.ndarray, capacity: int, most: int = 6000, each: int = 6) -> list[tuple[int, ...]]:
    """Patterns of two to four lengths that occur and fill a sequence, or nearly so; those with the least room left come first.

    counts[l] pieces have length l. For each length the completions by one piece and by two are
    listed, the last piece being the longest that fits, and the best of the latter with one more
    piece split in two; of equal room those whose rarest length is most frequent come first.
    """
    have = np.flatnonzero(counts[:capacity])
    if len(have) == 0:
        return []
    fits = np.zeros(capacity + 1, np.int64)  # the longest length up to each room
    fits[have] = have
    fits = np.maximum.accumulate(fits)
    scored: dict[tuple[int, ...], tuple[int, int]] = {}

    def add(*lengths: int) -> None:
        p = tuple(sorted((x for x in lengths if x), reverse=True))
        if len(p) > 1:
            scored[p] = (capacity - sum(p), -min(int(counts[x]) // p.count(x) for x in p))

    for a in have[::-1].tolist():
        rest = capacity - a
        add(a, int(fits[min(rest, a)]))
        b = have[(have <= min(a, rest)) & (have * 2 >= fits[rest])]
        c = np.minimum(fits[rest - b], b)
        order = np.lexsort((-np.minimum(counts[b], np.where(c > 0, counts[c], 0)), rest - b - c))[:each]
        for i in order.tolist():
            add(a, int(b[i]), int(c[i]))
            left = rest - int(c[i])
            d = have[(have < b[i]) & (have * 2 >= b[i])]
            if len(d):
                e = np.minimum(fits[left - d], d)
                j = int(np.lexsort((-counts[d], left - d - e))[0])
                add(a, int(c[i]), int(d[j]), int(e[j]))
    return sorted(scored, key=lambda p: (*scored[p], p))[:most]


def fitted(counts: np.ndarray, patterns: list[tuple[int, ...]], rounds: int = 300) -> np.ndarray:
    """Repeat counts x >= 0 that minimise the squared difference between the patterns' lengths and counts.

    Multiplicative non-negative least squares steps on the sparse incidence, then rounded, and
    lowered wherever that would overdraw a length.
    """
    if not patterns:
        return np.empty(0, np.int64)
    rows = np.concatenate([np.asarray(p) for p in patterns])
    cols = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    at = lambda x: np.bincount(rows, x[cols], len(counts))
    back = lambda y: np.bincount(cols, y[rows], len(patterns))
    x = np.full(len(patterns), max(1e-9, counts.sum() / len(rows)))
    target = back(counts.astype(float))
    for _ in range(rounds):
        x *= target / np.maximum(back(at(x)), 1e-12)
    left = counts.astype(np.int64).copy()

    def taken(order: Iterable[int], most: np.ndarray) -> np.ndarray:
        out = np.zeros(len(patterns), np.int64)
        for i in order:
            need = {length: patterns[i].count(length) for length in patterns[i]}
            out[i] = min(most[i], *(left[length] // k for length, k in need.items()))
            for length, k in need.items():
                left[length] -= k * out[i]
        return out

    whole = taken(range(len(patterns)), np.floor(x + 1e-6).astype(np.int64))
    # where small counts leave only fractions, one repeat each, the largest remainders first
    return whole + taken(np.argsort(whole - x, kind="stable").tolist(), np.ones(len(patterns), np.int64))


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over a histogram: (lengths in one sequence, number of such sequences)."""
    groups: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    free: list[int] = []

    def put(room: int, inside: tuple[int, ...], n: int) -> None:
        if n:
            if room not in groups:
                groups[room] = []
                bisect.insort(free, room)
            groups[room].append((inside, n))

    for length in np.flatnonzero(counts)[::-1].tolist():
        c = int(counts[length])
        while c:
            i = bisect.bisect_left(free, length)
            if i < len(free):
                room = free[i]
                inside, n = groups[room].pop()
                if not groups[room]:
                    del groups[room], free[i]
            else:
                room, inside, n = capacity, (), c
            each = room // length
            full = min(n, c // each)
            put(room - each * length, inside + (length,) * each, full)
            c, n = c - full * each, n - full
            if n and c and c < each:
                put(room - c * length, inside + (length,) * c, 1)
                c, n = 0, n - 1
            if inside:
                put(room, inside, n)
    return [g for room in free for g in groups[room]]


def layout_of(counts: np.ndarray, capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], int]:
    """Sequences by what they hold (lengths, repeats), and how many pieces the fitted patterns place.

    The fit stands but for what costs sequences: patterns that leave much room are dropped, from the
    roomiest on, and the repeats of the others lowered in steps, until what is left packs into the fewest
    sequences; of equal counts the most patterns stay.
    """
    patterns = patterns_of(counts, capacity)
    used = [(p, int(r)) for p, r in zip(patterns, fitted(counts, patterns), strict=True) if r]
    rooms = sorted({capacity - sum(p) for p, _ in used})
    best: tuple[int, int, list] | None = None
    for limit in [*rooms[:: max(1, len(rooms) // 12)], *rooms[-1:]]:
        for share in SHARES:
            kept = [(p, k) for p, r in used if capacity - sum(p) <= limit and (k := int(r * share + 0.5))]
            left = counts.copy()
            for p, r in kept:
                for length in p:
                    left[length] -= r
            layout = kept + best_fit(left, capacity)
            placed = sum(len(p) * r for p, r in kept)
            found = (sum(r for _, r in layout), -placed, layout)
            if best is None or found[:2] < best[:2]:
                best = found
    if best is None:
        return best_fit(counts, capacity), 0
    return best[2], -best[1]


def plan_of(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Placement of every rank: rows (length, first rank, ranks, first sequence, offset)."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    layout, _ = layout_of(counts, capacity)
    rows, rank, sequence = [], [0] * (capacity + 1), 0
    for p, r in layout:
        offset = 0
        for length in p:
            rows.append((length, rank[length], r, sequence, offset))
            rank[length] += r
            offset += length
        sequence += r
    return rows


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pack documents (doc_id, text) into sequences of at most capacity tokens.

    Returns per piece: doc_id, piece, start, length, ids (little-endian unsigned 32-bit), ids_crc32,
    sequence_id, offset. A null or empty text is the single token end_id. Repeated rows and repeated
    doc_ids are packed each for itself; a null doc_id stays null; other columns are ignored; no
    documents give no rows. Only documents longer than capacity are cut.
    """
    spark: SparkSession = docs.sparkSession
    pieces = common.materialize(pieces_of(docs, path or tokenizer_path(), capacity, end_id), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    # what the pieces of a length in earlier partitions take of its ranks; a row for each partition, not each piece
    before = counts.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows = plan_of(histogram, capacity)
    plan = spark.createDataFrame(rows, "length long, r0 long, n long, seq0 long, offset long")
    if len(rows) <= BROADCAST_ROWS:
        plan = F.broadcast(plan)
    small = pieces.select("uid", "part", "k", "length").join(before.select("part", "length", F.coalesce("base", F.lit(0)).alias("base")), ["part", "length"])
    ranked = small.select("uid", "length", (F.col("base") + F.col("k")).alias("r"))
    placed = ranked.join(plan, (ranked["length"] == plan["length"]) & (F.col("r") >= F.col("r0")) & (F.col("r") < F.col("r0") + F.col("n")))
    placed = placed.select("uid", (F.col("seq0") + F.col("r") - F.col("r0")).alias("sequence_id"), "offset")
    return pieces.join(placed, "uid").select("doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents")).drop("ids")
