"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

Equal shingle sets are one row of the matrix (a node). A first pass counts all shingles and
so finds the common ones; then the leading columns of every node are multiplied, those that
the size-derived bound leaves: two sets that reach the similarity share one of their first
``n - ceil(t n) + 1`` shingles in any fixed order, here rare shingles first. Counts and
incidences travel as packed blocks, one per mapper and target; every target multiplies its
block of columns and accumulates the overlap of each pair of rows, and the sums over all
targets are held against the bound: what two sets share beyond their leading columns is at
most what the one that ends first has left. Pairs below it are discarded; the others are
finished on the remaining columns, exactly, first by marks and then on the whole sets.

A column of a common shingle is not multiplied out: its nodes are compared with leaders, so
that a group of near copies costs a comparison per member and not per pair, and only nodes
of different components are compared again. Its columns count as shared in every bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

N, PERCENT = 5, 75
#: A column with more rows than this is not multiplied out.
DENSE = 6
#: Incidences that a mapper holds before it sends its blocks on.
HELD = 1_000_000
#: Text bytes that a mapper makes into shingles at once; what it holds meanwhile takes several times as much.
SLICE = common.SLICE_BYTES // 4
#: Common shingles whose frequency orders the columns; beyond so many, only the most common.
ORDERED = 500_000
#: Up to so many ids of documents are sent to all mappers, as packed numbers, and so many rows of a narrow table are broadcast; more are joined by a shuffle.
BROADCAST_IDS, BROADCAST_ROWS = 1_000_000, 200_000
#: Where a table by column is too large to broadcast, a column's entries are dealt over so many tasks; so many of them go to one task at most where they are multiplied out.
SALTS, SALTED = 32, 2_000
#: Leader comparisons before what is left of dense columns is multiplied out under the bounds.
LEADER_ROUNDS = 3
LEADERS = 8
#: Dense columns of up to so many entries need no leaders.
SMALL = 32

#: An incidence: column, node, size of the node's set, and its place among the set's shingles.
ENTRY = np.dtype([("q", "<u4"), ("v", "<u8"), ("n", "<u4"), ("p", "<u4")])
DOC, PAIR, DENSE_ENTRY = 0, 2, 3
ROWS = "key long, kind int, doc_id long, a long, b long, n long, m long, pos long, block binary"
FIELDS = ["key", "kind", "doc_id", "a", "b", "n", "m", "pos", "block"]
TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]


def rows(count: int, /, **columns) -> pa.RecordBatch:
    """A batch of ROWS with the given columns, the others null."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f], t) if f in columns else pa.nulls(count, t) for f, t in zip(FIELDS, TYPES, strict=True)], FIELDS)


def even_keys(spark: SparkSession, n: int) -> list[int]:
    """One key for each of n hash partitions."""
    found = spark.range(40 * n + 1000).select("id", F.expr(f"pmod(hash(id), {n})").alias("p")).groupBy("p").agg(F.min("id").alias("id")).collect()
    return [r["id"] for r in sorted(found, key=lambda r: r["p"])]


def shingles(batch: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, one after the other, their offsets, and the texts' nodes; node 0 is the empty set."""
    codes, offsets, dictionary = common.words_of(batch.column("text"))
    words = common.word_hashes(dictionary)[codes]
    counts, first = np.diff(offsets), offsets[:-1]
    whole = counts >= n
    size = np.where(whole, counts - n + 1, np.minimum(counts, 1))
    ends = np.cumsum(size)
    starts = ends - size
    runs_ = common.gram_hashes(words, n)
    flat, full = np.empty(int(size.sum()), np.uint64), np.repeat(whole, size)
    flat[full] = runs_[(np.arange(len(flat)) + np.repeat(first - starts, size))[full]]
    for i in np.flatnonzero(~whole & (counts > 0)).tolist():
        flat[starts[i]] = common.gram_hashes(words[first[i] : first[i] + counts[i]], n)[0]
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        flat[a:b].sort()
    new = np.ones(len(flat), bool)
    np.not_equal(flat[1:], flat[:-1], out=new[1:])
    some = np.flatnonzero(size)
    new[starts[some]] = True
    own, left = flat[new], np.concatenate([[0], np.cumsum(new)])
    bounds = np.concatenate([[0], left[ends]]) if len(ends) else np.zeros(1, np.int64)
    nodes = np.zeros(len(counts), np.uint64)
    if len(some):
        at = bounds[some]
        total = np.bitwise_xor.reduceat(own, at) + np.add.reduceat(own, at) + np.diff(bounds)[some].astype(np.uint64)
        nodes[some] = common.mix(total) | np.uint64(1)
    return own, bounds, nodes


def sets(batch: pa.RecordBatch, n: int) -> Iterator[tuple[int, np.ndarray, int]]:
    """(row, sorted distinct shingle hashes, node) of each text."""
    own, bounds, nodes = shingles(batch, n)
    for i, (a, b, node) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), nodes.tolist(), strict=True)):
        yield i, own[a:b], node


class Fresh:
    """The texts of a batch whose nodes this mapper has not had yet."""

    def __init__(self):
        self.seen: set[int] = set()

    def __call__(self, own: np.ndarray, bounds: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Their shingles, set sizes and nodes."""
        new = np.fromiter((v != 0 and v not in self.seen and not self.seen.add(v) for v in nodes.tolist()), bool, len(nodes))
        sizes = np.diff(bounds)
        return own[np.repeat(new, sizes)], sizes[new], nodes[new]


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def columns_of(h: np.ndarray, targets: int) -> tuple[np.ndarray, np.ndarray]:
    """Target and 32-bit column of each shingle; two shingles in one column only make a candidate more."""
    return ((h & np.uint64(0xFFFFFFFF)) % np.uint64(targets)).astype(np.int64), (h >> np.uint64(32)).astype(np.uint32)


class Blocks:
    """Entries of one mapper, sent as one packed block per target."""

    def __init__(self, keys: list[int], kind: np.dtype, most: int = HELD):
        self.keys, self.kind, self.most, self.parts, self.held = keys, kind, most, [], 0

    def add(self, entries: np.ndarray) -> bool:
        self.parts.append(entries)
        self.held += len(entries)
        return self.held >= self.most

    def take(self) -> np.ndarray:
        all_ = np.concatenate(self.parts) if self.parts else np.empty(0, self.kind)
        self.parts, self.held = [], 0
        return all_

    def send(self, entries: np.ndarray, target: np.ndarray | None = None, pack=lambda x: x.tobytes()) -> Iterator[pa.RecordBatch]:
        """One row per target; target is that of each entry, by its field h unless given."""
        if target is None:
            target = (entries["h"] % np.uint64(len(self.keys))).astype(np.int64)
        order = np.argsort(target, kind="stable")
        entries = entries[order]
        target = target[order]
        del order
        cuts = np.flatnonzero(np.diff(target)) + 1
        starts = np.concatenate([[0], cuts])
        ends = np.concatenate([cuts, [len(entries)]])
        if len(entries):
            yield rows(len(starts), key=[self.keys[t] for t in target[starts].tolist()], n=target[starts], block=[pack(entries[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])


TAGGED = np.dtype([("q", "<u4"), ("t", "u1")])


def packed(entries: np.ndarray) -> bytes:
    """Entries sorted by column: columns as 16-bit steps, longer steps apart, then the tags."""
    entries = entries[np.argsort(entries["q"], kind="stable")]
    step = np.diff(entries["q"], prepend=np.uint32(0))
    long = step >= 0xFFFF
    return np.uint32(len(step)).tobytes() + np.where(long, 0xFFFF, step).astype("<u2").tobytes() + entries["t"].tobytes() + step[long].astype("<u4").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data, "<u4", 1)[0])
    step = np.frombuffer(data, "<u2", n, 4).astype(np.uint32)
    out = np.empty(n, TAGGED)
    out["t"] = np.frombuffer(data, "u1", n, 4 + 2 * n)
    step[step == 0xFFFF] = np.frombuffer(data, "<u4", -1, 4 + 3 * n)
    out["q"] = np.cumsum(step, dtype=np.uint32)
    return out


def runs(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal values."""
    starts = np.concatenate([[0], np.flatnonzero(np.diff(h)) + 1]) if len(h) else np.empty(0, np.int64)
    return starts, np.diff(np.concatenate([starts, [len(h)]]))


def products(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of places within runs of at most DENSE."""
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for m in range(2, DENSE + 1):
        at = starts[lengths == m]
        if len(at):
            i, j = np.triu_indices(m, 1)
            left.append((at[:, None] + i).ravel())
            right.append((at[:, None] + j).ravel())
    return np.concatenate(left), np.concatenate(right)


def bits_of(own: np.ndarray) -> bytes:
    """Which of 4 to 8 times as many places as the set has members are taken by one."""
    size = 1 << max(6, int(4 * len(own) - 1).bit_length())
    bits = np.zeros(size, np.uint8)
    bits[(own & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


class Among:
    """Lets the rows pass whose doc_id is one of the ids, null too if that is one: eight bytes an id, in the driver as well."""

    def __init__(self, spark: SparkSession, ids: pa.Array):
        known = np.sort(ids.drop_null().to_numpy(zero_copy_only=False))
        self.sent = spark.sparkContext.broadcast((known, ids.null_count > 0))

    def __call__(self, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, null = self.sent.value
        for batch in it:
            ids = batch.column("doc_id")
            x = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
            keep = np.full(len(x), False)
            if len(known):
                keep = known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x
            yield batch.filter(pa.array(np.where(ids.is_valid().to_numpy(zero_copy_only=False), keep, null)))


def sets_of(docs: DataFrame, n: int, among: Among | None = None) -> DataFrame:
    """(v, n, marks, s) of each document with words, or of those that among lets pass: its set's size, taken places, and shingles; a node once in each task."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in common.batches(it if among is None else among(it), "text"):
            got = [(node, own) for _, own, node in sets(batch, n) if node and node not in seen and not seen.add(node)]
            v = signed(np.array([g[0] for g in got], np.uint64))
            sizes = np.array([len(g[1]) for g in got], np.int64)
            marks = pa.array([bits_of(g[1]) for g in got], pa.binary())
            values = np.concatenate([signed(g[1]) for g in got]) if got else np.empty(0, np.int64)
            lists_ = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))
            yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(sizes), marks, lists_], ["v", "n", "marks", "s"])

    return docs.mapInArrow(common.lean(run), "v long, n long, marks binary, s array<long>")


def unmatched(x: np.ndarray, y: np.ndarray) -> int:
    """Members of x at least that y lacks: places taken by x alone, folded to the shorter marks."""
    size = min(len(x), len(y))
    fold = lambda z: np.bitwise_or.reduce(z.reshape(-1, size), 0)
    return int(np.unpackbits(fold(x) & ~fold(y)).sum())


def hopeful(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """The pairs whose marks leave the similarity possible: an exact bound that spares most whole sets the way."""
    left, right = (marks.select(F.col("v").alias(e), F.col("n").alias(f"n{e}"), F.col("marks").alias(f"m{e}")) for e in ("a", "b"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            keep = []
            for na, nb, x, y in zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "ma", "mb")), strict=True):
                x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                both = min(na - unmatched(x, y), nb - unmatched(y, x))
                keep.append(both * (100 + percent) >= percent * (na + nb))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "ma", "mb").mapInArrow(common.lean(run), "a long, b long")


def lists(column: pa.Array) -> Iterator[np.ndarray]:
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield values[a:b].view(np.uint64)


def common_shingles(docs: DataFrame, n: int, keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Columns of more than DENSE nodes (target << 32 | column, sorted) and their counts; ORDERED at most.

    A node counts by one byte of it, so that copies of a text count once wherever they lie; counts end at 256.
    """
    def mapper(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, targets, fresh = Blocks(keys, TAGGED, 2 * HELD), Blocks(keys, np.dtype(np.int32)), Fresh()

        def flush() -> Iterator[pa.RecordBatch]:
            yield from blocks.send(blocks.take(), targets.take(), packed)
            fresh.seen.clear()

        for part in common.batches(it, "text", SLICE):
            own, sizes, nodes = fresh(*shingles(part, n))
            target, q = columns_of(own, len(keys))
            entries = np.empty(len(own), TAGGED)
            entries["q"], entries["t"] = q, np.repeat((nodes >> np.uint64(8)).astype(np.uint8), sizes)
            targets.add(target.astype(np.int32))
            if blocks.add(entries):
                yield from flush()
        yield from flush()

    def reducer(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in it:
            for target, data in zip(batch.column("n").to_pylist(), batch.column("block").to_pylist(), strict=True):
                held.setdefault(target, []).append(unpacked(data))
        for target, parts in held.items():
            e = np.concatenate(parts)
            q = common.distinct(e["q"].astype(np.uint64) << np.uint64(8) | e["t"]) >> np.uint64(8)
            starts, lengths = runs(q)
            often = lengths > DENSE
            yield rows(int(often.sum()), a=(target << 32) + q[starts[often]].astype(np.int64), n=lengths[often])

    found = docs.mapInArrow(common.lean(mapper), ROWS).repartition(len(keys), "key").mapInArrow(common.lean(reducer), ROWS).select("a", "n")
    got = found.orderBy(F.desc("n"), "a").limit(ORDERED).toArrow()
    a, c = got.column("a").to_numpy(), got.column("n").to_numpy()
    order = np.argsort(a)
    return a[order], c[order]


def product(docs: DataFrame, often: tuple[np.ndarray, np.ndarray], n: int, percent: int, keys: list[int]) -> DataFrame:
    """Rows of kind DOC for every document, DENSE_ENTRY for a node's columns that are not multiplied out, and PAIR.

    A PAIR is what one block of columns adds to the product at (a, b): m columns in common, the sizes packed
    in n (a's by the lower 32 bits), and pos, the most that both have left from a common column on.
    """
    table = docs.sparkSession.sparkContext.broadcast(often)  # ORDERED entries at most

    def mapper(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = table.value
        maybe = np.zeros(1 << 22, bool)
        maybe[known & (len(maybe) - 1)] = True
        blocks, targets, fresh, turn = Blocks(keys, ENTRY, HELD), Blocks(keys, np.dtype(np.int32)), Fresh(), 0

        def flush() -> Iterator[pa.RecordBatch]:
            yield from blocks.send(blocks.take(), targets.take())
            fresh.seen.clear()

        def spread(count: int) -> list[int]:
            return [keys[(turn + i) % len(keys)] for i in range(count)]

        for part in common.batches(it, "text", SLICE):
            own, bounds, nodes = shingles(part, n)
            yield rows(len(nodes), key=spread(len(nodes)), kind=np.full(len(nodes), DOC), doc_id=part.column("doc_id"), a=signed(nodes), n=np.diff(bounds), pos=part.column("th"))
            own, sizes, nodes = fresh(own, bounds, nodes)
            turn += part.num_rows
            if not len(nodes):
                continue
            target, q = columns_of(own, len(keys))
            column = (target << 32) + q
            df = np.zeros(len(own), np.int64)
            look = np.flatnonzero(maybe[column & (len(maybe) - 1)])
            if len(look):
                at = np.minimum(np.searchsorted(known, column[look]), len(known) - 1)
                df[look] = np.where(known[at] == column[look], counts[at], 0)
            rare, start = df == 0, np.cumsum(sizes) - sizes
            place = np.cumsum(rare) - rare
            place -= np.repeat(place[start], sizes)
            leading = sizes - -(-percent * sizes // 100) + 1
            take = rare & (place < np.repeat(leading, sizes))
            entries = np.empty(int(take.sum()), ENTRY)
            entries["q"], entries["p"] = q[take], place[take]
            entries["v"], entries["n"] = np.repeat(nodes, sizes)[take], np.repeat(sizes, sizes)[take]
            targets.add(target[take].astype(np.int32))
            full = blocks.add(entries)
            few = np.add.reduceat(rare, start)
            dense = []
            for i in np.flatnonzero(few < leading).tolist():
                mine = start[i] + np.flatnonzero(~rare[start[i] : start[i] + sizes[i]])
                mine = mine[np.argsort(df[mine], kind="stable")[: leading[i] - few[i]]]
                dense.append((column[mine], np.full(len(mine), nodes[i]), np.arange(few[i], leading[i]), np.full(len(mine), sizes[i])))
            if dense:
                h, v, pos, size = (np.concatenate(x) for x in zip(*dense, strict=True))
                yield rows(len(h), key=spread(len(h)), kind=np.full(len(h), DENSE_ENTRY), a=h, b=signed(v), n=size, pos=pos)
            if full:
                yield from flush()
        yield from flush()

    def reducer(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in it:
            is_block = batch.column("block").is_valid()
            blocks = batch.filter(is_block)
            for target, data in zip(blocks.column("n").to_pylist(), blocks.column("block").to_pylist(), strict=True):
                held.setdefault(target, []).append(np.frombuffer(data, ENTRY))
            yield batch.filter(pc.invert(is_block))
        for parts in held.values():
            e = np.concatenate(parts)
            e = e[np.argsort(e["q"], kind="stable")]
            starts, lengths = runs(e["q"])
            e = e[np.repeat(lengths > 1, lengths)]
            e = e[np.lexsort((e["p"], e["v"], e["q"]))]
            new = np.ones(len(e), bool)  # copies of one text in several mappers are one node
            new[1:] = (e["q"][1:] != e["q"][:-1]) | (e["v"][1:] != e["v"][:-1]) | (e["p"][1:] != e["p"][:-1])
            e = e[new]
            starts, lengths = runs(e["q"])
            yield accumulated(e, *products(starts, lengths), percent)
            # beyond the ORDERED most common: compared with leaders, whatever their place
            over = e[np.repeat(lengths > DENSE, lengths)]
            yield rows(len(over), kind=np.full(len(over), DENSE_ENTRY), a=over["q"].astype(np.int64) - (1 << 33), b=signed(over["v"].copy()), n=over["n"].astype(np.int64), pos=over["p"].astype(np.int64))

    return docs.mapInArrow(common.lean(mapper), ROWS).repartition(len(keys), "key").mapInArrow(common.lean(reducer), ROWS).drop("key", "block")


def accumulated(e: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> pa.RecordBatch:
    """The block's product: of the pairs of entries (i, j) one PAIR row for each pair of nodes whose sizes allow the similarity."""
    size = e["n"].astype(np.int64)
    ok = 100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j])
    i, j = i[ok], j[ok]
    turn = e["v"][i] > e["v"][j]
    i, j = np.where(turn, j, i), np.where(turn, i, j)
    rest = np.minimum(size[i] - e["p"][i], size[j] - e["p"][j])
    order = np.lexsort((e["v"][j], e["v"][i]))
    i, j, rest = i[order], j[order], rest[order]
    a, b = e["v"][i], e["v"][j]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    at = np.flatnonzero(new)
    if len(at) == 0:
        return rows(0)
    shared, most = np.diff(np.concatenate([at, [len(a)]])), np.maximum.reduceat(rest, at)
    return rows(len(at), kind=np.full(len(at), PAIR), a=signed(a[at]), b=signed(b[at]), n=size[i[at]] + (size[j[at]] << 32), m=shared, pos=most)


def candidates(parts: DataFrame, entries: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs whose accumulated overlap leaves the similarity possible.

    What the leading columns share is the count over all blocks and at most the columns of either that
    were not multiplied out; what the rest shares is at most the rest of the set whose leading columns end first.
    """
    summed = parts.groupBy("a", "b").agg(F.first("n").alias("n"), F.sum("m").alias("shared"), F.max("pos").alias("most"))
    summed = summed.select("a", "b", F.col("n").bitwiseAND(0xFFFFFFFF).alias("na"), F.shiftright("n", 32).alias("nb"), "shared", "most")
    least = F.ceil(percent * (F.col("na") + F.col("nb")) / (100 + percent))  # the overlap that the similarity takes
    summed = summed.where(F.col("most") >= least)
    left = lambda size: F.ceil(percent * F.col(size) / 100) - 1
    rest = F.greatest(left("na"), left("nb"))
    summed = summed.where((F.col("shared") + rest >= least) | F.lit(not entries.isEmpty()))
    if not entries.isEmpty():
        heavy = entries.groupBy("v").agg(F.count("*").alias("heavy"))
        for end in ("a", "b"):
            summed = summed.join(heavy.select(F.col("v").alias(end), F.col("heavy").alias(f"heavy_{end}")), end, "left")
        summed = summed.where(F.col("shared") + F.least(F.coalesce("heavy_a", F.lit(0)), F.coalesce("heavy_b", F.lit(0))) + rest >= least)
    return summed.select("a", "b")


def bounded(nx, ny, px, py, percent: int):
    """Whether sets of sizes nx and ny whose first common shingle is at px and py can reach the similarity."""
    rest = F.least(nx - px, ny - py)
    return (100 * F.least(nx, ny) >= percent * F.greatest(nx, ny)) & (rest * (100 + percent) >= percent * (nx + ny))


def verified(pairs: DataFrame, own: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the similarity."""
    left, right = own.select(F.col("v").alias("a"), F.col("s").alias("s1")), own.select(F.col("v").alias("b"), F.col("s").alias("s2"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            keep = []
            for x, y in zip(lists(batch.column("s1")), lists(batch.column("s2")), strict=True):
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "s1", "s2").mapInArrow(common.lean(run), "a long, b long")


def text_hash(docs: DataFrame):
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def similar(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """Classes of documents linked by the Jaccard similarity of their n-word shingle sets.

    docs has doc_id and text; other columns are ignored. Returns a row per input row: doc_id,
    n_shingles, class_size (rows with the same set; null for the empty one), component_id. A-Z
    is lower-cased. A text of fewer than n words is one shingle, its whole sequence; a null text
    or one without words has no shingle, is linked with nothing and is its own component; a long
    text counts whole. Rows with equal sets are linked, repeated rows too. component_id is the
    smallest doc_id that links reach; rows with a null doc_id take part, and have the component
    of what they reach. An empty table gives no rows.
    """
    return classes_of(docs, n, percent).select("doc_id", "n_shingles", "class_size", "component_id")


def one_of_each(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """The rows of docs without near copies: of rows linked as in similar() one stays.

    That of the smallest doc_id (null last), of several with it that of the smallest text hash, of equal
    ones any. Rows that share a doc_id but are not linked all stay, and so do texts without words.
    """
    found = common.materialize(classes_of(docs, n, percent).where("component is not null").select("doc_id", "text_hash", "component"), "found")
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    kept = found.groupBy("component").agg(F.min(own).alias("kept"), F.count("*").alias("rows")).where("rows > 1").select("component", "kept")
    met = found.join(sized(kept, 4), "component").select("doc_id", "text_hash", (own == F.col("kept")).alias("stays"))
    met = common.materialize(met.groupBy("doc_id", "text_hash", "stays").count(), "met")
    names = [f"_own{i}" for i in range(len(docs.columns))]
    out = docs.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(docs.columns, names, strict=True)], F.col("doc_id").cast("long").alias("_id"), text_hash(docs).alias("_hash"))
    same = lambda other: out["_id"].eqNullSafe(other["doc_id"]) & (out["_hash"] == other["text_hash"])
    gone, twice = met.where("not stays"), met.where("stays and count > 1")
    if not twice.isEmpty():
        out = out.join(twice, same(twice), "left_anti").union(out.join(twice, same(twice), "left_semi").dropDuplicates(["_id", "_hash"]))
    return out.join(gone, same(gone), "left_anti").select(*names).toDF(*docs.columns)


def sized(table: DataFrame, width: int = 1) -> DataFrame:
    """The table, for a broadcast up to BROADCAST_ROWS of rows that are `width` times a narrow one's."""
    table = common.materialize(table, "sized")
    return F.broadcast(table) if table.count() * width <= BROADCAST_ROWS else table


def classes_of(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """What similar() returns, text_hash and component: one number for each group of linked rows, null without words."""
    spark = docs.sparkSession
    keys = even_keys(spark, common.partitions(spark, docs))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_hash(docs).alias("th"))
    first = common.materialize(product(texts, common_shingles(texts, n, keys), n, percent, keys), "grams")
    members = first.where(f"kind = {DOC}").select("doc_id", F.col("a").alias("v"), "n", F.col("pos").alias("text_hash"))
    classes = common.materialize(members.where("v <> 0").groupBy("v").agg(F.min("doc_id").alias("rep"), F.count("*").alias("class_size")), "classes")
    entries = common.materialize(first.where(f"kind = {DENSE_ENTRY}").select(F.col("a").alias("h"), F.col("b").alias("v"), "n", "pos").distinct(), "entries")
    pairs = common.materialize(candidates(first.where(f"kind = {PAIR}"), entries, percent), "pairs")
    entries = common.materialize(mixed(entries.withColumn("lead", leads(percent)).withColumn("c", F.col("v"))).drop("c", "rows"), "entries")

    def sets_at(nodes: DataFrame) -> DataFrame:
        """The sets of one text of each node (with those of the same doc_id)."""
        reps = common.materialize(classes.join(nodes.distinct(), "v", "left_semi").select("rep").distinct(), "reps")
        if reps.count() <= BROADCAST_IDS:
            return sets_of(texts, n, Among(spark, reps.toArrow().column("rep").combine_chunks()))
        return sets_of(texts.join(reps, texts["doc_id"].eqNullSafe(reps["rep"]), "left_semi"), n)

    def linked(tried: DataFrame) -> DataFrame:
        """The pairs that reach the similarity, by their marks first, then by their whole sets."""
        left = common.materialize(hopeful(tried, own, percent), "hopeful")
        return common.materialize(verified(left, own, percent), "links")

    own = common.materialize(sets_at(pairs.select(F.explode(F.array("a", "b")).alias("v")).union(entries.select("v"))), "sets")
    if not own.groupBy("v").count().where("count > 1").isEmpty():  # repeated rows of one doc_id
        own = common.materialize(own.dropDuplicates(["v"]), "sets")
    entries = None if entries.isEmpty() else entries
    labels = links(pairs, entries, linked, percent)
    named = classes if labels is None else classes.join(labels.withColumnRenamed("node", "v"), "v", "left")
    named = named.withColumn("component", F.coalesce("component", "v") if labels is not None else F.col("v"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "component").select("v", "class_size", "component_id", "component")
    out = members.join(named, "v", "left")
    component_id = F.when(F.col("v") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "class_size", component_id.alias("component_id"), "component")


def links(pairs: DataFrame, entries: DataFrame | None, linked, percent: int) -> DataFrame | None:
    """Components (node, component) of the candidate pairs and dense columns; None without any link.

    First every node is compared with its smallest partner and with the smallest node of its dense
    columns; later rounds compare only nodes that are still in different components.
    """
    labels, round_ = None, 0
    while True:
        seen = None if labels is None else labels.groupBy("node").agg(F.min("component").alias("component"))
        if round_ == 0:
            tried = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
        elif round_ == 1:
            tried = pairs if seen is None else apart(pairs, seen)
        else:
            tried = None
        if entries is not None:
            fresh, entries = led(entries, seen, percent, last=round_ >= LEADER_ROUNDS)
            tried = fresh if tried is None else tried.union(fresh)
        round_ += 1
        if tried is None:
            return None if labels is None else common.components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")), "components")
        edges = linked(tried.where("a <> b").distinct())
        if not edges.isEmpty():
            known = edges if labels is None else edges.union(labels.select(F.col("node").alias("a"), F.col("component").alias("b")))
            labels = common.components(known, "components", whole=False)
        if entries is None and round_ >= 2:
            return None if labels is None else common.components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")), "components")


def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    for end in ("a", "b"):
        pairs = pairs.join(labels.select(F.col("node").alias(end), F.col("component").alias(f"c{end}")), end, "left")
    return pairs.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def leads(percent: int):
    """Whether a node can be the smaller of a similar pair whose first common shingle stands here."""
    return F.col("pos") * (100 + percent) <= (100 - percent) * F.col("n")


def beside(entries: DataFrame, columns: DataFrame, how: str = "inner", width: int = 1) -> DataFrame:
    """entries joined with a table by column h: broadcast up to BROADCAST_ROWS of rows that are `width` times a narrow one's, else with every column dealt over SALTS tasks."""
    columns = common.materialize(columns, "columns")
    if columns.count() * width <= BROADCAST_ROWS:
        return entries.join(F.broadcast(columns), "h", how)
    dealt = columns.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return entries.withColumn("salt", F.pmod(F.col("v"), F.lit(SALTS)).cast("int")).join(dealt, ["h", "salt"], how).drop("salt")


def mixed(entries: DataFrame) -> DataFrame:
    """Entries of columns that hold more than one component and a node that can be the smaller of a pair; `rows`: entries of the column."""
    columns = entries.groupBy("h").agg(F.count("*").alias("rows"), F.min("c").alias("x"), F.max("c").alias("y"), F.max("lead").alias("z"))
    return beside(entries, columns.where("x <> y and z").select("h", "rows"))


def multiplied(here: DataFrame, percent: int) -> DataFrame:
    """Candidates (a, b) of different components within the columns, under the bounds; columns of over SALTED entries are dealt over several tasks."""
    dealt = here.withColumn("parts", F.ceil(F.col("rows") / SALTED).cast("int"))
    x, y = (dealt.select("h", "parts", *[F.col(k).alias(f"{k}{i}") for k in ("v", "n", "pos", "c", "lead")]) for i in (1, 2))
    x = x.where("lead1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    y = y.withColumn("salt", F.pmod(F.col("v2"), F.col("parts")).cast("int")).drop("parts")
    first = (F.col("n1") < F.col("n2")) | ((F.col("n1") == F.col("n2")) & (~F.col("lead2") | (F.col("v1") < F.col("v2"))))
    met = x.join(y, ["h", "salt"]).where(first & (F.col("c1") != F.col("c2")) & bounded(F.col("n1"), F.col("n2"), F.col("pos1"), F.col("pos2"), percent))
    return met.select(F.least("v1", "v2").alias("a"), F.greatest("v1", "v2").alias("b"))


def led(entries: DataFrame, labels: DataFrame | None, percent: int, last: bool) -> tuple[DataFrame, DataFrame | None]:
    """Candidates of every dense column and the entries that are still to be compared (None: none).

    Columns of at most SMALL entries are multiplied out at once; every other one is compared with its
    smallest node, from the second round on with LEADERS nodes, one of each residue, and at last multiplied out too.
    """
    here = entries.withColumn("c", F.col("v"))
    if labels is not None:
        here = entries.join(labels.select(F.col("node").alias("v"), F.col("component").alias("c")), "v", "left").withColumn("c", F.coalesce("c", "v"))
        here = common.materialize(here, "entries")
    here = common.materialize(mixed(here), "entries")
    large = here.where(F.col("rows") > SMALL)
    if last or large.isEmpty():
        return multiplied(here, percent), None
    firsts = large.groupBy("h", F.pmod(F.shiftright("v", 20), F.lit(1 if labels is None else LEADERS)).alias("_k")).agg(F.min(F.struct("v", "n", "pos", "c")).alias("l"))
    leaders = firsts.groupBy("h").agg(F.collect_list("l").alias("ls"))
    met = beside(large, leaders, width=LEADERS)
    fits = F.filter("ls", lambda l: (l["v"] != F.col("v")) & (l["c"] != F.col("c")) & bounded(F.col("n"), l["n"], F.col("pos"), l["pos"], percent))
    # a node meets the same leaders in many columns: once each
    mine = met.groupBy("v").agg(F.array_distinct(F.flatten(F.collect_set(F.transform(fits, lambda l: l["v"])))).alias("a"))
    pairs = mine.select(F.explode("a").alias("a"), F.col("v").alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = met.where(~F.exists("ls", lambda l: l["v"] == F.col("v"))).select("h", "v", "n", "pos", "lead")
    return multiplied(here.where(F.col("rows") <= SMALL), percent).union(pairs), common.materialize(rest, "entries")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(common.table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "class_size")


ORACLE_OP2 = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(words) - 4, 1) + 1), lambda i: array_to_string(list_slice(words, i, i + 4), ' '))) END AS g
  FROM w
), e AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
o AS (
  SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS shared
  FROM e x JOIN e y ON x.g = y.g AND x.doc_id <> y.doc_id AND 100 * least(x.n, y.n) >= 75 * greatest(x.n, y.n)
  GROUP BY 1, 2
), links AS (SELECT a, b FROM o WHERE 100 * shared >= 75 * (na + nb - shared)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), size AS (SELECT g AS gs, count(*) AS class_size FROM (SELECT list_sort(g) AS g FROM s) WHERE len(g) > 0 GROUP BY 1)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, c.component_id, z.class_size
FROM s JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY 1) c ON c.a = s.doc_id
LEFT JOIN size z ON z.gs = list_sort(s.g)
"""
