"""Approximate nearest neighbours: a neighbour graph by NN-descent, searched greedily.

Equal vectors are one node. The graph starts from the leaves of a few random-projection
trees, fitted on a bounded sample; then rounds of Spark joins bring every node's neighbours
together with their vectors, and neighbours of neighbours that are nearer replace the
farthest. As in NN-descent, a node that very many point to is met by a sample of these, drawn
anew each round by a hash; all edges stay in the graph. A query starts at the sample nodes of
its own leaves and expands the nearest unexpanded nodes of its beam, for all queries at once,
until nothing is left to expand. Graph and search compare vectors in single precision; what is
found is ranked by exact distances in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Neighbours of a node, trees, vectors of a leaf, rounds at most, share of changed edges that ends them.
K, TREES, LEAF, ROUNDS, SETTLED = 20, 3, 64, 5, 0.02
#: The trees and the entry points are fitted on so many nodes at most, those of the smallest hash.
SAMPLE = 4096
#: Nodes that point to one and are brought together with it in a round: all up to so many, else a sample of about as many.
REVERSE = 3 * K
#: Vectors that are compared with each other at once; a larger leaf is cut along one more direction.
LARGEST = 4096
#: Entry points of a query in each tree, and nodes of its beam.
ENTRIES, BEAM = 16, 192
RESULTS = 10


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vec double array) of vectors that take part: of the commonest length, all components finite, not zero."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = v.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0)).where(~bad & F.exists("vec", lambda x: x != 0))
    size = v.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return v.where(F.size("vec") == (size["n"] if size else 0))


def lowered(x: np.ndarray, scale: float) -> list[bytes]:
    """Rows as single-precision bytes in units of scale: what the graph and the search compare."""
    with np.errstate(over="ignore"):
        return [r.tobytes() for r in (x / scale).astype(np.float32)]


def raised(rows: list[bytes]) -> np.ndarray:
    """Rows of lowered() as a matrix."""
    return np.frombuffer(b"".join(rows), np.float32).reshape(len(rows), -1).astype(float) if rows else np.empty((0, 0))


def matrix(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1) if rows else np.empty((0, 0))


def nodes_of(vectors: DataFrame) -> DataFrame:
    """One row per distinct vector: node (its smallest id), ids (its RESULTS + 1 smallest), vec as bytes of doubles."""

    def gather(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}
        for batch in it:
            column = batch.column("vec")
            flat = column.values.to_numpy()[column.offsets[0].as_py() : column.offsets[-1].as_py()] + 0.0  # -0.0 is 0.0
            rows = flat.reshape(batch.num_rows, -1) if batch.num_rows else flat
            for i, row in zip(batch.column("vec_id").to_pylist(), rows, strict=True):
                held.setdefault(row.tobytes(), []).append(i)
            if len(held) > 50_000:
                yield out(held)
                held = {}
        yield out(held)

    def out(held: dict[bytes, list[int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([sorted(set(x))[: RESULTS + 1] for x in held.values()], pa.list_(pa.int64())), pa.array(list(held), pa.binary())], ["ids", "vec"])

    met = vectors.mapInArrow(common.lean(gather), "ids array<long>, vec binary").groupBy("vec").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, RESULTS + 1).alias("ids"))
    return met.select(F.col("ids")[0].alias("node"), "ids", "vec")


class Trees:
    """Random-projection trees: at every inner place a direction and the median of the sample along it."""

    def __init__(self, sample: np.ndarray, total: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.depth = max(0, int(np.ceil(np.log2(max(1, min(total / LEAF, len(sample) / 2))))))
        self.trees = []
        for _ in range(TREES):
            directions = np.zeros((1 << self.depth, sample.shape[1]))
            cuts = np.full(1 << self.depth, 0.0)
            place = np.ones(len(sample), np.int64)
            for level in range(self.depth):
                for p in range(1 << level, 2 << level):
                    own = sample[place == p]
                    if len(own) < 2:
                        directions[p] = rng.standard_normal(sample.shape[1])
                        continue
                    a, b = rng.choice(len(own), 2, replace=False)
                    directions[p] = own[a] - own[b] if np.any(own[a] != own[b]) else rng.standard_normal(sample.shape[1])
                    cuts[p] = np.median(own @ directions[p])
                side = np.einsum("ij,ij->i", sample, directions[place]) > cuts[place]
                place = 2 * place + side
            self.trees.append((directions, cuts))

    def places(self, x: np.ndarray) -> np.ndarray:
        """The place of each vector at the bottom of every tree."""
        out = np.empty((len(self.trees), len(x)), np.int64)
        for t, (directions, cuts) in enumerate(self.trees):
            place = np.ones(len(x), np.int64)
            for _ in range(self.depth):
                place = 2 * place + (np.einsum("ij,ij->i", x, directions[place]) > cuts[place])
            out[t] = place
        return out


class Entries:
    """The sample by its places in the trees: where a query enters the graph."""

    def __init__(self, trees: Trees, ids: np.ndarray, sample: np.ndarray):
        self.trees, self.ids, self.sample = trees, ids, sample
        self.by = []
        for places in trees.places(sample):
            order = np.argsort(places, kind="stable")
            self.by.append((order, places[order]))

    def near(self, x: np.ndarray) -> list[np.ndarray]:
        """Of each vector the sample nodes below the lowest place, in every tree, that has ENTRIES of them."""
        found: list[list[np.ndarray]] = [[] for _ in range(len(x))]
        for (order, sorted_), places in zip(self.by, self.trees.places(x), strict=True):
            for i, place in enumerate(places.tolist()):
                for up in range(self.trees.depth + 1):
                    lo, hi = np.searchsorted(sorted_, ((place >> up) << up, ((place >> up) + 1) << up))
                    if hi - lo >= ENTRIES:
                        break
                found[i].append(order[lo:hi])
        return [common.distinct(np.concatenate(f)) for f in found]


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = (x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * (x @ y.T)
    return np.maximum(d, 0)


def nearest(u: np.ndarray, v: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each u its k nearest different v."""
    order = np.lexsort((v, u))
    u, v, d = u[order], v[order], d[order]
    new = np.ones(len(u), bool)
    new[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1])
    new &= u != v
    u, v, d = u[new], v[new], d[new]
    order = np.lexsort((v, d, u))
    u, v, d = u[order], v[order], d[order]
    if len(u) == 0:
        return u, v, d
    starts = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
    rank = np.arange(len(u)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(u)]])))
    return u[rank < k], v[rank < k], d[rank < k]


EDGES = "u long, v long, d double, fresh boolean"


def edge_batch(u: np.ndarray, v: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(d), pa.array(np.ones(len(u), bool))], ["u", "v", "d", "fresh"])


def groups(it: Iterator[pa.RecordBatch], key: str, columns: list[str], most: int | None = None) -> Iterator[list]:
    """Runs of equal key of sorted batches, as one list of rows for each column; cut where a run has `most` rows."""
    held, now = [[] for _ in columns], None
    for batch in it:
        data = [batch.column(c).to_pylist() for c in columns]
        keys = batch.column(key).to_pylist()
        start = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[start] or (most and len(held[0]) + i - start >= most):
                if now is not None and keys[start] != now:
                    yield held
                    held = [[] for _ in columns]
                now = keys[start]
                for h, x in zip(held, data, strict=True):
                    h += x[start:i]
                start = i
                if most and len(held[0]) >= most:
                    yield held
                    held, now = [[] for _ in columns], None
    if now is not None:
        yield held


def first_edges(nodes: DataFrame, trees: Trees) -> DataFrame:
    """Edges among the nodes of a leaf; a leaf that grew beyond 4 LEAF is split further at medians.

    Leaves lie in order of place and, within one, along a direction, and are dealt out by ranges: a leaf
    of any size is cut into blocks of LARGEST neighbours along it, whatever task they are in.
    """
    shared = nodes.sparkSession.sparkContext.broadcast(trees)

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows:
                x = raised(batch.column("low").to_pylist())
                leaves = (shared.value.places(x) << 8) + np.arange(TREES)[:, None]
                along = x @ np.random.default_rng(5).standard_normal((x.shape[1], TREES))
                take = pa.array(np.tile(np.arange(batch.num_rows), TREES))
                yield pa.RecordBatch.from_arrays([pa.array(leaves.ravel()), pa.array(along.T.ravel()), batch.column("node").take(take), batch.column("low").take(take)], ["leaf", "along", "node", "low"])

    def within(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(11)
        for ids, vectors in groups(it, "leaf", ["node", "low"], LARGEST):
            ids, x = np.array(ids), raised(vectors)
            todo = [np.arange(len(ids))]
            us, vs, ds = [], [], []
            while todo:
                own = todo.pop()
                if len(own) > 4 * LEAF:
                    along = np.argsort(x[own] @ rng.standard_normal(x.shape[1]), kind="stable")
                    todo += [own[along[: len(own) // 2]], own[along[len(own) // 2 :]]]
                    continue
                d = distances(x[own], x[own])
                u, v, d = nearest(np.repeat(ids[own], len(own)), np.tile(ids[own], len(own)), d.ravel(), K)
                us.append(u), vs.append(v), ds.append(d)
            yield edge_batch(np.concatenate(us), np.concatenate(vs), np.concatenate(ds))

    placed = nodes.select("node", "low").mapInArrow(common.lean(place), "leaf long, along double, node long, low binary")
    return placed.repartitionByRange(common.partitions(nodes.sparkSession), "leaf", "along").sortWithinPartitions("leaf", "along", "node").mapInArrow(common.lean(within), EDGES)


def best_edges(edges: DataFrame) -> DataFrame:
    """The K nearest of every node; an edge that was there before is no longer fresh."""

    def keep(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in it if b.num_rows]
        if not got:
            return
        u, v, d, fresh = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in got]) for c in ("u", "v", "d", "fresh"))
        order = np.lexsort((fresh, v, u))  # of one edge the older stands first and is kept
        u, v, d, fresh = u[order], v[order], d[order], fresh[order]
        new = np.concatenate([[True], (u[1:] != u[:-1]) | (v[1:] != v[:-1])])
        u, v, d, fresh = u[new], v[new], d[new], fresh[new]
        order = np.lexsort((v, d, u))
        u, v, d, fresh = u[order], v[order], d[order], fresh[order]
        starts = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
        rank = np.arange(len(u)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(u)]])))
        ok = rank < K
        for a in range(0, int(ok.sum()), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[ok][a : a + 100_000]) for x in (u, v, d, fresh)], ["u", "v", "d", "fresh"])

    return edges.repartition(common.partitions(edges.sparkSession), "u").mapInArrow(common.lean(keep), EDGES)


def descend(nodes: DataFrame, edges: DataFrame, turn: int) -> DataFrame:
    """Nearer pairs among the neighbours of every node, one of them fresh at least.

    Of nodes that point to one, all up to REVERSE are among its neighbours, else a sample of about REVERSE,
    drawn by a hash before anything is brought together.
    """
    ahead = edges.select(F.col("u").alias("c"), F.col("v").alias("m"), "d", "fresh")
    hubs = common.materialize(edges.groupBy(F.col("v").alias("c")).agg(F.count("*").alias("n")).where(F.col("n") > REVERSE), "hubs")
    back = edges.select(F.col("v").alias("c"), F.col("u").alias("m"), "d", "fresh").join(hubs, "c", "left")
    back = back.where(F.col("n").isNull() | (F.pmod(F.xxhash64("c", "m", F.lit(turn)), F.col("n")) < REVERSE)).drop("n")
    far = edges.groupBy("u").agg(F.max("d").alias("far"), F.count("*").alias("n")).select(F.col("u").alias("m"), F.when(F.col("n") >= K, F.col("far")).otherwise(float("inf")).alias("far"))
    known = nodes.select(F.col("node").alias("m"), "low").join(far, "m", "left")
    met = ahead.union(back).join(known, "m")

    def within(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, vs, ds, size = [], [], [], 0

        def out() -> pa.RecordBatch:
            return edge_batch(*nearest(*(np.concatenate(x) for x in (us, vs, ds)), K))

        for m, d, fresh, vectors, far_ in groups(it, "c", ["m", "d", "fresh", "low", "far"]):
            order = np.argsort(d, kind="stable")
            ids, first = np.unique(np.array(m)[order], return_index=True)
            pick = order[np.sort(first)]
            ids = np.array(m)[pick]
            if len(ids) < 2:
                continue
            x = raised([vectors[i] for i in pick])
            new = np.array(fresh)[pick]
            limit = np.array([np.inf if far_[i] is None else far_[i] for i in pick])
            dist = distances(x, x)
            i, j = np.nonzero((dist < limit[:, None]) & (new[:, None] | new[None]) & ~np.eye(len(ids), dtype=bool))
            us.append(ids[i]), vs.append(ids[j]), ds.append(dist[i, j])
            size += len(i)
            if size > 500_000:
                yield out()
                us, vs, ds, size = [], [], [], 0
        if us:
            yield out()

    return met.repartition(common.partitions(nodes.sparkSession), "c").sortWithinPartitions("c").mapInArrow(common.lean(within), EDGES)


class Graph:
    """Nodes, edges (node, near) in both directions, where queries enter, and the unit of their low vectors."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, entries: Entries, scale: float):
        self.nodes, self.edges, self.entries, self.scale = nodes, edges, entries, scale


def build(vectors: DataFrame) -> Graph:
    """Index every usable vector (vec_id, embedding).

    Vectors that are null, zero, of another length than most, or hold null or non-finite
    components take no part, nor rows with a null vec_id. Equal vectors are one node, and the
    same vec_id with different vectors is several. Other columns are ignored.
    """
    exact = common.materialize(nodes_of(usable(vectors)), "exact")

    def largest(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([float(np.abs(matrix(batch.column("vec"))).max())])], ["most"])

    scale = exact.select("vec").mapInArrow(common.lean(largest), "most double").agg(F.max("most")).first()[0] or 1.0

    def add(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lowered(matrix(batch.column("vec")), scale), pa.binary())], ["node", "ids", "vec", "low"])

    nodes = common.materialize(exact.mapInArrow(common.lean(add), "node long, ids array<long>, vec binary, low binary"), "nodes")
    total = nodes.count()
    got = nodes.orderBy(F.xxhash64("vec"), "node").limit(SAMPLE).select("node", "low").toArrow()
    ids, sample = got.column("node").to_numpy(), raised(got.column("low").to_pylist())
    trees = Trees(sample, total)
    entries = Entries(trees, ids, sample)
    if total == 0:
        return Graph(nodes, nodes.select("node", F.col("node").alias("near")), entries, scale)
    edges = common.materialize(best_edges(first_edges(nodes, trees)), "edges")
    for turn in range(ROUNDS):
        edges = common.materialize(best_edges(edges.withColumn("fresh", F.lit(False)).union(descend(nodes, edges, turn))), "edges")
        if edges.where("fresh").count() < SETTLED * K * total:
            break
    # both directions, so that a node that is near to few is found too
    both = edges.select(F.col("u").alias("node"), F.col("v").alias("near")).union(edges.select("v", "u")).distinct()
    return Graph(nodes, common.materialize(both, "graph"), entries, scale)


BEAMS = "query long, qvec binary, found array<long>, dist array<double>, done array<boolean>"


def search(graph: Graph, queries: DataFrame, k: int = RESULTS) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest vectors found for each of queries (vec_id, embedding).

    score is the Euclidean distance in double precision; ties go to the smaller vec_id; the
    query's own vec_id is left out; a query that is not usable has no rows; repeated queries are
    one. Fewer candidates than k: all of them.
    """
    spark = queries.sparkSession
    n, scale = common.partitions(spark), graph.scale
    entries = spark.sparkContext.broadcast(graph.entries)  # SAMPLE vectors at most
    asked = usable(queries).select(F.col("vec_id").alias("query"), "vec").dropDuplicates(["query"])

    def enter(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = entries.value
        for batch in it:
            if batch.num_rows == 0 or len(start.ids) == 0:
                continue
            column = batch.column("vec")
            q = column.values.to_numpy()[column.offsets[0].as_py() : column.offsets[-1].as_py()].reshape(batch.num_rows, -1)
            if q.shape[1] != start.sample.shape[1]:
                continue
            out = []
            low = raised(lowered(q, scale))
            for row, near in zip(low, start.near(low), strict=True):
                d = distances(row[None], start.sample[near])[0]
                out.append((start.ids[near].tolist(), d.tolist(), [False] * len(near)))
            f, d, e = zip(*out, strict=True)
            yield beam_batch(batch.column("query"), [r.tobytes() for r in q], f, d, e)

    def beam_batch(query, qvec, f, d, e) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([query, pa.array(qvec, pa.binary()), pa.array(f, pa.list_(pa.int64())), pa.array(d, pa.list_(pa.float64())), pa.array(e, pa.list_(pa.bool_()))], ["query", "qvec", "found", "dist", "done"])

    def advance(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a query: its beam (node null), and the neighbours of the nodes it expands, with their vectors."""
        out = []
        for query, qvec, found, dist, done, node, low in groups(it, "query", ["query", "qvec", "found", "dist", "done", "node", "low"]):
            b = next(i for i, x in enumerate(qvec) if x is not None)
            have, ds, es = found[b], dist[b], [True] * len(done[b])
            fresh = {v: i for i, v in enumerate(node) if v is not None}
            fresh = [(v, i) for v, i in sorted(fresh.items()) if v not in set(have)]
            if fresh:
                q = raised(lowered(np.frombuffer(qvec[b], np.float64)[None], scale))
                d = distances(q, raised([low[i] for _, i in fresh]))[0].tolist()
                have, ds, es = have + [v for v, _ in fresh], ds + d, es + [False] * len(fresh)
            order = np.lexsort((have, ds))[:BEAM].tolist()
            out.append((query[b], qvec[b], [have[i] for i in order], [ds[i] for i in order], [es[i] for i in order]))
        if out:
            q, v, f, d, e = zip(*out, strict=True)
            yield beam_batch(pa.array(q, pa.int64()), v, f, d, e)

    beams = common.materialize(asked.mapInArrow(common.lean(enter), BEAMS), "beams")
    while True:
        open_ = beams.select("query", F.explode(F.arrays_zip("found", "done")).alias("x")).where("not x.done").select("query", F.col("x.found").alias("node"))
        if open_.isEmpty():
            break
        near = open_.join(graph.edges, "node").select("query", F.col("near").alias("node")).distinct()
        known = beams.select("query", "found")
        near = near.join(known, "query").where(~F.array_contains("found", F.col("node"))).select("query", "node")
        near = near.join(graph.nodes.select("node", "low"), "node")
        null = lambda t: F.lit(None).cast(t)
        rows = beams.select("*", null("long").alias("node"), null("binary").alias("low")).unionByName(
            near.select("query", null("binary").alias("qvec"), null("array<long>").alias("found"), null("array<double>").alias("dist"), null("array<boolean>").alias("done"), "node", "low")
        )
        beams = common.materialize(rows.repartition(n, "query").sortWithinPartitions("query").mapInArrow(common.lean(advance), BEAMS), "beams")

    def rank(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for query, qvec, ids, vec in groups(it, "query", ["query", "qvec", "ids", "vec"]):
            q = np.frombuffer(qvec[0], np.float64)
            x = np.frombuffer(b"".join(vec), np.float64).reshape(len(vec), -1)
            d = np.sqrt(((x - q) ** 2).sum(1))
            pairs = sorted({(float(dd), i) for dd, own in zip(d, ids, strict=True) for i in own if i != query[0]})
            out += [(query[0], r + 1, i, dd) for r, (dd, i) in enumerate(pairs[:k])]
        columns = zip(*out, strict=True) if out else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int32(), pa.int64(), pa.float64()], strict=True)], ["query_id", "rank", "vec_id", "score"])

    last = beams.select("query", "qvec", F.explode("found").alias("node")).join(graph.nodes.select("node", "ids", "vec"), "node").select("query", "qvec", "ids", "vec")
    return last.repartition(n, "query").sortWithinPartitions("query").mapInArrow(common.lean(rank), "query_id long, rank int, vec_id long, score double")


def op10_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings")
    return search(build(vectors), vectors.where("vec_id % 100 = 0"))
