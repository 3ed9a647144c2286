"""Shared plumbing of the training-data operators.

Text is processed in Arrow batches of bounded row count and re-sliced by bytes,
words are dictionary-encoded, and everything that must be read twice is written
to the shared folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from functools import wraps
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder and has no cluster (tests, laptops).
FALLBACK_DIR = "file:///tmp/checkpoints"
#: Text bytes handled at once by one Python worker.
SLICE_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared scratch folder, spark.checkpoint.dir; a local one only where that is unset and all runs in one process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.conf.get("spark.master", "")
    if not path and master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (path or FALLBACK_DIR).rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/rasterloom-{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    prepare(spark)
    path = scratch(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bounds what one batch takes in the executor and in its worker, where rows are long texts.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def prepare(spark: SparkSession) -> None:
    """Python workers on machines that have this folder import the package from it, wherever they run; batches are of SLICE_BYTES unless the session says otherwise."""
    env, own = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if own not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [own, env.get("PYTHONPATH")]))
    if BATCH_BYTES not in dict(spark.conf.getAll):
        spark.conf.set(BATCH_BYTES, str(SLICE_BYTES))


#: Bytes of input for each task that gathers from all of it, and such tasks at most.
GATHERED_BYTES, GATHERING = 64 << 20, 20_000
#: The planner's size of a source that does not know it is beyond this.
UNKNOWN = 1 << 60


def partitions(spark: SparkSession, df: DataFrame | None = None) -> int:
    """Shuffle partitions as set, or more where the tables that df reads are large: tasks that hold what they gather stay small.

    A source that does not know its size counts nothing.
    """
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    if df is None:
        return n
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    return max(n, min(GATHERING, sum(s for s in sizes if s < UNKNOWN) // GATHERED_BYTES))


def held_out(doc_id: Column) -> Column:
    """Rows kept away from training: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which its worker gives freed memory back: workers stay alive beside the stages that follow."""

    @wraps(run)
    def wrapped(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(it)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return wrapped


def batches(it: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Re-slice record batches so that column holds about `most` bytes of text at once; a longer text is alone."""
    for batch in it:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        cut = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // most)) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows], strict=True):
            if b > a:
                yield batch.slice(a, b - a)


def words_of(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words (runs without ASCII white space) as codes: (codes, offsets of each text, dictionary).

    A null text has no words. Lower-casing touches A-Z alone.
    """
    texts = pc.fill_null(texts, "")
    texts = pc.ascii_lower(texts) if lower else texts
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    kept = np.concatenate([[0], np.cumsum(full)])
    coded = flat.filter(pa.array(full)).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), kept[offsets], coded.dictionary


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit avalanche, so that any bits of the result serve as a bucket."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


STEP = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(dictionary: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word: a number for every byte and its place, added up."""
    words = dictionary.cast(pa.large_binary())
    if len(words) == 0:
        return np.empty(0, np.uint64)
    places = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = words.buffers()[2]
    data = np.frombuffer(data, np.uint8)[places[0] : places[-1]] if data is not None else np.empty(0, np.uint8)
    sizes, starts = np.diff(places), places[:-1] - places[0]
    at = (np.arange(1, len(data) + 1) - np.repeat(starts, sizes)).astype(np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(at * STEP + data), dtype=np.uint64)])
    return mix(sums[starts + sizes] - sums[starts] + sizes.astype(np.uint64))


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values in order, by a sort."""
    x = np.sort(x)
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new]


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-word runs; the whole sequence as one where there are fewer words."""
    k = min(n, len(words))
    if k == 0:
        return np.empty(0, np.uint64)
    out = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[i : len(words) - k + 1 + i]
        out ^= out >> np.uint64(29)
    return mix(out)


def components(edges: DataFrame, tag: str, whole: bool = True) -> DataFrame:
    """Connected components of undirected edges (a, b): rows (node, component = smallest node).

    Without `whole` a single round is made: each node has a node it is connected with, not yet the
    smallest one, and the rows as edges have the same components.

    Alternating large-star and small-star rounds; every round is aggregated before it is
    shuffled and written to the shared folder, and the loop ends when a round changes nothing.
    """
    cur = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), tag)
    seen = None
    while True:
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        cur = materialize(small.where("a <> b").distinct(), tag)
        if not whole:
            break
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component"))
