"""Connected components of an edge list by alternating star rounds, each written to shared storage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder and has no cluster.
FALLBACK_DIR = "file:///tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a local one only where that is unset and all runs in one process."""
    path, master = spark.conf.get("spark.checkpoint.dir", None), spark.conf.get("spark.master", "")
    if not path and master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (path or FALLBACK_DIR).rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """df by way of a table in the shared folder: executors may be lost after it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rasterloom-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge; component is its smallest node."""
    cur = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = None
    while True:
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        cur = written(small.where("a <> b").distinct(), "edges")
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    ends = cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(ends)


def chain(*steps):
    """A graph of operators as one operator: each step takes the DataFrame of the one before."""

    def run(df: DataFrame) -> DataFrame:
        for step in steps:
            df = step(df)
        return df

    return run
