"""Scenes that arrive as a stream: blocks are emitted once whole."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.graph import shared_dir


#: Blocks along each axis that share a state.
SHARED = 64


def whole_blocks(pixels: DataFrame, looks: int) -> DataFrame:
    """Mean of every block of looks x looks pixels (y, x, v) of a stream, once its last pixel is there; only unfinished blocks are kept.

    SHARED x SHARED blocks have one state, the sums and counts of those unfinished, and are added up together.
    """

    def add(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sums = [pd.DataFrame(dict(zip(("y", "x", "v", "n"), state.get, strict=True)))] if state.exists else []
        sums += [pdf.groupby(["y", "x"], sort=False).agg(v=("v", "sum"), n=("v", "size")).reset_index() for pdf in parts]
        total = pd.concat(sums).groupby(["y", "x"], sort=False)[["v", "n"]].sum().reset_index()
        whole = total.n >= looks * looks
        rest = total[~whole]
        if len(rest):
            state.update(tuple(rest[c].tolist() for c in ("y", "x", "v", "n")))
        elif state.exists:
            state.remove()
        done = total[whole]
        yield pd.DataFrame({"y": done.y, "x": done.x, "v": done.v / done.n})

    blocks = pixels.select(F.expr(f"y div {looks}").alias("y"), F.expr(f"x div {looks}").alias("x"), "v")
    shared = blocks.withColumns({f"_{c}": F.expr(f"{c} div {SHARED}") for c in ("y", "x")}).groupBy("_y", "_x")
    return shared.applyInPandasWithState(add, "y long, x long, v double", "y array<long>, x array<long>, v array<double>, n array<long>", "append", GroupStateTimeout.NoTimeout)


def multilook(spark: SparkSession, sf_dir: str, looks: int = 2, digits: int = 7) -> DataFrame:
    """Multilook over a stream of pixels; every trigger appends its finished blocks to the table that is read at the end."""
    root = f"{shared_dir(spark)}/rasterloom-stream-{uuid.uuid4().hex}"
    path = f"{sf_dir}/events.parquet"
    source = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path if "*" in path else f"{sf_dir}/events.parquet*")
    px = source.select(F.expr("event_id div 100").alias("y"), (F.col("event_id") % 100).alias("x"), F.col("value").alias("v"))
    run = whole_blocks(px, looks).writeStream.format("parquet").outputMode("append").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema("y long, x long, v double").parquet(f"{root}/out").select("y", "x", (F.round("v", digits) + F.lit(0.0)).alias("v"))
