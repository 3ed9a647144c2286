"""Raster scenes and stacks over the tables of a folder."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 100


def find_package(spark: SparkSession) -> None:
    """Python workers on machines that have this folder import the package from it, wherever they run."""
    env, own = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if own not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [own, env.get("PYTHONPATH")]))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    find_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intensity scene (y, x, v)."""
    e = read(spark, sf_dir, "events")
    return e.select(F.expr(f"event_id div {WIDTH}").alias("y"), (F.col("event_id") % WIDTH).alias("x"), F.col("value").alias("v"))


def scene_cplx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-look complex scene (y, x, i, q)."""
    e = read(spark, sf_dir, "events")
    return e.select(
        F.expr(f"event_id div {WIDTH}").alias("y"),
        (F.col("event_id") % WIDTH).alias("x"),
        (F.col("value") - 60).alias("i"),
        (F.get_json_object("props", "$.k").cast("double") - 50).alias("q"),
    )


def second(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another acquisition on the same grid (y, x, v)."""
    o = read(spark, sf_dir, "orders")
    return o.select(F.expr(f"o_orderkey div {WIDTH}").alias("y"), (F.col("o_orderkey") % WIDTH).alias("x"), (F.col("o_totalprice") / 970).alias("v"))


def pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coregistered complex pair (y, x, i1, q1, i2, q2): the second is the first with a phase ramp and noise of its own."""
    e = read(spark, sf_dir, "events")
    return scene_cplx(spark, sf_dir).join(
        e.select(
            F.expr(f"event_id div {WIDTH}").alias("y"),
            (F.col("event_id") % WIDTH).alias("x"),
            (F.col("value") - 60 + F.col("user_id") % 7 - 3).alias("i2"),
            (F.get_json_object("props", "$.k").cast("double") - 50 + F.col("user_id") % 5 - 2).alias("q2"),
        ),
        ["y", "x"],
    ).withColumnsRenamed({"i": "i1", "q": "q1"})


def quad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quad-pol scattering matrix (y, x, hh_i, hh_q, hv_i, hv_q, vh_i, vh_q, vv_i, vv_q)."""
    e = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    return e.select(
        F.expr(f"event_id div {WIDTH}").alias("y"),
        (F.col("event_id") % WIDTH).alias("x"),
        ((F.col("value") - 60) / 9.7).alias("hh_i"),
        ((k - 50) / 9.7).alias("hh_q"),
        ((F.col("user_id") % 17 - 8) / 9.7).alias("hv_i"),
        ((F.col("event_id") * 7 % 13 - 6) / 9.7).alias("hv_q"),
        ((F.col("user_id") % 19 - 9) / 9.7).alias("vh_i"),
        ((F.col("event_id") * 5 % 11 - 5) / 9.7).alias("vh_q"),
        ((F.col("user_id") % 29 - 14 + k / 5) / 9.7).alias("vv_i"),
        ((F.col("event_id") % 11 - 5 + F.col("value") / 20) / 9.7).alias("vv_q"),
    )


def stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stack in long form (pixel, epoch, v) with 64 epochs."""
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("pixel"), F.posexplode("embedding").alias("epoch", "v")).withColumn("v", F.col("v").cast("double") + 1)


def overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several samples per cell (cell, product, v, w)."""
    line = read(spark, sf_dir, "lineitem")
    return line.select(F.col("l_orderkey").alias("cell"), F.col("l_linenumber").alias("product"), (F.col("l_extendedprice") / 97).alias("v"), F.col("l_quantity").alias("w"))
