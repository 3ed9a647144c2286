"""Sliding 2-D windows as two passes of RANGE frames: along x within a line, then along y within a column.

Frames clip at the scene's edge and skip nulls, so no halo and no tile border exists;
each pass is one shuffle on (scene, line) or (scene, column).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def box_sums(df: DataFrame, sums: Mapping[str, Column], size_x: int, size_y: int | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Add, for every name, the sum of its column over the window around each pixel.

    Every pixel of the scene's rectangle must have its row; one without data has nulls. A window of
    even size reaches one pixel further back than ahead.
    """
    size_y = size_y or size_x
    low = lambda n: -(n // 2)
    high = lambda n: n - 1 - n // 2
    across = Window.partitionBy(*keys, "y").orderBy("x").rangeBetween(low(size_x), high(size_x))
    down = Window.partitionBy(*keys, "x").orderBy("y").rangeBetween(low(size_y), high(size_y))
    first = df.withColumns({f"_{n}": F.sum(c).over(across) for n, c in sums.items()})
    second = first.withColumns({n: F.sum(f"_{n}").over(down) for n in sums})
    return second.drop(*[f"_{n}" for n in sums])


def moments(df: DataFrame, v: Column, size: int, size_y: int | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Add n, mean, and sample variance of the valid (non-null) values of v over the window."""
    out = box_sums(df, {"_n": F.when(v.isNotNull(), 1.0).otherwise(0.0), "_s": F.coalesce(v, F.lit(0.0)), "_q": F.coalesce(v * v, F.lit(0.0))}, size, size_y, keys)
    mean = F.col("_s") / F.col("_n")
    return out.withColumns({"n": F.col("_n"), "mean": F.when(F.col("_n") > 0, mean), "var": F.when(F.col("_n") > 1, F.greatest((F.col("_q") - F.col("_n") * mean * mean) / (F.col("_n") - 1), F.lit(0.0)))}).drop("_n", "_s", "_q")


def neighbours(df: DataFrame, size: int, keys: tuple[str, ...] = (), columns: tuple[str, ...] = ("v",)) -> DataFrame:
    """One row per pixel and window place: keys, y, x of the centre, dy, dx, and the neighbour's columns.

    Each pixel scatters itself to the centres it is a neighbour of; the explode is bounded by size².
    """
    reach = F.sequence(F.lit(-(size // 2)), F.lit(size - 1 - size // 2))
    out = df.select(*keys, F.col("y").alias("_y"), F.col("x").alias("_x"), *columns)
    out = out.withColumn("dy", F.explode(reach)).withColumn("dx", F.explode(reach))
    return out.select(*keys, (F.col("_y") - F.col("dy")).alias("y"), (F.col("_x") - F.col("dx")).alias("x"), "dy", "dx", *columns)
