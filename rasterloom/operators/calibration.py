"""Radiometry, noise and look-up tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


#: Intervals of a look-up table that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000


def asof(points: DataFrame, knots: DataFrame, at: str, knot: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Linear interpolation of a table's value at each point, by the knots on either side; beyond the ends the end holds.

    The knots become intervals, dealt over equal ranges of the axis, and a point meets the intervals of its
    range only: a hash join, with no order among the points. A null point or one without knots has no value;
    of equal knots the smallest value counts.
    """
    k = knots.select(*keys, F.col(knot).cast("double").alias("_k"), F.col(value).cast("double").alias("_v")).where("_k is not null and _v is not null").groupBy(*keys, "_k").agg(F.min("_v").alias("_v"))
    ends = k.agg(F.min("_k").alias("lo"), F.max("_k").alias("hi"), F.count("*").alias("n"), F.approx_count_distinct("_k").alias("places")).first()
    ranges = max(1, 2 * (ends["places"] or 0))
    low, width = ends["lo"] or 0.0, ((ends["hi"] or 0.0) - (ends["lo"] or 0.0)) / ranges
    # the same increasing function of points and ends, so that a point's range is one of its interval's
    place = lambda x: F.greatest(F.lit(0), F.least(F.lit(ranges - 1), F.floor((x - low) / width))).cast("long") if width > 0 else F.lit(0).cast("long")
    w = Window.partitionBy(*keys).orderBy("_k")
    iv = k.select(*keys, "_k", "_v", F.lead("_k").over(w).alias("_k2"), F.lead("_v").over(w).alias("_v2"), F.lag("_k").over(w).alias("_before"))
    first, last = F.lit(0).cast("long"), F.lit(ranges - 1).cast("long")
    span = F.sequence(F.when(F.col("_before").isNull(), first).otherwise(place(F.col("_k"))), F.when(F.col("_k2").isNull(), last).otherwise(place(F.col("_k2"))))
    iv = iv.select(*[F.col(c).alias(f"_key{i}") for i, c in enumerate(keys)], "_k", "_v", "_k2", "_v2", "_before", F.explode(span).alias("_range"))
    if ends["n"] <= BROADCAST_ROWS:
        iv = F.broadcast(iv)
    x = F.col(at).cast("double")
    p = points.withColumns({"_at": x, "_place": F.when(x.isNotNull() & ~F.isnan(x), place(x))})
    met = (F.col("_place") == F.col("_range")) & (F.col("_before").isNull() | (F.col("_at") >= F.col("_k"))) & (F.col("_k2").isNull() | (F.col("_at") < F.col("_k2")))
    for i, c in enumerate(keys):
        met = met & (F.col(c) == F.col(f"_key{i}"))
    t = F.when(F.col("_k2").isNull() | (F.col("_at") <= F.col("_k")), 0.0).otherwise((F.col("_at") - F.col("_k")) / F.when(F.col("_k2") > F.col("_k"), F.col("_k2") - F.col("_k")))
    return p.join(iv, met, "left").select(*[F.col(c) for c in points.columns if c != value], (F.col("_v") + t * (F.coalesce("_v2", "_v") - F.col("_v"))).alias(value))


def lut_bilinear(df: DataFrame, lut: DataFrame, value: str = "value") -> DataFrame:
    """Table (line, pixel, value) on a full grid of knots at the pixels (y, x): along pixels, then along lines."""
    pixels = df.select("x").distinct()
    rows = lut.select("line").distinct()
    every = pixels.join(F.broadcast(rows))
    along = asof(every, lut, "x", "pixel", value, keys=("line",))
    return asof(df, along, "y", "line", value, keys=("x",))


def calibrate(df: DataFrame, factor: Column, unit: str = "amplitude", decibel: bool = False, phase: bool = False) -> DataFrame:
    """Backscatter: power of the samples times the factor, in dB if asked, or back with its phase for complex input."""
    power = F.col("i") ** 2 + F.col("q") ** 2 if unit == "complex" else F.col("v") ** 2 if unit == "amplitude" else F.col("v")
    sigma = power * factor
    if phase:
        scale = F.when(power > 0, F.sqrt(sigma / power)).otherwise(0.0)
        return df.select("y", "x", (F.col("i") * scale).alias("i"), (F.col("q") * scale).alias("q"))
    return df.select("y", "x", (10 * F.log10(F.greatest(sigma, F.lit(1e-30))) if decibel else sigma).alias("sigma"))


def factor(sensor: str, **m: float) -> Column:
    """Factor of each mission's product by its metadata, for the power of the samples; theta is a column in radians."""
    sin = F.sin("theta")
    lit = lambda k: F.lit(float(m[k]))
    rules = {
        "lut_squared": lambda: 1 / (F.col("lut") * F.col("lut")),
        "decibel_constant": lambda: F.pow(F.lit(10.0), lit("k") / 10),
        "constant": lambda: lit("k"),
        "constant_sine": lambda: lit("k") * sin,
        "centre_sine": lambda: lit("k") * F.sin(lit("centre")),
        "sine_ratio": lambda: sin / (lit("k") * F.sin(lit("centre"))),
        "reference_range": lambda: F.pow(lit("range"), 2 * lit("exponent")) * F.sin(lit("reference")) / (lit("rescale") ** 2 * lit("k")),
        "inverse_square": lambda: 1 / (lit("k") * lit("k")),
    }
    return rules[sensor]()


def remove_noise(df: DataFrame, unit: str = "amplitude", floor: float | None = 0.0) -> DataFrame:
    """Power less the noise column; without noise (0) as it is; below 0 the floor, if there is one."""
    power = F.col("v") ** 2 if unit == "amplitude" else F.col("v")
    out = F.when(F.col("noise") == 0, power).otherwise(power - F.col("noise"))
    return df.select("y", "x", (out if floor is None else F.when(out < 0, floor).otherwise(out)).alias("v"))


def border_noise(df: DataFrame, limit: int, threshold: float, dark: float = 30.0) -> DataFrame:
    """In a frame of `limit` pixels, dark samples become null: noise of the processor along a scene's edge."""
    size = df.agg(F.max("y").alias("my"), F.max("x").alias("mx"))
    frame = (F.col("y") < limit) | (F.col("x") < limit) | (F.col("y") > F.col("my") - limit) | (F.col("x") > F.col("mx") - limit)
    bad = frame & ((F.sqrt(F.greatest(F.col("v") ** 2 - F.col("noise"), F.lit(0.0))) < threshold) | (F.col("v") < dark))
    return df.join(F.broadcast(size)).select("y", "x", F.when(~bad, F.col("v")).alias("v"))


def antenna_pattern(df: DataFrame, gains: DataFrame) -> DataFrame:
    """Undo a gain per range sample (x, gain)."""
    return df.join(gains, "x").select("y", "x", (F.col("v") / (F.col("gain") * F.col("gain"))).alias("v"))


def nearest_neighbours(df: DataFrame, table: DataFrame, columns: Sequence[str], values: Sequence[str], k: int = 1, most: int = 100_000) -> DataFrame:
    """Mean of the k table rows nearest in the given columns (inversion of a backscatter model).

    The table is a look-up table of bounded size, which is checked; it is broadcast, and pixels are compared
    with it in blocks of bounded memory. A pixel with a null column has no values; fewer rows than k: all.
    """
    rows = table.select(*columns, *values).limit(most + 1).toPandas().to_numpy(float)
    if len(rows) > most:
        raise ValueError(f"the look-up table has more than {most} rows")
    rows = rows[np.lexsort([*rows.T[: len(columns)][::-1], *rows.T[len(columns) :][::-1]])]  # of equal distances the smallest values come first
    shared = df.sparkSession.sparkContext.broadcast(rows)
    own = [f"_own{i}" for i in range(len(df.columns))]
    named = df.select(*[F.col(c).alias(o) for c, o in zip(df.columns, own, strict=True)], *[F.col(c).cast("double").alias(f"_at{i}") for i, c in enumerate(columns)])
    schema = StructType([*named.schema.fields[: len(own)], *(StructField(f"_out{i}", DoubleType()) for i in range(len(values)))])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lut = shared.value
        knots, few = lut[:, : len(columns)], min(k, len(lut))
        for batch in it:
            x = np.stack([batch.column(len(own) + i).to_numpy(zero_copy_only=False).astype(float) for i in range(len(columns))], 1)
            out = np.full((len(x), len(values)), np.nan)
            step = max(1, 4_000_000 // max(1, len(lut)))
            for a in range(0, len(x) if few else 0, step):
                d = sum((x[a : a + step, i : i + 1] - knots[:, i]) ** 2 for i in range(len(columns)))
                last = np.partition(d, few - 1, 1)[:, few - 1 : few]
                tied = d == last
                chosen = (d < last) | (tied & (np.cumsum(tied, 1) <= few - (d < last).sum(1, keepdims=True)))
                out[a : a + step] = chosen @ lut[:, len(columns) :] / few
            bad = np.isnan(x).any(1)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], *(pa.array(np.where(bad, 0.0, v), mask=bad | np.isnan(v)) for v in out.T)], [f.name for f in schema.fields])

    return named.mapInArrow(run, schema).toDF(*df.columns, *values)


def soil_moisture(df: DataFrame, coefficients: Sequence[float], low: float = 0.0, high: float = 0.55) -> DataFrame:
    """Volumetric moisture from a real dielectric constant (rdc) by a quadratic soil model with clay and sand shares.

    The model is rdc = a + b m + c m², each of a, b, c linear in sand and clay (nine coefficients); the root
    within [low, high] is taken. quality: 0 found, 1 no constant, 2 no soil, 3 no root in the range.
    """
    k = [float(v) for v in coefficients]
    term = lambda i: k[i] + k[i + 1] * F.col("sand") + k[i + 2] * F.col("clay")
    a, b, c = term(0) - F.col("rdc"), term(3), term(6)
    root = (-b + F.sqrt(F.greatest(b * b - 4 * a * c, F.lit(0.0)))) / (2 * c)
    ok = root.between(low, high) & (b * b - 4 * a * c >= 0)
    quality = F.when(F.col("rdc").isNull(), 1).when(F.col("sand").isNull() | F.col("clay").isNull(), 2).when(~ok, 3).otherwise(0)
    return df.select("y", "x", F.when(quality == 0, root).alias("moisture"), quality.alias("quality"))
