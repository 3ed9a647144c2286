"""Generic raster operators: selection, merging, resampling, mosaics, stacks and statistics.

A product is a DataFrame with y, x and a column per band; no-data is null.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import neighbours


def band_select(df: DataFrame, bands: Sequence[str] = (), pattern: str | None = None, polarisations: Sequence[str] = ()) -> DataFrame:
    """Keep bands by name, regular expression or polarisation suffix; all if nothing is asked."""
    every = [c for c in df.columns if c not in ("y", "x")]
    keep = [c for c in every if (not bands or c in bands) and (not pattern or re.fullmatch(pattern, c)) and (not polarisations or any(p.lower() in c.lower().split("_") for p in polarisations))]
    return df.select("y", "x", *keep)


def band_merge(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Columns of products on one grid; a clashing name gets _2, _3 and so on."""
    out = first
    for other in others:
        names, seen = {}, set(out.columns)
        for c in other.columns:
            if c in ("y", "x"):
                continue
            new, k = c, 2
            while new in seen:
                new, k = f"{c}_{k}", k + 1
            names[c] = new
            seen.add(new)
        out = out.join(other.withColumnsRenamed(names), ["y", "x"])
    return out


def set_nodata(df: DataFrame, bands: Sequence[str], value: float) -> DataFrame:
    """The sentinel becomes null."""
    return df.withColumns({b: F.when(~F.col(b).eqNullSafe(F.lit(value)), F.col(b)) for b in bands})


def data_analysis(df: DataFrame, band: str) -> DataFrame:
    """Whole-image minimum, maximum, mean, population deviation, coefficient of variation and equivalent looks.

    The maximum is the true one for all-negative bands too.
    """
    v = F.col(band)
    m = df.agg(F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.avg(v * v).alias("m2"), F.avg(v * v * v * v).alias("m4"))
    spread = F.greatest(F.col("m4") - F.col("m2") * F.col("m2"), F.lit(0.0))
    return m.select("min", "max", "mean", F.sqrt(F.greatest(F.col("m2") - F.col("mean") * F.col("mean"), F.lit(0.0))).alias("std"), (F.sqrt(spread) / F.col("m2")).alias("cv"), (F.col("m2") * F.col("m2") / F.nullif(spread, F.lit(0.0))).alias("enl"))


def tiles(df: DataFrame, height: int, width: int, overlap: int = 0) -> DataFrame:
    """Pixels with the tile (ty, tx) they belong to; with overlap a pixel is in every tile whose grown frame holds it."""
    if not overlap:
        return df.withColumns({"ty": F.floor(F.col("y") / height), "tx": F.floor(F.col("x") / width)})
    span = lambda c, n: F.sequence(F.floor(F.greatest(F.col(c) - overlap, F.lit(0)) / n), F.floor((F.col(c) + overlap) / n))
    return df.withColumn("ty", F.explode(span("y", height))).withColumn("tx", F.explode(span("x", width)))


def subset(df: DataFrame, y0: int, y1: int, x0: int, x1: int) -> DataFrame:
    """Crop to a half-open region."""
    return df.where(F.col("y").between(y0, y1 - 1) & F.col("x").between(x0, x1 - 1))


def undersample(df: DataFrame, step_y: int, step_x: int) -> DataFrame:
    """Every step-th line and sample."""
    return df.where((F.col("y") % step_y == 0) & (F.col("x") % step_x == 0)).withColumns({"y": F.expr(f"y div {step_y}"), "x": F.expr(f"x div {step_x}")})


def undersample_kernel(df: DataFrame, kernel: Sequence[Sequence[float]], step_y: float, step_x: float, band: str = "v") -> DataFrame:
    """Weighted window at every output pixel's nearest source pixel, divided by the kernel's size; clipped at the edge."""
    height, width = len(kernel), len(kernel[0])
    spark = df.sparkSession
    weights = spark.createDataFrame([(i - height // 2, j - width // 2, float(kernel[i][j])) for i in range(height) for j in range(width)], "dy long, dx long, k double")
    size = df.agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    # a source pixel serves the few output pixels whose window holds it
    placed = df.select("y", "x", band).join(F.broadcast(weights)).select((F.col("y") - F.col("dy")).alias("cy"), (F.col("x") - F.col("dx")).alias("cx"), band, "k")
    ty, tx = F.ceil((F.col("cy") - 0.5) / step_y), F.ceil((F.col("cx") - 0.5) / step_x)
    hit = placed.withColumns({"ty": ty, "tx": tx}).where((F.floor(F.col("ty") * step_y + 0.5) == F.col("cy")) & (F.floor(F.col("tx") * step_x + 0.5) == F.col("cx")))
    out = hit.groupBy(F.col("ty").alias("y"), F.col("tx").alias("x")).agg((F.sum(F.col("k") * F.col(band)) / (height * width)).alias(band))
    return out.join(F.broadcast(size)).where((F.col("y") >= 0) & (F.col("x") >= 0) & (F.col("y") < F.floor(F.col("h") / step_y)) & (F.col("x") < F.floor(F.col("w") / step_x))).drop("h", "w")


def oversample(df: DataFrame, factor: int, band: str = "v", tile: int = 64) -> DataFrame:
    """Band-limited interpolation: each tile's spectrum is padded with zeros, per axis."""

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = int(pdf.y.min()), int(pdf.x.min())
        a = np.zeros((int(pdf.y.max()) - y0 + 1, int(pdf.x.max()) - x0 + 1))
        a[pdf.y.to_numpy() - y0, pdf.x.to_numpy() - x0] = pdf[band]
        for axis in (0, 1):
            n = a.shape[axis]
            f = np.fft.fft(a, axis=axis)
            half = n // 2
            f = np.moveaxis(f, axis, 0)
            g = np.zeros((n * factor, *f.shape[1:]), complex)
            g[: half + n % 2] = f[: half + n % 2]
            g[len(g) - half :] = f[n - half :]
            if n % 2 == 0 and factor > 1:  # the middle frequency belongs to both halves
                g[half] = g[len(g) - half] = f[half] / 2
            a = np.moveaxis(np.fft.ifft(g, axis=0).real * factor, 0, axis)
        yy, xx = np.mgrid[: a.shape[0], : a.shape[1]]
        return pd.DataFrame({"y": yy.ravel() + y0 * factor, "x": xx.ravel() + x0 * factor, band: a.ravel()})

    return tiles(df.select("y", "x", band), tile, tile).groupBy("ty", "tx").applyInPandas(grow, f"y long, x long, {band} double")


def multilook(df: DataFrame, looks_y: int, looks_x: int, band: str = "v", unit: str = "intensity") -> DataFrame:
    """Block averages; blocks cut by the edge are left out.

    unit: intensity, amplitude (root of the mean square), db (mean in linear power), phase and
    others (plain mean). Complex input: pass i²+q² as an intensity.
    """
    v = F.col(band)
    lin = {"amplitude": v * v, "db": F.pow(F.lit(10.0), v / 10)}.get(unit, v)
    mean = F.avg(lin)
    value = {"amplitude": F.sqrt(mean), "db": 10 * F.log10(mean)}.get(unit, mean)
    out = df.groupBy(F.expr(f"y div {looks_y}").alias("y"), F.expr(f"x div {looks_x}").alias("x")).agg(value.alias(band), F.count("*").alias("_n"))
    return out.where(F.col("_n") == looks_y * looks_x).drop("_n")


def square_looks(looks_x: int, range_spacing: float, azimuth_spacing: float, incidence_deg: float, ground_range: bool) -> int:
    """Azimuth looks that make ground pixels about square for the given range looks."""
    ground = range_spacing if ground_range else range_spacing / np.sin(np.radians(incidence_deg))
    return max(1, int(looks_x * ground / azimuth_spacing + 0.5))


def mosaic(samples: DataFrame, keys: Sequence[str], v: str = "v", w: str = "w") -> DataFrame:
    """Weighted mean of all products in each cell; null and zero samples are no data."""
    good = samples.where(F.col(v).isNotNull() & (F.col(v) != 0) & (F.col(w) > 0))
    return good.groupBy(*keys).agg((F.sum(F.col(v) * F.col(w)) / F.sum(w)).alias(v), F.count("*").alias("n"))


def edge_weight(x: Column, y: Column, width: int, height: int) -> Column:
    """Mosaic weight: how far a pixel is from its product's edge."""
    return (F.least(x + 1, width - x) * F.least(y + 1, height - y)).cast("long")


def multitemporal_composite(stack: DataFrame, keys: Sequence[str], gamma: str = "v", area: str = "a") -> DataFrame:
    """Local-resolution weighting over dates: sum of gamma/area over sum of 1/area."""
    good = stack.where(F.col(gamma).isNotNull() & (F.col(area) > 0))
    return good.groupBy(*keys).agg((F.sum(F.col(gamma) / F.col(area)) / F.sum(1 / F.col(area))).alias("v"))


def stack_average(stack: DataFrame, keys: Sequence[str], statistic: str, v: str = "v") -> DataFrame:
    """Statistic of each pixel over its dates: mean, min, max, std (population) or cv of the intensity."""
    c = F.col(v)
    m, m2, m4 = F.avg(c), F.avg(c * c), F.avg(c * c * c * c)
    zero = F.lit(0.0)
    value = {"mean": m, "min": F.min(c), "max": F.max(c), "std": F.sqrt(F.greatest(m2 - m * m, zero)), "cv": F.sqrt(F.greatest(m4 - m2 * m2, zero)) / m2}[statistic]
    return stack.groupBy(*keys).agg(value.alias(statistic))


def create_stack(reference: DataFrame, secondary: DataFrame, shift_y: int = 0, shift_x: int = 0, extent: str = "master") -> DataFrame:
    """Secondary pixels on the reference grid, by a whole-pixel shift. extent: master, minimum or maximum."""
    moved = secondary.withColumns({"y": F.col("y") + shift_y, "x": F.col("x") + shift_x})
    names = {c: f"{c}_sec" for c in secondary.columns if c not in ("y", "x") and c in reference.columns}
    return reference.join(moved.withColumnsRenamed(names), ["y", "x"], {"master": "left", "minimum": "inner", "maximum": "full_outer"}[extent])


def stack_split(stack: DataFrame, epoch: str = "epoch") -> dict[str, DataFrame]:
    """One product per acquisition. Names of epochs are metadata: their number is that of the stack's dates."""
    return {str(r[0]): stack.where(F.col(epoch) == r[0]).drop(epoch) for r in stack.select(epoch).distinct().orderBy(epoch).collect()}


def slice_assembly(slices: DataFrame, table: DataFrame) -> DataFrame:
    """Lines of slices one after the other; each output line from the slice whose [start, end) holds it.

    slices: slice, y, x and bands; table: slice, start, end (lines of the assembled product), a row per slice.
    """
    placed = slices.join(table, "slice").withColumn("y", F.col("y") + F.col("start"))
    return placed.where(F.col("y") < F.col("end")).drop("slice", "start", "end")


def dedup_overlap(df: DataFrame, keys: Sequence[str], priority: Sequence[Column]) -> DataFrame:
    """Of samples in one cell the one that comes first by priority (sub-swath merge, burst mosaics)."""
    w = Window.partitionBy(*keys).orderBy(*priority)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def resample_line(df: DataFrame, coefficients: Sequence[float], width: int, method: str = "linear", band: str = "v") -> DataFrame:
    """Slant to ground range and the like: output sample x takes its value at the polynomial of x.

    method: nearest, linear, or cubic (four points, parameter -0.5). The output grid joins the few source
    samples it needs on (y, sample); outside the line there is no value.
    """
    lines = df.select("y").distinct()
    grid = lines.select("y", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"))
    at = sum((F.lit(float(c)) * F.pow(F.col("x").cast("double"), F.lit(float(k))) for k, c in enumerate(coefficients)), F.lit(0.0))
    grid = grid.withColumn("at", at)
    t = F.col("at") - F.floor("at")
    if method == "nearest":
        taps = [(F.floor(F.col("at") + 0.5), F.lit(1.0))]
    elif method == "linear":
        taps = [(F.floor("at"), 1 - t), (F.floor("at") + 1, t)]
    else:
        a = -0.5
        near = lambda s: (a + 2) * s * s * s - (a + 3) * s * s + 1
        far = lambda s: a * s * s * s - 5 * a * s * s + 8 * a * s - 4 * a
        taps = [(F.floor("at") - 1, far(1 + t)), (F.floor("at"), near(t)), (F.floor("at") + 1, near(1 - t)), (F.floor("at") + 2, far(2 - t))]
    wanted = grid.select("y", "x", F.explode(F.array(*[F.struct(p.cast("long").alias("s"), w.alias("w")) for p, w in taps])).alias("tap")).select("y", "x", "tap.s", "tap.w").where("w <> 0")
    source = df.select("y", F.col("x").alias("s"), band)
    met = wanted.join(source, ["y", "s"], "left")
    return met.groupBy("y", "x").agg(F.sum(F.col(band) * F.col("w")).alias(band), F.sum(F.when(F.col(band).isNull(), 1).otherwise(0)).alias("_m")).where("_m = 0").drop("_m")


def bilinear(points: DataFrame, grid: DataFrame, step_y: float, step_x: float, value: str = "value") -> DataFrame:
    """Tie-point grid (gy, gx, value) interpolated at the pixels of points; beyond the grid its border holds."""
    fy, fx = F.col("y") / step_y, F.col("x") / step_x
    size = grid.agg(F.max("gy").alias("my"), F.max("gx").alias("mx"))
    placed = points.join(F.broadcast(size)).withColumns({"_y": F.least(F.floor(fy), F.greatest(F.col("my") - 1, F.lit(0))), "_x": F.least(F.floor(fx), F.greatest(F.col("mx") - 1, F.lit(0)))})
    placed = placed.withColumns({"_ty": F.least(fy - F.col("_y"), F.lit(1.0)), "_tx": F.least(fx - F.col("_x"), F.lit(1.0))})
    corners = F.array(*[F.struct(F.least(F.col("_y") + i, F.col("my")).alias("gy"), F.least(F.col("_x") + j, F.col("mx")).alias("gx"), ((F.col("_ty") if i else 1 - F.col("_ty")) * (F.col("_tx") if j else 1 - F.col("_tx"))).alias("w")) for i in (0, 1) for j in (0, 1)])
    met = placed.select("y", "x", F.explode(corners).alias("c")).select("y", "x", "c.*").join(grid, ["gy", "gx"])
    return met.groupBy("y", "x").agg(F.sum(F.col(value) * F.col("w")).alias(value))


def convolve(df: DataFrame, kernel: Mapping[tuple[int, int], float], size: int, band: str = "v") -> DataFrame:
    """Sum of kernel times neighbours; places outside the scene count as 0."""
    weights = df.sparkSession.createDataFrame([(dy, dx, float(k)) for (dy, dx), k in kernel.items()], "dy int, dx int, k double")
    inside = df.select("y", "x")
    met = neighbours(df, size, columns=(band,)).join(F.broadcast(weights), ["dy", "dx"])
    return met.groupBy("y", "x").agg(F.sum(F.col("k") * F.col(band)).alias(band)).join(inside, ["y", "x"])
