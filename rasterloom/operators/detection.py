"""Detection, change, texture and classification over intensity scenes."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.windows import box_sums, moments
from ..plans.graph import connected, written
from .raster import convolve, tiles

EPS = 1e-15


def change(df: DataFrame, a: str = "a", b: str = "b", kind: str = "ratio", low: float = 0.5, high: float = 2.0) -> DataFrame:
    """difference, ratio, log_ratio or normalised difference of two bands and a mask of -1, 0, 1; 0 where either is absent or not positive."""
    x, y = F.col(a), F.col(b)
    value = {"difference": x - y, "ratio": x / y, "log_ratio": F.log(F.greatest(x / y, F.lit(EPS))), "normalised": (x - y) / (x + y)}[kind]
    good = (x > 0) & (y > 0)
    out = df.select("y", "x", F.when(good, value).otherwise(0.0).alias("change"))
    return out.withColumn("mask", F.when(F.col("change") > high, 1).when(F.col("change") < low, -1).otherwise(0))


def flood(df: DataFrame, band: str = "v", unit: str = "linear", reference: str | None = None) -> DataFrame:
    """Water where backscatter is low; with a reference band only what was no water there."""
    water = lambda c: (F.col(c) < -13.0) if unit == "db" else ((F.col(c) > 0) & (F.col(c) < 0.05))
    mask = water(band) if reference is None else ~water(reference) & water(band)
    return df.select("y", "x", F.coalesce(mask, F.lit(False)).alias("flood"))


def decision_tree(df: DataFrame, tree: Mapping | int, columns: Sequence[str] = ("y", "x")) -> DataFrame:
    """Class of every pixel by a tree {"if": expression, "then": tree, "else": tree}; leaves are class ids, null decides for else."""

    def compiled(t: Mapping | int) -> Column:
        if isinstance(t, int):
            return F.lit(t).cast("short")
        return F.when(F.expr(t["if"]), compiled(t["then"])).otherwise(compiled(t["else"]))

    return df.select(*columns, compiled(tree).alias("class"))


def oil_spill(df: DataFrame, size: int, k_db: float = 2.0, band: str = "v") -> DataFrame:
    """Dark spots: below the window's mean by k dB."""
    m = moments(df, F.col(band), size)
    return m.select("y", "x", F.when(F.col(band) < F.col("mean") / float(10 ** (k_db / 10)), 1).otherwise(0).alias("spill"))


def adaptive_threshold(df: DataFrame, target: int, guard: int, background: int, pfa: float = 6.5, band: str = "v") -> DataFrame:
    """Two-parameter constant false alarm rate detector: target mean above the background ring's mean plus t deviations."""
    t = float(NormalDist().inv_cdf(1 - 10.0**-pfa))
    v = F.col(band)
    parts = {"n": F.when(v.isNotNull(), 1.0).otherwise(0.0), "s": F.coalesce(v, F.lit(0.0)), "q": F.coalesce(v * v, F.lit(0.0))}
    out = box_sums(df, {f"t{k}": parts[k] for k in "ns"}, target)
    out = box_sums(out, {f"g{k}": c for k, c in parts.items()}, guard)
    out = box_sums(out, {f"b{k}": c for k, c in parts.items()}, background)
    n, s, q = (F.col(f"b{k}") - F.col(f"g{k}") for k in "nsq")
    mean = s / n
    dev = F.sqrt(F.greatest(q / n - mean * mean, F.lit(0.0)))
    return out.select("y", "x", F.when((n > 0) & (F.col("tn") > 0) & (mean >= 0.005) & (F.col("ts") / F.col("tn") > mean + t * dev), 1).otherwise(0).alias("ship"))


def clusters(mask: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """8-connected clusters of the given pixels (y, x): every pixel with the cluster it is in (smallest pixel number)."""
    width = 1 << 31
    ids = mask.select("y", "x", *columns, (F.col("y") * width + F.col("x")).alias("node"))
    shifts = F.array(*[F.lit(dy * width + dx) for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1))])
    other = ids.select(F.col("node").alias("a"), F.explode(shifts).alias("d")).select("a", (F.col("a") + F.col("d")).alias("b"))
    edges = other.join(ids.select(F.col("node").alias("b")), "b").select("a", "b")
    return ids.join(connected(edges), "node", "left").withColumn("cluster", F.coalesce("component", "node")).drop("component", "node")


def oil_spill_clusters(mask: DataFrame, least: int) -> DataFrame:
    """Pixels of clusters of at least so many pixels."""
    c = clusters(mask)
    big = c.groupBy("cluster").agg(F.count("*").alias("size")).where(F.col("size") >= least)
    return c.join(big, "cluster").select("y", "x", "cluster", "size")


def discriminate(mask: DataFrame, spacing_y: float, spacing_x: float, least: float, most: float) -> DataFrame:
    """Objects whose bounding box has a diagonal, in metres, between least and most."""
    c = clusters(mask)
    length, width = (F.max("y") - F.min("y") + 1) * spacing_y, (F.max("x") - F.min("x") + 1) * spacing_x
    out = c.groupBy("cluster").agg(F.min("y").alias("y"), F.min("x").alias("x"), length.alias("length"), width.alias("width"), F.count("*").alias("pixels"))
    size = F.sqrt(F.col("length") * F.col("length") + F.col("width") * F.col("width"))
    return out.withColumn("size", size).where(F.col("size").between(least, most))


def speckle_divergence(df: DataFrame, size: int, c: float, band: str = "v") -> DataFrame:
    """Coefficient of variation of intensities above 0.4 in the window, less c: urban areas vary more than speckle."""
    m = moments(df, F.when(F.col(band) > 0.4, F.col(band)), size)
    return m.select("y", "x", (F.sqrt(F.coalesce("var", F.lit(0.0))) / F.col("mean") - c).alias("divergence"))


def gabor(df: DataFrame, size: int = 9, wavelength: float = 4.0, angle: float = 0.0, sigma: float = 2.0, aspect: float = 0.5, phase: float = 0.0, band: str = "v") -> DataFrame:
    """Convolution with a Gabor kernel without mean and of unit norm."""
    i, j = np.mgrid[: size, : size] - size // 2
    xr, yr = j * np.cos(angle) + i * np.sin(angle), -j * np.sin(angle) + i * np.cos(angle)
    k = np.exp(-(xr**2 + aspect**2 * yr**2) / (2 * sigma**2)) * np.cos(2 * np.pi * xr / wavelength + phase)
    k -= k.mean()
    k /= np.sqrt((k**2).sum()) or 1.0
    return convolve(df, {(int(a), int(b)): k[a + size // 2, b + size // 2] for a, b in zip(i.ravel(), j.ravel(), strict=True)}, size, band)


def forest_area(df: DataFrame, size: int, low: float, high: float, numerator: str = "a", denominator: str = "b", floor: float | None = None) -> DataFrame:
    """Ratio of window means in dB and a mask of forest where it lies between low and high and the numerator is above the floor."""
    out = box_sums(df, {"sa": F.col(numerator), "sb": F.col(denominator), "n": F.lit(1.0)}, size)
    ratio = 10 * F.log10(F.col("sa") / F.col("sb"))
    bright = F.lit(True) if floor is None else F.col("sa") / F.col("n") > floor
    return out.select("y", "x", ratio.alias("ratio"), (ratio.between(low, high) & bright).alias("forest"))


def reactiv(stack: DataFrame, keys: Sequence[str] = ("y", "x"), v: str = "v", t: str = "t") -> DataFrame:
    """Change composite of a time series of amplitudes: hue is when, saturation how much it varies, value how bright."""
    time = stack.agg(F.min(t).alias("t0"), F.max(t).alias("t1"))
    px = stack.groupBy(*keys).agg(F.max_by(t, F.struct(v, -F.col(t))).alias("when"), F.max(v).alias("peak"), (F.stddev_pop(v) / F.avg(v)).alias("cv"))
    scene = px.agg(F.avg("peak").alias("mp"), F.stddev_pop("peak").alias("sp"))
    all_ = px.join(F.broadcast(time)).join(F.broadcast(scene))
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    return all_.select(
        *keys,
        (0.9 * (F.col("when") - F.col("t0")) / F.nullif(F.col("t1") - F.col("t0"), F.lit(0))).alias("hue"),
        clamp((F.col("cv") - 0.2286) / 1.616 + 0.25).alias("saturation"),
        F.least(F.lit(1.0), F.col("peak") / (F.col("mp") + F.col("sp"))).alias("value"),
    )


def robust_pca(stack: DataFrame, tile: int = 32, rounds: int = 60, v: str = "v", epoch: str = "epoch") -> DataFrame:
    """Per tile, pixels by dates as low rank plus sparse; the sparse part above 0 is change."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot_table(index=["y", "x"], columns=epoch, values=v)
        a = m.fillna(0).to_numpy()
        lam, mu = 1 / np.sqrt(max(a.shape)), a.size / (4 * np.abs(a).sum() + 1e-12)
        s, dual = np.zeros_like(a), np.zeros_like(a)
        shrink = lambda z, k: np.sign(z) * np.maximum(np.abs(z) - k, 0)
        for _ in range(rounds):
            u, d, w = np.linalg.svd(a - s + dual / mu, full_matrices=False)
            low = (u * shrink(d, 1 / mu)) @ w
            s = shrink(a - low + dual / mu, lam / mu)
            dual += mu * (a - low - s)
            if np.linalg.norm(a - low - s) <= 1e-7 * np.linalg.norm(a):
                break
        out = pd.DataFrame(np.maximum(s, 0), index=m.index, columns=m.columns).stack().rename("change").reset_index()
        return out[["y", "x", epoch, "change"]]

    return tiles(stack, tile, tile).groupBy("ty", "tx").applyInPandas(run, f"y long, x long, {epoch} int, change double")


def forest_classes(df: DataFrame, bands: Sequence[str], seed_low: float, seed_high: float, classes: int = 3, threshold: float = 95.0, most: int = 10) -> DataFrame:
    """Gaussian maximum-likelihood clustering, seeded by the ratio's range (class 0) and equal splits outside it.

    Each round is one aggregate per class; it ends when every class keeps its threshold per cent of pixels.
    """
    df = written(df.select("y", "x", *bands), "bands")  # read in every round
    ratio = F.col(bands[0])
    ends = df.agg(F.min(ratio).alias("a"), F.max(ratio).alias("b")).first()
    inside = ratio.between(seed_low, seed_high)
    outside = F.least(F.lit(classes - 1), 1 + F.floor((ratio - ends["a"]) / ((ends["b"] - ends["a"]) or 1.0) * (classes - 1)).cast("int"))
    now: Column = F.when(inside, 0).otherwise(outside)
    n = len(bands)
    centres: dict[int, tuple] = {}
    for _ in range(most):
        sums = [F.avg(b).alias(f"m{i}") for i, b in enumerate(bands)] + [F.avg(F.col(a) * F.col(b)).alias(f"p{i}_{j}") for i, a in enumerate(bands) for j, b in enumerate(bands)]
        got = {int(r["c"]): r for r in df.withColumn("c", now).groupBy("c").agg(F.count("*").alias("n"), *sums).collect()}
        for c, r in got.items():  # an empty class keeps its centre
            mean = np.array([r[f"m{i}"] for i in range(n)])
            cov = np.array([[r[f"p{i}_{j}"] for j in range(n)] for i in range(n)]) - np.outer(mean, mean) + 1e-9 * np.eye(n)
            centres[c] = (mean, np.linalg.inv(cov), float(np.log(np.linalg.det(cov))))
        order = sorted(centres)
        cost = []
        for c in order:
            mean, inv, logdet = centres[c]
            d = [F.col(b) - float(m) for b, m in zip(bands, mean, strict=True)]
            cost.append(sum((d[i] * d[j] * float(inv[i, j]) for i in range(n) for j in range(n)), F.lit(logdet)))
        nearest = F.array_position(F.array(*cost), F.array_min(F.array(*cost))).cast("int") - 1
        new = F.get(F.array(*[F.lit(c) for c in order]), nearest)
        same = {int(r["c"]): r for r in df.select(now.alias("c"), new.alias("d")).groupBy("c").agg(F.avg(F.when(F.col("c") == F.col("d"), 100.0).otherwise(0.0)).alias("p")).collect()}
        now = new
        if len(same) == classes and all(r["p"] >= threshold for r in same.values()):
            break
    return df.select("y", "x", now.cast("int").alias("class"))


# Coefficients 1 to 28 of the C-band model function (Hersbach, 2003), its reference angles and power.
CMOD5 = (-0.688, -0.793, 0.338, -0.173, 0.0, 0.004, 0.111, 0.0162, 6.7329, 2.7541, -2.2918, 0.4, -0.6, 0.045, 0.007, 0.33, 0.012, 22.0, 1.95, 3.0, 8.39, -3.44, 1.36, 5.35, 1.99, 0.29, 3.80, 1.53)
CMOD5_ANGLE, CMOD5_RANGE, CMOD5_POWER = 40.0, 25.0, 1.6
#: Speeds that are tried, in m/s.
SPEEDS = np.arange(1, 201) / 10


def cmod5(speed: np.ndarray, cosine: float, theta: float) -> np.ndarray:
    """Backscatter of the sea for wind speeds (m/s), the cosine of the wind's angle to the look direction, and an incidence angle in degrees."""
    c = (0.0, *CMOD5)  # counted from 1, as published
    x = (theta - CMOD5_ANGLE) / CMOD5_RANGE
    s0, s = c[12] + c[13] * x, (c[7] + c[8] * x) * speed
    a3 = 1 / (1 + np.exp(-np.maximum(s, s0)))
    with np.errstate(divide="ignore", invalid="ignore"):
        a3 = np.where(s < s0, a3 * np.power(np.maximum(s / s0, 0), s0 * (1 - a3)), a3)
    b0 = a3 ** (c[9] + c[10] * x + c[11] * x * x) * 10 ** (c[1] + c[2] * x + c[3] * x**2 + c[4] * x**3 + (c[5] + c[6] * x) * speed)
    b1 = c[14] * (1 + x) - c[15] * speed * (0.5 + x - np.tanh(4 * (x + c[16] + c[17] * speed)))
    b1 = b1 / (np.exp(0.34 * (speed - c[18])) + 1)
    y0, n = c[19], c[20]
    v2 = speed / (c[21] + c[22] * x + c[23] * x * x) + 1
    v2 = np.where(v2 < y0, y0 - (y0 - 1) / n + np.power(np.maximum(v2 - 1, 0), n) / (n * (y0 - 1) ** (n - 1)), v2)
    b2 = (c[27] + c[28] * x) * v2 - (c[24] + c[25] * x + c[26] * x * x)
    return b0 * (1 + b1 * cosine + b2 * np.exp(-v2) * (2 * cosine * cosine - 1)) ** CMOD5_POWER


def wind_speed(df: DataFrame, theta: float, cosine: float = 1.0, sigma: str = "v", model: Mapping[float, float] | None = None) -> DataFrame:
    """Speed, 0.1 to 20 m/s, whose modelled backscatter is nearest, for one geometry; model maps speed to backscatter instead."""
    table = model or dict(zip(SPEEDS.tolist(), cmod5(SPEEDS, cosine, theta).tolist(), strict=True))
    speeds = np.array(sorted(table), float)
    modelled = np.array([table[s] for s in sorted(table)], float)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            found = pdf.v.to_numpy(float)
            # of equally near speeds the smallest; pixels at once so few that their distances stay in the cache
            best = [np.abs(found[k : k + 512, None] - modelled).argmin(1) for k in range(0, len(found), 512)]
            yield pd.DataFrame({"y": pdf.y, "x": pdf.x, "speed": speeds[np.concatenate(best)] if best else []})

    return df.select("y", "x", F.col(sigma).alias("v")).mapInPandas(run, "y long, x long, speed double")


def wind_direction(image: np.ndarray, size_km: float) -> tuple[float, float, float]:
    """Direction (dx, dy, up the image) across the streaks of a square window, up to a half turn, and how round the spectrum is.

    The flattened window's spectrum, averaged over its four corners and kept between waves of 2.5 and
    15 km, is fitted by a quadratic form below its peak; the wind blows along its steeper axis.
    """
    n = len(image)
    ones = np.ones_like(image)

    def total(z: np.ndarray) -> np.ndarray:
        """Sums over 11 x 11 samples, cut at the border."""
        for axis in (0, 1):
            sums = np.concatenate([np.zeros_like(z.take([0], axis)), z.cumsum(axis)], axis)
            at = np.arange(n)
            z = sums.take(np.minimum(at + 6, n), axis) - sums.take(np.maximum(at - 5, 0), axis)
        return z

    flat = image * total(ones) / total(image)
    size = 2 * n // 3 | 1
    corners = [flat[a : a + size, b : b + size] for a in (0, n - size) for b in (0, n - size)]
    spectrum = np.mean([np.abs(np.fft.fftshift(np.fft.fft2(z))) ** 2 for z in corners], 0)
    step, middle = 1.5 / (size_km * 1000), size // 2
    outer = min(int(2 * np.pi / (2500 * step)), middle)
    inner = int(2 * np.pi / (15000 * step))
    inner = 1 if inner >= middle else inner
    if outer < 1:
        return float("nan"), float("nan"), float("nan")
    spectrum[middle - inner : middle + inner + 1, middle - inner : middle + inner + 1] = 0
    ring = spectrum[middle - outer : middle + outer + 1, middle - outer : middle + outer + 1]
    smooth = np.zeros_like(ring)
    smooth[1:-1, 1:-1] = np.median(np.lib.stride_tricks.sliding_window_view(ring, (3, 3)), (2, 3))
    y, x = (z.ravel().astype(float) for z in np.mgrid[-outer : outer + 1, -outer : outer + 1])
    form, *_ = np.linalg.lstsq(np.stack([x * x, y * y, x * y], 1), smooth.ravel() - smooth.max(), rcond=None)
    values, vectors = np.linalg.eigh([[form[0], -form[2] / 2], [-form[2] / 2, form[1]]])
    steep = int(np.argmax(np.abs(values)))
    dx, dy = vectors[:, steep]
    turn = -1 if dx > 0 or (dx == 0 and dy < 0) else 1
    largest = np.abs(values).max()
    return float(turn * dx), float(turn * dy), float(np.abs(values).min() / largest) if largest else float("nan")


def wind_field(df: DataFrame, size: int, size_km: float, polarisation: str = "vv") -> DataFrame:
    """Wind of every whole window of size x size pixels: y, x of its middle, speed, dx, dy, ratio.

    df: y, x, v (calibrated power, null on land), theta (incidence in degrees). Windows that are half
    land have no wind, and none with an empty middle a speed; other land counts as the window's mean.
    """
    half = size // 2

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"y": pd.Series(dtype="int64"), "x": pd.Series(dtype="int64"), **{k: pd.Series(dtype="float64") for k in ("speed", "dx", "dy", "ratio")}})
        z = pdf.sort_values(["y", "x"])
        v, theta = (z[c].to_numpy(float) for c in ("v", "theta"))
        if len(z) != size * size or np.isnan(v).sum() >= size * size // 2:
            return out
        image = np.where(np.isnan(v), np.nanmean(v), v).reshape(size, size)
        dx, dy, ratio = wind_direction(image, size_km)
        k = half * size + half
        sigma = v[k]
        if polarisation == "hh":
            t = np.tan(np.radians(theta[k])) ** 2
            sigma = sigma * ((1 + 2 * t) / (1 + t)) ** 2
        speed = SPEEDS[np.argmin(np.abs(sigma - cmod5(SPEEDS, dx / np.hypot(dx, dy), theta[k])))] if np.isfinite(sigma + dx) else np.nan
        out.loc[0] = [z.y.iloc[0] + half, z.x.iloc[0] + half, speed, dx, dy, ratio]
        return out.astype({"y": "int64", "x": "int64"})

    blocks = df.select("y", "x", "v", "theta", F.floor(F.col("y") / size).alias("_by"), F.floor(F.col("x") / size).alias("_bx"))
    return blocks.groupBy("_by", "_bx").applyInPandas(run, "y long, x long, speed double, dx double, dy double, ratio double")
