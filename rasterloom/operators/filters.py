"""Speckle filters. Moment filters are separable windows; order statistics scatter pixels to their neighbours."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.windows import moments, neighbours
from .raster import tiles


def looks_of(df: DataFrame, band: str = "v") -> float:
    """Equivalent number of looks of the whole scene: squared mean over population variance."""
    r = df.agg(F.avg(band).alias("m"), F.var_pop(band).alias("v")).first()
    return float(r["m"] ** 2 / r["v"]) if r["v"] else 1.0


def boxcar(df: DataFrame, size: int, band: str = "v") -> DataFrame:
    return moments(df, F.col(band), size).select("y", "x", F.col("mean").alias(band))


def _spread(mean: Column, var: Column) -> Column:
    return F.sqrt(F.coalesce(var, F.lit(0.0))) / mean


def lee(df: DataFrame, size: int, looks: float | None = None, band: str = "v") -> DataFrame:
    """Minimum mean square error between the centre and the window's mean, by the ratio of noise to local variation."""
    looks = looks or looks_of(df, band)
    m = moments(df, F.col(band), size)
    ci, cu = _spread(F.col("mean"), F.col("var")), 1 / float(np.sqrt(looks))
    w = 1 - cu * cu / (ci * ci)
    return m.select("y", "x", F.when(F.col("mean") == 0, 0.0).when(ci < cu, F.col("mean")).otherwise(F.col(band) * w + F.col("mean") * (1 - w)).alias(band))


def gamma_map(df: DataFrame, size: int, looks: float | None = None, band: str = "v") -> DataFrame:
    """Maximum a posteriori under gamma speckle: the mean where smooth, the centre where a target stands out."""
    looks = looks or looks_of(df, band)
    m = moments(df, F.col(band), size)
    ci, cu = _spread(F.col("mean"), F.col("var")), 1 / float(np.sqrt(looks))
    alpha = (1 + cu * cu) / (ci * ci - cu * cu)
    b = alpha - looks - 1
    d = F.col("mean") * F.col("mean") * b * b + 4 * alpha * looks * F.col("mean") * F.col(band)
    mid = (b * F.col("mean") + F.sqrt(d)) / (2 * alpha)
    return m.select("y", "x", F.when(F.col("mean") == 0, 0.0).when(ci <= cu, F.col("mean")).when(ci < float(np.sqrt(2)) * cu, mid).otherwise(F.col(band)).alias(band))


def frost(df: DataFrame, size: int, damping: float = 2.0, band: str = "v") -> DataFrame:
    """Weights fall exponentially with the chessboard distance, faster where the window varies more."""
    local = moments(df, F.col(band), size).select("y", "x", (damping * F.coalesce("var", F.lit(0.0)) / (F.col("mean") * F.col("mean"))).alias("k"))
    met = neighbours(df.where(F.col(band).isNotNull()), size, columns=(band,)).join(local, ["y", "x"])
    w = F.exp(-F.coalesce("k", F.lit(0.0)) * F.greatest(F.abs("dy"), F.abs("dx")))
    return met.groupBy("y", "x").agg((F.sum(w * F.col(band)) / F.sum(w)).alias(band))


def median(df: DataFrame, size: int, band: str = "v") -> DataFrame:
    """Upper median of the valid neighbours."""
    met = neighbours(df.where(F.col(band).isNotNull()), size, columns=(band,)).groupBy("y", "x").agg(F.sort_array(F.collect_list(band)).alias("a"))
    return met.join(df.select("y", "x"), ["y", "x"]).select("y", "x", F.get("a", F.floor(F.size("a") / 2).cast("int")).alias(band))


def multitemporal(stack: DataFrame, size: int, band: str = "v", epoch: str = "epoch") -> DataFrame:
    """Each date's filtered value times the mean, over dates, of value over filtered value; dates with filtered 0 are skipped."""
    f = moments(stack, F.col(band), size, keys=(epoch,)).withColumnRenamed("mean", "f")
    good = (F.col("f").isNotNull()) & (F.col("f") != 0)
    ratio = f.groupBy("y", "x").agg(F.avg(F.when(good, F.col(band) / F.col("f"))).alias("r"))
    return f.join(ratio, ["y", "x"]).select(epoch, "y", "x", (F.col("f") * F.col("r")).alias(band))


def _grid(pdf: pd.DataFrame, band: str) -> tuple[np.ndarray, int, int]:
    y0, x0 = int(pdf.y.min()), int(pdf.x.min())
    a = np.full((int(pdf.y.max()) - y0 + 1, int(pdf.x.max()) - x0 + 1), np.nan)
    a[pdf.y.to_numpy() - y0, pdf.x.to_numpy() - x0] = pdf[band]
    return a, y0, x0


def tiled(df: DataFrame, kernel, halo: int, band: str = "v", tile: int = 128) -> DataFrame:
    """Apply a numpy kernel (grid -> grid) to tiles with a halo, so that no tile border shows."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, y0, x0 = _grid(pdf, band)
        out = kernel(a)
        ty, tx = int(pdf.ty.iloc[0]), int(pdf.tx.iloc[0])
        own = pdf[(pdf.y // tile == ty) & (pdf.x // tile == tx)]
        return pd.DataFrame({"y": own.y, "x": own.x, band: out[own.y.to_numpy() - y0, own.x.to_numpy() - x0]})

    return tiles(df.select("y", "x", band), tile, tile, halo).groupBy("ty", "tx").applyInPandas(run, f"y long, x long, {band} double")


def _windows(a: np.ndarray, size: int) -> np.ndarray:
    h = size // 2
    return np.lib.stride_tricks.sliding_window_view(np.pad(a, h, constant_values=np.nan), (size, size))


def refined_lee(df: DataFrame, looks: float = 1.0, band: str = "v") -> DataFrame:
    """7 x 7: where the window varies, the edge direction picks the half of the window that the centre belongs to."""
    noise = 1.0 / looks

    def kernel(a: np.ndarray) -> np.ndarray:
        w = _windows(a, 7)
        with np.errstate(all="ignore"):
            sub = np.stack([np.nanmean(w[..., i : i + 3, j : j + 3], (-2, -1)) for i in (0, 2, 4) for j in (0, 2, 4)], -1).reshape(*a.shape, 3, 3)
            grads = np.stack([
                sub[..., :, 2].sum(-1) - sub[..., :, 0].sum(-1),
                sub[..., 0, 1] + sub[..., 0, 2] + sub[..., 1, 2] - sub[..., 1, 0] - sub[..., 2, 0] - sub[..., 2, 1],
                sub[..., 0, :].sum(-1) - sub[..., 2, :].sum(-1),
                sub[..., 0, 0] + sub[..., 0, 1] + sub[..., 1, 0] - sub[..., 1, 2] - sub[..., 2, 1] - sub[..., 2, 2],
            ], -1)
            which = np.nanargmax(np.nan_to_num(np.abs(grads)), -1)
            i, j = np.mgrid[-3:4, -3:4]
            sides = [(j >= 0, j <= 0), (j >= i, j <= i), (i <= 0, i >= 0), (i + j <= 0, i + j >= 0)]
            centre = sub[..., 1, 1]
            ends = [(sub[..., 1, 2], sub[..., 1, 0]), (sub[..., 0, 2], sub[..., 2, 0]), (sub[..., 0, 1], sub[..., 2, 1]), (sub[..., 0, 0], sub[..., 2, 2])]
            mean, var = np.empty_like(a), np.empty_like(a)
            for d in range(4):
                near = np.abs(ends[d][0] - centre) < np.abs(ends[d][1] - centre)
                for side in (0, 1):
                    at = (which == d) & (near == (side == 0))
                    if at.any():
                        v = np.where(sides[d][side], w[at], np.nan)
                        mean[at], var[at] = np.nanmean(v, (-2, -1)), np.nanvar(v, (-2, -1))
            signal = np.maximum((var - noise * mean * mean) / (1 + noise), 0)
            k = np.where(var > 0, signal / var, 0)
        return mean + k * (a - mean)

    return tiled(df, kernel, 4, band)


def lee_sigma(df: DataFrame, looks: float = 1.0, sigma: float = 0.9, size: int = 7, target: int = 3, band: str = "v") -> DataFrame:
    """Mean of the neighbours within the speckle's sigma range about a first estimate; bright point targets stay.

    The range of a gamma-distributed intensity with the given looks that holds the share sigma is taken by its quantiles.
    """
    rng = np.random.default_rng(3)
    sample = np.sort(rng.gamma(looks, 1 / looks, 200_000))
    low, high = np.quantile(sample, [(1 - sigma) / 2, 1 - (1 - sigma) / 2])
    bright = float(df.selectExpr(f"percentile_approx({band}, 0.98, 10000)").first()[0] or 0)
    noise = 1.0 / looks

    def mmse(v: np.ndarray, centre: np.ndarray) -> np.ndarray:
        mean, var = np.nanmean(v, (-2, -1)), np.nanvar(v, (-2, -1))
        signal = np.maximum((var - noise * mean * mean) / (1 + noise), 0)
        return mean + np.where(var > 0, signal / var, 0) * (centre - mean)

    def kernel(a: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            near = _windows(a, target)
            kept = (a >= bright) & ((near >= bright).sum((-2, -1)) >= 5)
            prior = mmse(near, a)
            w = _windows(a, size)
            inside = np.where((w >= low * prior[..., None, None]) & (w <= high * prior[..., None, None]), w, np.nan)
            out = np.where((~np.isnan(inside)).any((-2, -1)), mmse(inside, a), prior)
        return np.where(kept, a, out)

    return tiled(df, kernel, size // 2 + target, band)


def idan(df: DataFrame, looks: float = 1.0, most: int = 50, band: str = "v") -> DataFrame:
    """Intensity-driven adaptive neighbourhood: grow a region of like pixels about each pixel, then average it."""
    near, far = float(2 / 3 / np.sqrt(looks)), float(2 / np.sqrt(looks))

    def kernel(a: np.ndarray) -> np.ndarray:
        out = np.full_like(a, np.nan)
        seeds = _windows(a, 3)
        with np.errstate(all="ignore"):
            seed = np.nanmedian(seeds, (-2, -1))
        # plain numbers in a list with a border of NaN: the growth looks at single pixels
        height, width = a.shape[0] + 2, a.shape[1] + 2
        flat = np.pad(a, 1, constant_values=np.nan).ravel().tolist()
        around = (-width - 1, -width, -width + 1, -1, 1, width - 1, width, width + 1)
        mean_of = lambda values: float(np.add.reduce(np.array(values)) / len(values))
        for y in range(a.shape[0]):
            for x, s in enumerate(seed[y].tolist()):
                at = (y + 1) * width + x + 1
                if flat[at] != flat[at] or not s:
                    out[y, x] = flat[at]
                    continue
                inside, edge, seen, front = [flat[at]], [], {at}, [at]
                while front and len(inside) < most:
                    grown = []
                    for c in front:
                        for step in around:
                            p = c + step
                            if p in seen:
                                continue
                            v = flat[p]
                            if v != v:
                                continue
                            seen.add(p)
                            off = abs(v - s) / s
                            if off <= near and len(inside) < most:
                                inside.append(v)
                                grown.append(p)
                            elif off <= far:
                                edge.append(v)
                    front = grown
                mean = mean_of(inside)
                if mean:
                    inside += [v for v in edge if abs(v - mean) / mean <= far / 3]
                out[y, x] = mean_of(inside)
        return out

    return tiled(df, kernel, 8, band, tile=64)


def mulog(df: DataFrame, looks: float = 1.0, search: int = 5, patch: int = 3, rounds: int = 6, band: str = "v") -> DataFrame:
    """Log-domain despeckling: alternate a non-local mean with the proximal step of the log-gamma likelihood."""
    halo = (search + patch) * rounds // 2

    def smooth(u: np.ndarray, valid: np.ndarray, h: float) -> np.ndarray:
        total, weight = np.zeros_like(u), np.zeros_like(u)
        r, p = search // 2, patch // 2
        pad = lambda z, k: np.pad(z, k)
        for dy in range(-r, r + 1):
            for dx in range(-r, r + 1):
                other = pad(u, r)[r + dy : r + dy + u.shape[0], r + dx : r + dx + u.shape[1]]
                ok = pad(valid, r)[r + dy : r + dy + u.shape[0], r + dx : r + dx + u.shape[1]]
                d = np.lib.stride_tricks.sliding_window_view(pad((u - other) ** 2, p), (patch, patch)).mean((-2, -1))
                w = np.exp(-d / (h * h)) * ok
                total += w * other
                weight += w
        return np.where(weight > 0, total / np.maximum(weight, 1e-12), u)

    def kernel(a: np.ndarray) -> np.ndarray:
        valid = (a > 0) & ~np.isnan(a)
        v = np.where(valid, np.log(np.where(valid, a, 1) + 1e-10), 0.0)
        rho = 1 + 2 / looks
        u, w = v.copy(), np.zeros_like(v)
        for _ in range(rounds):
            z = smooth(u - w, valid.astype(float), 0.7 / np.sqrt(looks) + 0.2)
            t = z + w
            u = t.copy()
            for _ in range(8):  # Newton on looks (u + exp(v - u)) + rho/2 (u - t)²
                e = np.exp(v - u)
                u -= (looks * (1 - e) + rho * (u - t)) / (looks * e + rho)
            w += z - u
        return np.where(valid, np.exp(u), np.nan)

    return tiled(df, kernel, halo, band)
