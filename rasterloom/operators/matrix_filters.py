"""Adaptive speckle filters of polarimetric matrices: one choice of neighbours for all elements of a pixel.

Matrices are flat columns as in polarimetry. Every filter runs on tiles with a halo as wide as its
reach, so that tile borders do not show; pixels without a row, or with a null element, are left out.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .polarimetry import elements
from .raster import tiles

TILE = 64


def tiled(df: DataFrame, n: int, name: str, kernel: Callable[[np.ndarray], np.ndarray], halo: int) -> DataFrame:
    """Apply a kernel from and to an array (element, line, sample) with NaN where there is no data."""
    names = elements(n, name)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = int(pdf.y.min()), int(pdf.x.min())
        a = np.full((len(names), int(pdf.y.max()) - y0 + 1, int(pdf.x.max()) - x0 + 1), np.nan)
        a[:, pdf.y.to_numpy() - y0, pdf.x.to_numpy() - x0] = pdf[names].to_numpy(float).T
        a[:, np.isnan(a).any(0)] = np.nan
        own = pdf[(pdf.y // TILE == pdf.ty.iloc[0]) & (pdf.x // TILE == pdf.tx.iloc[0])]
        with np.errstate(all="ignore"):
            out = kernel(a)[:, own.y.to_numpy() - y0, own.x.to_numpy() - x0]
        return pd.DataFrame({"y": own.y.to_numpy(), "x": own.x.to_numpy(), **dict(zip(names, out, strict=True))})

    schema = "y long, x long, " + ", ".join(f"{e} double" for e in names)
    return tiles(df.select("y", "x", *names), TILE, TILE, halo).groupBy("ty", "tx").applyInPandas(run, schema)


def diagonal(n: int) -> list[int]:
    """Places of the real diagonal elements."""
    names = elements(n, "m")
    return [names.index(f"m{i}{i}") for i in range(1, n + 1)]


def windows(a: np.ndarray, size: int) -> np.ndarray:
    """The size x size neighbours of every pixel of the last two axes, NaN beyond the border."""
    h = size // 2
    pad = [(0, 0)] * (a.ndim - 2) + [(h, h), (h, h)]
    return np.lib.stride_tricks.sliding_window_view(np.pad(a, pad, constant_values=np.nan), (size, size), (-2, -1))


def gain(v: np.ndarray, noise: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean of the last axis and the weight of the pixel against it, by the variance beyond speckle of the given relative variance."""
    mean, var = np.nanmean(v, -1), np.nanvar(v, -1, ddof=1)
    signal = np.maximum((var - noise * mean * mean) / (1 + noise), 0)
    return mean, np.where(var > 0, signal / np.where(var > 0, var, 1), np.nan)


def refined_lee(df: DataFrame, n: int, name: str, looks: float = 1.0) -> DataFrame:
    """7 x 7: the span's edge direction picks the half window that the pixel belongs to; all elements share it and its weight.

    Where the window is cut by the border or by missing data each element has its own window statistics. A
    window without variance gives 0, as in the scalar definition.
    """
    size, noise = 7, 1.0 / looks
    i, j = np.mgrid[:size, :size]
    half = size // 2
    sides = np.array([[j >= half, j <= half], [j >= i, j <= i], [i <= half, i >= half], [i + j < size, i + j >= size - 1]])

    def kernel(a: np.ndarray) -> np.ndarray:
        span = a[diagonal(n)].sum(0)
        near = windows(a, size).reshape(*a.shape, -1)
        mean, weight = gain(near, noise)
        out = np.where(np.isnan(weight), 0.0, mean + weight * (a - mean))
        s = windows(span, size)
        whole = ~np.isnan(s).any((-2, -1))
        if whole.any():
            s = s[whole]
            sub = np.stack([[s[:, p : p + 3, q : q + 3].mean((-2, -1)) for q in (0, 2, 4)] for p in (0, 2, 4)]).transpose(2, 0, 1)
            right, top = sub[:, :, 2].sum(1) - sub[:, :, 0].sum(1), sub[:, 0].sum(1) - sub[:, 2].sum(1)
            rising = sub[:, 0, 1] + sub[:, 0, 2] + sub[:, 1, 2] - sub[:, 1, 0] - sub[:, 2, 0] - sub[:, 2, 1]
            falling = sub[:, 0, 0] + sub[:, 0, 1] + sub[:, 1, 0] - sub[:, 1, 2] - sub[:, 2, 1] - sub[:, 2, 2]
            slopes = np.stack([right, rising, top, falling])
            way = np.argmax(np.abs(slopes), 0)
            part = sides[way, (slopes[way, np.arange(len(way))] > 0).astype(int)]
            _, weight = gain(np.where(part, s, np.nan).reshape(len(s), -1), noise)
            for k in range(len(a)):
                z = a[k][whole]
                m = np.nanmean(np.where(part, near[k][whole].reshape(-1, size, size), np.nan), (-2, -1))
                out[k][whole] = np.where(np.isnan(weight), 0.0, m + weight * (z - m))
        return np.where(np.isnan(a), np.nan, out)

    return tiled(df, n, name, kernel, size // 2)


def lee_sigma(df: DataFrame, n: int, name: str, looks: float = 1.0, sigma: float = 0.9, size: int = 7, target: int = 3) -> DataFrame:
    """Mean over the neighbours whose every diagonal element is within the speckle's range about a first estimate.

    The range holds the share sigma of a gamma-distributed power, by quantiles of a seeded sample. Bright point
    targets (the 98th percentile of a channel, five of the nearest) stay. One weight by the span serves all elements.
    """
    sample = np.random.default_rng(3).gamma(looks, 1 / looks, 200_000)
    low, high = np.quantile(sample, [(1 - sigma) / 2, (1 + sigma) / 2])
    names = elements(n, name)
    places = diagonal(n)
    row = df.agg(*[F.percentile_approx(names[p], 0.98, 10_000).alias(f"q{p}") for p in places]).first()
    bright = np.array([row[f"q{p}"] if row[f"q{p}"] is not None else np.inf for p in places])
    noise = 1.0 / looks

    def kernel(a: np.ndarray) -> np.ndarray:
        d = a[places]
        near = windows(d, target).reshape(*d.shape, -1)
        point = ((d >= bright[:, None, None]) & ((near >= bright[:, None, None, None]).sum(-1) >= 5)).any(0)
        mean, weight = gain(near, noise)
        prior = mean + np.nan_to_num(weight) * (d - mean)
        w = windows(a, size).reshape(*a.shape, -1)
        wd = w[places]
        inside = ((wd >= low * prior[..., None]) & (wd <= high * prior[..., None])).all(0)
        some = inside.any(-1)
        mean, weight = gain(np.where(inside, wd.sum(0), np.nan), noise)
        own = np.nanmean(np.where(inside, w, np.nan), -1)
        out = own + np.nan_to_num(weight) * (a - own)
        return np.where(point | ~some, a, out)

    return tiled(df, n, name, kernel, size // 2 + target)


def idan(df: DataFrame, n: int, name: str, looks: float = 1.0, most: int = 50) -> DataFrame:
    """Intensity-driven adaptive neighbourhoods: regions of like diagonals, grown about each pixel in steps, then averaged.

    All pixels of a tile grow at once; a region has at most `most` pixels, the nearest ones, and reaches 5 pixels far.
    A second look takes in what was left out, if it is near the region's own mean.
    """
    reach = 5
    near, far = 2 / 3 * n / np.sqrt(looks), 2 * n / np.sqrt(looks)
    side = 2 * reach + 1
    centre = reach * side + reach
    steps = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy, dx) != (0, 0)]

    def off(w: np.ndarray, about: np.ndarray) -> np.ndarray:
        return np.abs((w - about[..., None]) / np.where(about > 0, about, np.nan)[..., None]).sum(0)

    def grown(inside: np.ndarray) -> np.ndarray:
        grid = inside.reshape(*inside.shape[:2], side, side)
        out = grid.copy()
        for dy, dx in steps:
            out |= np.roll(np.pad(grid, ((0, 0), (0, 0), (1, 1), (1, 1))), (dy, dx), (2, 3))[:, :, 1:-1, 1:-1]
        return out.reshape(inside.shape)

    def kernel(a: np.ndarray) -> np.ndarray:
        d = a[diagonal(n)]
        seed = np.nanmedian(windows(d, 3).reshape(*d.shape, -1), -1)
        w = windows(d, side).reshape(*d.shape, -1)
        like = off(w, seed) <= near
        inside = np.zeros(like.shape, bool)
        inside[..., centre] = True
        for _ in range(reach):
            full = inside.sum(-1) >= most
            more = grown(inside) & like
            more[full] = inside[full]
            inside = more | inside
        mean = np.nanmean(np.where(inside, w, np.nan), -1)
        edge = grown(inside) & ~inside & (off(w, seed) <= far) & (off(w, mean) <= far / 3)
        used = inside | edge
        out = np.empty_like(a)
        for k in range(len(a)):
            out[k] = np.nanmean(np.where(used, windows(a[k], side).reshape(*a.shape[1:], -1), np.nan), -1)
        return np.where(np.isnan(a), np.nan, out)

    return tiled(df, n, name, kernel, reach + 2)


def hermitian(a: np.ndarray, n: int) -> np.ndarray:
    """Matrices (line, sample, n, n) of flat elements."""
    out = np.zeros((*a.shape[1:], n, n), complex)
    k = 0
    for i in range(n):
        out[..., i, i] = a[k]
        k += 1
        for j in range(i + 1, n):
            out[..., i, j] = a[k] + 1j * a[k + 1]
            out[..., j, i] = out[..., i, j].conj()
            k += 2
    return out


def flat(m: np.ndarray, n: int) -> np.ndarray:
    """The flat elements of matrices."""
    return np.stack([part for i in range(n) for j in range(i, n) for part in ((m[..., i, i].real,) if i == j else (m[..., i, j].real, m[..., i, j].imag))])


def non_local(df: DataFrame, n: int, name: str, looks: int = 1, search: int = 7, patch: int = 3, scale: int = 1) -> DataFrame:
    """Weighted mean over the search window, by the likelihood ratio between the patches about both pixels, with bias reduction.

    Matrices are smoothed by a small Gaussian first, their correlations scaled by looks / n so that determinants are positive.
    """
    share = min(looks / n, 1.0)
    h, p = search // 2, patch // 2

    def shifted(z: np.ndarray, dy: int, dx: int) -> np.ndarray:
        out = np.full_like(z, np.nan)
        height, width = z.shape[-2:]
        if abs(dy) >= height or abs(dx) >= width:
            return out
        y, x = slice(max(0, -dy), min(height, height - dy)), slice(max(0, -dx), min(width, width - dx))
        out[..., y, x] = z[..., max(0, dy) : height + min(0, dy), max(0, dx) : width + min(0, dx)]
        return out

    def determinant(z: np.ndarray) -> np.ndarray:
        return np.linalg.det(hermitian(np.nan_to_num(z), n)).real

    def kernel(a: np.ndarray) -> np.ndarray:
        smooth, total = np.zeros_like(a), 0.0
        for dy in range(-scale, scale + 1):
            for dx in range(-scale, scale + 1):
                g = np.exp(-np.pi * (dy * dy + dx * dx) / (scale + 0.5) ** 2)
                smooth += g * np.nan_to_num(shifted(a, dy, dx))
                total += g
        smooth /= total
        smooth[[k for k in range(len(a)) if k not in diagonal(n)]] *= share
        smooth[:, np.isnan(a[0])] = np.nan
        det = determinant(smooth)
        sums, squares = np.zeros_like(a), np.zeros((n, *a.shape[1:]))
        weights = np.zeros(a.shape[1:])
        for dy in range(-h, h + 1):
            for dx in range(-h, h + 1):
                other, both = shifted(smooth, dy, dx), determinant(smooth + shifted(smooth, dy, dx))
                ratio = det * determinant(other) / both**2
                ratio = np.where((ratio > 0) & ~np.isnan(other[0]) & ~np.isnan(smooth[0]) & (both > 0), ratio, np.nan)
                each = -np.log(ratio) - 2 * n * np.log(2)
                near = windows(each, patch).reshape(*each.shape, -1)
                valid = (~np.isnan(near)).any(-1)
                w = np.where(valid, np.exp(-3 * np.nansum(near, -1)), 0.0)
                moved = shifted(a, dy, dx)
                w = np.where(np.isnan(moved[0]), 0.0, w)
                sums += w * np.nan_to_num(moved)
                squares += w * np.nan_to_num(moved[diagonal(n)]) ** 2
                weights += w
        mean = sums / np.where(weights > 0, weights, np.nan)
        d = mean[diagonal(n)]
        var = squares / np.where(weights > 0, weights, np.nan) - d * d
        alpha = np.maximum(np.nanmax(np.where(var > 0, 1 - d * d / (np.where(var > 0, var, 1) * looks), 0.0), 0), 0.0)
        return np.where(np.isnan(mean), a, (1 - alpha) * mean + alpha * a)

    return tiled(df, n, name, kernel, h + p + scale)
