"""Shifts between complex images, resampling through terrain and orbits, and geocoding of complex data.

Lines and columns are transformed whole, one group each; blocks of a scene are correlated one group each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cx import Cx
from .geometry import Sensor, locate, orbit_of, simulate
from .topsar import deramp

#: Samples on either side of a place that a sinc interpolation takes.
TAPS = 4
#: Lines and samples of the blocks in which places meet an image.
BLOCK = 128


def fractional_shift(df: DataFrame, shift: float, axis: str = "x") -> DataFrame:
    """A complex image (y, x, i, q) moved by a fraction of a sample along an axis: sample k takes the signal at k + shift.

    Every line (or column) is turned in its spectrum; missing samples count as 0, and the ends are cyclic.
    """
    other = "y" if axis == "x" else "x"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at = pdf[axis].to_numpy() - pdf[axis].min()
        z = np.zeros(at.max() + 1, complex)
        z[at] = pdf.i + 1j * pdf.q
        z = np.fft.ifft(np.fft.fft(z) * np.exp(2j * np.pi * np.fft.fftfreq(len(z)) * shift))[at]
        return pd.DataFrame({"y": pdf.y, "x": pdf.x, "i": z.real, "q": z.imag})

    return df.select("y", "x", "i", "q").groupBy(other).applyInPandas(run, "y long, x long, i double, q double")


def block_shifts(reference: DataFrame, secondary: DataFrame, size: int = 64, fine: int = 50) -> DataFrame:
    """Shift of every block of size x size pixels: (by, bx, dy, dx, quality): the secondary's sample at k + shift matches the reference's at k.

    Amplitudes without their mean are correlated; the peak is refined to 1 / fine of a pixel on the finely
    sampled correlation about it. quality is the peak over the root mean square. Blocks at the border that
    are not whole, or without variance, have no row.
    """
    both = reference.select("y", "x", F.hypot("i", "q").alias("a")).join(secondary.select("y", "x", F.hypot("i", "q").alias("b")), ["y", "x"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"by": pd.Series(dtype="int64"), "bx": pd.Series(dtype="int64"), "dy": pd.Series(dtype=float), "dx": pd.Series(dtype=float), "quality": pd.Series(dtype=float)})
        if len(pdf) < size * size:
            return out
        pdf = pdf.sort_values(["y", "x"])
        a, b = (pdf[c].to_numpy(float).reshape(size, size) for c in ("a", "b"))
        a, b = a - a.mean(), b - b.mean()
        if not a.any() or not b.any():
            return out
        spectrum = np.conj(np.fft.fft2(a)) * np.fft.fft2(b)
        rough = np.fft.ifft2(spectrum).real
        peak = np.unravel_index(np.argmax(rough), rough.shape)
        f = np.fft.fftfreq(size)
        near = np.arange(-fine, fine + 1) / fine
        rows, columns = (np.exp(2j * np.pi * np.outer(p + near, f)) for p in peak)
        exact = (rows @ spectrum @ columns.T).real / size**2
        i, j = np.unravel_index(np.argmax(exact), exact.shape)
        place = [p + near[k] for p, k in zip(peak, (i, j), strict=True)]
        dy, dx = (p - size if p > size / 2 else p for p in place)
        out.loc[0] = [int(pdf.by.iloc[0]), int(pdf.bx.iloc[0]), dy, dx, exact[i, j] / np.sqrt((rough**2).mean())]
        return out.astype({"by": "int64", "bx": "int64"})

    placed = both.withColumns({"by": F.floor(F.col("y") / size), "bx": F.floor(F.col("x") / size)})
    return placed.groupBy("by", "bx").applyInPandas(run, "by long, bx long, dy double, dx double, quality double")


def overall_shift(shifts: DataFrame, column: str, least: float = 3.0) -> float:
    """Mean shift of the blocks of enough quality; 0 without any."""
    r = shifts.where(F.col("quality") >= least).agg(F.avg(column)).first()[0]
    return float(r or 0.0)


def range_shift(reference: DataFrame, secondary: DataFrame, size: int = 64, least: float = 3.0) -> DataFrame:
    """The secondary image moved along range by its overall shift against the reference."""
    return fractional_shift(secondary, overall_shift(block_shifts(reference, secondary, size), "dx", least), "x")


def azimuth_shift(df: DataFrame, shift: float, rate: float = 0.0, doppler: float = 0.0, centre: float = 0.0, interval: float = 1.0) -> DataFrame:
    """A burst moved along azimuth: its ramp is taken off, the columns shifted, and the ramp put back where the samples came from."""
    moved = fractional_shift(deramp(df, rate, doppler, centre, interval), shift, "y")
    t = (F.col("y") + shift) * interval - centre
    z = Cx.of("i", "q") * Cx.turn(t * t * (-math.pi * rate) + t * (-2 * math.pi * doppler)).conj()
    return moved.select("y", "x", z.re.alias("i"), z.im.alias("q"))


def azimuth_spectrum(df: DataFrame, prf: float) -> DataFrame:
    """Mean power over all columns at each azimuth frequency (Hz, from -prf / 2): (bin, frequency, power)."""
    lines = df.agg((F.max("y") + 1).alias("n")).first()["n"] or 0

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        z = np.zeros(lines, complex)
        z[pdf.y] = pdf.i + 1j * pdf.q
        return pd.DataFrame({"bin": np.arange(lines), "power": np.fft.fftshift(np.abs(np.fft.fft(z)) ** 2)})

    each = df.select("y", "x", "i", "q").groupBy("x").applyInPandas(run, "bin long, power double")
    frequency = (F.col("bin") - lines // 2) * prf / max(lines, 1)
    return each.groupBy("bin").agg(F.avg("power").alias("power")).select("bin", frequency.alias("frequency"), "power")


def sinc_resample(places: DataFrame, image: DataFrame) -> DataFrame:
    """Complex value at line and sample of each place (its own y, x): 2 * TAPS windowed sinc weights along both axes; null where a tap is missing.

    Places keep their columns. Weights sum to one, so that a constant stays. Places meet the image by blocks
    of its pixels, each grown by the taps, so that a place is one row all along.
    """
    columns = places.columns
    near = range(1 - TAPS, TAPS + 1)

    def weights(t: np.ndarray) -> list[np.ndarray]:
        d = [t - k for k in near]
        raw = [np.where(np.abs(x) < 1e-12, 1.0, np.sin(np.pi * x) / np.where(np.abs(x) < 1e-12, 1.0, np.pi * x)) * (0.5 + 0.5 * np.cos(np.pi * x / TAPS)) for x in d]
        total = sum(raw[1:], raw[0])
        return [w / total for w in raw]

    def run(key: tuple, own: pd.DataFrame, pixels: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = (int(k) * BLOCK - TAPS for k in key)
        z = np.full((BLOCK + 2 * TAPS + 1, BLOCK + 2 * TAPS + 1), np.nan, complex)
        z[pixels["_y"].to_numpy() - y0, pixels["_x"].to_numpy() - x0] = pixels["_i"].to_numpy(float) + 1j * pixels["_q"].to_numpy(float)
        line, sample = (own[c].to_numpy(float) for c in ("line", "sample"))
        some = np.flatnonzero(~np.isnan(line) & ~np.isnan(sample))
        at, to = (np.floor(c[some]) for c in (line, sample))
        wy, wx = weights(line[some] - at), weights(sample[some] - to)
        at, to = at.astype(np.int64) - y0, to.astype(np.int64) - x0
        made = np.zeros(len(some), complex)
        for dy, v in zip(near, wy, strict=True):
            for dx, w in zip(near, wx, strict=True):
                weight = v * w
                # a weight of nothing needs no sample
                made += np.where(np.abs(weight) > 1e-9, z[at + dy, to + dx] * weight, 0)
        i, q = np.full(len(own), np.nan), np.full(len(own), np.nan)
        i[some], q[some] = made.real, made.imag
        return own[columns].assign(i=i, q=q)

    block = lambda at, other: F.floor(F.coalesce(F.when(~F.isnan(at), F.col(at)), F.col(other)) / BLOCK)
    grown = lambda c: F.explode(F.sequence(F.floor((F.col(c) - TAPS) / BLOCK), F.floor((F.col(c) + TAPS) / BLOCK)))
    asked = places.withColumns({"_by": block("line", "y"), "_bx": block("sample", "x")})
    source = image.select(F.col("y").alias("_y"), F.col("x").alias("_x"), F.col("i").alias("_i"), F.col("q").alias("_q")).withColumn("_by", grown("_y")).withColumn("_bx", grown("_x"))
    schema = ", ".join(f"{c} {t}" for c, t in places.dtypes) + ", i double, q double"
    return asked.groupBy("_by", "_bx").cogroup(source.groupBy("_by", "_bx")).applyInPandas(run, schema)


def polynomial(coefficients: list[float], y: Column, x: Column) -> Column:
    """A polynomial of y and x by rising degree: 1, y, x, y², yx, x², ..."""
    terms, k, degree = [], 0, 0
    while k < len(coefficients):
        for j in range(degree + 1):
            if k < len(coefficients):
                terms.append(float(coefficients[k]) * F.pow(y, F.lit(float(degree - j))) * F.pow(x, F.lit(float(j))))
                k += 1
        degree += 1
    return sum(terms[1:], terms[0])


def warp(df: DataFrame, line: list[float], sample: list[float]) -> DataFrame:
    """A complex secondary image on the reference's grid: the pixel (y, x) takes it at the polynomials' line and sample, by sinc; null where taps are missing."""
    y, x = F.col("y").cast("double"), F.col("x").cast("double")
    return sinc_resample(df.select("y", "x").withColumns({"line": polynomial(line, y, x), "sample": polynomial(sample, y, x)}), df).select("y", "x", "i", "q")


def back_geocode(grid: DataFrame, secondary: DataFrame, reference_orbit: DataFrame, secondary_orbit: DataFrame, ref: Sensor, sec: Sensor, rate: float = 0.0, doppler: float = 0.0, centre: float = 0.0) -> DataFrame:
    """A secondary burst on the reference's pixels: (y, x, i, q, dy, dx), with the offsets that were applied.

    Each terrain cell (lat, lon, h) is located in both images and a reference pixel takes the mean offset of
    its cells; the burst is deramped, resampled by sinc, and the ramp put back at the place it was taken from.
    """
    a = locate(grid, orbit_of(reference_orbit), ref).select("y", "x", F.floor(F.col("line") + 0.5).cast("long").alias("ry"), F.floor(F.col("sample") + 0.5).cast("long").alias("rx"), F.col("line").alias("la"), F.col("sample").alias("sa"))
    b = locate(grid, orbit_of(secondary_orbit), sec).select("y", "x", F.col("line").alias("lb"), F.col("sample").alias("sb"))
    met = a.join(b, ["y", "x"]).where("la is not null and lb is not null")
    offsets = met.groupBy(F.col("ry").alias("y"), F.col("rx").alias("x")).agg(F.avg(F.col("lb") - F.col("la")).alias("dy"), F.avg(F.col("sb") - F.col("sa")).alias("dx"))
    places = offsets.withColumns({"line": F.col("y") + F.col("dy"), "sample": F.col("x") + F.col("dx")})
    made = sinc_resample(places, deramp(secondary, rate, doppler, centre, sec.interval))
    t = F.col("line") * sec.interval - centre
    z = Cx.of("i", "q") * Cx.turn(t * t * (-math.pi * rate) + t * (-2 * math.pi * doppler)).conj()
    return made.select("y", "x", z.re.alias("i"), z.im.alias("q"), "dy", "dx")


def geocoded_slc(grid: DataFrame, image: DataFrame, vectors: DataFrame, sensor: Sensor, wavelength: float, flatten: bool = True) -> DataFrame:
    """Complex image on a map grid (y, x, lat, lon, h), by sinc; flattened: without the phase of the range to each cell."""
    made = sinc_resample(locate(grid, orbit_of(vectors), sensor), image)
    if not flatten:
        return made
    z = Cx.of("i", "q") * Cx.turn(4 * math.pi / wavelength * (sensor.near_range + F.col("sample") * sensor.spacing))
    return made.select(*[c for c in made.columns if c not in ("i", "q")], z.re.alias("i"), z.im.alias("q"))


def simulation_correction(grid: DataFrame, image: DataFrame, vectors: DataFrame, sensor: Sensor, cell_area: float, size: int = 64, least: float = 3.0) -> DataFrame:
    """Terrain correction of an image (y, x, v) whose timing is off: the simulated image tells the shift, by blocks."""
    from .geometry import resample

    zero = F.lit(0.0).alias("q")
    made = simulate(grid, vectors, sensor, cell_area).select("y", "x", F.col("v").alias("i"), zero)
    shifts = block_shifts(made, image.select("y", "x", F.col("v").alias("i"), zero), size)
    dy, dx = (overall_shift(shifts, c, least) for c in ("dy", "dx"))
    placed = locate(grid, orbit_of(vectors), sensor).withColumns({"line": F.col("line") + dy, "sample": F.col("sample") + dx})
    return resample(placed, image)


def tie_point_geocoding(grid: DataFrame, image: DataFrame, ties: DataFrame, most: int = 100_000) -> DataFrame:
    """Image (y, x, v) on a map grid (y, x, lat, lon) by way of tie points (line, pixel, lat, lon) on a full grid of lines and pixels.

    The grid is of checked size and sent to every task; a cell starts at its nearest tie point and walks to the
    patch that holds it, whose corners are interpolated. Cells outside all patches have no value.
    """
    from .geometry import resample

    rows = ties.select("line", "pixel", "lat", "lon").limit(most + 1).toPandas().sort_values(["line", "pixel"])
    if len(rows) > most:
        raise ValueError(f"there are more than {most} tie points")
    lines, pixels = np.sort(rows.line.unique()), np.sort(rows["pixel"].unique())
    lat, lon = (rows[c].to_numpy(float).reshape(len(lines), len(pixels)) for c in ("lat", "lon"))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            la, lo = pdf.lat.to_numpy(float), pdf.lon.to_numpy(float)
            line, sample = np.full(len(pdf), np.nan), np.full(len(pdf), np.nan)
            scale = np.cos(np.radians(lat.mean()))
            start = np.concatenate([np.argmin((la[k : k + 256, None] - lat.ravel()) ** 2 + ((lo[k : k + 256, None] - lon.ravel()) * scale) ** 2, 1) for k in range(0, len(pdf), 256)]) if len(pdf) else np.empty(0, int)
            u, v = (start // len(pixels)).astype(float), (start % len(pixels)).astype(float)
            for _ in range(30):  # Newton steps on the patch that the place is in
                i, j = (np.clip(np.floor(w), 0, n - 2).astype(int) for w, n in ((u, len(lines)), (v, len(pixels))))
                s, t = u - i, v - j
                value, du, dv = [], [], []
                for g in (lat, lon):
                    a, b, c, d = g[i, j], g[i, j + 1], g[i + 1, j], g[i + 1, j + 1]
                    value.append((1 - s) * ((1 - t) * a + t * b) + s * ((1 - t) * c + t * d))
                    du.append((1 - t) * (c - a) + t * (d - b))
                    dv.append((1 - s) * (b - a) + s * (d - c))
                e, f = la - value[0], lo - value[1]
                det = du[0] * dv[1] - du[1] * dv[0]
                with np.errstate(all="ignore"):
                    u = np.clip(u + np.nan_to_num((e * dv[1] - f * dv[0]) / det), -1, len(lines))
                    v = np.clip(v + np.nan_to_num((f * du[0] - e * du[1]) / det), -1, len(pixels))
            eps = 1e-6
            inside = (u >= -eps) & (u <= len(lines) - 1 + eps) & (v >= -eps) & (v <= len(pixels) - 1 + eps) & (np.abs(e) + np.abs(f) < 1e-6)
            # places as exact as the search: a border that is met counts as met
            line[inside], sample[inside] = (np.round(np.interp(w[inside], np.arange(len(n)), n), 6) for w, n in ((u, lines), (v, pixels)))
            yield pdf.assign(line=line, sample=sample)

    schema = ", ".join(f"{c} {t}" for c, t in grid.dtypes) + ", line double, sample double"
    placed = grid.mapInPandas(run, schema)
    return resample(placed.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("line", "sample")}), image)
