"""Range-Doppler geometry: where a ground point falls in a radar image, and what follows from it.

Orbits are state vectors of one product (checked to be few); positions between them are local
cubic fits. Solving for the zero-Doppler time is vectorised in Arrow batches; resampling is a
join of every output cell with the four image pixels around its place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The WGS 84 ellipsoid.
A, INVERSE_F = 6378137.0, 298.257223563
E2 = (2 - 1 / INVERSE_F) / INVERSE_F


@dataclass(frozen=True)
class Sensor:
    """Timing of an image: first line time, line interval, slant range of the first sample, range spacing."""

    first_time: float
    interval: float
    near_range: float
    spacing: float


def ecef(lat: np.ndarray, lon: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Earth-centred coordinates of latitude and longitude in degrees and height in metres."""
    la, lo = np.radians(lat), np.radians(lon)
    n = A / np.sqrt(1 - E2 * np.sin(la) ** 2)
    return np.stack([(n + h) * np.cos(la) * np.cos(lo), (n + h) * np.cos(la) * np.sin(lo), (n * (1 - E2) + h) * np.sin(la)], -1)


class Orbit:
    """Polynomial fit of state vectors (t, x, y, z)."""

    def __init__(self, vectors: np.ndarray, degree: int = 5):
        self.t0, self.scale = vectors[:, 0].mean(), max(np.ptp(vectors[:, 0]) / 2, 1e-9)
        self.lo, self.hi = vectors[0, 0], vectors[-1, 0]
        u = (vectors[:, 0] - self.t0) / self.scale
        self.c = np.polyfit(u, vectors[:, 1:], min(degree, len(vectors) - 1))

    def at(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        u = (t - self.t0) / self.scale
        p = np.stack([np.polyval(self.c[:, k], u) for k in range(3)], -1)
        v = np.stack([np.polyval(np.polyder(self.c[:, k]), u) / self.scale for k in range(3)], -1)
        return p, v

    def zero_doppler(self, ground: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(time, slant range) at which the point lies across the track; NaN where the orbit never passes it."""
        lo, hi = np.full(len(ground), self.lo), np.full(len(ground), self.hi)

        def along(t: np.ndarray) -> np.ndarray:
            p, v = self.at(t)
            return ((ground - p) * v).sum(-1)

        inside = (along(lo) >= 0) & (along(hi) <= 0)
        for _ in range(50):
            mid = (lo + hi) / 2
            ahead = along(mid) > 0
            lo, hi = np.where(ahead, mid, lo), np.where(ahead, hi, mid)
        t = np.where(inside, (lo + hi) / 2, np.nan)
        return t, np.where(inside, np.linalg.norm(ground - self.at((lo + hi) / 2)[0], axis=-1), np.nan)


def ground_of(orbit: Orbit, sensor: Sensor, line: np.ndarray, sample: np.ndarray, h: np.ndarray, side: str = "right") -> np.ndarray:
    """Earth-centred points at heights h above the ellipsoid that an image's lines and samples see: across the track, at the range, on the ellipsoid grown by h."""
    p, v = orbit.at(sensor.first_time + line * sensor.interval)
    r = sensor.near_range + sample * sensor.spacing
    up = p / np.linalg.norm(p, axis=-1, keepdims=True)
    across = np.cross(v, up) * (1 if side == "right" else -1)
    across /= np.linalg.norm(across, axis=-1, keepdims=True)
    altitude = np.linalg.norm(p, axis=-1) - A * 0.9983
    drop = np.minimum(altitude, r * 0.999)
    g = p - up * drop[:, None] + across * np.sqrt(np.maximum(r * r - drop * drop, 0))[:, None]
    a, b = A + h, A * (1 - 1 / INVERSE_F) + h
    axes = 1 / np.stack([a * a, a * a, b * b], -1)
    for _ in range(25):  # Newton steps on the three conditions
        d = g - p
        error = np.stack([(d * v).sum(-1), (d * d).sum(-1) - r * r, ((g * g * axes).sum(-1) - 1) * A * A], -1)
        slope = np.stack([v, 2 * d, 2 * g * axes * A * A], -2)
        g = g - np.linalg.solve(slope, error[..., None])[..., 0]
    return g


def orbit_of(vectors: DataFrame, most: int = 10_000) -> Orbit:
    rows = sorted(tuple(r) for r in vectors.select("t", "px", "py", "pz").limit(most + 1).collect())
    if len(rows) > most:
        raise ValueError(f"the orbit has more than {most} state vectors")
    return Orbit(np.array(rows, float))


def locate(cells: DataFrame, orbit: Orbit, sensor: Sensor) -> DataFrame:
    """Add line and sample (fractions; null outside the orbit), and the incidence angle in radians, to cells with lat, lon, h."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            ground = ecef(pdf.lat.to_numpy(float), pdf.lon.to_numpy(float), pdf.h.to_numpy(float))
            t, r = orbit.zero_doppler(ground)
            look = orbit.at(np.nan_to_num(t, nan=orbit.t0))[0] - ground
            cos = (look * ground).sum(-1) / (np.linalg.norm(look, axis=-1) * np.linalg.norm(ground, axis=-1))
            yield pdf.assign(line=(t - sensor.first_time) / sensor.interval, sample=(r - sensor.near_range) / sensor.spacing, incidence=np.arccos(np.clip(cos, -1, 1)))

    schema = ", ".join(f"{c} {t}" for c, t in cells.dtypes) + ", line double, sample double, incidence double"
    out = cells.mapInPandas(run, schema)
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("line", "sample")})


def resample(places: DataFrame, image: DataFrame, band: str = "v", method: str = "bilinear") -> DataFrame:
    """Value of the image (y, x, band) at line and sample of each place (keyed by its own y, x); outside it null.

    method: nearest, bilinear, or cubic (sixteen pixels, parameter -0.5).
    """
    ly, lx = F.floor("line"), F.floor("sample")
    ty, tx = F.col("line") - ly, F.col("sample") - lx
    if method == "nearest":
        taps = [((F.floor(F.col("line") + 0.5)), F.floor(F.col("sample") + 0.5), F.lit(1.0))]
    elif method == "cubic":
        near, far = (lambda s: (1.5 * s - 2.5) * s * s + 1), (lambda s: ((-0.5 * s + 2.5) * s - 4) * s + 2)
        along = lambda t: [far(1 + t), near(t), near(1 - t), far(2 - t)]
        taps = [(ly + i - 1, lx + j - 1, a * b) for i, a in enumerate(along(ty)) for j, b in enumerate(along(tx))]
    else:
        taps = [(ly + i, lx + j, (ty if i else 1 - ty) * (tx if j else 1 - tx)) for i in (0, 1) for j in (0, 1)]
    tap = F.explode(F.array(*[F.struct(a.cast("long").alias("sy"), b.cast("long").alias("sx"), w.alias("w")) for a, b, w in taps]))
    wanted = places.where("line is not null").select("y", "x", tap.alias("t")).select("y", "x", "t.*").where("w <> 0")
    source = image.select(F.col("y").alias("sy"), F.col("x").alias("sx"), F.col(band).alias("_v"))
    met = wanted.join(source, ["sy", "sx"], "left").groupBy("y", "x").agg(F.sum(F.col("_v") * F.col("w")).alias("_s"), F.max(F.col("_v").isNull()).alias("_m"))
    return places.join(met, ["y", "x"], "left").select(*places.columns, F.when(~F.col("_m"), F.col("_s")).alias(band))


def terrain_correction(grid: DataFrame, image: DataFrame, vectors: DataFrame, sensor: Sensor, method: str = "bilinear") -> DataFrame:
    """Image on a map grid (y, x, lat, lon, h)."""
    return resample(locate(grid, orbit_of(vectors), sensor), image, method=method)


def ellipsoid_correction(grid: DataFrame, image: DataFrame, vectors: DataFrame, sensor: Sensor, height: float = 0.0) -> DataFrame:
    """Terrain correction with one height for the scene."""
    return terrain_correction(grid.withColumn("h", F.lit(float(height))), image, vectors, sensor)


def coregister(grid: DataFrame, secondary: DataFrame, reference_orbit: DataFrame, secondary_orbit: DataFrame, ref: Sensor, sec: Sensor) -> DataFrame:
    """Secondary image on the reference's pixels by way of the terrain.

    Each terrain cell is located in both images; a reference pixel takes the mean offset of its cells.
    """
    a = locate(grid, orbit_of(reference_orbit), ref).select("y", "x", F.floor(F.col("line") + 0.5).cast("long").alias("ry"), F.floor(F.col("sample") + 0.5).cast("long").alias("rx"), F.col("line").alias("la"), F.col("sample").alias("sa"))
    b = locate(grid, orbit_of(secondary_orbit), sec).select("y", "x", F.col("line").alias("lb"), F.col("sample").alias("sb"))
    offsets = a.join(b, ["y", "x"]).where("la is not null and lb is not null").groupBy(F.col("ry").alias("y"), F.col("rx").alias("x")).agg(F.avg(F.col("lb") - F.col("la")).alias("dy"), F.avg(F.col("sb") - F.col("sa")).alias("dx"))
    return resample(offsets.withColumns({"line": F.col("y") + F.col("dy"), "sample": F.col("x") + F.col("dx")}), secondary)


def illuminated_area(grid: DataFrame, vectors: DataFrame, sensor: Sensor, cell_area: float) -> DataFrame:
    """Terrain area seen by each image pixel (y, x, area): cells' areas over tan of incidence, scattered to four pixels."""
    placed = locate(grid, orbit_of(vectors), sensor).where("line is not null")
    ly, lx = F.floor("line"), F.floor("sample")
    ty, tx = F.col("line") - ly, F.col("sample") - lx
    tap = F.explode(F.array(*[F.struct((ly + i).cast("long").alias("y"), (lx + j).cast("long").alias("x"), ((ty if i else 1 - ty) * (tx if j else 1 - tx)).alias("w")) for i in (0, 1) for j in (0, 1)]))
    return placed.select("incidence", tap.alias("t")).groupBy("t.y", "t.x").agg(F.sum(F.col("t.w") * cell_area / F.tan("incidence")).alias("area"))


def simulate(grid: DataFrame, vectors: DataFrame, sensor: Sensor, cell_area: float) -> DataFrame:
    """Simulated image: illuminated area of each pixel."""
    return illuminated_area(grid, vectors, sensor, cell_area).select("y", "x", F.col("area").alias("v"))


def terrain_flattening(image: DataFrame, grid: DataFrame, vectors: DataFrame, sensor: Sensor, cell_area: float, beta_area: float, threshold: float = 0.05) -> DataFrame:
    """Backscatter per illuminated area; no data where the area is below the threshold."""
    a = illuminated_area(grid, vectors, sensor, cell_area)
    out = image.join(a, ["y", "x"], "left")
    return out.select("y", "x", F.when(F.col("area") > threshold * beta_area, F.col("v") / (F.col("area") / beta_area)).alias("v"))


def geo_reference(grid: DataFrame, vectors: DataFrame, sensor: Sensor) -> DataFrame:
    """Latitude and longitude of image pixels: the mean of the terrain cells that fall on them."""
    placed = locate(grid, orbit_of(vectors), sensor).where("line is not null")
    return placed.groupBy(F.floor(F.col("line") + 0.5).cast("long").alias("y"), F.floor(F.col("sample") + 0.5).cast("long").alias("x")).agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))


def deskew(image: DataFrame, shift: tuple[float, ...]) -> DataFrame:
    """Move each sample along track by a polynomial of its range index, to the nearest line."""
    s = sum((F.lit(float(c)) * F.pow(F.col("x").cast("double"), F.lit(float(k))) for k, c in enumerate(shift)), F.lit(0.0))
    return image.select((F.col("y") + F.floor(s + 0.5).cast("long")).alias("y"), "x", "v")


def deburst_scan(lines: DataFrame, times: DataFrame, tolerance: float, peak: bool = False) -> DataFrame:
    """Wide-swath lines whose times agree within the tolerance are merged, by mean or peak intensity.

    lines: line, x, v; times: line, t. Times are numbered by whole tolerances, so that lines meet in an equality join.
    """
    key = F.floor(F.col("t") / tolerance + 0.5).cast("long")
    met = lines.join(times, "line").where("v <> 0").groupBy(key.alias("y"), "x")
    return met.agg((F.max("v") if peak else F.avg("v")).alias("v"))
