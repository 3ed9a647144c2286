"""Soil moisture from the real dielectric constant: a quadratic model of sand and clay, and a refractive mixing model of clay and temperature."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .calibration import soil_moisture

# Hallikainen's coefficients (constant, sand, clay) of moisture to the powers 0, 1 and 2.
HALLIKAINEN = (1.993, 0.002, 0.015, 38.086, -0.176, -0.633, 10.720, 1.256, 1.522)

# Mironov's polynomials of the clay share, by rising power: dry soil, largest bound water, and of bound and free water
# the permittivity at the reference temperature, its expansion, the conductivity and its slope, enthalpy and entropy of relaxation.
MIRONOV = {
    "dry_index": (1.62847, -0.70803, 0.4659), "dry_loss": (0.03945, -0.03721), "bound_limit": (0.00625, 0.33918),
    "bound_permittivity": (79.82918, -85.36581, 32.70444), "bound_expansion": (-5.96311e-19, -1.25999e-3, 1.83991e-3, -9.77347e-4, -1.39013e-7), "bound_conductivity": (0.29721, 0.49), "bound_slope": (0.0028, 2.37388e-2, -2.93876e-2, 3.28954e-2, -2.00582e-2), "bound_enthalpy": (1466.80741, 26.97032e2, -0.09803e4), "bound_entropy": (0.88775, 0.09697e2, -4.2622),
    "free_permittivity": (100.0,), "free_expansion": (1.10511e-4, -5.16834e-6), "free_conductivity": (0.12799, 1.65164), "free_slope": (0.00277, 3.58315e-2), "free_enthalpy": (2230.20237, -0.39234e2), "free_entropy": (3.6439, -0.00134e2),
}
VACUUM, OPTICAL, RELAXATION, REFERENCE_CELSIUS, KELVIN = 8.854e-12, 4.9, 48e-12, 20.0, 273.15
#: Below this moisture the constant is continued as a parabola about 0, so that it has one slope.
SYMMETRIC_BELOW = 0.02


def mironov(moisture: np.ndarray, clay: np.ndarray, celsius: float, frequency: float) -> np.ndarray:
    """Real dielectric constant of moist soil; clay in per cent, frequency in Hz."""
    c = clay / 100
    of = lambda name: np.polynomial.polynomial.polyval(c, MIRONOV[name])
    kelvin, warmer = celsius + KELVIN, celsius - REFERENCE_CELSIUS

    def water(kind: str) -> tuple[np.ndarray, np.ndarray]:
        """Refractive index and loss of bound or free water: a relaxation with conductivity, all by temperature."""
        e0 = of(f"{kind}_permittivity")
        f = np.log((e0 - 1) / (e0 + 2)) - of(f"{kind}_expansion") * warmer
        static = (1 + 2 * np.exp(f)) / (1 - np.exp(f))
        turn = 2 * np.pi * frequency * RELAXATION * np.exp(of(f"{kind}_enthalpy") / kelvin - of(f"{kind}_entropy")) / kelvin
        step = (static - OPTICAL) / (1 + turn * turn)
        lost = step * turn + (of(f"{kind}_conductivity") + of(f"{kind}_slope") * warmer) / (2 * np.pi * VACUUM * frequency)
        root = np.sqrt((OPTICAL + step) + 1j * lost)
        return root.real, root.imag

    (nb, kb), (nu, ku), limit = water("bound"), water("free"), of("bound_limit")
    nd, kd = of("dry_index"), of("dry_loss")

    def mixed(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bound, free = np.minimum(m, limit), np.maximum(m - limit, 0)
        return nd + (nb - 1) * bound + (nu - 1) * free, kd + kb * bound + ku * free

    m = np.abs(moisture)
    n, k = mixed(m)
    out = n * n - k * k
    # the parabola that has the model's value and slope at the border of the symmetric part
    n, k = nd + SYMMETRIC_BELOW * (nb - 1), kd + SYMMETRIC_BELOW * kb
    slope = 2 * (n * (nb - 1) - k * kb)
    return np.where(m <= SYMMETRIC_BELOW, n * n - k * k + slope / (2 * SYMMETRIC_BELOW) * (m * m - SYMMETRIC_BELOW**2), out)


def hallikainen_moisture(df: DataFrame, low: float = 0.0, high: float = 0.55) -> DataFrame:
    """Moisture and quality of pixels with rdc, sand and clay (per cent)."""
    return soil_moisture(df, HALLIKAINEN, low, high)


def mironov_moisture(df: DataFrame, frequency: float, celsius: float = 18.0, low: float = 0.0, high: float = 0.55) -> DataFrame:
    """Moisture within [low, high] whose constant is the pixel's (rdc), by clay (per cent), at one temperature and frequency.

    The constant rises with moisture, so bisection finds it. quality: 0 found, 1 no constant, 2 no soil,
    3 nothing in the range.
    """

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rdc, clay = pdf.rdc.to_numpy(float), pdf.clay.to_numpy(float)
            soil = np.where(np.isnan(clay), 0.0, clay)
            a, b = np.full(len(pdf), low), np.full(len(pdf), high)
            inside = (mironov(a, soil, celsius, frequency) <= rdc) & (rdc <= mironov(b, soil, celsius, frequency))
            for _ in range(45):
                middle = (a + b) / 2
                less = mironov(middle, soil, celsius, frequency) < rdc
                a, b = np.where(less, middle, a), np.where(less, b, middle)
            quality = np.where(np.isnan(rdc), 1, np.where(np.isnan(clay) | (clay < 0), 2, np.where(inside, 0, 3)))
            yield pd.DataFrame({"y": pdf.y, "x": pdf.x, "moisture": np.where(quality == 0, (a + b) / 2, np.nan), "quality": quality})

    out = df.select("y", "x", F.col("rdc").cast("double").alias("rdc"), F.col("clay").cast("double").alias("clay")).mapInPandas(run, "y long, x long, moisture double, quality int")
    return out.select("y", "x", F.when(F.col("quality") == 0, F.col("moisture")).alias("moisture"), "quality")
