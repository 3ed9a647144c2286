"""Calibration by mission: power of the samples to sigma nought, and to beta or gamma nought by the incidence angle.

Every rule takes pixels (y, x, dn2: squared amplitude or intensity, theta: incidence in radians) with what
the mission's product gives beside them, and gives the power sigma nought; complex products keep their phase.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .polarimetry import over

#: Below this a power has no decibels.
FLOOR = 1e-30


def power(unit: str) -> Column:
    """Squared amplitude of the columns i and q, or v as amplitude, intensity or dB."""
    return {"complex": lambda: F.col("i") ** 2 + F.col("q") ** 2, "amplitude": lambda: F.col("v") ** 2, "intensity": lambda: F.col("v"), "decibel": lambda: F.pow(F.lit(10.0), F.col("v") / 10)}[unit]()


def constant_noise(dn2: Column, m: dict) -> Column:
    """X-band products with a constant for each channel and a noise power: constant times what exceeds it, by the sine of the angle."""
    return m["constant"] * F.abs(dn2 - (F.col("noise") if m.get("noise") else F.lit(0.0))) * F.sin("theta")


def gain_table(dn2: Column, m: dict) -> Column:
    """C-band products with range gains: complex samples over the gain squared; detected ones plus the offset over the gain."""
    if m["unit"] == "complex":
        return over(dn2, F.col("gain") * F.col("gain"))
    return F.coalesce(over(dn2 + m.get("offset", 0.0), F.col("gain")), dn2 + m.get("offset", 0.0))


def rescaled_cells(dn2: Column, m: dict) -> Column:
    """X-band products with a rescaling factor and a cell size, by the sine of the angle unless it is in the constant."""
    base = dn2 * m["rescale"] ** 2 * m["constant"] / m.get("cell", 1.0)
    return base if m.get("angle_included") else base * F.sin("theta")


def table_power(dn2: Column, m: dict) -> Column:
    """L- and P-band products with a table of factors (column lut), over that of an earlier calibration (column retro) where there is one."""
    out = dn2 * F.col("lut")
    return F.coalesce(over(out, F.col("retro")), out) if m.get("retro") else out


def table_squared(dn2: Column, m: dict) -> Column:
    """C-band products with a table of amplitudes (column lut), times the square of that of an earlier calibration (column retro)."""
    out = over(dn2, F.col("lut") * F.col("lut"))
    return out * F.col("retro") * F.col("retro") if m.get("retro") else out


def reference_sine(dn2: Column, m: dict) -> Column:
    """First-generation C-band products: over the constant at a reference angle, by the sine of the angle, with range spreading and antenna pattern undone where they were left in."""
    out = dn2 * F.sin("theta") / (m["constant"] * F.sin(F.lit(float(m["reference"]))))
    if "reference_range" in m:
        out = out * F.pow(F.col("range") / m["reference_range"], F.lit(float(m.get("exponent", 3.0))))
    if m.get("gain"):
        out = over(out, F.col("gain") * F.col("gain"))
    return out


def constant_sine(dn2: Column, m: dict) -> Column:
    """Second-generation C-band products: by the sine of the angle over the constant; geocoded ones hold the sine already."""
    out = dn2 / m["constant"]
    out = out if m.get("angle_included") else out * F.sin("theta")
    if m.get("retro"):
        out = over(out * F.col("old_gain") * F.col("old_gain"), F.col("new_gain") * F.col("new_gain"))
    return out


RULES: dict[str, Callable[[Column, dict], Column]] = {
    "terrasarx": constant_noise, "paz": constant_noise, "radarsat2": gain_table, "rcm": gain_table, "kompsat5": rescaled_cells,
    "nisar": table_power, "biomass": table_power, "spacety": table_squared, "sentinel1": table_squared, "ers": reference_sine, "asar": constant_sine,
}


def calibrate(df: DataFrame, mission: str, unit: str = "complex", output: str = "sigma", decibel: bool = False, keep_phase: bool = False, **meta: float | bool) -> DataFrame:
    """(y, x, sigma | beta | gamma) of a mission's pixels, or i and q with the calibrated amplitude.

    beta is sigma over the sine of the angle, gamma over its cosine. A power of 0 has the decibels of FLOOR;
    where the product gives no gain or table value the result is null, as is a null sample's.
    """
    dn2 = power(unit)
    out = RULES[mission](dn2, {"unit": unit, **meta})
    out = {"sigma": lambda: out, "beta": lambda: over(out, F.sin("theta")), "gamma": lambda: over(out, F.cos("theta"))}[output]()
    if keep_phase:
        scale = F.when(dn2 > 0, F.sqrt(F.greatest(out, F.lit(0.0)) / F.when(dn2 > 0, dn2))).otherwise(0.0)
        return df.select("y", "x", (F.col("i") * scale).alias("i"), (F.col("q") * scale).alias("q"))
    return df.select("y", "x", (10 * F.log10(F.greatest(out, F.lit(FLOOR))) if decibel else out).alias(output))


def window_mean_adc(df: DataFrame, correction: DataFrame, size: int, constant: float) -> DataFrame:
    """First-generation products saturate their converters: power times the loss at the mean power of a block (correction: level in dB, loss).

    Blocks of size x size pixels; between the table's levels the loss is interpolated, beyond them the end holds.
    """
    from .calibration import asof

    block = [F.floor(F.col("y") / size).alias("by"), F.floor(F.col("x") / size).alias("bx")]
    level = df.select("y", "x", "dn2", *block)
    mean = level.groupBy("by", "bx").agg((10 * F.log10(F.greatest(F.avg("dn2") / constant, F.lit(FLOOR)))).alias("level"))
    loss = asof(mean, correction.select(F.col("level").alias("at"), "loss"), "level", "at", "loss")
    return level.join(loss.select("by", "bx", "loss"), ["by", "bx"]).select("y", "x", (F.col("dn2") * F.coalesce("loss", F.lit(1.0))).alias("dn2"))
