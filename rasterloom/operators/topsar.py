"""Burst-mode products: split, deburst, merge, deramp, shifts between bursts, and orbits."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cx import Cx, atan2


def split(df: DataFrame, swath: str, first: int, last: int) -> DataFrame:
    """Bursts first to last of a sub-swath."""
    return df.where((F.col("swath") == swath) & F.col("burst").between(first, last))


def deburst(df: DataFrame, bursts: DataFrame, interval: float) -> DataFrame:
    """One line per output time: of two bursts that hold it, the later one after the middle of their overlap.

    df: burst, line, x, v; bursts: burst, first, last (line times), a row per burst.
    """
    w = Window.orderBy("burst")  # a row per burst, a few dozen in a scene
    table = bursts.withColumns({"_prev": F.lag("last").over(w), "_next": F.lead("first").over(w)})
    table = table.withColumns({"_from": F.coalesce((F.col("_prev") + F.col("first")) / 2, F.lit(-1e300)), "_to": F.coalesce((F.col("last") + F.col("_next")) / 2, F.lit(1e300))})
    start = bursts.agg(F.min("first").alias("_t0"))
    t = F.col("first") + F.col("line") * interval
    met = df.join(F.broadcast(table), "burst").join(F.broadcast(start)).withColumn("_t", t)
    kept = met.where((F.col("_t") > F.col("_from")) & (F.col("_t") <= F.col("_to")) & (F.col("_t") < F.col("last")))
    y = F.floor((F.col("_t") - F.col("_t0")) / interval + 0.5).alias("y")
    return kept.groupBy(y, "x").agg(F.max_by("v", "burst").alias("v"))


def merge(swaths: DataFrame, limits: DataFrame) -> DataFrame:
    """Sub-swaths side by side: each sample from the sub-swath that its column belongs to.

    swaths: swath, y, x, v (columns of the merged grid); limits: swath, first, last, a row per sub-swath.
    """
    met = swaths.join(F.broadcast(limits), "swath").where(F.col("x").between(F.col("first"), F.col("last")))
    w = Window.partitionBy("y", "x").orderBy("swath")
    return met.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("y", "x", "v")


def deramp(df: DataFrame, rate: float, doppler: float, centre: float, interval: float, inverse: bool = False) -> DataFrame:
    """Turn by the quadratic deramp and linear demodulation phases of a burst about its centre time."""
    t = F.col("y") * interval - centre
    phase = t * t * (-math.pi * rate) + t * (-2 * math.pi * doppler)
    z = Cx.of("i", "q") * (Cx.turn(phase).conj() if inverse else Cx.turn(phase))
    return df.select("y", "x", z.re.alias("i"), z.im.alias("q"))


def double_difference(overlap: DataFrame) -> DataFrame:
    """Phase between the interferograms of two bursts over their overlap (i1, q1, i2, q2)."""
    z = Cx.of("i2", "q2") * Cx.of("i1", "q1").conj()
    return overlap.select("y", "x", z.arg().alias("phase"))


def spectral_diversity(blocks: DataFrame, separation: float, azimuth_interval: float) -> DataFrame:
    """Azimuth shift of every overlap: coherence-weighted double-difference phase over the Doppler separation.

    blocks: overlap, i, q (double difference), coherence.
    """
    w = F.col("coherence")
    phase = atan2(F.sum(F.col("q") * w), F.sum(F.col("i") * w))
    return blocks.groupBy("overlap").agg((phase / (2 * math.pi * separation * azimuth_interval)).alias("shift"), F.avg("coherence").alias("coherence"))


def periodogram_shift(blocks: DataFrame, separation: float, azimuth_interval: float, most: float = 0.05, steps: int = 201) -> DataFrame:
    """As spectral_diversity, by the candidate shift that agrees best with all samples.

    The samples of an overlap are first summed, since the best candidate depends on their weighted sum alone.
    """
    s = blocks.groupBy("overlap").agg(F.sum(F.col("i") * F.col("coherence")).alias("re"), F.sum(F.col("q") * F.col("coherence")).alias("im"))
    grid = F.sequence(F.lit(0), F.lit(steps - 1))
    score = lambda k: -most + k * (2 * most / (steps - 1))
    angle = lambda k: score(k) * (2 * math.pi * separation * azimuth_interval)
    best = F.array_max(F.transform(grid, lambda k: F.struct((F.col("re") * F.cos(angle(k)) + F.col("im") * F.sin(angle(k))).alias("s"), score(k).alias("shift"))))
    return s.select("overlap", best["shift"].alias("shift"))


def integrate_arcs(arcs: Sequence[tuple[int, int, float, float]], n: int, norm: str = "L2") -> np.ndarray:
    """Shift of each image from the shifts of pairs (from, to, shift, weight); image 0 is 0. L1 by reweighting."""
    a, b, w = np.zeros((len(arcs), n)), np.array([x[2] for x in arcs]), np.array([x[3] for x in arcs])
    for k, (i, j, _, _) in enumerate(arcs):
        a[k, j], a[k, i] = 1, -1
    seen, front = {0}, [0]
    while front:
        at = front.pop()
        for i, j, _, _ in arcs:
            for p, q in ((i, j), (j, i)):
                if p == at and q not in seen:
                    seen.add(q)
                    front.append(q)
    if len(seen) < n:
        raise ValueError("the network of pairs is not connected")
    a, x = a[:, 1:], np.zeros(n - 1)
    for _ in range(1 if norm == "L2" else 50):
        v = w if norm == "L2" else w / np.maximum(np.abs(a @ x - b), 1e-6)
        x = np.linalg.solve((a.T * v) @ a + 1e-15 * np.eye(n - 1), (a.T * v) @ b)
    return np.concatenate([[0.0], x])


def lagrange_orbit(points: DataFrame, vectors: DataFrame, order: int = 8, most: int = 10_000) -> DataFrame:
    """Position at each point's time t by Lagrange interpolation of the nearest state vectors.

    vectors: t, px, py, pz: the orbit file of one product, whose bounded size is checked.
    """
    rows = sorted(tuple(r) for r in vectors.select("t", "px", "py", "pz").limit(most + 1).collect())
    if len(rows) > most:
        raise ValueError(f"the orbit has more than {most} state vectors")
    table = np.array(rows, float)

    def run(it):
        for pdf in it:
            t = pdf.t.to_numpy(float)
            n = min(order, len(table))
            first = np.clip(np.searchsorted(table[:, 0], t) - n // 2, 0, len(table) - n)
            pick = first[:, None] + np.arange(n)
            k, out = table[pick, 0], np.zeros((len(t), 3))
            for i in range(n):
                w = np.ones(len(t))
                for j in range(n):
                    if i != j:
                        w *= (t - k[:, j]) / (k[:, i] - k[:, j])
                out += w[:, None] * table[pick[:, i], 1:]
            yield pd.DataFrame({"t": t, "px": out[:, 0], "py": out[:, 1], "pz": out[:, 2]})

    return points.select(F.col("t").cast("double").alias("t")).mapInPandas(run, "t double, px double, py double, pz double")


def etad_deburst(layers: DataFrame) -> DataFrame:
    """Layers of all bursts on one grid; where bursts overlap the later sub-swath and burst holds."""
    w = Window.partitionBy("y", "x").orderBy(F.col("swath").desc(), F.col("burst").desc())
    return layers.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def antenna_phase(df: DataFrame, table: DataFrame, interval: float, rate: float) -> DataFrame:
    """Turn each sample by the antenna pattern's phase at its elevation angle, the roll changing along the burst.

    df: y, x, i, q, elevation; table: angle (whole hundredths of a degree), phase.
    """
    key = F.floor((F.col("elevation") + F.col("y") * interval * rate) * 100 + 0.5).cast("long")
    met = df.withColumn("angle", key).join(table, "angle", "left")
    z = Cx.of("i", "q") * Cx.turn(-F.coalesce("phase", F.lit(0.0)))
    return met.select("y", "x", z.re.alias("i"), z.im.alias("q"))


def timing_correction(df: DataFrame, layers: DataFrame, azimuth_interval: float, range_interval: float) -> DataFrame:
    """Move samples by azimuth and range timing layers (y, x, azimuth, range in seconds), to the nearest pixel."""
    met = df.join(layers, ["y", "x"])
    sy = (F.col("y") + F.floor(F.col("azimuth") / azimuth_interval + 0.5)).cast("long")
    sx = (F.col("x") + F.floor(F.col("range") / range_interval + 0.5)).cast("long")
    places = met.select("y", "x", sy.alias("sy"), sx.alias("sx"))
    return places.join(df.select(F.col("y").alias("sy"), F.col("x").alias("sx"), "v"), ["sy", "sx"]).select("y", "x", "v")
