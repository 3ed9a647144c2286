"""More models of polarimetric data: Kennaugh matrices, dual-pol and compact models, eigenvector angles."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cx import Cx, atan2
from .polarimetry import EPS, _eigen, db, elements, over, stokes

# Kennaugh matrices of the trihedral, cylinder, narrow dihedral and dihedral, as diagonals and the (1, 2) element.
TARGETS = {"trihedral": (1, 1, 1, -1, 0), "cylinder": (0.625, 0.625, 0.5, -0.5, 0.375), "narrow dihedral": (0.625, 0.625, -0.5, 0.5, 0.375), "dihedral": (1, 1, -1, 1, 0)}


def eigen_angles(t3: DataFrame) -> DataFrame:
    """Entropy, anisotropy, and of the eigenvectors alpha, beta, delta, gamma (degrees) and lambda: probability means, and each alpha and lambda."""

    def run(it):
        for pdf in it:
            values, v = _eigen(pdf, 3, "t")
            p = np.clip(values / np.maximum(values.sum(1, keepdims=True), EPS), 0, 1)
            angle = lambda z: np.arctan2(z.imag, z.real + EPS)
            wrap = lambda a: np.degrees(np.arctan2(np.sin(a), np.cos(a) + EPS))
            alpha = np.degrees(np.arccos(np.clip(np.abs(v[:, 0]), 0, 1)))
            beta = np.degrees(np.arctan2(np.abs(v[:, 2]), np.abs(v[:, 1]) + EPS))
            delta, gamma = (wrap(angle(v[:, k]) - angle(v[:, 0])) for k in (1, 2))
            mean = lambda z: (p * z).sum(1)
            yield pd.DataFrame({
                "y": pdf.y, "x": pdf.x, "entropy": -(p * np.log(p + EPS)).sum(1) / np.log(3), "anisotropy": (p[:, 1] - p[:, 2]) / (p[:, 1] + p[:, 2] + EPS),
                "alpha": mean(alpha), "beta": mean(beta), "delta": mean(delta), "gamma": mean(gamma), "lambda": mean(values),
                **{f"alpha{k + 1}": alpha[:, k] for k in range(3)}, **{f"lambda{k + 1}": values[:, k] for k in range(3)},
            })

    names = ("entropy", "anisotropy", "alpha", "beta", "delta", "gamma", "lambda", "alpha1", "alpha2", "alpha3", "lambda1", "lambda2", "lambda3")
    return t3.select("y", "x", *elements(3, "t")).mapInPandas(run, "y long, x long, " + ", ".join(f"{k} double" for k in names))


def model_based(c2: DataFrame, sign: int = 1) -> DataFrame:
    """Dual-pol surface and volume power (dB), their ratio, alpha and delta (degrees), rho and span.

    The volume is the root of 0.75 m² + b m + c that lies between 0 and the span, else 0.
    """
    s0, s1, s2, s3 = F.col("c11") + F.col("c22"), F.col("c11") - F.col("c22"), 2 * F.col("c12_re"), 2 * F.col("c12_im")
    b, c = sign * s1 - 2 * s0, s0 * s0 - s1 * s1 - s2 * s2 - s3 * s3
    root = F.when(b * b >= 3 * c, F.sqrt(F.greatest(b * b - 3 * c, F.lit(0.0))))
    large, small = (root - b) / 1.5, (-b - root) / 1.5
    mv = F.when(large.between(0, s0), large).when(small.between(0, s0), small).otherwise(0.0)
    out = c2.select("*", s0.alias("_s0"), s1.alias("_s1"), s2.alias("_s2"), s3.alias("_s3"), mv.alias("_mv"))
    mv, ms = F.col("_mv"), F.col("_s0") - F.col("_mv")
    cosine = over(sign * F.col("_s1") - 0.5 * mv, ms)
    decibel = lambda p: F.when(p > 0, 10 * F.log10(F.when(p > 0, p)))
    alpha = F.when(F.abs(cosine) <= 1, F.degrees(0.5 * F.acos(cosine)))
    rho = over(F.hypot("c12_re", "c12_im"), F.sqrt(F.col("c11") * F.col("c22")))
    return out.select("y", "x", decibel(ms).alias("surface"), decibel(mv).alias("volume"), (decibel(ms) - decibel(mv)).alias("ratio"), alpha.alias("alpha"), F.degrees(atan2(F.col("_s3"), F.col("_s2"))).alias("delta"), rho.alias("rho"), F.col("_s0").alias("span"))


def random_volume(c2: DataFrame, hand: str = "right") -> DataFrame:
    """Random volume over ground of compact data: alpha, mv, ms, phi, and the powers double, volume, surface."""
    s = stokes(c2, hand)
    g1, g2, g3, g0, m = (F.col(k) for k in ("g1", "g2", "g3", "g0", "m"))
    sign = 1 if hand == "right" else -1
    alpha = 0.5 * atan2(F.hypot(g1, g2), g3)
    s = s.select("*", alpha.alias("_alpha"))
    cosine = F.cos(2 * F.col("_alpha"))
    return s.select("y", "x", F.col("_alpha").alias("alpha"), (0.5 * g0 * (1 - m)).alias("mv"), (2 * g0 * m).alias("ms"), atan2(sign * g2, g1).alias("phi"), (m * g0 * (1 - cosine) / 2).alias("double"), ((1 - m) * g0).alias("volume"), (m * g0 * (1 + cosine) / 2).alias("surface"))


def distortion(covariance: np.ndarray, rounds: int = 4) -> np.ndarray:
    """The 4 x 4 distortion of (HH, HV, VH, VV) that leaves a scene's covariance without imbalance and crosstalk.

    In every round the imbalance comes from the co-polarised powers and half the phase between them, the
    crosstalk from the correlations of co- with cross-polarised channels, both to first order; rounds are
    composed, so that the whole imbalance is in the result. One round is the non-iterative form.
    """
    whole, c = np.eye(4, dtype=complex), covariance.astype(complex)
    for _ in range(rounds):
        p, q = c[0, 0].real, c[3, 3].real
        if p <= 0 or q <= 0:
            break
        f = np.sqrt(q / p) * np.exp(-0.5j * np.angle(c[0, 3]))
        step = np.kron([[1, 0], [0, np.sqrt(f)]], [[1, 0], [0, np.sqrt(f)]])
        # what leaks from a co-polarised channel into a cross-polarised one stands in their correlation
        flat = np.linalg.inv(step) @ c @ np.linalg.inv(step).conj().T
        d1, d2, d3, d4 = flat[1, 0] / flat[0, 0].real, flat[2, 0] / flat[0, 0].real, flat[1, 3] / flat[3, 3].real, flat[2, 3] / flat[3, 3].real
        leak = np.eye(4, dtype=complex)
        leak[1, 0], leak[2, 0], leak[1, 3], leak[2, 3] = d1, d2, d3, d4
        leak[0, 1], leak[0, 2], leak[3, 1], leak[3, 2] = d3, d4, d1, d2
        step = step @ leak
        whole = whole @ step
        inverse = np.linalg.inv(step)
        c = inverse @ c @ inverse.conj().T
    return whole


def polarimetric_calibration(df: DataFrame, stride: int = 10, rounds: int = 4) -> DataFrame:
    """Scattering matrices (y, x, hh_i .. vv_q) without channel imbalance and crosstalk, which the scene's own covariance tells.

    The covariance is one aggregate over every stride-th line and sample; pixels are one column expression.
    """
    pols = ("hh", "hv", "vh", "vv")
    z = [Cx.of(f"{p}_i", f"{p}_q") for p in pols]
    sums = []
    for i in range(4):
        for j in range(i, 4):
            w = z[i] * z[j].conj()
            sums += [F.avg(w.re).alias(f"r{i}{j}"), F.avg(w.im).alias(f"m{i}{j}")]
    row = df.where((F.col("y") % stride == 0) & (F.col("x") % stride == 0)).agg(*sums).first()
    c = np.zeros((4, 4), complex)
    for i in range(4):
        for j in range(i, 4):
            c[i, j] = (row[f"r{i}{j}"] or 0.0) + 1j * (row[f"m{i}{j}"] or 0.0)
            c[j, i] = c[i, j].conj()
    inverse = np.linalg.inv(distortion(c, rounds))
    out = []
    for i, p in enumerate(pols):
        re = sum((z[j].re * float(inverse[i, j].real) - z[j].im * float(inverse[i, j].imag) for j in range(4)), F.lit(0.0))
        im = sum((z[j].re * float(inverse[i, j].imag) + z[j].im * float(inverse[i, j].real) for j in range(4)), F.lit(0.0))
        out += [re.alias(f"{p}_i"), im.alias(f"{p}_q")]
    return df.select("y", "x", *out)


def _norm(k: dict[str, Column]) -> Column:
    """Frobenius norm of a symmetric matrix of named elements."""
    return F.sqrt(sum(((1 if a[0] == a[1] else 2) * v * v for a, v in k.items()), F.lit(0.0)))


def generalized_vegetation(t3: DataFrame) -> DataFrame:
    """Generalised radar vegetation index: geodesic distances of the Kennaugh matrix to a generalised volume and to four canonical targets.

    The (2, 4) element is the mean of Im T13 and Im T23, as the index is commonly computed.
    """
    t = {k: F.col(f"t{k}") for k in ("11", "22", "33", "12_re", "12_im", "13_re", "13_im", "23_re", "23_im")}
    k = {"11": (t["11"] + t["22"] + t["33"]) / 2, "22": (t["11"] + t["22"] - t["33"]) / 2, "33": (t["11"] - t["22"] + t["33"]) / 2, "44": (t["22"] + t["33"] - t["11"]) / 2,
         "12": t["12_re"], "13": t["13_re"], "14": t["23_im"], "23": t["23_re"], "24": (t["13_im"] + t["23_im"]) / 2, "34": -t["12_im"]}
    base = t3.select("y", "x", *[v.alias(f"k{a}") for a, v in k.items()], ((t["11"] + t["22"]) / 2 + t["12_re"]).alias("_c11"), ((t["11"] + t["22"]) / 2 - t["12_re"]).alias("_c33"))
    own = {a: F.col(f"k{a}") for a in k}
    gamma = over(F.col("_c11"), F.col("_c33"))
    root = F.sqrt(F.greatest(gamma, F.lit(0.0)))
    scale = over(F.lit(1.0), 1.5 * (1 + gamma) - 0.5 * root)
    v11, v22, v12 = scale * (0.5 * (1 + gamma) + root / 3), scale * (0.5 * (1 + gamma) - root / 3), scale * 0.5 * (gamma - 1)
    volume = {"11": (v11 + 2 * v22) / 2, "22": v11 / 2, "33": v11 / 2, "44": (2 * v22 - v11) / 2, "12": v12}

    def distance(other: dict[str, Column]) -> Column:
        inner = sum(((1 if a[0] == a[1] else 2) * own[a] * v for a, v in other.items()), F.lit(0.0))
        cosine = over(inner, _norm(own) * _norm(other))
        return 2 * F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))) / math.pi

    targets = [distance({a: F.lit(float(x)) for a, x in zip(("11", "22", "33", "44", "12"), d, strict=True)}) for d in TARGETS.values()]
    base = base.select("y", "x", distance(volume).alias("_gd"), F.least(*targets).alias("_lo"), F.greatest(*targets).alias("_hi"))
    beta = over(F.col("_lo"), F.col("_hi"))
    return base.select("y", "x", ((1 - F.col("_gd")) * F.pow(beta * beta, F.col("_gd"))).alias("vegetation"))


def yang(t3: DataFrame) -> DataFrame:
    """Huynen parameters of a single target, from the Kennaugh matrix or, where A0 is at most a tenth of its first element, from a turned one that is turned back.

    Returns the target's t11, t22, t33 and correlations.
    """

    def run(it):
        for pdf in it:
            g = {c: pdf[c].to_numpy(float) for c in elements(3, "t")}
            a0, b0, b = g["t11"] / 2, (g["t22"] + g["t33"]) / 2, (g["t22"] - g["t33"]) / 2
            c, d, h, gg, e, f = g["t12_re"], -g["t12_im"], g["t13_re"], g["t13_im"], g["t23_re"], g["t23_im"]
            k = np.array([[a0 + b0, c, h, f], [c, a0 + b, e, gg], [h, e, a0 - b, d], [f, gg, d, b0 - a0]]).transpose(2, 0, 1)
            # the turn brings another element into the place of A0: the last two rows and columns change places and one its sign
            order, sign = np.array([0, 1, 3, 2]), np.array([1, 1, 1, -1])
            low = a0 <= 0.1 * k[:, 0, 0]
            out = single(k)
            out[low] = (single(k[low][:, order][:, :, order] * sign[:, None] * sign) * sign[:, None] * sign)[:, order][:, :, order]
            a0, b0, b = (out[:, 0, 0] - out[:, 3, 3]) / 2, (out[:, 0, 0] + out[:, 3, 3]) / 2, (out[:, 1, 1] - out[:, 2, 2]) / 2
            yield pd.DataFrame({"y": pdf.y, "x": pdf.x, "t11": 2 * a0, "t12_re": out[:, 0, 1], "t12_im": -out[:, 2, 3], "t13_re": out[:, 0, 2], "t13_im": out[:, 1, 3], "t22": b0 + b, "t23_re": out[:, 1, 2], "t23_im": out[:, 0, 3], "t33": b0 - b})

    return t3.select("y", "x", *elements(3, "t")).mapInPandas(run, "y long, x long, " + ", ".join(f"{e} double" for e in elements(3, "t")))


def single(k: np.ndarray) -> np.ndarray:
    """The Kennaugh matrix of the single target with the same A0, C, D, G, H."""
    a0 = (k[:, 0, 0] - k[:, 3, 3]) / 2
    c, d, g, h = k[:, 0, 1], k[:, 2, 3], k[:, 1, 3], k[:, 0, 2]
    with np.errstate(all="ignore"):
        b0, b = (c * c + d * d + g * g + h * h) / (4 * a0), (c * c + d * d - g * g - h * h) / (4 * a0)
        e, f = (c * h - d * g) / (2 * a0), (c * g + d * h) / (2 * a0)
    return np.array([[a0 + b0, c, h, f], [c, a0 + b, e, g], [h, e, a0 - b, d], [f, g, d, b0 - a0]]).transpose(2, 0, 1)


def yang_decibels(t3: DataFrame) -> DataFrame:
    """The three powers of the single target in dB."""
    return yang(t3).select("y", "x", db(F.col("t11")).alias("two_a0"), db(F.col("t22")).alias("b0_plus_b"), db(F.col("t33")).alias("b0_minus_b"))
