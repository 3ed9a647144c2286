"""Polarimetry: matrices, decompositions, indices and Wishart classification.

Matrix elements are flat double columns named c11, c12_re, c12_im and so on (t.. for coherency),
so that Catalyst prunes and folds them; eigenvalue kernels are vectorised pandas functions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cx import Cx, atan2, divided
from ..functions.quantiles import quantiles
from ..functions.windows import box_sums
from ..plans.graph import written

EPS = 1e-15
POLS = ("hh", "hv", "vh", "vv")


def _s(p: str) -> Cx:
    return Cx.of(f"{p}_i", f"{p}_q")


def _matrix(df: DataFrame, vector: Sequence[Cx], name: str, keep: Sequence[str] = ("y", "x")) -> DataFrame:
    out = []
    for i, a in enumerate(vector):
        out.append(a.power().alias(f"{name}{i + 1}{i + 1}"))
        for j in range(i + 1, len(vector)):
            z = a * vector[j].conj()
            out += [z.re.alias(f"{name}{i + 1}{j + 1}_re"), z.im.alias(f"{name}{i + 1}{j + 1}_im")]
    return df.select(*keep, *out)


def matrix(df: DataFrame, kind: str) -> DataFrame:
    """C2, C3, C4, T3 or T4 of a scattering matrix (hh_i .. vv_q)."""
    hh, hv, vh, vv = (_s(p) for p in POLS)
    r, h = math.sqrt(2), math.sqrt(0.5)
    cross = (hv + vh) * 0.5
    vectors = {
        "C2": [hh, hv],
        "C3": [hh, cross * r, vv],
        "C4": [hh, hv, vh, vv],
        "T3": [(hh + vv) * h, (hh - vv) * h, cross * r],
        "T4": [(hh + vv) * h, (hh - vv) * h, (hv + vh) * h, Cx((vh.im - hv.im), (hv.re - vh.re)) * h],
    }
    return _matrix(df, vectors[kind], kind[0].lower())


def elements(n: int, name: str) -> list[str]:
    return [f"{name}{i}{i}" if i == j else f"{name}{i}{j}_{p}" for i in range(1, n + 1) for j in range(i, n + 1) for p in (("re",) if i == j else ("re", "im"))]


def averaged(df: DataFrame, n: int, name: str, size: int) -> DataFrame:
    """Every matrix element's mean over the window: the boxcar filter of a matrix."""
    names = elements(n, name)
    s = box_sums(df, {**{f"s_{e}": F.col(e) for e in names}, "_n": F.lit(1.0)}, size)
    return s.select("y", "x", *[(F.col(f"s_{e}") / F.col("_n")).alias(e) for e in names])


def db(c: Column) -> Column:
    return 10 * F.log10(F.greatest(c, F.lit(EPS)))


def pauli(df: DataFrame) -> DataFrame:
    hh, hv, vh, vv = (_s(p) for p in POLS)
    return df.select("y", "x", db((hh - vv).power() / 2).alias("pauli_r"), db((hv + vh).power() / 2).alias("pauli_g"), db((hh + vv).power() / 2).alias("pauli_b"))


def sinclair(df: DataFrame) -> DataFrame:
    hh, hv, vh, vv = (_s(p) for p in POLS)
    return df.select("y", "x", db(vv.power()).alias("sinclair_r"), db(((hv + vh) * 0.5).power()).alias("sinclair_g"), db(hh.power()).alias("sinclair_b"))


def over(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.when(b != 0, a / F.when(b != 0, b))


def span_db(df: DataFrame, powers: Sequence[str], span: Column) -> DataFrame:
    """Powers in dB, each drawn into the range of the span over the whole scene; the scene's span is one aggregate."""
    ends = df.agg(F.min(span).alias("_lo"), F.max(span).alias("_hi"))
    return df.join(F.broadcast(ends)).select("y", "x", *[(10 * F.log10(F.greatest(F.least(F.greatest(F.col(p), F.col("_lo")), F.col("_hi")), F.lit(EPS)))).alias(p) for p in powers])


def _three_powers(c11: Column, c22: Column, c33: Column, re: Column, im: Column) -> tuple[Column, Column, Column]:
    """Surface, double-bounce and volume power by the volume's share of C22; beyond the positive definite cone the correlation is drawn back onto it."""
    fv = 4 * c22
    a, b, r = c11 - 3 * fv / 8, c33 - 3 * fv / 8, re - fv / 8
    m2 = r * r + im * im
    scale = F.when(a * b < m2, F.sqrt(F.greatest(a * b, F.lit(0.0))) / F.sqrt(F.greatest(m2, F.lit(1e-300)))).otherwise(1.0)
    left = F.greatest(a * b - m2, F.lit(0.0))
    r, i = r * scale, im * scale
    # the mechanism whose angle is fixed, by the sign of the correlation, and the other one
    fixed = F.abs(over(left, a + b + 2 * F.abs(r)))
    free = F.abs(b - fixed)
    mixed = free + over((F.abs(r) + fixed) * (F.abs(r) + fixed) + i * i, free)
    none = (a <= EPS) | (b <= EPS)
    part = lambda surface: F.when(none, 0.0).otherwise(F.when((r >= 0) == F.lit(surface), mixed).otherwise(2 * fixed))
    return part(True), part(False), fv


def freeman_durden(c3: DataFrame) -> DataFrame:
    """Surface, double-bounce and volume power of C3; where the volume takes all of a co-polarised channel the others are 0."""
    e = {k: F.col(k) for k in ("c11", "c22", "c33", "c13_re", "c13_im")}
    surface, double, volume = _three_powers(*e.values())
    return c3.select("y", "x", surface.alias("surface"), double.alias("double"), volume.alias("volume"))


def generalized_freeman_durden(t3: DataFrame) -> DataFrame:
    pv = 4 * F.col("t33")
    t11, t22 = F.col("t11") - 2 * F.col("t33"), F.col("t22") - F.col("t33")
    s, d = t11 + t22, t11 - t22
    root = F.sqrt(d * d + 4 * (F.col("t12_re") ** 2 + F.col("t12_im") ** 2))
    return t3.select("y", "x", (0.5 * (s + root)).alias("ms"), (0.5 * (s - root)).alias("md"), pv.alias("pv"))


def van_zyl(c3: DataFrame) -> DataFrame:
    """Powers from the eigenvalues of C3; without a first channel there are none (NaN)."""
    zeta = divided(F.col("c33"), F.col("c11"))
    rho2 = divided(F.col("c13_re") ** 2 + F.col("c13_im") ** 2, F.col("c11") * F.col("c11"))
    root = F.sqrt((zeta - 1) * (zeta - 1) + 4 * rho2)
    l1, l2 = 0.5 * F.col("c11") * (zeta + 1 + root), 0.5 * F.col("c11") * (zeta + 1 - root)
    return c3.select("y", "x", F.greatest(l1, l2).alias("surface"), F.least(l1, l2).alias("double"), F.col("c22").alias("volume"))


def huynen(t3: DataFrame) -> DataFrame:
    a0 = F.col("t11") / 2
    c, d, h, g = F.col("t12_re"), F.col("t12_im"), F.col("t13_re"), F.col("t13_im")
    two = 2 * a0
    return t3.select("y", "x", two.alias("a0_2"), divided(c * c + d * d + h * h + g * g, 2 * two).alias("b0"), divided(c * c + d * d - h * h - g * g, 2 * two).alias("b"), divided(c * h + d * g, two).alias("e"), divided(c * g - d * h, two).alias("f"))


def krogager(df: DataFrame) -> DataFrame:
    """Sphere, diplane and helix amplitudes from circular components of the scattering matrix."""
    hh, hv, vh, vv = (_s(p) for p in POLS)
    cross = (hv + vh) * 0.5
    diff = (hh - vv) * 0.5
    rr = Cx(diff.re - cross.im, diff.im + cross.re)
    ll = Cx(diff.re + cross.im, diff.im - cross.re)
    rl = (hh + vv) * 0.5
    return df.select("y", "x", rl.abs().alias("sphere"), F.least(rr.abs(), ll.abs()).alias("diplane"), F.abs(rr.abs() - ll.abs()).alias("helix"))


def yamaguchi(t3: DataFrame) -> DataFrame:
    """Four components: helix from Im T23, volume by the co-polarised ratio (three models), then surface or double bounce.

    Without volume it is the three-component decomposition, with no helix.
    """
    co, cross = (F.col("t11") + F.col("t22")) / 2, F.col("t12_re")
    span = F.col("t11") + F.col("t22") + F.col("t33")
    base = t3.select("*", (co + cross).alias("c11"), (co - cross).alias("c33"), ((F.col("t11") - F.col("t22")) / 2).alias("c13_re"), (-F.col("t12_im")).alias("c13_im"), span.alias("_span"), (2 * F.abs("t23_im")).alias("_pc"))
    c11, c33, t33 = F.col("c11"), F.col("c33"), F.col("t33")
    # 10 log10(c33 / c11) at most -2, beyond 2, or between; no ratio where a channel is empty
    low, high = 10**-0.2, 10**0.2
    skew = F.when(c33 <= low * c11, 1 / 6).when(c33 > high * c11, -1 / 6).otherwise(0.0)
    k2, k3 = F.when(skew != 0, 7 / 30).otherwise(1 / 4), F.when(skew != 0, 4 / 15).otherwise(1 / 4)
    base = base.select("*", ((t33 - F.col("_pc") / 2) / k3).alias("_pv"), skew.alias("_k1"), k2.alias("_k2"))
    pv, pc, span = F.col("_pv"), F.col("_pc"), F.col("_span")
    base = base.select("*", (F.col("t11") - pv / 2).alias("_s"), (F.col("t22") - F.col("_k2") * pv - pc / 2).alias("_d"), ((F.col("t12_re") - F.col("_k1") * pv) ** 2 + F.col("t12_im") ** 2).alias("_c"))
    s, d, c = F.col("_s"), F.col("_d"), F.col("_c")
    surface = F.col("c13_re") - t33 / 2 + pc / 2 >= 0
    share = over(c, F.when(surface, s).otherwise(d))
    ps, pd_ = F.when(surface, s + share).otherwise(s - share), F.when(surface, d - share).otherwise(d + share)
    rest, full = span - pv - pc, pv + pc < span
    three = _three_powers(c11, t33, c33, F.col("c13_re"), F.col("c13_im"))
    pick = lambda own, other: F.when((own < 0) | ~full, 0.0).when(other < 0, F.when(own > 0, rest).otherwise(own)).otherwise(own)
    volume = F.when(~full | ((ps < 0) & (pd_ < 0)), span - pc).otherwise(pv)
    four = (pick(ps, pd_), pick(pd_, ps), volume, pc)
    return base.select("y", "x", *[F.when(pv <= 0, t).otherwise(f).alias(k) for k, f, t in zip(("surface", "double", "volume", "helix"), four, (*three, F.lit(0.0)), strict=True)])


def _hermitian(pdf: pd.DataFrame, n: int, name: str) -> np.ndarray:
    m = np.zeros((len(pdf), n, n), complex)
    for i in range(n):
        m[:, i, i] = pdf[f"{name}{i + 1}{i + 1}"]
        for j in range(i + 1, n):
            m[:, i, j] = pdf[f"{name}{i + 1}{j + 1}_re"] + 1j * pdf[f"{name}{i + 1}{j + 1}_im"]
            m[:, j, i] = m[:, i, j].conj()
    return m


def _eigen(pdf: pd.DataFrame, n: int, name: str) -> tuple[np.ndarray, np.ndarray]:
    values, vectors = np.linalg.eigh(_hermitian(pdf, n, name))
    return np.maximum(values[:, ::-1], 0), vectors[:, :, ::-1]


def h_a_alpha(df: DataFrame, n: int = 3, name: str = "t") -> DataFrame:
    """Entropy, anisotropy and mean alpha (degrees) of T3 (n=3) or C2 (n=2), with the eigenvalues."""

    def run(it):
        for pdf in it:
            values, vectors = _eigen(pdf, n, name)
            p = values / np.maximum(values.sum(1, keepdims=True), EPS)
            h = -(p * np.log(np.maximum(p, EPS))).sum(1) / np.log(n)
            alpha = np.degrees(np.arccos(np.clip(np.abs(vectors[:, 0, :]), 0, 1)))
            a = (values[:, -2] - values[:, -1]) / np.maximum(values[:, -2] + values[:, -1], EPS)
            yield pd.DataFrame({"y": pdf.y, "x": pdf.x, "entropy": h, "anisotropy": a, "alpha": (p * alpha).sum(1), **{f"lambda{k + 1}": values[:, k] for k in range(n)}})

    lam = ", ".join(f"lambda{k + 1} double" for k in range(n))
    return df.select("y", "x", *elements(n, name)).mapInPandas(run, f"y long, x long, entropy double, anisotropy double, alpha double, {lam}")


def eigen2(c2: DataFrame) -> DataFrame:
    """Eigenvalues of C2 in closed form."""
    s, d = F.col("c11") + F.col("c22"), F.col("c11") - F.col("c22")
    root = F.sqrt(d * d + 4 * (F.col("c12_re") ** 2 + F.col("c12_im") ** 2))
    return c2.withColumns({"lambda1": (s + root) / 2, "lambda2": (s - root) / 2})


def cloude(t3: DataFrame) -> DataFrame:
    """Powers of the dominant mechanism's Pauli parts in dB."""

    def run(it):
        for pdf in it:
            values, vectors = _eigen(pdf, 3, "t")
            p = values[:, :1] * np.abs(vectors[:, :, 0]) ** 2
            d = 10 * np.log10(np.maximum(p, EPS))
            yield pd.DataFrame({"y": pdf.y, "x": pdf.x, "surface": d[:, 0], "double": d[:, 1], "volume": d[:, 2]})

    return t3.select("y", "x", *elements(3, "t")).mapInPandas(run, "y long, x long, surface double, double double, volume double")


def touzi(t3: DataFrame) -> DataFrame:
    """Mean orientation, helicity, phase and magnitude angles (radians) of the eigenvectors."""

    def run(it):
        for pdf in it:
            values, vectors = _eigen(pdf, 3, "t")
            p = values / np.maximum(values.sum(1, keepdims=True), EPS)
            v = vectors * np.exp(-1j * np.angle(vectors[:, :1, :]))
            psi = 0.5 * np.arctan2(v[:, 2].real, v[:, 1].real + EPS)
            turned = v[:, 1] * np.cos(2 * psi) + v[:, 2] * np.sin(2 * psi)
            other = -v[:, 1] * np.sin(2 * psi) + v[:, 2] * np.cos(2 * psi)
            # beyond an eighth of a turn the same target has the other handedness
            hand = np.where(np.abs(psi) > np.pi / 4, -1.0, 1.0)
            tau = hand * 0.5 * np.arctan2(-other.imag, v[:, 0].real + EPS)
            phi = hand * np.arctan2(turned.imag, turned.real + EPS)
            alpha = np.arctan2(np.abs(turned), np.hypot(v[:, 0].real, other.imag))
            yield pd.DataFrame({"y": pdf.y, "x": pdf.x, "psi": (p * psi).sum(1), "tau": (p * tau).sum(1), "phi": (p * phi).sum(1), "alpha_s": (p * alpha).sum(1)})

    return t3.select("y", "x", *elements(3, "t")).mapInPandas(run, "y long, x long, psi double, tau double, phi double, alpha_s double")


def det3(name: str = "t") -> Column:
    """Determinant of a 3 x 3 Hermitian matrix."""
    e = lambda k: F.col(f"{name}{k}")
    a, b, c = Cx(e("12_re"), e("12_im")), Cx(e("13_re"), e("13_im")), Cx(e("23_re"), e("23_im"))
    return e("11") * e("22") * e("33") + 2 * (a * c * b.conj()).re - e("11") * c.power() - e("22") * b.power() - e("33") * a.power()


def mf3cf(t3: DataFrame) -> DataFrame:
    """Model-free three components of T3: degree of polarisation and scattering angle share the span."""
    span = F.col("t11") + F.col("t22") + F.col("t33")
    out = t3.withColumns({"_span": span, "_m": F.sqrt(F.greatest(1 - 27 * F.greatest(det3(), F.lit(0.0)) / F.pow(span, F.lit(3.0)), F.lit(0.0)))})
    m, s, h = F.col("_m"), F.col("_span"), F.col("t22") + F.col("t33")
    theta = F.atan(m * s * (F.col("t11") - h) / (F.col("t11") * h + m * m * s * s))
    sin2 = F.sin(2 * theta)
    return out.select("y", "x", (m * s / 2 * (1 + sin2)).alias("surface"), (m * s / 2 * (1 - sin2)).alias("double"), (s * (1 - m)).alias("volume"), F.degrees(theta).alias("theta"))


def mf4cf(t3: DataFrame) -> DataFrame:
    """Model-free four components of T3: as mf3cf, with a helix part from the imaginary correlation of T23."""
    span = F.col("t11") + F.col("t22") + F.col("t33")
    m = F.sqrt(F.greatest(1 - 27 * F.greatest(det3(), F.lit(0.0)) / F.when(span > 0, F.pow(span, F.lit(3.0))), F.lit(0.0)))
    out = t3.select("*", span.alias("_span"), m.alias("_m"))
    m, s, h = F.col("_m"), F.col("_span"), F.col("t22") + F.col("t33")
    theta = F.atan(over(m * s * (F.col("t11") - h), F.col("t11") * h + m * m * s * s))
    tau = F.atan(over(2 * F.abs("t23_im"), s))
    helix, volume = m * s * F.sin(2 * tau), s * (1 - m)
    rest = (s - helix - volume) / 2
    return out.select("y", "x", (rest * (1 + F.sin(2 * theta))).alias("surface"), (rest * (1 - F.sin(2 * theta))).alias("double"), volume.alias("volume"), helix.alias("helix"), F.degrees(theta).alias("theta"), F.degrees(tau).alias("tau"))


def parameters(t3: DataFrame) -> DataFrame:
    """Span, pedestal height and radar vegetation index of T3 by its eigenvalues (the second, where a well-known slip has alpha)."""
    e = h_a_alpha(t3)
    total = F.col("lambda1") + F.col("lambda2") + F.col("lambda3")
    return e.select("y", "x", (2 * total).alias("span"), over(F.col("lambda3"), F.col("lambda1")).alias("pedestal"), over(4 * F.col("lambda3"), total).alias("rvi"))


def channel_parameters(c3: DataFrame) -> DataFrame:
    """Indices and ratios of the channels: rfdi, csi, vsi, bmi, ratios, coherence and phase of co-polarisation; over an empty channel infinite or NaN."""
    hh, hv, vv = F.col("c11"), F.col("c22") / 2, F.col("c33")
    bmi = (hh + vv) / 2
    return c3.select("y", "x", (2 * (hh + vv + 2 * hv)).alias("span"), divided(hh - hv, hh + hv).alias("rfdi"), divided(vv, hh + vv).alias("csi"), divided(hv, hv + bmi).alias("vsi"), bmi.alias("bmi"), divided(hh, vv).alias("hhvv_ratio"), divided(hv, hh).alias("hvhh_ratio"), divided(F.hypot("c13_re", "c13_im"), F.sqrt(hh * vv)).alias("coherence"), atan2(F.col("c13_im"), F.col("c13_re")).alias("phase"))


def faraday(df: DataFrame, size: int) -> DataFrame:
    """Rotation angle from the window mean of the circular cross product, and the matrix turned back by it."""
    hh, hv, vh, vv = (_s(p) for p in POLS)
    cross, total = hv - vh, hh + vv
    z01, z10 = Cx(cross.re - total.im, cross.im + total.re), Cx(-cross.re - total.im, -cross.im + total.re)
    z = z01 * z10.conj()
    s = box_sums(df, {"re": z.re, "im": z.im}, size).withColumn("omega", -0.25 * atan2(F.col("im"), F.col("re")))
    c, n = F.cos("omega"), F.sin("omega")
    turn = {
        "hh": hh * (c * c) + (vh - hv) * (n * c) - vv * (n * n),
        "hv": hv * (c * c) + vh * (n * n) + (hh + vv) * (n * c),
        "vh": vh * (c * c) + hv * (n * n) - (hh + vv) * (n * c),
        "vv": vv * (c * c) + (vh - hv) * (n * c) - hh * (n * n),
    }
    return s.select("y", "x", "omega", *[v.alias(f"{p}_{e}") for p, zz in turn.items() for e, v in (("i", zz.re), ("q", zz.im))])


def orientation(t3: DataFrame) -> DataFrame:
    """Turn T3 about the line of sight by its own orientation angle."""
    theta = 0.25 * (F.atan2(2 * F.col("t23_re"), F.col("t33") - F.col("t22")) + math.pi)
    out = t3.withColumn("_t", F.when(theta > math.pi / 4, theta - math.pi / 2).otherwise(theta))
    c, s = F.cos(2 * F.col("_t")), F.sin(2 * F.col("_t"))
    a, b = Cx(F.col("t12_re"), F.col("t12_im")), Cx(F.col("t13_re"), F.col("t13_im"))
    t12, t13 = a * c + b * s, b * c - a * s
    mix = 2 * F.col("t23_re") * s * c
    return out.select("y", "x", F.degrees("_t").alias("theta"), "t11", t12.re.alias("t12_re"), t12.im.alias("t12_im"), t13.re.alias("t13_re"), t13.im.alias("t13_im"), (F.col("t22") * c * c + F.col("t33") * s * s + mix).alias("t22"), (F.col("t23_re") * (c * c - s * s) + (F.col("t33") - F.col("t22")) * s * c).alias("t23_re"), F.col("t23_im"), (F.col("t22") * s * s + F.col("t33") * c * c - mix).alias("t33"))


def snr_correction(df: DataFrame, size: int) -> DataFrame:
    """Cross channels times the coherence of HV and VH over the window."""
    hv, vh = _s("hv"), _s("vh")
    z = hv * vh.conj()
    s = box_sums(df, {"re": z.re, "im": z.im, "pa": hv.power(), "pb": vh.power()}, size)
    g = F.when(F.col("pa") * F.col("pb") > 0, F.hypot("re", "im") / F.sqrt(F.col("pa") * F.col("pb"))).otherwise(0.0)
    return s.select("y", "x", *[(F.col(f"{p}_{e}") * g).alias(f"{p}_{e}") for p in ("hv", "vh") for e in "iq"])


def stokes(c2: DataFrame, hand: str = "right") -> DataFrame:
    """Stokes parameters of compact C2 and what is derived from them."""
    sign = 1 if hand == "right" else -1
    out = c2.select("y", "x", (F.col("c11") + F.col("c22")).alias("g0"), (F.col("c11") - F.col("c22")).alias("g1"), (2 * F.col("c12_re")).alias("g2"), (sign * 2 * F.col("c12_im")).alias("g3"))
    pol = F.sqrt(F.col("g1") ** 2 + F.col("g2") ** 2 + F.col("g3") ** 2)
    m = divided(pol, F.col("g0"))
    return out.select("*", m.alias("m"), divided(F.sqrt(F.col("g1") ** 2 + F.col("g2") ** 2), F.col("g0")).alias("linear"), divided(F.col("g0") - F.col("g3"), F.col("g0") + F.col("g3")).alias("cpr"), divided(F.col("g0") - F.col("g1"), F.col("g0") + F.col("g1")).alias("lpr"), atan2(F.col("g3"), F.col("g2")).alias("delta"), F.when(pol > 0, 0.5 * F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), divided(-F.col("g3"), pol))))).otherwise(0.0).alias("chi"), (0.5 * atan2(F.col("g2"), F.col("g1"))).alias("psi"))


def compact(c2: DataFrame, kind: str) -> DataFrame:
    """Compact-polarimetry decompositions m_chi, m_delta, m_alpha."""
    s = stokes(c2)
    g0 = F.col("g0")
    mg = F.when(g0 != 0, F.col("m") * g0).otherwise(0.0)
    part = {
        "m_chi": (mg * (1 - F.sin(2 * F.col("chi"))) / 2, mg * (1 + F.sin(2 * F.col("chi"))) / 2),
        "m_delta": (mg * (1 - F.sin("delta")) / 2, mg * (1 + F.sin("delta")) / 2),
    }
    alpha = 0.5 * atan2(F.sqrt(F.col("g1") ** 2 + F.col("g2") ** 2), F.col("g3"))
    part["m_alpha"] = (mg * F.cos(alpha) ** 2, mg * F.sin(alpha) ** 2)
    a, b = part[kind]
    root = lambda c: F.sqrt(F.greatest(c, F.lit(0.0)))
    return s.select("y", "x", root(a).alias("a"), root(b).alias("b"), root((1 - F.col("m")) * g0 if kind == "m_delta" else g0 - mg).alias("random"))


def mf3cc(c2: DataFrame) -> DataFrame:
    """Model-free three components of compact data."""
    s = stokes(c2)
    m, g0 = F.col("m"), F.col("g0")
    sc, oc = (g0 - F.col("g3")) / 2, (g0 + F.col("g3")) / 2
    theta = F.atan(divided(m * g0 * (oc - sc), oc * sc + m * m * g0 * g0))
    return s.select("y", "x", (m * g0 / 2 * (1 + F.sin(2 * theta))).alias("surface"), (m * g0 / 2 * (1 - F.sin(2 * theta))).alias("double"), F.when(g0 != 0, g0 * (1 - m)).otherwise(g0).alias("volume"))


def simulate_compact(df: DataFrame) -> DataFrame:
    """C2 that a right-circular transmitter and linear receivers would have measured."""
    hh, hv, vh, vv = (_s(p) for p in POLS)
    cross = (hv + vh) * 0.5
    h = math.sqrt(0.5)
    rh = Cx(hh.re + cross.im, hh.im - cross.re) * h
    rv = Cx(cross.re + vv.im, cross.im - vv.re) * h
    return _matrix(df, [rh, rv], "c")


def ratio_indices(c2: DataFrame) -> DataFrame:
    a, b = F.col("c11"), F.col("c22")
    good = (a + b > 0) & (a > 0)
    return c2.select("y", "x", F.when(good, (a - b) / (a + b)).alias("rfdi"), F.when(good, b / a).alias("cross_ratio"), F.when(good & (b > 0), 10 * F.log10(b / a)).alias("cross_ratio_db"), (a + b).alias("span"))


def radar_vegetation(c2: DataFrame) -> DataFrame:
    """Dual-pol radar vegetation index."""
    e = eigen2(c2)
    span = F.col("c11") + F.col("c22")
    det = F.col("c11") * F.col("c22") - F.col("c12_re") ** 2 - F.col("c12_im") ** 2
    m = F.sqrt(F.greatest(1 - divided(4 * det, span * span), F.lit(0.0)))
    return e.select("y", "x", F.when(span > 0, 1 - m * F.col("lambda1") / span).alias("rvi"))


# Shares of the co- and cross-polarised channel in the volume models.
VOLUMES = {"uniform": (1 / 2, 1 / 2), "bragg": (2 / 3, 1 / 3), "dipole": (3 / 8, 1 / 8)}


def y3(c2: DataFrame, model: str = "uniform") -> DataFrame:
    """Dual-pol three powers: the largest volume that both channels allow, the rest to surface or dihedral by the correlation's sign."""
    a, b = VOLUMES[model]
    fv = F.least(F.col("c22") / b, F.greatest(F.col("c11"), F.lit(0.0)) / a)
    rest = F.greatest(F.col("c11") - fv * a, F.lit(0.0)) + F.greatest(F.col("c22") - fv * b, F.lit(0.0))
    return c2.select("y", "x", F.when(F.col("c12_re") >= 0, rest).otherwise(0.0).alias("surface"), F.when(F.col("c12_re") < 0, rest).otherwise(0.0).alias("double"), (fv * (a + b)).alias("volume"))


def clipped(df: DataFrame, value: Column) -> Column:
    """A column's size, drawn into its 5th and 95th percentiles over the scene and divided by the latter."""
    low, high = quantiles(df, F.abs(value), (0.05, 0.95))
    return F.least(F.greatest(F.abs(value), F.lit(low)), F.lit(high)) / F.lit(high) if high else F.lit(0.0)


def builtup_index(c2: DataFrame) -> DataFrame:
    """Root mean square of the polarised Stokes parameters, each clipped to its 5th and 95th percentiles and scaled by the latter."""
    s = written(stokes(c2).select("y", "x", "g1", "g2", "g3"), "stokes")  # read in every pass of the percentiles
    part = [clipped(s, F.col(g)) for g in ("g1", "g2", "g3")]
    return s.select("y", "x", F.sqrt(sum((p * p for p in part), F.lit(0.0)) / 3).alias("builtup"))


def surface_index(c2: DataFrame, nesz: float = -100.0) -> DataFrame:
    """(1 - entropy) times what the first Stokes parameter, clipped and scaled, leaves; without the entropy where c11 is not above nesz (dB)."""
    c2 = written(c2, "surface")  # read in every pass of the percentiles
    e = eigen2(c2)
    span = F.col("lambda1") + F.col("lambda2")
    p1, p2 = (F.greatest(over(F.col(f"lambda{k}"), span), F.lit(EPS)) for k in (1, 2))
    h = -(p1 * F.log2(p1) + p2 * F.log2(p2))
    g = clipped(c2, F.col("c11") - F.col("c22"))
    rest = F.sqrt(F.greatest(1 - g * g, F.lit(0.0)))
    return e.select("y", "x", F.when(F.col("c11") > 10 ** (nesz / 10), (1 - h) * rest).otherwise(rest).alias("surface_index"))


def compact_vegetation(c2: DataFrame) -> DataFrame:
    """Compact-pol vegetation index from the geodesic distance to a random target."""
    s = stokes(c2)
    sc, oc = (F.col("g0") - F.col("g3")) / 2, (F.col("g0") + F.col("g3")) / 2
    norm = F.sqrt(F.col("g0") ** 2 + F.col("g1") ** 2 + F.col("g2") ** 2 + F.col("g3") ** 2)
    gd = 2 / math.pi * F.acos(F.least(divided(F.col("g0"), norm), F.lit(1.0)))
    lam = 1.5 * gd
    return s.select("y", "x", ((1 - lam) * F.pow(divided(F.least(sc, oc), F.greatest(sc, oc)), 2 * lam)).alias("vegetation"))


def change_test(first: DataFrame, second: DataFrame, looks: float, n: int = 2, threshold: float = 0.99) -> DataFrame:
    """Likelihood-ratio test that two covariance matrices (C2) are one: statistic, probability and mask."""
    det = lambda d: F.col(f"{d}11") * F.col(f"{d}22") - F.col(f"{d}12_re") ** 2 - F.col(f"{d}12_im") ** 2
    a = first.select("y", "x", *[F.col(e).alias(f"a{e[1:]}") for e in elements(2, "c")])
    b = second.select("y", "x", *[F.col(e).alias(f"b{e[1:]}") for e in elements(2, "c")])
    met = a.join(b, ["y", "x"]).withColumns({f"m{e[1:]}": (F.col(f"a{e[1:]}") + F.col(f"b{e[1:]}")) / 2 for e in elements(2, "c")})
    ln = lambda c: F.log(F.greatest(c, F.lit(EPS)))
    t = -2 * looks * (ln(det("a")) + ln(det("b")) - 2 * ln(det("m")))
    # chi-square with 4 degrees of freedom in closed form
    p = 1 - F.exp(-F.col("statistic") / 2) * (1 + F.col("statistic") / 2)
    out = met.select("y", "x", F.greatest(t, F.lit(0.0)).alias("statistic"))
    return out.select("y", "x", "statistic", p.alias("probability"), (p >= threshold).alias("changed"))


def zone(entropy: Column, alpha: Column) -> Column:
    """Zones 1 to 9 of the entropy-alpha plane."""
    by = lambda hi, mid, a, b, c: F.when(alpha > hi, a).when(alpha > mid, b).otherwise(c)
    return F.when(entropy > 0.9, by(55, 40, 1, 2, 3)).when(entropy > 0.5, by(50, 40, 4, 5, 6)).otherwise(by(47.5, 42.5, 7, 8, 9))


def h_alpha_zones(m: DataFrame, n: int = 3, name: str = "t") -> DataFrame:
    """Entropy-alpha zone of T3, or of C2 with n=2, name="c"."""
    return h_a_alpha(m, n, name).select("y", "x", zone(F.col("entropy"), F.col("alpha")).alias("zone"))


def _wishart(c: np.ndarray, name: str = "t") -> Column:
    """Wishart distance of each pixel's matrix to a centre: trace of centre's inverse times the matrix, and the log determinant."""
    inv = np.linalg.inv(c)
    terms = [F.lit(float(np.log(max(np.linalg.det(c).real, 1e-300))))]
    for i in range(len(c)):
        terms.append(F.col(f"{name}{i + 1}{i + 1}") * float(inv[i, i].real))
        for j in range(i + 1, len(c)):
            terms.append(2 * (F.col(f"{name}{i + 1}{j + 1}_re") * float(inv[i, j].real) + F.col(f"{name}{i + 1}{j + 1}_im") * float(inv[i, j].imag)))
    return sum(terms[1:], terms[0])


def _centres(df: DataFrame, label: Column, n: int, name: str) -> dict:
    """Mean matrix of every class, in one aggregate, and its number of pixels."""
    got = df.withColumn("z", label).where("z is not null").groupBy("z").agg(F.count("*").alias("_pixels"), *[F.avg(e).alias(e) for e in elements(n, name)]).collect()
    return {r["z"]: (_hermitian(pd.DataFrame([r.asDict()]), n, name)[0] + 1e-12 * np.eye(n), r["_pixels"]) for r in sorted(got, key=lambda r: str(r["z"]).zfill(12))}


def _nearest(centres: dict, name: str, among: dict | None = None) -> Column:
    """The class of the nearest centre, the first of equals; among: a condition for each class."""
    cost = [F.struct((F.when(among[z], _wishart(c, name)) if among else _wishart(c, name)).alias("d"), F.lit(k).alias("k"), F.lit(z).alias("z")) for k, (z, (c, _)) in enumerate(centres.items())]
    least = F.array_min(F.filter(F.array(*cost), lambda x: x["d"].isNotNull()))
    return least["z"]


def wishart(m: DataFrame, seeds: DataFrame, rounds: int = 3, n: int = 3, name: str = "t") -> DataFrame:
    """Seed classes (y, x, zone) refined: centres are class means, each pixel goes to the nearest centre.

    A round is one aggregate over the input, which is written once; it ends early where no pixel's class changes.
    """
    df = written(m.join(seeds.select("y", "x", F.col("zone").alias("_z")), ["y", "x"]), "wishart")
    now: Column = F.col("_z")
    for _ in range(rounds):
        new = _nearest(_centres(df, now, n, name), name)
        same = df.where(now != new).isEmpty()
        now = new
        if same:
            break
    return df.select("y", "x", now.cast("int").alias("class"))


def supervised_wishart(t3: DataFrame, centres: dict[int, np.ndarray], size: int) -> DataFrame:
    """Class of the nearest trained centre for the window-mean T3."""
    df = averaged(t3, 3, "t", size)
    cost = F.array(*[_wishart(c) for c in centres.values()])
    at = (F.array_position(cost, F.array_min(cost)) - 1).cast("int")
    return df.select("y", "x", F.get(F.array(*[F.lit(k) for k in centres]), at).alias("class"))


#: Categories of a scattering power, by place: surface, double bounce, volume, and none that prevails.
MIXED = 3


def scattering_wishart(m: DataFrame, powers: DataFrame, clusters: int = 6, final: int = 9, rounds: int = 3, prevails: float = 0.5, n: int = 3, name: str = "t") -> DataFrame:
    """Classes that keep their scattering mechanism: y, x, category, class.

    powers (y, x, surface, double, volume) come from any decomposition. A pixel's category is the power of
    more than the share `prevails`, else mixed. Each category starts as equal parts by its power; the two
    nearest clusters of a category (by their Wishart distances) are merged while there are more than `final`,
    but none into one of over twice the mean size. Then pixels go to the nearest centre of their category,
    mixed ones to any, for some rounds.
    """
    p = [F.greatest(F.col(k), F.lit(0.0)) for k in ("surface", "double", "volume")]
    total = p[0] + p[1] + p[2]
    category = F.when(total <= 0, F.lit(None)).when(p[0] > prevails * total, 0).when(p[1] > prevails * total, 1).when(p[2] > prevails * total, 2).otherwise(MIXED)
    joined = m.join(powers.select("y", "x", category.alias("_cat"), *[q.alias(f"_p{k}") for k, q in enumerate(p)]), ["y", "x"])
    df = written(joined.where("_cat is not null"), "wishart")
    own = F.element_at(F.array("_p0", "_p1", "_p2"), F.col("_cat") + 1)
    start = F.when(F.lit(False), F.lit(0))
    for c in range(MIXED):
        cuts = quantiles(df.where(F.col("_cat") == c), F.col(f"_p{c}"), [k / clusters for k in range(1, clusters)])
        if cuts and cuts[0] is not None:
            place = sum(((own > q).cast("int") for q in cuts), F.lit(0))
            start = start.when(F.col("_cat") == c, clusters * c + place)
    centres = _centres(df, start, n, name)
    if not centres:
        return df.select("y", "x", F.col("_cat").cast("int").alias("category"), F.lit(None).cast("int").alias("class"))
    most = 2 * sum(k for _, k in centres.values()) / final

    def apart(a: np.ndarray, b: np.ndarray) -> float:
        trace = lambda u, v: np.trace(np.linalg.inv(u) @ v).real
        log = lambda u: np.log(max(np.linalg.det(u).real, 1e-300))
        return 0.5 * (log(a) + log(b) + trace(a, b) + trace(b, a))

    while len(centres) > final:
        pairs = [(apart(centres[a][0], centres[b][0]), a, b) for a in centres for b in centres if a < b and a // clusters == b // clusters and centres[a][1] + centres[b][1] <= most]
        if not pairs:
            break
        _, a, b = min(pairs)
        (x, i), (y, j) = centres[a], centres.pop(b)
        centres[a] = ((x * i + y * j) / (i + j), i + j)
    now = F.lit(None)
    for _ in range(rounds):
        among = {z: (F.col("_cat") == z // clusters) | (F.col("_cat") == MIXED) for z in centres}
        now = _nearest(centres, name, among)
        centres = {z: c for z, c in _centres(df, now, n, name).items()}
    return df.select("y", "x", F.col("_cat").cast("int").alias("category"), now.cast("int").alias("class"))


def dual_pol_powers(df: DataFrame, factorised: bool = False) -> DataFrame:
    """Surface, dihedral and diffuse power from g0, the degree of polarisation, and the built-up (rbi) and surface (rsi) indices.

    Decomposed, the polarised power is shared by the angle midway between those of the two indices;
    factorised, the larger index takes its share of the power first.
    """
    g0, rbi, rsi = F.col("g0"), F.col("rbi"), F.col("rsi")
    if factorised:
        ps = F.when(rsi > rbi, g0 * rsi).otherwise(g0 * (1 - rbi) * rsi)
        pd_ = F.when(rsi > rbi, g0 * (1 - rsi) * rbi).otherwise(g0 * rbi)
        return df.select("y", "x", ps.alias("surface"), pd_.alias("double"), (g0 - ps - pd_).alias("rest"))
    angle = atan2(rbi, 1 - rbi) + atan2(1 - rsi, rsi)
    half = F.col("dop") * g0 / 2
    return df.select("y", "x", (half * (1 + F.cos(angle))).alias("surface"), (half * (1 - F.cos(angle))).alias("double"), ((1 - F.col("dop")) * g0).alias("rest"))


def cameron(df: DataFrame) -> DataFrame:
    """Degree of symmetry (radians) and orientation of the largest symmetric part of the scattering matrix."""
    hh, hv, vh, vv = (_s(p) for p in POLS)
    r = math.sqrt(0.5)
    a, b, c = (hh + vv) * r, (hh - vv) * r, (hv + vh) * r
    re = (b * c.conj()).re * 2
    chi = 0.5 * atan2(re, b.power() - c.power())
    sym = b * F.cos(chi) + c * F.sin(chi)
    size = F.sqrt(a.power() + b.power() + c.power())
    share = F.when(size > 0, F.sqrt(a.power() + sym.power()) / size).otherwise(0.0)
    return df.select("y", "x", F.acos(F.least(share, F.lit(1.0))).alias("tau"), (-0.5 * chi).alias("psi"))
