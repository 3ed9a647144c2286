"""Interferometry and time series."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cx import Cx
from ..functions.windows import box_sums
from .geometry import Sensor, ecef, ground_of, orbit_of
from .raster import tiles

C = 299_792_458.0


def interferogram(pair: DataFrame, phase: Column | None = None) -> DataFrame:
    """Reference times the conjugate of the secondary turned by the given (flat-earth, topographic) phase."""
    sec = Cx.of("i2", "q2")
    z = Cx.of("i1", "q1") * (sec if phase is None else sec * Cx.turn(phase)).conj()
    return pair.select("y", "x", z.re.alias("i"), z.im.alias("q"), z.arg().alias("phase"))


def polynomial_phase(coefficients: Sequence[float], order: int) -> Column:
    """Sum of c_ij y^i x^j, terms by rising degree: the flat-earth phase as a column."""
    terms, k = [], 0
    for degree in range(order + 1):
        for j in range(degree + 1):
            terms.append(F.lit(float(coefficients[k])) * F.pow(F.col("y").cast("double"), F.lit(float(degree - j))) * F.pow(F.col("x").cast("double"), F.lit(float(j))))
            k += 1
    return sum(terms[1:], terms[0])


def coherence(pair: DataFrame, size_y: int, size_x: int, debias: bool = False) -> DataFrame:
    """Modulus of the windowed cross product over the root of the powers' product; optionally less its bias."""
    a, b = Cx.of("i1", "q1"), Cx.of("i2", "q2")
    z = a * b.conj()
    s = box_sums(pair, {"re": z.re, "im": z.im, "pa": a.power(), "pb": b.power(), "n": F.lit(1.0)}, size_x, size_y)
    power = F.col("pa") * F.col("pb")
    g = F.when(power > 0, F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")) / F.sqrt(power)).otherwise(0.0)
    if debias:
        g = F.greatest(g - (1 - g * g) / (2 * F.col("n")), F.lit(0.0))
    return s.select("y", "x", g.alias("coherence"))


def multi_master(slcs: DataFrame, pairs: DataFrame, size: int) -> DataFrame:
    """Interferogram, intensities and window coherence of every pair of epochs.

    slcs: epoch, y, x, i, q and phase (reference phase); pairs: pair, ref, sec. Null samples give nothing.
    """
    one = slcs.select(F.col("epoch").alias("ref"), "y", "x", F.col("i").alias("i1"), F.col("q").alias("q1"), F.col("phase").alias("p1"))
    two = slcs.select(F.col("epoch").alias("sec"), "y", "x", F.col("i").alias("i2"), F.col("q").alias("q2"), F.col("phase").alias("p2"))
    met = pairs.join(one, "ref").join(two, ["sec", "y", "x"])
    a, b = Cx.of("i1", "q1"), Cx.of("i2", "q2")
    z = a * b.conj() * Cx.turn(F.col("p2") - F.col("p1"))
    met = met.withColumns({"i": z.re, "q": z.im, "intensity1": a.power(), "intensity2": b.power()})
    s = box_sums(met, {"re": F.col("i"), "im": F.col("q"), "pa": F.col("intensity1"), "pb": F.col("intensity2")}, size, keys=("pair",))
    power = F.col("pa") * F.col("pb")
    return s.select("pair", "y", "x", "i", "q", "intensity1", "intensity2", F.when(power > 0, F.sqrt(F.col("re") ** 2 + F.col("im") ** 2) / F.sqrt(power)).otherwise(0.0).alias("coherence"))


def consecutive_pairs(epochs: DataFrame, epoch: str = "epoch") -> DataFrame:
    """(ref, sec): each acquisition with the next. Epochs are metadata, a row per acquisition."""
    w = Window.orderBy(epoch)
    return epochs.select(epoch).distinct().select(F.col(epoch).alias("ref"), F.lead(epoch).over(w).alias("sec")).where("sec is not null")


def overview(acquisitions: DataFrame, critical_baseline: float = 1200.0, critical_days: float = 1000.0, critical_doppler: float = 900.0) -> DataFrame:
    """Modelled coherence of every pair of acquisitions (epoch, day, perp, doppler) and each reference's mean.

    Acquisitions are metadata: their pairs are as few as the stack's dates squared.
    """
    a, b = acquisitions.alias("a"), acquisitions.alias("b")
    part = lambda d, most: F.greatest(1 - F.abs(d) / most, F.lit(0.0))
    met = a.join(F.broadcast(b), F.col("a.epoch") != F.col("b.epoch"))
    days, perp, doppler = (F.col(f"b.{c}") - F.col(f"a.{c}") for c in ("day", "perp", "doppler"))
    out = met.select(F.col("a.epoch").alias("ref"), F.col("b.epoch").alias("sec"), perp.alias("perp"), days.alias("days"), doppler.alias("doppler"), (part(perp, critical_baseline) * part(days, critical_days) * part(doppler, critical_doppler)).alias("modelled"))
    return out.withColumn("reference_score", F.avg("modelled").over(Window.partitionBy("ref")))


def phase_to_displacement(df: DataFrame, wavelength: float, phase: str = "phase") -> DataFrame:
    return df.select("y", "x", (F.col(phase) * (-wavelength / (4 * math.pi))).alias("displacement"))


def integer_interferogram(df: DataFrame, q1: int, q2: int, phase1: str = "phase1", phase2: str = "phase2") -> DataFrame:
    z = Cx.turn(q1 * F.col(phase1) + q2 * F.col(phase2))
    return df.select("y", "x", z.re.alias("i"), z.im.alias("q"))


def horizontal_vertical(asc: DataFrame, desc: DataFrame, incidence: tuple[float, float], heading: tuple[float, float], reference: tuple[int, int]) -> DataFrame:
    """East-west and vertical motion (mm) from ascending and descending line-of-sight phase in mm, relative to a reference pixel."""
    (ta, td), (ha, hd) = ([math.radians(v) for v in x] for x in (incidence, heading))
    a11, a12, a21, a22 = -math.sin(ta) * math.cos(ha), math.cos(ta), -math.sin(td) * math.cos(hd), math.cos(td)
    det = a11 * a22 - a12 * a21
    met = asc.select("y", "x", F.col("los").alias("a")).join(desc.select("y", "x", F.col("los").alias("d")), ["y", "x"])
    ref = met.where((F.col("y") == reference[0]) & (F.col("x") == reference[1])).select(F.col("a").alias("ra"), F.col("d").alias("rd"))
    a, d = F.col("a") - F.col("ra"), F.col("d") - F.col("rd")
    return met.join(F.broadcast(ref)).select("y", "x", ((a22 * a - a12 * d) / det).alias("east"), ((a11 * d - a21 * a) / det).alias("up"))


def tropo(df: DataFrame, threshold: float, least_height: float, stride: int, phase: str = "phase", height: str = "height", coherence_: str = "coherence", degree: int = 1) -> DataFrame:
    """Remove the part of the phase that is a polynomial (degree 1 or 2) of height, fitted on coherent pixels of every stride-th line and sample.

    With fewer samples than five for each coefficient, or heights that do not determine it, the phase stays.
    """
    good = (F.col("y") % stride == 0) & (F.col("x") % stride == 0) & (F.col(coherence_) >= threshold) & (F.col(height) > least_height)
    used = df.where(good & F.col(phase).isNotNull() & ~F.isnan(phase)).select(F.col(phase).alias("p"), F.col(height).alias("z"))
    middle = used.agg(F.avg("z").alias("mz"), F.count("*").alias("n"))
    z, p = F.col("z") - F.col("mz"), F.col("p")
    # moments about the mean height: the linear term is orthogonal to the constant one
    sums = used.join(F.broadcast(middle)).agg(F.first("mz").alias("mz"), F.first("n").alias("n"), *[F.avg(z**k).alias(f"z{k}") for k in (2, 3, 4)], *[F.avg(p * z**k).alias(f"p{k}") for k in (0, 1, 2)])
    out = df.join(F.broadcast(sums))
    z2, z3 = F.col("z2"), F.col("z3")
    slope = F.when(z2 > 0, F.col("p1") / F.greatest(z2, F.lit(1e-300)))
    h = F.col(height) - F.col("mz")
    if degree == 1:
        fit = F.col("p0") + slope * h
    else:
        skew = F.when(z2 > 0, z3 / F.greatest(z2, F.lit(1e-300)))
        left = F.col("z4") - z2 * z2 - skew * z3
        bend = F.when(left > 1e-12 * F.col("z4"), (F.col("p2") - F.col("p0") * z2 - skew * F.col("p1")) / F.greatest(left, F.lit(1e-300)))
        fit = F.col("p0") + slope * h + bend * (h * h - skew * h - z2)
    return out.select("y", "x", F.when((F.col("n") >= 5 * (degree + 1)) & (z2 > 0), F.col(phase) - F.coalesce(fit, F.lit(0.0))).otherwise(F.col(phase)).alias(phase))


def split_band_ionosphere(df: DataFrame, f_low: float, f_high: float, f0: float, low: str = "low", high: str = "high") -> DataFrame:
    """Dispersive phase of two sub-band phases."""
    k = f_low * f_high / (f0 * (f_high**2 - f_low**2))
    return df.select("y", "x", ((F.col(low) * f_high - F.col(high) * f_low) * k).alias("ionosphere"))


def demodulate(df: DataFrame, doppler: float, rate: float, interval: float, inverse: bool = False) -> DataFrame:
    """Turn samples by the azimuth phase -2 pi f t - pi k t² (back again when inverse)."""
    t = F.col("y") * interval
    phase = t * (-2 * math.pi * doppler) - t * t * (math.pi * rate)
    z = Cx.of("i", "q") * (Cx.turn(phase).conj() if inverse else Cx.turn(phase))
    return df.select("y", "x", z.re.alias("i"), z.im.alias("q"))


def three_pass(defo: DataFrame, topo: DataFrame, ratio: Sequence[float]) -> DataFrame:
    """Differential interferogram: turned back by the baseline ratio (degree-one polynomial of y and x) times the topographic phase."""
    met = defo.join(topo.select("y", "x", F.col("phase").alias("topo")), ["y", "x"])
    r = float(ratio[0]) + float(ratio[1]) * F.col("y") + float(ratio[2]) * F.col("x")
    z = Cx.of("i", "q") * Cx.turn(-r * F.col("topo"))
    return met.select("y", "x", F.coalesce(z.re, F.lit(0.0)).alias("i"), F.coalesce(z.im, F.lit(0.0)).alias("q"))


def phase_to_elevation(df: DataFrame, wavelength: float) -> DataFrame:
    """Height from unwrapped phase about the DEM seed of the smallest slope.

    df: y, x, phase, slant, theta, perp, parallel (baselines), flat (look angle less that of the scene's
    middle, radians), dem, slope. Where the effective baseline is 0 the height is null.
    """
    seed = df.where("dem > 0").agg(F.min_by(F.struct("phase", "dem"), F.struct("slope", "y", "x")).alias("s"))
    k = 4 * math.pi / wavelength
    baseline = F.col("parallel") * F.sin("flat") + F.col("perp") * F.cos("flat")
    alpha = F.when(baseline != 0, F.col("slant") * F.sin("theta") / (k * baseline))
    out = df.join(F.broadcast(seed))
    return out.select("y", "x", (F.col("s.dem") - alpha * (F.col("phase") - F.col("s.phase"))).alias("elevation"))


def principal_components(df: DataFrame, bands: Sequence[str], share: float = 99.0) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Components that hold the share of variance, each less its minimum; also all eigenvalues and the vectors.

    One aggregate for the population covariance, one for the minima; signs make each vector's largest entry positive.
    """
    sums = [F.avg(b).alias(f"m{i}") for i, b in enumerate(bands)] + [F.avg(F.col(a) * F.col(b)).alias(f"p{i}_{j}") for i, a in enumerate(bands) for j, b in enumerate(bands) if j >= i]
    r = df.agg(*sums).first()
    n = len(bands)
    mean = np.array([r[f"m{i}"] for i in range(n)])
    cov = np.array([[r[f"p{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)]) - np.outer(mean, mean)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), range(n)])
    keep = int(np.searchsorted(np.cumsum(values) / values.sum() * 100, share - 1e-9)) + 1
    pcs = {f"pc{k + 1}": sum((F.col(b) * float(vectors[i, k]) for i, b in enumerate(bands)), F.lit(0.0)) for k in range(min(keep, n))}
    out = df.withColumns(pcs)
    low = out.agg(*[F.min(p).alias(f"low_{p}") for p in pcs])
    keys = [c for c in df.columns if c not in bands]
    return out.join(F.broadcast(low)).select(*keys, *[(F.col(p) - F.col(f"low_{p}")).alias(p) for p in pcs]), values, vectors


def _complex_tiles(df: DataFrame, kernel, tile: int, halo: int) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = int(pdf.y.min()), int(pdf.x.min())
        a = np.zeros((int(pdf.y.max()) - y0 + 1, int(pdf.x.max()) - x0 + 1), complex)
        a[pdf.y.to_numpy() - y0, pdf.x.to_numpy() - x0] = pdf.i + 1j * pdf.q
        out = kernel(a)
        ty, tx = int(pdf.ty.iloc[0]), int(pdf.tx.iloc[0])
        own = pdf[(pdf.y // tile == ty) & (pdf.x // tile == tx)]
        z = out[own.y.to_numpy() - y0, own.x.to_numpy() - x0]
        return pd.DataFrame({"y": own.y, "x": own.x, "i": z.real, "q": z.imag})

    return tiles(df.select("y", "x", "i", "q"), tile, tile, halo).groupBy("ty", "tx").applyInPandas(run, "y long, x long, i double, q double")


def goldstein(df: DataFrame, alpha: float = 0.5, block: int = 32, smooth: int = 3) -> DataFrame:
    """Blocks' spectra weighted by their own smoothed modulus to the power alpha, added up with triangular weights."""

    def kernel(a: np.ndarray) -> np.ndarray:
        step = block // 4
        tri = 1 - np.abs(np.arange(block) - (block - 1) / 2) / (block / 2)
        w = np.outer(tri, tri)
        padded = np.pad(a, block)
        out, weight = np.zeros_like(padded), np.zeros(padded.shape)
        for y in range(0, padded.shape[0] - block + 1, step):
            for x in range(0, padded.shape[1] - block + 1, step):
                f = np.fft.fft2(padded[y : y + block, x : x + block])
                m = np.abs(f)
                s = sum(np.roll(m, (i, j), (0, 1)) for i in range(-(smooth // 2), smooth // 2 + 1) for j in range(-(smooth // 2), smooth // 2 + 1))
                z = np.fft.ifft2(f * (s / (s.max() or 1)) ** alpha)
                out[y : y + block, x : x + block] += w * z
                weight[y : y + block, x : x + block] += w
        return (out / np.maximum(weight, 1e-12))[block:-block, block:-block]

    return _complex_tiles(df, kernel, tile=block * 4, halo=block)


def _lines(df: DataFrame, along: str, kernel) -> DataFrame:
    """Apply a kernel to whole lines (along x) or columns (along y): no tile width enters the result."""
    other = "y" if along == "x" else "x"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(along)
        z = kernel(pdf.i.to_numpy() + 1j * pdf.q.to_numpy(), pdf[along].to_numpy())
        return pd.DataFrame({"y": pdf.y, "x": pdf.x, "i": z.real, "q": z.imag})

    return df.select("y", "x", "i", "q").groupBy(other).applyInPandas(run, "y long, x long, i double, q double")


def _hamming(f: np.ndarray, width: float, alpha: float) -> np.ndarray:
    return np.where(np.abs(f) <= width / 2, alpha + (1 - alpha) * np.cos(2 * np.pi * f / width), 0)


def band_pass(df: DataFrame, centre: float, bandwidth: float, rate: float, alpha: float = 0.75) -> DataFrame:
    """Range sub-band: mix to its centre, then a Hamming window over its spectrum."""

    def kernel(z: np.ndarray, x: np.ndarray) -> np.ndarray:
        base = z * np.exp(-2j * np.pi * centre * x / rate)
        return np.fft.ifft(np.fft.fft(base) * _hamming(np.fft.fftfreq(len(z), 1 / rate), bandwidth, alpha))

    return _lines(df, "x", kernel)


def azimuth_filter(df: DataFrame, doppler: float, other: float, bandwidth: float, prf: float, alpha: float = 0.75) -> DataFrame:
    """Keep the Doppler band that both acquisitions share."""
    width = max(1.0, 2 * (bandwidth / 2 - abs(doppler - other) / 2))

    def kernel(z: np.ndarray, y: np.ndarray) -> np.ndarray:
        f = (np.fft.fftfreq(len(z), 1 / prf) - (doppler + other) / 2 + prf / 2) % prf - prf / 2
        return np.fft.ifft(np.fft.fft(z) * _hamming(f, width, alpha))

    return _lines(df, "y", kernel)


def range_filter(df: DataFrame, shift: float, bandwidth: float, rate: float, alpha: float = 0.75) -> DataFrame:
    """Keep the range band that both acquisitions share, given the local spectral shift."""

    def kernel(z: np.ndarray, x: np.ndarray) -> np.ndarray:
        f = np.fft.fftfreq(len(z), 1 / rate)
        undo = _hamming(f, bandwidth, alpha)
        w = _hamming(f - shift / 2, bandwidth - abs(shift), alpha)
        return np.fft.ifft(np.fft.fft(z) * np.where(undo > 0, w / np.where(undo > 0, undo, 1), 0))

    return _lines(df, "x", kernel)


def cross_correlation(chips: DataFrame) -> DataFrame:
    """Shift of the secondary chip of every control point by the peak of the FFT correlation, with quality peak over mean.

    chips: gcp, y, x, a, b (pixels of both chips, one chip per control point).
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = (pdf.pivot(index="y", columns="x", values=c).fillna(0).to_numpy() for c in ("a", "b"))
        c = np.abs(np.fft.ifft2(np.fft.fft2(a - a.mean()).conj() * np.fft.fft2(b - b.mean())))
        i, j = np.unravel_index(int(c.argmax()), c.shape)
        dy, dx = (k - n if k > n // 2 else k for k, n in zip((i, j), c.shape, strict=True))
        return pd.DataFrame({"gcp": [pdf.gcp.iloc[0]], "dy": [float(dy)], "dx": [float(dx)], "quality": [float(c.max() / (c.mean() or 1))]})

    return chips.groupBy("gcp").applyInPandas(run, "gcp long, dy double, dx double, quality double")


def fit_warp(gcps: DataFrame, order: int = 1, rms: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares polynomials for the shifts (y, x, dy, dx), control points beyond the residual removed once.

    The normal equations are aggregated in Spark; only they reach the driver.
    """
    terms = [(i, j) for d in range(order + 1) for i, j in [(d - k, k) for k in range(d + 1)]]
    col = lambda i, j: F.pow(F.col("y").cast("double"), F.lit(float(i))) * F.pow(F.col("x").cast("double"), F.lit(float(j)))

    def solve(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        n = len(terms)
        r = df.agg(*[F.sum(col(a[0] + b[0], a[1] + b[1])) for a in terms for b in terms], *[F.sum(col(*a) * F.col(d)) for d in ("dy", "dx") for a in terms]).first()
        m, v = np.array(r[: n * n], float).reshape(n, n), np.array(r[n * n :], float).reshape(2, n)
        return np.linalg.lstsq(m, v[0], rcond=None)[0], np.linalg.lstsq(m, v[1], rcond=None)[0]

    cy, cx = solve(gcps)
    value = lambda c: sum((float(k) * col(*t) for k, t in zip(c, terms, strict=True)), F.lit(0.0))
    good = gcps.where(F.hypot(F.col("dy") - value(cy), F.col("dx") - value(cx)) <= rms)
    return solve(good) if good.limit(len(terms)).count() == len(terms) else (cy, cx)


def sbas(obs: DataFrame, epochs: Sequence[float], reference: int, wavelength: float, least_coherence: float = 0.3, looks: float = 100.0) -> DataFrame:
    """Per pixel, phases of all epochs from a network of interferograms by weighted least squares.

    obs: y, x, ref, sec (epoch numbers), phase, coherence. Returns phases and displacements (mm) per epoch,
    velocity (mm a year), temporal coherence and the number of pairs used.
    """
    n = len(epochs)
    years = np.array(epochs, float) / 365.25
    keep = [k for k in range(n) if k != reference]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """All pixels of the part at once: pairs by pixels, a pair that a pixel lacks weighs nothing."""
        place, pixels = pdf.groupby(["y", "x"], sort=False).ngroup().to_numpy(), pdf[["y", "x"]].drop_duplicates()
        again = pdf.groupby(["y", "x", "ref", "sec"]).cumcount().to_numpy()
        kinds, pair = np.unique(np.stack([pdf.ref, pdf.sec, again], 1), axis=0, return_inverse=True)
        coherence, phases = (np.zeros((len(kinds), len(pixels))) for _ in range(2))
        coherence[pair.ravel(), place], phases[pair.ravel(), place] = pdf.coherence, pdf.phase
        used = coherence >= least_coherence
        a = np.zeros((len(kinds), n))
        a[np.arange(len(kinds)), kinds[:, 1]] += 1
        a[np.arange(len(kinds)), kinds[:, 0]] -= 1
        c = np.minimum(coherence, 0.9999)
        w = np.where(used, 2 * looks * c * c / (1 - c * c), 0.0)
        own, count = a[:, keep], used.sum(0)
        m = (w.T @ (own[:, :, None] * own[:, None, :]).reshape(len(kinds), -1)).reshape(-1, n - 1, n - 1)
        good = (count >= n - 1) & (np.linalg.matrix_rank(m, hermitian=True) == n - 1)
        phase = np.zeros((len(pixels), n))
        if good.any():
            m, right = m[good], ((w * phases).T @ own)[good]
            stiff = np.linalg.cond(m) > 1e10
            m[stiff] += 1e-6 * np.trace(m[stiff], axis1=1, axis2=2)[:, None, None] / (n - 1) * np.eye(n - 1)
            phase[np.ix_(good, keep)] = np.linalg.solve(m, right[:, :, None])[:, :, 0]
        disp = -phase * wavelength / (4 * np.pi) * 1000
        centred = years - years.mean()
        velocity = disp @ centred / max((centred * centred).sum(), 1e-300)
        rest = np.where(used, np.exp(1j * (phases - a @ phase.T)), 0).sum(0)
        none = lambda z: [v if g else None for v, g in zip(z.tolist(), good, strict=True)]
        out = pixels.assign(phase=none(phase), displacement=none(disp), velocity=np.where(good, velocity, np.nan), temporal_coherence=np.where(good, np.abs(rest) / np.maximum(count, 1), np.nan), pairs=count)
        out["phase"], out["displacement"] = ([v or [None] * n for v in out[k]] for k in ("phase", "displacement"))
        return out

    return obs.groupBy("y", (F.col("x") / 64).cast("long").alias("_part")).applyInPandas(run, "y long, x long, phase array<double>, displacement array<double>, velocity double, temporal_coherence double, pairs long")


def alike(kind: str, alpha: float, epochs: int):
    """Test of two amplitude samples of the same length, sorted, for one distribution: (pixels, epochs) each to a flag per pixel.

    ks: Kolmogorov-Smirnov. ad: Anderson-Darling over the pooled ranks (Scholz and Stephens). tlog: the means of
    logarithms, of positive amplitudes, by their standard errors.
    """
    if kind == "ks":
        limit = np.sqrt(-np.log(alpha / 2) / epochs)

        def ks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            # the largest distance of two step functions is at a step of either
            below = lambda p, q: (q[:, None, :] <= p[:, :, None]).mean(2)
            return np.maximum(*(np.abs(below(p, a) - below(p, b)).max(1) for p in (a, b))) <= limit

        return ks
    if kind == "tlog":
        # Two-sided limits of the normal distribution as they are commonly tabled for this test.
        limit = 2.576 if alpha <= 0.01 else 2.326 if alpha <= 0.025 else 1.960

        def tlog(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            with np.errstate(all="ignore"):
                (m, u, n), (w, v, k) = ((np.nanmean(z, 1), np.nanvar(z, 1, ddof=1), (~np.isnan(z)).sum(1)) for z in (np.where(x > 0, np.log(np.where(x > 0, x, 1)), np.nan) for x in (a, b)))
                error = np.sqrt(np.nan_to_num(u) / np.maximum(n, 1) + v / np.maximum(k, 1))
                return (k > 1) & (~(error > 0) | (np.abs(np.nan_to_num(m) - w) <= limit * error))

        return tlog
    # Limits of the standardised two-sample statistic by significance.
    limit = next(t for least, t in ((0.10, 1.226), (0.05, 1.961), (0.025, 2.718), (0.0, 3.752)) if alpha >= least)
    n, j = 2 * epochs, np.arange(1, 2 * epochs)
    inverse, h = 2 / epochs, (1 / j).sum()
    g = sum(1 / ((n - i) * k) for i in range(1, n - 1) for k in range(i + 1, n))
    powers = np.array([(4 * g - 6) + (10 - 6 * g) * inverse, 4 * (2 * g - 4) + 16 * h + (2 * g - 14 * h - 4) * inverse - 8 * h + 4 * g - 6, 4 * (6 * h + 2 * g - 2) + 2 * (4 * h - 4 * g + 6) + (2 * h - 6) * inverse + 4 * h, 4 * (2 * h + 6) - 8 * h])
    variance = np.polyval(powers, n) / ((n - 1.0) * (n - 2) * (n - 3)) if n > 3 else 1.0
    sigma = math.sqrt(variance) if variance > 0 else 1.0

    def ad(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        first = np.argsort(np.concatenate([a, b], 1), 1, kind="stable") < epochs
        count = np.cumsum(first, 1)[:, :-1]
        total = ((n * count - j * epochs) ** 2 / (j * (n - j))).sum(1) * (n - 1) / n**2 * inverse
        return (total - 1) / sigma <= limit

    return ad


def closure_phase(obs: DataFrame) -> DataFrame:
    """Root mean square over all triplets (a, b), (b, c), (a, c) of a pixel's unwrapped phases (y, x, ref, sec, phase) of what they do not close by, wrapped; and their number."""
    pair = lambda r, s, v: obs.select("y", "x", F.col("ref").alias(r), F.col("sec").alias(s), F.col("phase").alias(v))
    met = pair("a", "b", "ab").join(pair("b", "c", "bc"), ["y", "x", "b"]).join(pair("a", "c", "ac"), ["y", "x", "a", "c"])
    rest = F.col("ab") + F.col("bc") - F.col("ac")
    rest = rest - 2 * math.pi * F.ceil((rest - math.pi) / (2 * math.pi))  # beyond -pi, at most pi
    return met.groupBy("y", "x").agg(F.sqrt(F.avg(rest * rest)).alias("rms"), F.count("*").alias("triplets"))


def baselines(grid: DataFrame, reference: DataFrame, secondary: DataFrame) -> DataFrame:
    """Length, parallel and perpendicular baseline (positive where the secondary sees a steeper angle) at each cell (y, x, lat, lon, h).

    Both positions are where the cell lies across the track; null where either orbit never passes it.
    """
    first, second = orbit_of(reference), orbit_of(secondary)

    def run(it):
        for pdf in it:
            ground = ecef(pdf.lat.to_numpy(float), pdf.lon.to_numpy(float), pdf.h.to_numpy(float))
            (t, r), (u, q) = first.zero_doppler(ground), second.zero_doppler(ground)
            m, n = (o.at(np.nan_to_num(w, nan=o.t0))[0] for o, w in ((first, t), (second, u)))
            length = np.linalg.norm(n - m, axis=1)
            parallel = r - q
            cosine = lambda p: ((p - ground) * ground).sum(1) / (np.linalg.norm(p - ground, axis=1) * np.linalg.norm(ground, axis=1))
            perpendicular = np.sqrt(np.maximum(length**2 - parallel**2, 0)) * np.where(cosine(n) > cosine(m), 1, -1)
            none = np.isnan(t) | np.isnan(u)
            yield pd.DataFrame({"y": pdf.y, "x": pdf.x, **{k: np.where(none, np.nan, v) for k, v in (("length", length), ("parallel", parallel), ("perpendicular", perpendicular))}})

    out = grid.select("y", "x", "lat", "lon", "h").mapInPandas(run, "y long, x long, length double, parallel double, perpendicular double")
    return out.select("y", "x", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("length", "parallel", "perpendicular")])


def phase_to_height(df: DataFrame, reference: DataFrame, secondary: DataFrame, sensor: Sensor, wavelength: float, lines: int, samples: int, points: int = 12, heights: int = 3, degree: int = 2, degree2: int = 3, highest: float = 5000.0, side: str = "right") -> DataFrame:
    """Height of unwrapped topographic phase (y, x, phase), by polynomials that are fitted to the geometry.

    At a grid of points x points places the phases of some heights above the ellipsoid are computed from both
    orbits; a polynomial of the phase gives the height at each place, and one of line and sample its
    coefficients everywhere. The fits are of bounded size; pixels are then one column expression.
    """
    first, second = orbit_of(reference), orbit_of(secondary)
    yy, xx = (z.ravel() for z in np.meshgrid(np.linspace(0, max(lines - 1, 1), points), np.linspace(0, max(samples - 1, 1), points), indexing="ij"))
    levels = np.linspace(0, highest, heights)
    phase = np.empty((heights, len(yy)))
    for k, h in enumerate(levels):
        ground = ground_of(first, sensor, yy, xx, np.full(len(yy), h), side)
        phase[k] = -4 * math.pi / wavelength * (sensor.near_range + xx * sensor.spacing - second.zero_doppler(ground)[1])
    phase -= phase[0].copy()
    scale = float(np.abs(phase).max()) or 1.0
    alphas = np.array([np.polyfit(phase[:, i] / scale, levels, degree) for i in range(len(yy))])  # highest power first
    powers = [(i, j) for i in range(degree2 + 1) for j in range(degree2 + 1 - i)]
    ny, nx = max(lines - 1, 1), max(samples - 1, 1)
    fit, *_ = np.linalg.lstsq(np.stack([(yy / ny) ** i * (xx / nx) ** j for i, j in powers], 1), alphas, rcond=None)
    y, x, out = F.col("y") / ny, F.col("x") / nx, F.lit(0.0)
    for k in range(degree + 1):
        own = sum((float(c) * F.pow(y, F.lit(float(i))) * F.pow(x, F.lit(float(j))) for c, (i, j) in zip(fit[:, k], powers, strict=True)), F.lit(0.0))
        out = out * (F.col("phase") / scale) + own
    return df.select("y", "x", out.alias("height"))


def phase_linking(stack: DataFrame, epochs: int, size: int = 7, least: int = 8, alpha: float = 0.05, estimator: str = "evd", tile: int = 32, selector: str = "ks") -> DataFrame:
    """Per pixel one phase per epoch from the coherence matrix of its statistically alike neighbours (by the selector ks, ad or tlog).

    stack: y, x, epoch (0..n-1), i, q. estimator: evd (largest eigenvector) or emi (smallest of the inverse-modulus
    weighted matrix). Pixels with too few alike neighbours keep their own phases.
    """
    h, test = size // 2, alike(selector, alpha, epochs)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = int(pdf.y.min()), int(pdf.x.min())
        z = np.full((int(pdf.y.max()) - y0 + 1, int(pdf.x.max()) - x0 + 1, epochs), np.nan, complex)
        z[pdf.y.to_numpy() - y0, pdf.x.to_numpy() - x0, pdf.epoch.to_numpy()] = pdf.i + 1j * pdf.q
        ordered = np.sort(np.abs(z), -1)
        ty, tx = int(pdf.ty.iloc[0]), int(pdf.tx.iloc[0])
        own = pdf[(pdf.y // tile == ty) & (pdf.x // tile == tx)][["y", "x"]].drop_duplicates()
        if not len(own):  # beyond the scene's last line or column there is only the halo
            return pd.DataFrame({"y": [], "x": [], "phase": pd.Series(dtype=object), "temporal_coherence": [], "alike": []})
        at, to = own.y.to_numpy() - y0, own.x.to_numpy() - x0
        mine, height, width = ordered[at, to], *z.shape[:2]
        count, power = np.zeros(len(own), int), np.zeros((len(own), epochs))
        c = np.zeros((len(own), epochs, epochs), complex)
        for dy, dx in ((i, j) for i in range(-h, h + 1) for j in range(-h, h + 1)):
            yy, xx = np.clip(at + dy, 0, height - 1), np.clip(to + dx, 0, width - 1)
            other, near = ordered[yy, xx], z[yy, xx]
            inside = (yy == at + dy) & (xx == to + dx) & ~np.isnan(near).any(1)
            like = inside & test(mine, other)
            part = np.where(like[:, None], near, 0)
            count += like
            power += np.abs(part) ** 2
            c += part[:, :, None] * part[:, None, :].conj()
        with np.errstate(all="ignore"):
            c /= np.sqrt(power[:, :, None] * power[:, None, :])
            first = z[at, to]
            phase, gamma = np.angle(first * first[:, :1].conj()), np.zeros(len(own))
        good = (count >= least) & ~np.isnan(c).any((1, 2))
        if good.any():
            c = c[good]
            if estimator == "emi":
                v = np.linalg.eigh(np.linalg.pinv(np.abs(c) + 1e-6 * np.eye(epochs), hermitian=True) * c)[1][:, :, 0]
            else:
                v = np.linalg.eigh(c)[1][:, :, -1]
            phase[good] = np.angle(v * v[:, :1].conj())
            i, j = np.triu_indices(epochs, 1)
            linked = phase[good]
            gamma[good] = np.exp(1j * (np.angle(c[:, i, j]) - (linked[:, i] - linked[:, j]))).mean(1).real if epochs > 1 else 1.0
        return own.assign(phase=phase.tolist(), temporal_coherence=gamma, alike=count)

    return tiles(stack, tile, tile, h).groupBy("ty", "tx").applyInPandas(run, "y long, x long, phase array<double>, temporal_coherence double, alike long")


def offset_velocity(gcps: DataFrame, spacing_y: float, spacing_x: float, days: float, most: float, size: int = 3) -> DataFrame:
    """Velocity of control points (gy, gx, dy, dx): too fast ones are holes, shifts averaged locally, holes left null."""
    v = lambda dy, dx: F.hypot(dy * spacing_y, dx * spacing_x) / days
    ok = v(F.col("dy"), F.col("dx")) <= most
    grid = gcps.select(F.col("gy").alias("y"), F.col("gx").alias("x"), ok.alias("ok"), F.when(ok, F.col("dy")).alias("dy"), F.when(ok, F.col("dx")).alias("dx"))
    s = box_sums(grid, {"sy": F.col("dy"), "sx": F.col("dx"), "n": F.when(F.col("ok"), 1.0)}, size).where("ok")
    mean = s.select(F.col("y").alias("gy"), F.col("x").alias("gx"), (F.col("sy") / F.col("n")).alias("my"), (F.col("sx") / F.col("n")).alias("mx"))
    return gcps.select("gy", "gx").join(mean, ["gy", "gx"], "left").select("gy", "gx", v(F.col("my"), F.col("mx")).alias("velocity"))


def topo_phase_removal(ifg: DataFrame, located: DataFrame, wavelength: float) -> DataFrame:
    """Turn an interferogram back by the phase of the terrain's range difference.

    located: y, x, range1, range2: slant ranges of each pixel's terrain point in both acquisitions.
    """
    met = ifg.join(located, ["y", "x"])
    phase = 4 * math.pi / wavelength * (F.col("range1") - F.col("range2"))
    z = Cx.of("i", "q") * Cx.turn(phase)
    return met.select("y", "x", z.re.alias("i"), z.im.alias("q"))


def cross_resample(df: DataFrame, line: Sequence[float], sample: Sequence[float]) -> DataFrame:
    """Nearest-sample resampling by degree-one polynomials of (y, x) for source line and sample."""
    at = lambda c: F.floor(float(c[0]) + float(c[1]) * F.col("y") + float(c[2]) * F.col("x") + 0.5).cast("long")
    places = df.select("y", "x", at(line).alias("sy"), at(sample).alias("sx"))
    return places.join(df.select(F.col("y").alias("sy"), F.col("x").alias("sx"), "v"), ["sy", "sx"]).select("y", "x", "v")


def unwrapping_export(df: DataFrame, coherence_: DataFrame) -> DataFrame:
    """What an external unwrapper needs: wrapped phase and coherence per pixel of one grid."""
    return df.select("y", "x", Cx.of("i", "q").arg().alias("phase")).join(coherence_.select("y", "x", "coherence"), ["y", "x"])


def unwrapping_import(wrapped: DataFrame, unwrapped: DataFrame) -> DataFrame:
    """Unwrapped phase back on the interferogram's grid, with the whole turns it adds."""
    met = wrapped.select("y", "x", F.col("phase").alias("wrapped")).join(unwrapped.select("y", "x", F.col("phase").alias("unwrapped")), ["y", "x"])
    return met.withColumn("turns", F.round((F.col("unwrapped") - F.col("wrapped")) / (2 * math.pi)).cast("long"))


def smooth_gaussian(df: DataFrame, sigma: float, value: str = "v", weight: str = "w") -> DataFrame:
    """Weighted Gaussian mean over a window of three sigmas, in two passes: the dispersive phase's smoothing."""
    h = max(1, int(math.ceil(3 * sigma)))
    kernel = df.sparkSession.createDataFrame([(k, math.exp(-k * k / (2 * sigma * sigma))) for k in range(-h, h + 1)], "d long, g double")
    out = df.select("y", "x", (F.col(value) * F.col(weight)).alias("n"), F.col(weight).alias("m"))
    for axis in ("x", "y"):
        spread = out.join(F.broadcast(kernel)).withColumn(axis, F.col(axis) + F.col("d"))
        out = spread.groupBy("y", "x").agg(F.sum(F.col("n") * F.col("g")).alias("n"), F.sum(F.col("m") * F.col("g")).alias("m"))
    return df.select("y", "x").join(out, ["y", "x"]).select("y", "x", (F.col("n") / F.col("m")).alias(value))
