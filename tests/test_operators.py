"""Operators against values worked out by hand or from how the input was made."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import calibration, coregistration, detection, filters, geometry, insar, matrix_filters, polarimetry, polarimetry_models, raster, soil, topsar
from rasterloom.plans import catalog
from rasterloom.sources import formats


def ramp(spark, height=4, width=16):
    return spark.range(height * width).select(F.expr(f"id div {width}").alias("y"), (F.col("id") % width).alias("x"), (F.col("id") + 1).cast("double").alias("v"))


def test_multilook_of_amplitude_ramp(spark):
    looks = raster.square_looks(4, 0.5, 2.0, 30.0, ground_range=False)
    assert looks == 2
    got = [r["v"] for r in raster.multilook(ramp(spark), looks, 4, unit="amplitude").orderBy("y", "x").collect()]
    assert got == pytest.approx([13.247642, 16.598192, 20.186628, 23.906067, 43.260838, 47.1964, 51.14196, 55.09537], abs=1e-4)


def test_blocks_cut_by_the_edge_are_dropped(spark):
    assert raster.multilook(ramp(spark), 3, 5).count() == 3


def test_sbas_recovers_the_epochs(spark):
    pairs = [(0, 1), (1, 2), (2, 3), (3, 4), (0, 2), (2, 4), (0, 4)]
    obs = spark.createDataFrame([(0, x, a, b, (b - a) * 0.3, 0.9) for x in range(3) for a, b in pairs], "y long, x long, ref int, sec int, phase double, coherence double")
    for r in insar.sbas(obs, [0, 12, 24, 36, 48], 2, 0.0555).collect():
        assert r["phase"] == pytest.approx([(i - 2) * 0.3 for i in range(5)], abs=1e-9)
        assert r["pairs"] == 7 and r["temporal_coherence"] == pytest.approx(1.0)


def test_sbas_without_a_connected_network_gives_nothing(spark):
    obs = spark.createDataFrame([(0, 0, 0, 1, 0.3, 0.9), (0, 0, 3, 4, 0.3, 0.1)], "y long, x long, ref int, sec int, phase double, coherence double")
    assert insar.sbas(obs, [0, 12, 24, 36, 48], 2, 0.0555).first()["velocity"] is None


def test_phase_linking_recovers_a_ramp(spark):
    rng = np.random.default_rng(1)
    rows = []
    for y in range(7):
        for x in range(7):
            for k in range(5):
                p = 0.5 * k + rng.normal(0, 0.2)
                rows.append((y, x, k, math.cos(p), math.sin(p)))
    z = spark.createDataFrame(rows, "y long, x long, epoch int, i double, q double")
    for estimator in ("evd", "emi"):
        r = insar.phase_linking(z, 5, estimator=estimator).where("y = 3 and x = 3").first()
        assert np.angle(np.exp(1j * (np.array(r["phase"]) - 0.5 * np.arange(5)))) == pytest.approx(np.zeros(5), abs=0.2)


def test_clusters_are_global(spark):
    line = spark.createDataFrame([(y, y) for y in range(60)] + [(5, 40), (6, 41), (90, 1)], "y long, x long")
    sizes = sorted(r["size"] for r in detection.oil_spill_clusters(line, 2).groupBy("cluster").agg(F.first("size").alias("size")).collect())
    assert sizes == [2, 60]


def test_cross_correlation_finds_the_shift(spark):
    rng = np.random.default_rng(2)
    a = rng.random((32, 32))
    b = np.roll(a, (3, -5), (0, 1))
    chips = spark.createDataFrame([(1, y, x, float(a[y, x]), float(b[y, x])) for y in range(32) for x in range(32)], "gcp long, y long, x long, a double, b double")
    r = insar.cross_correlation(chips).first()
    assert (r["dy"], r["dx"]) == (3.0, -5.0) and r["quality"] > 5


def test_oversampling_keeps_the_samples(spark):
    got = {(r["y"], r["x"]): r["v"] for r in raster.oversample(ramp(spark, 8, 8), 2).collect()}
    assert len(got) == 256
    for r in ramp(spark, 8, 8).collect():
        assert got[2 * r["y"], 2 * r["x"]] == pytest.approx(r["v"], abs=1e-9)


@pytest.mark.parametrize("kind", ["refined_lee", "lee_sigma", "idan", "mulog"])
def test_speckle_filters_leave_a_flat_scene(spark, kind):
    flat = ramp(spark, 20, 20).withColumn("v", F.lit(5.0))
    assert [r["v"] for r in getattr(filters, kind)(flat, looks=4.0).select("v").distinct().collect()] == pytest.approx([5.0] * 1, abs=1e-6) or all(abs(r["v"] - 5.0) < 1e-6 for r in getattr(filters, kind)(flat, looks=4.0).collect())


def test_tiles_show_no_border(spark):
    s = ramp(spark, 40, 40).withColumn("v", F.abs(F.sin("v")) * 10 + 1)
    a = {(r["y"], r["x"]): r["v"] for r in filters.tiled(s, lambda g: g * 2 + np.nanmin(filters._windows(g, 5), (-2, -1)), 2, tile=16).collect()}
    b = {(r["y"], r["x"]): r["v"] for r in filters.tiled(s, lambda g: g * 2 + np.nanmin(filters._windows(g, 5), (-2, -1)), 2, tile=64).collect()}
    assert a == b


@pytest.mark.parametrize(("entropy", "alpha", "zone"), [(0.95, 60, 1), (0.95, 50, 2), (0.95, 30, 3), (0.7, 60, 4), (0.7, 45, 5), (0.7, 30, 6), (0.2, 60, 7), (0.2, 45, 8), (0.2, 10, 9)])
def test_zones(spark, entropy, alpha, zone):
    assert spark.range(1).select(polarimetry.zone(F.lit(entropy), F.lit(float(alpha)))).first()[0] == zone


def test_eigenvalues_of_a_trihedral(spark):
    s = spark.createDataFrame([(0, 0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0)], "y long, x long, hh_i double, hh_q double, hv_i double, hv_q double, vh_i double, vh_q double, vv_i double, vv_q double")
    r = polarimetry.h_a_alpha(polarimetry.matrix(s, "T3")).first()
    assert r["entropy"] == pytest.approx(0, abs=1e-9) and r["alpha"] == pytest.approx(0, abs=1e-6) and r["lambda1"] == pytest.approx(2)
    k = polarimetry.krogager(s).first()
    assert (k["sphere"], k["diplane"]) == pytest.approx((1.0, 0.0))


def test_asof_holds_at_the_ends(spark):
    knots = spark.createDataFrame([(0.0, 1.0), (10.0, 3.0)], "k double, g double")
    points = spark.createDataFrame([(-5.0,), (0.0,), (2.5,), (10.0,), (99.0,)], "t double")
    assert [r["g"] for r in calibration.asof(points, knots, "t", "k", "g").orderBy("t").collect()] == [1.0, 1.0, 1.5, 3.0, 3.0]


def test_arcs_must_connect():
    assert topsar.integrate_arcs([(0, 1, 0.2, 1.0), (1, 2, 0.1, 1.0)], 3) == pytest.approx([0, 0.2, 0.3])
    with pytest.raises(ValueError):
        topsar.integrate_arcs([(0, 1, 0.2, 1.0)], 3)


def test_empty_scene(spark):
    empty = ramp(spark).where("v < 0")
    assert raster.multilook(empty, 2, 2).count() == 0
    assert filters.boxcar(empty, 3).count() == 0
    assert detection.clusters(empty.select("y", "x")).count() == 0


def test_zero_doppler_of_a_straight_pass(spark):
    o = geometry.orbit_of(catalog.orbit(spark))
    g = geometry.ecef(np.array([45.0, 45.2, 45.4]), np.array([7.0, 7.1, 7.3]), np.array([0.0, 500.0, 1000.0]))
    t, r = o.zero_doppler(g)
    p0, v = o.at(np.zeros(1))
    want = ((g - p0) * v).sum(-1) / (v * v).sum(-1)
    assert t == pytest.approx(want, abs=1e-6)
    assert r == pytest.approx(np.linalg.norm(g - p0 - want[:, None] * v, axis=-1), abs=1e-3)
    assert np.isnan(o.zero_doppler(geometry.ecef(np.array([-45.0]), np.array([7.0]), np.array([0.0])))[0]).all()


def test_resampling_reproduces_a_plane(spark):
    image = ramp(spark, 6, 6).withColumn("v", F.col("y") * 10.0 + F.col("x"))
    places = spark.createDataFrame([(0, 0, 1.25, 2.5), (0, 1, 4.0, 5.0), (0, 2, 5.5, 1.0), (0, 3, None, None)], "y long, x long, line double, sample double")
    got = {r["x"]: r["v"] for r in geometry.resample(places, image).collect()}
    assert got[0] == pytest.approx(15.0) and got[1] == pytest.approx(45.0) and got[2] is None and got[3] is None


def test_binary_rasters_round_trip(spark, tmp_path):
    tile = formats.encode_bsq(ramp(spark, 4, 4), ["v"], 4).first()
    (tmp_path / "a.img").write_bytes(tile["content"])
    meta = formats.header(tile["header"])
    got = {(r["y"], r["x"]): r["v"] for r in formats.read_bsq(spark, str(tmp_path / "a.img"), meta, ["v"]).collect()}
    assert got == {(r["y"], r["x"]): r["v"] for r in ramp(spark, 4, 4).collect()}


# ------------------------------------------------------------------ hand-worked decompositions


def t3_row(spark, **own):
    names = ["t11", "t22", "t33", "t12_re", "t12_im", "t13_re", "t13_im", "t23_re", "t23_im"]
    return spark.createDataFrame([(0, 0, *(float(own.get(k, 0.0)) for k in names))], "y long, x long, " + ", ".join(f"{k} double" for k in names))


def c3_row(spark, c11, c22, c33, re, im=0.0):
    return spark.createDataFrame([(0, 0, c11, c22, c33, re, im)], "y long, x long, c11 double, c22 double, c33 double, c13_re double, c13_im double")


@pytest.mark.parametrize(("matrix", "want"), [
    ((3 / 8, 1 / 4, 3 / 8, 1 / 8), (0, 0, 1)),  # nothing but volume: it takes all of the co-polarised channels
    ((1.0, 0.0, 1.0, 0.9), (1.9, 0.1, 0)),  # fd = 0.19 / 3.8, fs = 0.95, beta = 1
    ((1.0, 0.0, 1.0, -0.9), (0.1, 1.9, 0)),
    ((1.0, 0.0, 1.0, 2.0), (2.0, 0, 0)),  # correlation drawn back to 1
    ((0.1, 0.4, 3.0, 0.0), (0, 0, 1.6)),  # volume beyond c11
])
def test_three_powers(spark, matrix, want):
    r = polarimetry.freeman_durden(c3_row(spark, *matrix)).first()
    assert (r["surface"], r["double"], r["volume"]) == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize(("matrix", "want"), [
    # balanced channels: pv = 0.2 / 0.25, s = 2 - 0.4, d = 0.6 - 0.2, c = 0.01
    (dict(t11=2, t22=0.6, t33=0.2, t12_re=0.1), (1.6 + 0.01 / 1.6, 0.4 - 0.01 / 1.6, 0.8, 0)),
    # helix takes 0.2: pv = (0.2 - 0.1) / 0.25, d = 0.6 - 0.1 - 0.1
    (dict(t11=2, t22=0.6, t33=0.2, t12_re=0.1, t23_im=0.1), (1.8 + 0.01 / 1.8, 0.4 - 0.01 / 1.8, 0.4, 0.2)),
    # c11 twice c33: pv = 0.2 * 15 / 4, k1 = 1/6, k2 = 7/30
    (dict(t11=2, t22=0.6, t33=0.2, t12_re=0.5), (1.625 + 0.375**2 / 1.625, 0.425 - 0.375**2 / 1.625, 0.75, 0)),
    # double bounce stronger: c13_re - c22 / 2 below 0
    (dict(t11=0.6, t22=2, t33=0.2, t12_re=0.1), (0.2 - 0.01 / 1.8, 1.8 + 0.01 / 1.8, 0.8, 0)),
    # more volume than there is power
    (dict(t11=0.1, t22=0.1, t33=0.2), (0, 0, 0.4, 0)),
    # no volume left beside the helix: three components, the helix is dropped
    (dict(t11=2, t22=0.6, t33=0.1, t23_im=0.2), None),
])
def test_four_powers(spark, matrix, want):
    r = polarimetry.yamaguchi(t3_row(spark, **matrix)).first()
    got = (r["surface"], r["double"], r["volume"], r["helix"])
    if want is None:
        three = polarimetry.freeman_durden(c3_row(spark, 1.3, 0.1, 1.3, 0.7)).first()
        want = (three["surface"], three["double"], 0.4, 0)
    assert got == pytest.approx(want, abs=1e-9)


def test_model_free_four_components(spark):
    r = polarimetry.mf4cf(t3_row(spark, t11=1)).first()
    assert (r["surface"], r["double"], r["volume"], r["helix"], r["theta"]) == pytest.approx((1, 0, 0, 0, 45), abs=1e-9)
    r = polarimetry.mf4cf(t3_row(spark, t22=1, t33=1, t23_im=1)).first()
    assert (r["surface"], r["double"], r["volume"], r["helix"], r["tau"]) == pytest.approx((0, 0, 0, 2, 45), abs=1e-9)
    r = polarimetry.mf4cf(t3_row(spark, t11=1, t22=1, t33=1)).first()
    assert (r["volume"], r["helix"]) == pytest.approx((3, 0), abs=1e-6)


def test_touzi_turns_handedness_beyond_an_eighth(spark):
    # eigenvector (1, -1 + j/2, 0): psi is a quarter turn, the turned phase -atan(1/2) changes its sign
    r = polarimetry.touzi(t3_row(spark, t11=1, t22=1.25, t12_re=-1, t12_im=-0.5)).first()
    assert (abs(r["psi"]), r["tau"], r["phi"], r["alpha_s"]) == pytest.approx((math.pi / 2, 0, math.atan(0.5), math.atan(math.sqrt(1.25))), abs=1e-6)


def test_general_parameters(spark):
    r = polarimetry.parameters(t3_row(spark, t11=1, t22=1, t33=1)).first()
    assert (r["span"], r["pedestal"], r["rvi"]) == pytest.approx((6, 1, 4 / 3))


def c2_rows(spark, rows):
    return spark.createDataFrame([(0, k, *map(float, r)) for k, r in enumerate(rows)], "y long, x long, c11 double, c22 double, c12_re double, c12_im double")


def test_dual_pol_three_powers(spark):
    got = [tuple(r)[2:] for r in polarimetry.y3(c2_rows(spark, [(3, 1, 0.5, 0), (3, 1, -0.5, 0), (0.5, 2, 0.1, 0)])).orderBy("x").collect()]
    assert got == [pytest.approx(w) for w in [(2, 0, 2), (0, 2, 2), (1.5, 0, 1)]]
    assert tuple(polarimetry.y3(c2_rows(spark, [(3, 0.5, 1, 0)]), "dipole").first())[2:] == pytest.approx((1.5, 0, 2))


def test_surface_index_scales_by_percentiles(spark):
    rows = [(10 + k, 10, 0, 0) for k in range(101)]  # |g1| from 0 to 100: 5 and 95 are the percentiles
    got = [r["surface_index"] for r in polarimetry.surface_index(c2_rows(spark, rows), nesz=13.0).orderBy("x").collect()]

    def want(k):
        p = (10 + k) / (20 + k)
        h = -(p * math.log2(p) + (1 - p) * math.log2(1 - p))
        left = math.sqrt(1 - (min(max(k, 5), 95) / 95) ** 2)
        return left * (1 - h if 10 * math.log10(10 + k) > 13 else 1)

    assert got == pytest.approx([want(k) for k in range(101)], abs=1e-9)


def test_quantiles_are_exact_over_many_values(spark, monkeypatch):
    from rasterloom.functions import quantiles

    monkeypatch.setattr(quantiles, "FEW", 50)
    monkeypatch.setattr(quantiles, "BINS", 7)
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(size=3000) ** 3, np.full(500, 0.25), rng.integers(0, 5, 400)])
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,), (float("nan"),)], "v double")
    shares = (0.0, 0.05, 0.5, 0.95, 0.999, 1.0)
    assert quantiles.quantiles(df, F.col("v"), shares) == pytest.approx(np.quantile(v, shares).tolist(), abs=1e-12)
    assert quantiles.quantiles(df.where("v is null"), F.col("v"), (0.5,)) == [None]


def test_tropospheric_fit(spark):
    rows = [(0, x, 3 + 0.02 * h - 1e-5 * h * h, float(h), 0.9) for x, h in enumerate(range(100, 2000, 100))]
    df = spark.createDataFrame(rows, "y long, x long, phase double, height double, coherence double")
    assert [r["phase"] for r in insar.tropo(df, 0.5, 0.0, 1, degree=2).collect()] == pytest.approx([0.0] * 19, abs=1e-9)
    linear = df.withColumn("phase", 3 + 0.02 * F.col("height"))
    assert [r["phase"] for r in insar.tropo(linear, 0.5, 0.0, 1).collect()] == pytest.approx([0.0] * 19, abs=1e-9)
    # ten samples for two coefficients, fifteen for three
    for degree, least in ((1, 10), (2, 15)):
        changed = [insar.tropo(df.limit(n), 0.5, 0.0, 1, degree=degree).first()["phase"] != df.first()["phase"] for n in (least - 1, least)]
        assert changed == [False, True]


def test_elevation_uses_both_baselines(spark):
    rows = [(0, 0, 1.0, 8e5, 0.6, 150.0, 40.0, 0.0, 500.0, 0.0), (0, 1, 2.0, 8e5, 0.6, 150.0, 40.0, 0.05, 0.0, 1.0), (0, 2, 2.0, 8e5, 0.6, 0.0, 0.0, 0.05, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "y long, x long, phase double, slant double, theta double, perp double, parallel double, flat double, dem double, slope double")
    got = [r["elevation"] for r in insar.phase_to_elevation(df, 0.0555).orderBy("x").collect()]
    alpha = 8e5 * math.sin(0.6) / (4 * math.pi / 0.0555 * (40 * math.sin(0.05) + 150 * math.cos(0.05)))
    assert got[:2] == pytest.approx([500.0, 500.0 - alpha]) and got[2] is None


def test_asof_with_keys_ends_and_gaps(spark):
    knots = spark.createDataFrame([("a", 0.0, 1.0), ("a", 0.1, 2.0), ("a", 100.0, 0.0), ("b", 5.0, 7.0), ("b", None, 9.0)], "k string, at double, v double")
    points = spark.createDataFrame([("a", x) for x in (-5.0, 0.0, 0.05, 0.1, 50.05, 100.0, 200.0, None)] + [("b", 1.0), ("b", 9.0), ("c", 1.0)], "k string, x double")
    got = {(r["k"], r["x"]): r["v"] for r in calibration.asof(points, knots, "x", "at", "v", ["k"]).collect()}
    assert got == {("a", -5.0): 1.0, ("a", 0.0): 1.0, ("a", 0.05): pytest.approx(1.5), ("a", 0.1): 2.0, ("a", 50.05): pytest.approx(1.0), ("a", 100.0): 0.0, ("a", 200.0): 0.0, ("a", None): None, ("b", 1.0): 7.0, ("b", 9.0): 7.0, ("c", 1.0): None}
    assert calibration.asof(points.drop("k"), knots.limit(0).drop("k"), "x", "at", "v").where("v is not null").count() == 0


def test_model_function_of_the_sea():
    # upwind is brighter than downwind, both than crosswind; brighter with the wind, darker with the angle
    at = lambda v, c, theta: float(detection.cmod5(np.array([v]), c, theta)[0])
    assert at(10, 1, 35) > at(10, -1, 35) > at(10, 0, 35) > 0
    assert at(15, 0, 35) > at(5, 0, 35) and at(10, 0, 25) > at(10, 0, 45)
    assert 10 * math.log10(at(10, 1, 40)) == pytest.approx(-12.4, abs=1.0)


@pytest.mark.parametrize("angle", [20, 70, 110, 160])
def test_wind_blows_along_the_streaks_spectrum(spark, angle):
    size, rng = 60, np.random.default_rng(4)
    y, x = np.mgrid[:size, : size + 7]
    wave = np.zeros(y.shape)
    for _ in range(150):  # streaks: many waves along one direction, up the image
        f, phi = rng.uniform(3, 16), math.radians(angle + rng.normal(0, 6))
        wave += np.cos(2 * math.pi * (f / size * (x * math.cos(phi) - y * math.sin(phi)) + rng.random()))
    power = 0.1 * (1 + 0.3 * wave / wave.std())
    rows = [(int(a), int(b), float(power[a, b]) if (a, b) != (3, 3) else None, 35.0) for a, b in zip(y.ravel(), x.ravel(), strict=True)]
    out = detection.wind_field(spark.createDataFrame(rows, "y long, x long, v double, theta double"), size, 10.0).collect()
    assert len(out) == 1 and (out[0]["y"], out[0]["x"]) == (30, 30) and out[0]["dx"] < 0 and 0 < out[0]["ratio"] < 1
    found = math.degrees(math.atan2(out[0]["dy"], out[0]["dx"])) % 180
    assert abs((found - angle - 90 + 90) % 180 - 90) < 12 and 0.1 <= out[0]["speed"] <= 20


# ------------------------------------------------------------------ matrix filters and classifiers


def speckled(spark, left, right, size=24, looks=1, seed=5):
    """C2 of two halves of a scene with speckle, as rows."""
    rng = np.random.default_rng(seed)
    rows = []
    for y in range(size):
        for x in range(size):
            a, b = left if x < size // 2 else right
            z = (rng.normal(size=(2, looks)) + 1j * rng.normal(size=(2, looks))) / math.sqrt(2) * np.sqrt([[a], [b]])
            c = z @ z.conj().T / looks
            rows.append((y, x, c[0, 0].real, c[0, 1].real, c[0, 1].imag, c[1, 1].real))
    return spark.createDataFrame([(y, x, *map(float, v)) for y, x, *v in rows], "y long, x long, c11 double, c12_re double, c12_im double, c22 double")


@pytest.mark.parametrize("kind", ["refined_lee", "lee_sigma", "idan", "non_local"])
def test_matrix_filters_smooth_and_keep_edges(spark, kind):
    looks = 1 if kind == "non_local" else 4
    df = speckled(spark, (1.0, 0.5), (20.0, 10.0), looks=4)
    out = getattr(matrix_filters, kind)(df, 2, "c", looks=looks).toPandas()
    raw = df.toPandas()
    assert len(out) == 576 and list(out.columns) == ["y", "x", "c11", "c12_re", "c12_im", "c22"] and not out.isna().any().any()
    for side in (out.x < 9, out.x > 14):
        own = raw.set_index(["y", "x"]).c11.reindex(list(zip(out[side].y, out[side].x, strict=True)))
        assert out[side].c11.std() < 0.75 * own.std() and abs(out[side].c11.mean() / own.mean() - 1) < 0.25
    assert out[out.x > 14].c11.mean() > 10 * out[out.x < 9].c11.mean()


@pytest.mark.parametrize("kind", ["refined_lee", "lee_sigma", "idan", "non_local"])
def test_matrix_filters_do_not_show_tiles(spark, kind, monkeypatch):
    df = speckled(spark, (1.0, 0.5), (3.0, 1.0), size=30)
    run = lambda: getattr(matrix_filters, kind)(df, 2, "c").toPandas().sort_values(["y", "x"]).to_numpy()
    whole = run()
    monkeypatch.setattr(matrix_filters, "TILE", 11)
    assert np.allclose(whole, run(), atol=1e-9)


def test_refined_lee_of_a_window_by_hand(spark):
    # a step: the pixel at its foot is filtered with the dark half only, which does not vary: weight undefined, value 0
    rows = [(y, x, 1.0 if x < 4 else 9.0, 0.0, 0.0, 0.0) for y in range(7) for x in range(7)]
    df = spark.createDataFrame(rows, "y long, x long, c11 double, c12_re double, c12_im double, c22 double")
    r = {(q["y"], q["x"]): q["c11"] for q in matrix_filters.refined_lee(df, 2, "c").collect()}
    assert r[3, 3] == 0.0
    # at the border the window is cut: its own mean and variance, here columns 0 to 3, all 1
    assert r[3, 0] == 0.0
    v = np.array([[1.0 if x < 4 else 9.0 for x in range(1, 7)]] * 7)
    var = v.var(ddof=1)
    weight = max((var - v.mean() ** 2) / 2, 0) / var
    assert r[3, 4] == pytest.approx(v.mean() + weight * (9 - v.mean()))


def test_classes_keep_their_mechanism(spark):
    rows = []
    for y in range(12):
        for x in range(12):
            strong = 1 + 0.1 * ((y * 12 + x) % 7)
            t = {0: (strong, 0.1, 0.05), 1: (0.1, strong, 0.05), 2: (0.5 * strong, 0.4 * strong, 0.4 * strong)}[x // 4]
            rows.append((y, x, t[0], 0.0, 0.0, 0.0, 0.0, t[1], 0.0, 0.0, t[2]))
    t3 = spark.createDataFrame(rows, "y long, x long, " + ", ".join(f"{e} double" for e in polarimetry.elements(3, "t")))
    powers = t3.select("y", "x", F.when(F.col("x") < 4, 1.0).otherwise(0.1).alias("surface"), F.when(F.col("x").between(4, 7), 1.0).otherwise(0.1).alias("double"), F.when(F.col("x") > 7, F.col("t11") * 3).otherwise(0.1).alias("volume"))
    out = polarimetry.scattering_wishart(t3, powers, clusters=4, final=5).toPandas()
    assert len(out) == 144 and (out.category == out.x // 4).all() and (out["class"] // 4 == out.category).all() and 3 <= out["class"].nunique() <= 5
    zones = polarimetry.wishart(t3, t3.select("y", "x", (F.col("x") / 4).cast("int").alias("zone")), rounds=5).toPandas()
    assert (zones["class"] == zones.x // 4).all()


def test_single_target_of_yang_is_itself(spark):
    # a pure target is its own decomposition, with A0 large and, turned, with A0 = 0
    for v in ([1, 0.3 + 0.2j, 0.1j], [0, 1, 0.5j], [0.05, 1, 0.4]):
        k = np.array(v)
        t = np.outer(k, k.conj())
        own = {f"t{i + 1}{j + 1}" + ("" if i == j else f"_{p}"): (t[i, j].real if p == "re" else t[i, j].imag) for i in range(3) for j in range(i, 3) for p in (("re",) if i == j else ("re", "im"))}
        r = polarimetry_models.yang(t3_row(spark, **own)).first()
        assert [r[e] for e in own] == pytest.approx(list(own.values()), abs=1e-9)


def test_eigen_angles_of_a_pure_target(spark):
    k = np.array([np.cos(0.4), np.sin(0.4) * np.cos(0.3) * np.exp(0.5j), np.sin(0.4) * np.sin(0.3) * np.exp(-0.2j)])
    t = 3 * np.outer(k, k.conj())
    own = dict(t11=t[0, 0].real, t22=t[1, 1].real, t33=t[2, 2].real, t12_re=t[0, 1].real, t12_im=t[0, 1].imag, t13_re=t[0, 2].real, t13_im=t[0, 2].imag, t23_re=t[1, 2].real, t23_im=t[1, 2].imag)
    r = polarimetry_models.eigen_angles(t3_row(spark, **own)).first()
    got = [r[c] for c in ("entropy", "alpha", "beta", "delta", "gamma", "lambda")]
    assert got == pytest.approx([0, math.degrees(0.4), math.degrees(0.3), math.degrees(0.5), math.degrees(-0.2), 3], abs=1e-6)


def test_model_based_volume_root(spark):
    r = polarimetry_models.model_based(c2_rows(spark, [(1.0, 0.25, 0.0, 0.0)])).first()
    # 0.75 m² + (0.75 - 2.5) m + 1.25² - 0.75² = 0: m = 1 or 4/3, the larger is beyond the span 1.25
    assert 10 ** (r["volume"] / 10) == pytest.approx(1.0) and 10 ** (r["surface"] / 10) == pytest.approx(0.25) and r["alpha"] == pytest.approx(0.0, abs=1e-6)


# ------------------------------------------------------------------ shifts and geocoding of complex data


def complex_scene(spark, height=64, width=64, seed=6, shift=(0.0, 0.0)):
    """Band-limited noise, exact under fractional shifts; sample k has the signal at k + shift."""
    rng = np.random.default_rng(seed)
    f = (rng.normal(size=(height, width)) + 1j * rng.normal(size=(height, width))) * (np.abs(np.fft.fftfreq(height))[:, None] < 0.3) * (np.abs(np.fft.fftfreq(width)) < 0.3)
    z = np.fft.ifft2(f * np.exp(2j * np.pi * (np.fft.fftfreq(height)[:, None] * shift[0] + np.fft.fftfreq(width) * shift[1]))) * 50
    return spark.createDataFrame([(y, x, float(z[y, x].real), float(z[y, x].imag)) for y in range(height) for x in range(width)], "y long, x long, i double, q double"), z


def test_fractional_shift_is_exact_for_band_limited_lines(spark):
    df, _ = complex_scene(spark)
    _, want = complex_scene(spark, shift=(0.0, 0.37))
    got = {(r["y"], r["x"]): complex(r["i"], r["q"]) for r in coregistration.fractional_shift(df, 0.37).collect()}
    assert max(abs(got[k] - want[k]) for k in got) < 1e-9


def test_block_shifts_find_the_planted_shift(spark):
    df, _ = complex_scene(spark, 128, 128)
    other, _ = complex_scene(spark, 128, 128, shift=(0.4, -1.3))
    out = coregistration.block_shifts(df, other, 64).toPandas()
    assert len(out) == 4 and (out.quality > 3).all()
    assert out.dy.mean() == pytest.approx(-0.4, abs=0.1) and out.dx.mean() == pytest.approx(1.3, abs=0.1)
    back = coregistration.range_shift(df, complex_scene(spark, 128, 128, shift=(0.0, -1.3))[0])
    a, b = df.toPandas().sort_values(["y", "x"]), back.toPandas().sort_values(["y", "x"])
    assert np.abs((a.i - b.i.to_numpy()) + 1j * (a.q - b.q.to_numpy())).mean() < 0.15 * np.hypot(a.i, a.q).mean()


def test_sinc_resampling(spark):
    df, z = complex_scene(spark)
    _, want = complex_scene(spark, shift=(0.25, 0.6))
    places = spark.createDataFrame([(y, x, y + 0.25, x + 0.6) for y in range(10, 50, 7) for x in range(10, 50, 7)] + [(0, 0, 0.5, 0.5), (1, 1, 20.0, 30.0), (2, 2, None, 3.0)], "y long, x long, line double, sample double")
    got = {(r["y"], r["x"]): r for r in coregistration.sinc_resample(places, df).collect()}
    assert got[0, 0]["i"] is None and got[2, 2]["i"] is None and complex(got[1, 1]["i"], got[1, 1]["q"]) == pytest.approx(z[20, 30])
    errors = [abs(complex(r["i"], r["q"]) - want[k]) for k, r in got.items() if k[0] >= 10]
    assert np.mean(errors) < 0.05 * np.abs(want).mean()


def test_back_geocoding_recovers_a_ramped_burst_from_another_orbit(spark):
    """The secondary looks from a shifted orbit; what it sees of a smooth signal comes back on the reference's pixels, ramp and all."""
    sensor = catalog.SENSOR
    rate, doppler, centre = 2000.0, 30.0, 0.2
    grid = catalog.terrain(spark, "/root/testdata/sf0.001")
    height, width = 40, 140
    signal = lambda y, x: np.exp(1j * (0.11 * y + 0.07 * x))
    y, x = np.mgrid[-10:height, -10:width].astype(float)
    t = y * sensor.interval - centre
    z = signal(y, x) * np.exp(1j * np.pi * (t * t * rate + 2 * t * doppler))
    rows = [(int(a), int(b), float(c.real), float(c.imag)) for a, b, c in zip(y.ravel(), x.ravel(), z.ravel(), strict=True)]
    df = spark.createDataFrame(rows, "y long, x long, i double, q double")
    out = coregistration.back_geocode(grid, df, catalog.orbit(spark), catalog.orbit(spark, -300_200.0), sensor, sensor, rate, doppler, centre).where("i is not null").toPandas()
    assert len(out) > 20 and out.dx.abs().max() > 0.5
    t = (out.y + out.dy) * sensor.interval - centre
    want = signal(out.y + out.dy, out.x + out.dx) * np.exp(1j * np.pi * (t * t * rate + 2 * t * doppler))
    assert np.abs(out.i + 1j * out.q - want).max() < 0.05


def test_azimuth_spectrum_peaks_at_the_centroid(spark):
    rows = [(y, x, math.cos(2 * math.pi * 5 * y / 32), math.sin(2 * math.pi * 5 * y / 32)) for y in range(32) for x in range(3)]
    r = coregistration.azimuth_spectrum(spark.createDataFrame(rows, "y long, x long, i double, q double"), 320.0).orderBy(F.desc("power")).first()
    assert (r["bin"], r["frequency"], r["power"]) == pytest.approx((21, 50.0, 1024.0))


def test_geocoding_by_tie_points(spark):
    place = lambda y, x: (45 + 0.01 * y + 0.001 * x + 1e-5 * y * x, 7 + 0.012 * x - 0.002 * y)
    ties = spark.createDataFrame([(float(y), float(x), *place(y, x)) for y in (0, 4, 9) for x in (0, 5, 10)], "line double, pixel double, lat double, lon double")
    image = spark.createDataFrame([(y, x, 10.0 * y + x) for y in range(10) for x in range(11)], "y long, x long, v double")
    grid = spark.createDataFrame([(y, x, *place(y, x)) for y, x in ((0, 0), (3, 7), (9, 10), (6, 2))] + [(50, 50, 46.0, 9.0)], "y long, x long, lat double, lon double")
    got = {(r["y"], r["x"]): r for r in coregistration.tie_point_geocoding(grid, image, ties).collect()}
    for k in ((0, 0), (9, 10)):
        assert got[k]["v"] == pytest.approx(10 * k[0] + k[1], abs=1e-3)
    assert (got[3, 7]["line"], got[3, 7]["sample"]) == pytest.approx((3, 7), abs=0.05) and got[50, 50]["v"] is None and got[50, 50]["line"] is None


def test_soil_models(spark):
    m = np.linspace(0, 0.5, 51)
    for clay in (10.0, 15.0, 45.0):  # with less clay the symmetric part, all of bound water, does not meet the rest
        e = soil.mironov(m, np.full(51, clay), 18.0, 1.4e9)
        assert (np.diff(e) > 0).all() and 2 < e[0] < 4 and 15 < e[-1] < 45
        assert soil.mironov(np.array([0.02 - 1e-9]), np.array([clay]), 18.0, 1.4e9)[0] == pytest.approx(soil.mironov(np.array([0.02 + 1e-9]), np.array([clay]), 18.0, 1.4e9)[0], abs=1e-5)
    rows = [(0, k, float(soil.mironov(np.array([v]), np.array([20.0]), 18.0, 5.4e9)[0]), 20.0) for k, v in enumerate((0.05, 0.2, 0.4))] + [(0, 3, None, 20.0), (0, 4, 9.0, None), (0, 5, 1.0, 20.0)]
    out = soil.mironov_moisture(spark.createDataFrame(rows, "y long, x long, rdc double, clay double"), 5.4e9).orderBy("x").collect()
    assert [r["moisture"] for r in out[:3]] == pytest.approx([0.05, 0.2, 0.4], abs=1e-6) and [r["quality"] for r in out] == [0, 0, 0, 1, 2, 3] and out[3]["moisture"] is None


# ------------------------------------------------------------------ selectors, closures, baselines


def two_sample(a, b):
    """The textbook two-sample Anderson-Darling statistic over pooled ranks."""
    pooled = sorted([(x, 0) for x in a] + [(x, 1) for x in b])
    n, m = len(a), len(pooled)
    total, count = 0.0, 0
    for j, (_, which) in enumerate(pooled[:-1], 1):
        count += which == 0
        total += (m * count - j * n) ** 2 / (j * (m - j))
    return total * (m - 1) / m**2 * (1 / n + 1 / len(b))


@pytest.mark.parametrize("kind", ["ks", "ad", "tlog"])
def test_selectors_hold_their_level_and_tell_scales_apart(kind):
    rng = np.random.default_rng(8)
    draw = lambda scale: np.sort(rng.rayleigh(scale, (4000, 24)), 1)
    test = insar.alike(kind, 0.05, 24)
    a = draw(1.0)
    assert 0.9 < test(a, draw(1.0)).mean() <= 1 and test(a, draw(2.5)).mean() < 0.15 and test(a, a).all()


def test_selectors_against_plain_statistics():
    rng = np.random.default_rng(9)
    a, b = np.sort(rng.rayleigh(1.0, (300, 10)), 1), np.sort(rng.rayleigh(1.6, (300, 10)), 1)
    ks = insar.alike("ks", 0.05, 10)(a, b)
    for x, y, got in zip(a, b, ks, strict=True):
        at = np.concatenate([x, y])
        distance = max(abs((x <= v).mean() - (y <= v).mean()) for v in at)
        assert got == (distance <= math.sqrt(-math.log(0.025) / 10))
    ad, plain = insar.alike("ad", 0.05, 10)(a, b), [two_sample(x, y) for x, y in zip(a, b, strict=True)]
    accepted, rejected = [v for v, g in zip(plain, ad, strict=True) if g], [v for v, g in zip(plain, ad, strict=True) if not g]
    assert accepted and rejected and max(accepted) < min(rejected)
    # the statistic's mean is 1 and its deviation about 0.75, so that the limit lies near 1 + 1.961 * 0.75
    assert 2.2 < (max(accepted) + min(rejected)) / 2 < 2.8


def test_closure_of_a_triplet(spark):
    rows = [(0, 0, 0, 1, 1.0), (0, 0, 1, 2, 2.0), (0, 0, 0, 2, 2.5), (0, 0, 2, 3, 9.0), (0, 1, 0, 1, 4.0), (0, 1, 1, 2, 4.0), (0, 1, 0, 2, 0.0)]
    out = {r["x"]: r for r in insar.closure_phase(spark.createDataFrame(rows, "y long, x long, ref int, sec int, phase double")).collect()}
    assert out[0]["rms"] == pytest.approx(0.5) and out[0]["triplets"] == 1 and out[1]["rms"] == pytest.approx(8 - 2 * math.pi)


def test_baselines_of_parallel_passes(spark):
    cell = spark.createDataFrame([(0, 0, 45.0, 7.0, 0.0), (0, 1, -45.0, 7.0, 0.0)], "y long, x long, lat double, lon double, h double")
    out = {r["x"]: r for r in insar.baselines(cell, catalog.orbit(spark), catalog.orbit(spark, -299_800.0)).collect()}
    look = math.atan2(300_000, 700_000)
    # 200 m to the east, towards the cell: the range gets shorter by 200 sin(look), the angle steeper
    assert out[0]["length"] == pytest.approx(200, abs=0.1) and out[0]["parallel"] == pytest.approx(200 * math.sin(look), abs=0.1) and out[0]["perpendicular"] == pytest.approx(200 * math.cos(look), abs=0.2)
    assert out[1]["length"] is None


def test_ground_points_and_heights_from_phase(spark):
    sensor, first, second = catalog.SENSOR, geometry.orbit_of(catalog.orbit(spark)), geometry.orbit_of(catalog.orbit(spark, -300_200.0))
    rng = np.random.default_rng(12)
    line, sample, h = rng.integers(0, 500, 40).astype(float), rng.integers(0, 400, 40).astype(float), rng.uniform(0, 4000, 40)
    ground = geometry.ground_of(first, sensor, line, sample, h)
    t, r = first.zero_doppler(ground)
    assert np.allclose((t - sensor.first_time) / sensor.interval, line, atol=1e-3) and np.allclose((r - sensor.near_range) / sensor.spacing, sample, atol=1e-6)
    lat = np.degrees(np.arctan2(ground[:, 2], np.hypot(ground[:, 0], ground[:, 1])))
    assert (np.abs(lat - 45) < 2).all()
    flat = geometry.ground_of(first, sensor, line, sample, np.zeros(40))
    phase = -4 * math.pi / 0.0555 * (second.zero_doppler(flat)[1] - second.zero_doppler(ground)[1])
    df = spark.createDataFrame([(int(y), int(x), float(p)) for y, x, p in zip(line, sample, phase, strict=True)], "y long, x long, phase double")
    got = {(q["y"], q["x"]): q["height"] for q in insar.phase_to_height(df, catalog.orbit(spark), catalog.orbit(spark, -300_200.0), sensor, 0.0555, 500, 400).collect()}
    assert max(abs(got[int(y), int(x)] - v) for y, x, v in zip(line, sample, h, strict=True)) < 1.0


def test_polarimetric_calibration_takes_off_planted_distortion(spark):
    rng = np.random.default_rng(14)
    n = 3600
    noise = lambda k: (rng.normal(size=n) + 1j * rng.normal(size=n)) * math.sqrt(k / 2)
    hh = noise(1.0)
    hv = noise(0.1)
    clean = np.stack([hh, hv, hv, 0.6 * hh + noise(0.64)])
    r, t = np.array([[1, 0.04j], [0.05, 0.9 * np.exp(0.3j)]]), np.array([[1, -0.03], [0.02 + 0.02j, 0.9 * np.exp(0.3j)]])
    seen = np.kron(r, t) @ clean
    rows = [(k // 60, k % 60, *(float(v) for z in seen[:, k] for v in (z.real, z.imag))) for k in range(n)]
    df = spark.createDataFrame(rows, "y long, x long, " + ", ".join(f"{p}_{c} double" for p in ("hh", "hv", "vh", "vv") for c in "iq"))
    out = polarimetry_models.polarimetric_calibration(df, stride=1).toPandas().sort_values(["y", "x"])
    z = np.stack([out[f"{p}_i"] + 1j * out[f"{p}_q"] for p in ("hh", "hv", "vh", "vv")])
    c, before = z @ z.conj().T / n, seen @ seen.conj().T / n
    assert c[3, 3].real / c[0, 0].real == pytest.approx(1, abs=0.02) and abs(np.angle(c[0, 3])) < 0.05 and abs(np.angle(before[0, 3])) > 0.5
    for i, j in ((0, 1), (0, 2), (3, 1), (3, 2)):
        assert abs(c[i, j]) < 0.25 * abs(before[i, j]) + 0.005


def test_warp_by_polynomials(spark):
    df, _ = complex_scene(spark)
    _, want = complex_scene(spark, shift=(0.3, -0.6))
    got = {(r["y"], r["x"]): r for r in coregistration.warp(df, [0.3, 1.0], [-0.6, 0.0, 1.0]).collect()}
    errors = [abs(complex(got[y, x]["i"], got[y, x]["q"]) - want[y, x]) for y in range(8, 56) for x in range(8, 56)]
    assert np.mean(errors) < 0.05 * np.abs(want).mean() and got[63, 10]["i"] is None
    y, x = F.lit(2.0), F.lit(3.0)
    assert spark.range(1).select(coregistration.polynomial([1, 10, 100, 1000, 10_000, 100_000], y, x)).first()[0] == 1 + 20 + 300 + 4000 + 60_000 + 900_000


def test_cubic_resampling_is_exact_for_quadratics(spark):
    image = spark.createDataFrame([(y, x, 2.0 + y * y - 0.5 * x * x + 0.1 * y * x) for y in range(9) for x in range(9)], "y long, x long, v double")
    places = spark.createDataFrame([(0, k, y, x) for k, (y, x) in enumerate([(3.25, 4.5), (4.0, 4.0), (2.75, 5.9), (0.5, 4.0)])], "y long, x long, line double, sample double")
    got = [r["v"] for r in geometry.resample(places, image, method="cubic").orderBy("x").collect()]
    assert got[:3] == pytest.approx([2 + y * y - 0.5 * x * x + 0.1 * y * x for y, x in ((3.25, 4.5), (4.0, 4.0), (2.75, 5.9))]) and got[3] is None
