"""Queries over whole scenes and stacks, on larger tables than the other tests have."""

from pathlib import Path

import duckdb
import pytest

from rasterloom.operators import insar
from rasterloom.plans import catalog

from .test_queries import ordered

DATA = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")


@pytest.mark.parametrize("name", ["slice_assembly", "tie_points", "topsar_deburst", "orbit_interpolation", "calibration_lut", "tile_statistics", "sbas_inversion"])
def test_whole_query_equals_its_sql(spark, name):
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    got, want = ordered(catalog.QUERIES[name](spark, DATA).toPandas()), ordered(c.execute(catalog.ORACLE_SQL[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    for column in got.columns:
        assert ((got[column] - want[column]).abs() <= 2e-6 + 1e-6 * want[column].abs()).all(), column


def test_phase_linking_covers_the_scene(spark):
    assert catalog.QUERIES["phase_linking"](spark, DATA).count() == 10_000


def test_cross_correlation_finds_the_shift_all_over_the_scene(spark):
    out = catalog.QUERIES["cross_correlation"](spark, DATA).toPandas()
    assert len(out) == 16 and (out.dy == 2).all() and (out.dx == 3).all()


def test_robust_pca_covers_all_epochs(spark):
    assert catalog.QUERIES["robust_pca"](spark, DATA).select("epoch").distinct().count() == 64


def test_warp_is_fitted_to_every_pixel(spark, monkeypatch):
    seen, fit = [], insar.fit_warp
    monkeypatch.setattr(insar, "fit_warp", lambda g: seen.append(g.count()) or fit(g))
    catalog.QUERIES["warp_fit"](spark, DATA)
    assert seen == [10_000]
