"""Files are written and read by strips of lines, so that no task holds a scene."""

import pytest
from pyspark.sql import functions as F

from rasterloom.sources import formats, products, sinks, tiff

WIDTH, HEIGHT = 5, 11


@pytest.fixture
def strips(monkeypatch):
    monkeypatch.setattr(formats, "STRIP", 2 * WIDTH)


def scene(spark):
    """Without its third strip, and without a pixel of the first."""
    px = spark.range(HEIGHT * WIDTH).select(F.expr(f"id div {WIDTH}").alias("y"), (F.col("id") % WIDTH).alias("x"), (F.col("id") * 1.5 - 7).alias("v"))
    return px.where("y not in (4, 5) and not (y = 0 and x = 1)")


def saved(files, folder):
    """How many parts the largest file has; the files are written."""
    assert sinks.save(files, str(folder)) == files.select("name").distinct().count()
    assert not [p for p in folder.rglob("*") if ".part" in p.name]
    return files.groupBy("name").count().agg(F.max("count")).first()[0]


def same(got, column, spark, absent):
    want = {(r["y"], r["x"]): r["v"] for r in scene(spark).collect()}
    rows = got.collect()
    assert len(rows) == HEIGHT * WIDTH
    for r in rows:
        assert r[column] == want.get((r["y"], r["x"]), absent)


def test_gamma_and_stamps(spark, tmp_path, strips):
    z = scene(spark).select("y", "x", F.col("v").alias("i"), (-F.col("v")).alias("q"))
    assert saved(sinks.gamma(z, "a", {"mission": "x"}), tmp_path / "g") == 6
    par = (tmp_path / "g" / "a.slc.par").read_text()
    same(products.read_gamma(spark, str(tmp_path / "g" / "a.slc"), par), "i", spark, 0.0)
    where = z.select("y", "x", F.lit(45.0).alias("lat"), F.lit(7.0).alias("lon"), F.lit(0.0).alias("height"))
    assert saved(sinks.stamps("20210101", {"20210101": z}, {"20210113": z}, where, {}, {"mission": "x"}), tmp_path / "s") == 6
    same(products.read_gamma(spark, str(tmp_path / "s" / "diff0" / "20210101_20210113.diff"), par), "i", spark, 0.0)


def test_tiff(spark, tmp_path, strips):
    both = scene(spark).withColumn("w", F.col("v") + 1)
    assert saved(sinks.geotiff(both, ["v", "w"], "out"), tmp_path / "t") == 13
    got, _ = tiff.decode((tmp_path / "t" / "out.tif").read_bytes())
    assert got.shape == (2, HEIGHT, WIDTH) and got[1, 10, 4] == got[0, 10, 4] + 1 == 75.0
    same(tiff.read(spark, str(tmp_path / "t" / "out.tif"), ["v", "w"]), "v", spark, None)


def test_matrices_phases_and_netcdf(spark, tmp_path, strips):
    m = scene(spark).withColumnRenamed("v", "c11")
    assert saved(sinks.polsarpro(m, ["c11"]), tmp_path / "p") == 6
    same(products.read_polsarpro(spark, str(tmp_path / "p"), ["c11"]), "c11", spark, 0.0)
    p = scene(spark).select("y", "x", F.col("v").alias("phase"), F.lit(0.5).alias("coherence"))
    assert saved(sinks.snaphu(p, "ifg", {}), tmp_path / "u") == 6
    head = formats.header((tmp_path / "u" / "phase_ifg.hdr").read_text())
    same(formats.read_bsq(spark, str(tmp_path / "u" / "phase_ifg.img"), head, ["phase"]), "phase", spark, 0.0)
    assert saved(sinks.netcdf(scene(spark), ["v"], "n"), tmp_path / "n") == 6
    assert len((tmp_path / "n" / "n.nc").read_bytes()) == 100 + 4 * HEIGHT * WIDTH


def test_a_store_that_only_spark_reaches(spark, tmp_path, strips, monkeypatch):
    z = scene(spark).select("y", "x", F.col("v").alias("i"), F.lit(0.0).alias("q"))
    sinks.save(sinks.gamma(z, "a", {"mission": "x"}).union(sinks.geotiff(scene(spark), ["v"], "t")).union(sinks.polsarpro(scene(spark).withColumnRenamed("v", "c11"), ["c11"])), str(tmp_path))
    monkeypatch.setattr(formats, "reached", lambda files: False)
    same(products.read_gamma(spark, str(tmp_path / "a.slc"), (tmp_path / "a.slc.par").read_text()), "i", spark, 0.0)
    same(tiff.read(spark, str(tmp_path / "t.tif"), ["v"]), "v", spark, None)
    same(products.read_polsarpro(spark, str(tmp_path), ["c11"]), "c11", spark, 0.0)
