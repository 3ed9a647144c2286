"""Orbit files, TIFF, products and sinks: what is written reads back, and hand-made files give their values."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.sources import formats, orbits, products, sinks, tiff

OSV = "<OSV><TAI>TAI=2021-01-01T00:00:37</TAI><UTC>UTC=2021-01-01T00:{m:02d}:00.000000</UTC><UT1/><Absolute_Orbit>+1</Absolute_Orbit><X unit='m'>{x}</X><Y unit='m'>{y}</Y><Z unit='m'>-3.5</Z><VX unit='m/s'>1</VX><VY unit='m/s'>2</VY><VZ unit='m/s'>3</VZ></OSV>"
DAY = 7671.0  # 2021-01-01 in days since 2000


def scene(spark, height=6, width=5):
    return spark.range(height * width).select(F.expr(f"id div {width}").alias("y"), (F.col("id") % width).alias("x"), (F.col("id") * 1.5 - 7).alias("v"))


def test_earth_observation_orbits(spark, tmp_path):
    head = "<Earth_Explorer_File xmlns='urn:x'><Fixed_Header><Validity_Start>UTC=2021-01-01T00:00:00</Validity_Start><Validity_Stop>UTC=2021-01-01T01:00:00</Validity_Stop></Fixed_Header><List_of_OSVs>"
    (tmp_path / "a.EOF").write_text(head + "".join(OSV.format(m=m, x=m**3, y=m * m) for m in range(0, 60, 10)) + "</List_of_OSVs></Earth_Explorer_File>")
    v = orbits.read(spark, str(tmp_path), "eof")
    rows = v.orderBy("t").collect()
    assert len(rows) == 6 and (rows[1]["x"], rows[1]["z"], rows[1]["vy"]) == (1000.0, -3.5, 2.0)
    assert [rows[0][k] for k in ("t", "valid_from", "valid_to")] == pytest.approx([DAY, DAY, DAY + 1 / 24])
    picked = orbits.choose(v, spark.createDataFrame([("p", DAY + 0.01), ("late", DAY + 2)], "product string, t double"))
    assert {r["product"] for r in picked.collect()} == {"p"} and picked.count() == 6
    # a cubic through four neighbours is exact for x = m³, between, at and beyond the vectors
    times = spark.createDataFrame([(DAY + m / 1440,) for m in (0.0, 5.0, 17.0, 25.0, 30.0, 44.0, 50.0, 55.0, -3.0)], "t double")
    for r in orbits.interpolate(v, times).collect():
        m = (r["t"] - DAY) * 1440
        assert (r["x"], r["y"], r["vz"]) == pytest.approx((m**3, m * m, 3.0), abs=2e-3)
    assert orbits.interpolate(v.limit(2), times).where("x is not null").count() == 0


def test_other_orbit_files(spark, tmp_path):
    record = lambda key, d, us, p, v: (f"{key:6}{'9105001':7}0{d:6d}{us:11d}" + "".join(f"{x:12d}" for x in p) + "".join(f"{x:11d}" for x in v)).ljust(130)
    prare = "DSIDP ".ljust(130) + "STATE ".ljust(130) + record("STINER", 76705, 0, (9, 9, 9), (9, 9, 9)) + record("STTERR", 76705, 69_184_000, (7_000_000_123, -1, 2), (7_500_000_000, 0, -5))
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a").write_text(prare)
    r = orbits.read(spark, str(tmp_path / "p"), "prare").collect()
    assert len(r) == 1 and (r[0]["x"], r[0]["vx"], r[0]["vz"]) == pytest.approx((7_000_000.123, 7500.0, -5e-6))
    assert r[0]["t"] == pytest.approx(7671 + (69.184 - 32.184 - 37) / 86400, abs=1e-9)  # 37 leap seconds by then
    (tmp_path / "o").mkdir()
    odr = b"@ODR" + b"ERS-1   " + struct.pack(">i", 0) + struct.pack(">4i", 35000, 12, 2, 404) + struct.pack(">4i", 86400, 0, 90_000_000, 7_000_000) + struct.pack(">4i", 86460, 90_000_000, 0, 7_000_000)
    (tmp_path / "o" / "a").write_bytes(odr)
    r = orbits.read(spark, str(tmp_path / "o"), "odr").orderBy("t").collect()
    assert (r[0]["x"], r[0]["y"], r[1]["z"]) == pytest.approx((0, 7000, 7000), abs=1e-9) and r[0]["t"] == orbits.SINCE_1985 + 1 and r[0]["vx"] is None
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a").write_bytes(b"MPH..\n01-JAN-2021 00:30:00.000000 -.291784 04511 +7000000.250 -0000001.500 +0000002.000 -0000.100000 +7500.000000 +0000.000000\n")
    r = orbits.read(spark, str(tmp_path / "d"), "doris").first()
    assert (r["t"], r["x"], r["y"], r["vy"]) == pytest.approx((DAY + 0.5 / 24, 7_000_000.25, -1.5, 7500))
    (tmp_path / "k").mkdir()
    (tmp_path / "k" / "a").write_text("#cV2021\n*  2021  1  1  0 10  0.00000000\nPL01  7000.5 -1.0 2.0 0\nVL01 75000.0 0.0 -10.0 0\nEOF\n")
    r = orbits.read(spark, str(tmp_path / "k"), "positions").first()
    assert (r["t"], r["x"], r["vx"], r["vz"]) == pytest.approx((DAY + 10 / 1440, 7_000_500.0, 7500.0, -1.0))


def test_listed_orbit_files(spark):
    name = "S1A_OPER_AUX_POEORB_OPOD_20210121T121423_V20201231T225942_20210102T005942.EOF"
    r = orbits.listed(spark.createDataFrame([(f"<a href='{name}'>{name}</a> other.EOF",), (None,)], "html string")).collect()
    assert len(r) == 1 and (r[0]["mission"], r[0]["kind"]) == ("S1A", "POEORB") and r[0]["valid_from"] == pytest.approx(DAY - 1 + 82782 / 86400)


@pytest.mark.parametrize("deflate", [True, False])
def test_tiff_round_trip(spark, tmp_path, deflate):
    a = np.arange(60, dtype=float).reshape(2, 6, 5) / 4
    (tmp_path / "a.tif").write_bytes(tiff.encode(a, (10.0, 10.0, 0.0), (500.0, 600.0), deflate))
    got, tags = tiff.decode((tmp_path / "a.tif").read_bytes())
    assert np.array_equal(got, a) and tags[tiff.SCALE] == (10.0, 10.0, 0.0) and tags[tiff.TIE_POINTS][3:5] == (500.0, 600.0)
    rows = tiff.read(spark, str(tmp_path), ["p", "q"]).collect()
    assert len(rows) == 30 and all((r["p"], r["q"]) == (a[0, r["y"], r["x"]], a[1, r["y"], r["x"]]) for r in rows)


def image(order, tags, data):
    """A TIFF by hand: tags with values of at most four bytes, or (format, values)."""
    n = {"H": 3, "I": 4}
    at = 8 + 2 + 12 * len(tags) + 4
    head, rest = struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, 8) + struct.pack(order + "H", len(tags)), b""
    for tag, (f, v) in sorted(tags.items()):
        value = struct.pack(order + f * len(v), *[x + at if tag in (273, 324) else x for x in v])
        if len(value) > 4:
            raise AssertionError("short values only")
        head += struct.pack(order + "HHI", tag, n[f], len(v)) + value.ljust(4, b"\0")
    return head + struct.pack(order + "I", 0) + rest + data


def test_tiff_complex_tiles_and_packed_bits():
    z = struct.pack(">8h", 1, -2, 3, 4, 5, 6, -7, 8)
    got, _ = tiff.decode(image(">", {256: ("I", [2]), 257: ("I", [2]), 258: ("H", [32]), 259: ("H", [1]), 273: ("I", [0]), 277: ("H", [1]), 278: ("I", [2]), 279: ("I", [16]), 339: ("H", [5])}, z))
    assert got[0].tolist() == [[1 - 2j, 3 + 4j], [5 + 6j, -7 + 8j]]
    packed = bytes([0xFD, 9, 1, 7, 8]) + bytes([0x80])
    got, _ = tiff.decode(image("<", {256: ("I", [3]), 257: ("I", [2]), 258: ("H", [8]), 259: ("H", [32773]), 273: ("I", [0]), 277: ("H", [1]), 278: ("I", [2]), 279: ("I", [6])}, packed))
    assert got[0].tolist() == [[9, 9, 9], [9, 7, 8]]
    tile = bytes(range(16))
    got, _ = tiff.decode(image("<", {256: ("I", [3]), 257: ("I", [2]), 258: ("H", [8]), 259: ("H", [1]), 277: ("H", [1]), 322: ("I", [4]), 323: ("I", [4]), 324: ("I", [0]), 325: ("I", [16])}, tile))
    assert got[0].tolist() == [[0, 1, 2], [4, 5, 6]]
    with pytest.raises(ValueError):
        tiff.decode(b"no image")


SENTINEL = """<product><adsHeader><missionId>S1A</missionId><productType>SLC</productType><polarisation>VV</polarisation><mode>IW</mode><swath>IW1</swath><startTime>2021-01-01T00:00:00.5</startTime><stopTime>2021-01-01T00:00:30</stopTime><absoluteOrbitNumber>77</absoluteOrbitNumber></adsHeader>
<generalAnnotation><productInformation><pass>Descending</pass><rangeSamplingRate>6.4e7</rangeSamplingRate><radarFrequency>5.405e9</radarFrequency></productInformation><orbitList count="1"><orbit><time>2021-01-01T00:00:10</time><position><x>1</x><y>2</y><z>3</z></position><velocity><x>4</x><y>5</y><z>6</z></velocity></orbit></orbitList></generalAnnotation>
<imageAnnotation><imageInformation><slantRangeTime>5.3e-3</slantRangeTime><rangePixelSpacing>2.3</rangePixelSpacing><azimuthPixelSpacing>14</azimuthPixelSpacing><azimuthTimeInterval>2e-3</azimuthTimeInterval><numberOfSamples>21</numberOfSamples><numberOfLines>15</numberOfLines></imageInformation></imageAnnotation>
<geolocationGrid><geolocationGridPointList count="1"><geolocationGridPoint><azimuthTime>x</azimuthTime><slantRangeTime>5e-3</slantRangeTime><line>0</line><pixel>10</pixel><latitude>48.5</latitude><longitude>9</longitude><height>300</height><incidenceAngle>35</incidenceAngle><elevationAngle>30</elevationAngle></geolocationGridPoint></geolocationGridPointList></geolocationGrid></product>"""
TERRASAR = """<level1Product><productInfo><missionInfo><mission>TSX-1</mission><absOrbit>9</absOrbit><orbitDirection>ASCENDING</orbitDirection></missionInfo><imageDataInfo><imageRaster><numberOfRows>3</numberOfRows><numberOfColumns>4</numberOfColumns><rowSpacing>2.5</rowSpacing><columnSpacing>1.5</columnSpacing></imageRaster></imageDataInfo><sceneInfo><start><timeUTC>2021-01-01T12:00:00Z</timeUTC></start></sceneInfo></productInfo>
<platform><orbit><stateVec><timeUTC>2021-01-01T12:00:00</timeUTC><posX>1</posX><posY>2</posY><posZ>3</posZ><velX>4</velX><velY>5</velY><velZ>6</velZ></stateVec></orbit></platform><calibration><calibrationConstant layerIndex="1"><polLayer>HH</polLayer><calFactor>1.5e-5</calFactor></calibrationConstant></calibration></level1Product>"""


def test_products(spark, tmp_path):
    (tmp_path / "s1.xml").write_text(SENTINEL)
    s1 = str(tmp_path / "s1.xml")
    r = products.metadata(spark, s1, "sentinel1").first()
    assert (r["mission"], r["pass"], r["lines"], r["range_spacing"], r["orbit"], r["calibration"]) == ("S1A", "Descending", 15, 2.3, 77, None)
    assert r["start_day"] == pytest.approx(DAY + 0.5 / 86400, abs=1e-9)
    v = products.state_vectors(spark, s1, "sentinel1").first()
    assert [v[k] for k in ("t", "x", "vz")] == pytest.approx([DAY + 10 / 86400, 1, 6])
    g = products.sentinel1_grid(spark, s1).first()
    assert (g["pixel"], g["latitude"], g["incidence"]) == (10, 48.5, 35)
    (tmp_path / "cal.xml").write_text("<calibration><calibrationVectorList><calibrationVector><line>7</line><pixel>0 40</pixel><sigmaNought>1 2</sigmaNought><betaNought>3 4</betaNought><gamma>5 6</gamma><dn>7 8</dn></calibrationVector></calibrationVectorList></calibration>")
    rows = products.sentinel1_table(spark, str(tmp_path / "cal.xml")).orderBy("pixel").collect()
    assert [(x["line"], x["pixel"], x["sigmaNought"], x["gamma"]) for x in rows] == [(7, 0, 1, 5), (7, 40, 2, 6)]
    (tmp_path / "lut.xml").write_text("<lut xmlns='u'><pixelFirstLutValue>9</pixelFirstLutValue><stepSize>-3</stepSize><offset>0.5</offset><gains>10 20 30</gains></lut>")
    assert [tuple(x)[1:] for x in products.gains(spark, str(tmp_path / "lut.xml")).collect()] == [(9, 0.5, 10), (6, 0.5, 20), (3, 0.5, 30)]
    (tmp_path / "tsx.xml").write_text(TERRASAR)
    tsx = str(tmp_path / "tsx.xml")
    r = products.metadata(spark, tsx, "terrasarx").first()
    assert (r["mission"], r["samples"], r["azimuth_spacing"], r["calibration"], r["stop"]) == ("TSX-1", 4, 2.5, 1.5e-5, None)
    assert tuple(products.calibration_constants(spark, tsx).first())[1:] == ("HH", 1.5e-5)
    with pytest.raises(Exception, match="s1.xml"):
        (tmp_path / "s1.xml").write_text("<broken")
        products.metadata(spark, s1, "sentinel1").collect()


def test_products_in_json_and_other_units(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"product_type": "SLC", "collect": {"platform": "capella-2", "mode": "spotlight", "start_timestamp": "2021-01-01T06:00:00.000000Z", "radar": {"center_frequency": 9.65e9}, "image": {"rows": 7, "columns": 9, "pixel_spacing_row": 0.5, "scale_factor": 2e-3, "image_geometry": {"delta_line_time": 1e-4}}, "state": {"direction": "ascending", "state_vectors": [{"time": "2021-01-01T06:00:00Z", "position": [1, 2, 3], "velocity": [4, 5, 6]}, {"time": "2021-01-01T06:00:10Z", "position": [7, 8, 9], "velocity": [4, 5, 6]}]}}}')
    c = str(tmp_path / "c.json")
    r = products.metadata(spark, c, "capella").first()
    assert (r["mission"], r["lines"], r["line_time"], r["frequency"], r["calibration"], r["range_spacing"], r["stop"]) == ("capella-2", 7, 1e-4, 9.65e9, 2e-3, None, None)
    v = products.state_vectors(spark, c, "capella").orderBy("t").collect()
    assert [(x["x"], x["vz"]) for x in v] == [(1, 6), (7, 6)] and v[0]["t"] == DAY + 0.25
    (tmp_path / "g.xml").write_text("<product><satellite>GF3</satellite><Direction>ASC</Direction><sensor><RadarCenterFrequency>5.4</RadarCenterFrequency><imagingMode>FSI</imagingMode></sensor><imageinfo><width>4</width><height>3</height><imagingTime><start>2021-01-01 06:00:00.0</start></imagingTime></imageinfo><GPS><GPSParam><TimeStamp>2021-01-01 06:00:00.0</TimeStamp><xPosition>1</xPosition><yPosition>2</yPosition><zPosition>3</zPosition><xVelocity>4</xVelocity><yVelocity>5</yVelocity><zVelocity>6</zVelocity></GPSParam></GPS></product>")
    g = str(tmp_path / "g.xml")
    r = products.metadata(spark, g, "gaofen3").first()
    assert (r["mission"], r["frequency"], r["lines"], r["pass"]) == ("GF3", pytest.approx(5.4e9), 3, "ASC") and products.state_vectors(spark, g, "gaofen3").first()["t"] == DAY + 0.25
    (tmp_path / "s.xml").write_text(SENTINEL)
    assert products.metadata(spark, str(tmp_path / "s.xml"), "spacety").first()["swath"] == "IW1"


def test_sun_raster(spark, tmp_path):
    head = struct.pack(">8I", 0x59A66A95, 3, 2, 8, 8, 1, 0, 0)
    (tmp_path / "a.ras").write_bytes(head + bytes([1, 2, 3, 0, 4, 5, 6, 0]))
    rows = products.read_sun_raster(spark, str(tmp_path)).collect()
    assert {(r["y"], r["x"]): r["v"] for r in rows}[1, 2] == 6 and len(rows) == 6
    assert products.sun_raster(struct.pack(">8I", 0x59A66A95, 3, 2, 8, 8, 2, 0, 0) + bytes([0x80, 3, 7, 0x80, 0, 1, 2, 0])).tolist() == [[7, 7, 7], [0x80, 1, 2]]
    assert products.sun_raster(struct.pack(">8I", 0x59A66A95, 9, 1, 1, 2, 1, 0, 0) + bytes([0b10000001, 0b10000000])).tolist() == [[1, 0, 0, 0, 0, 0, 0, 1, 1]]


def saved(files, folder):
    n = sinks.save(files, str(folder))
    names = sorted(p.name for p in folder.iterdir())
    assert n == len(names) and not any(x.startswith("_") for x in names)
    return names


def test_gamma_round_trip(spark, tmp_path):
    z = scene(spark).select("y", "x", F.col("v").alias("i"), (-F.col("v")).alias("q"))
    names = saved(sinks.gamma(z, "a", {"mission": "S1A", "prf": 1700.5}, [(10.0, 1, 2, 3, 4, 5, 6), (20.0, 1, 2, 3, 4, 5, 6)]), tmp_path / "g")
    assert names == ["a.slc", "a.slc.par"]
    par = (tmp_path / "g" / "a.slc.par").read_text()
    assert {"title": "a", "range_samples": "5", "prf": "1700.5", "state_vector_interval": "10.0"}.items() <= products.parameters(par).items()
    back = products.read_gamma(spark, str(tmp_path / "g" / "a.slc"), par)
    assert sorted((r["y"], r["x"], r["i"], r["q"]) for r in back.collect()) == sorted((r["y"], r["x"], r["i"], r["q"]) for r in z.collect())
    names = saved(sinks.gamma_dem(scene(spark).withColumnRenamed("v", "height"), "d", {"projection": "EQA", "north": 48.0}), tmp_path / "d")
    assert names == ["d.dem", "d.dem_par", "d.diff_par"] and "corner_north:\t48.0" in (tmp_path / "d" / "d.dem_par").read_text()
    assert np.frombuffer((tmp_path / "d" / "d.dem").read_bytes(), ">f4")[1] == -5.5


def test_polsarpro_round_trip(spark, tmp_path):
    c = scene(spark).select("y", "x", F.col("v").alias("c11"), (F.col("v") * 2).alias("c12_re"), (F.col("v") * 3).alias("c12_im"), (F.col("v") * 4).alias("c22"))
    names = saved(sinks.polsarpro(c, ["c11", "c12_re", "c12_im", "c22"]), tmp_path / "p")
    assert "C12_real.bin" in names and "C22.bin.hdr" in names and "config.txt" in names
    back = products.read_polsarpro(spark, str(tmp_path / "p"), ["c11", "c12_re", "c12_im", "c22"])
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, c.collect()))


def test_unwrapper_and_time_series_files(spark, tmp_path):
    s = scene(spark).select("y", "x", F.col("v").alias("phase"), F.lit(0.5).alias("coherence"))
    names = saved(sinks.snaphu(s, "ifg", {"baseline": 150.0, "wavelength": 0.0555}, tiles=(2, 3)), tmp_path / "s")
    conf = dict(line.split(None, 1) for line in (tmp_path / "s" / "snaphu.conf").read_text().splitlines())
    assert conf["LINELENGTH"] == "5" and conf["NTILECOL"] == "3" and conf["BPERP"] == "150.0" and "EARTHRADIUS" not in conf and conf["INFILE"] in names
    head = formats.header((tmp_path / "s" / "phase_ifg.hdr").read_text())
    back = formats.read_bsq(spark, str(tmp_path / "s" / "phase_ifg.img"), head, ["phase"])
    assert sorted((r["y"], r["x"], r["phase"]) for r in back.collect()) == sorted((r["y"], r["x"], r["phase"]) for r in s.collect())
    t = scene(spark).select("y", "x", F.col("v").alias("unw_20210101_20210113"), F.lit(0.25).alias("coh_20210101_20210113"))
    names = saved(sinks.pyrate(t, [("20210101", "20210113")], 0.0555, {"x_first": 9.0, "y_first": 48.0, "x_step": 0.1, "y_step": 0.1}, 35.0), tmp_path / "t")
    assert {"unw_20210101_20210113.tif", "unw_20210101_20210113.tif.rsc", "ifgs.txt", "pyrate.conf"} <= set(names)
    assert tiff.read(spark, str(tmp_path / "t" / "unw_20210101_20210113.tif"), ["v"]).agg(F.max("v")).first()[0] == 36.5


def test_scatterer_chain_folders(spark, tmp_path):
    z = scene(spark).select("y", "x", F.col("v").alias("i"), (-F.col("v")).alias("q"))
    where = scene(spark).select("y", "x", (45 + F.col("y")).cast("double").alias("lat"), (7 + F.col("x")).cast("double").alias("lon"), F.col("v").alias("height"))
    files = sinks.stamps("20210101", {"20210101": z, "20210113": z}, {"20210113": z}, where, {"20210113": (12.5, -150.0)}, {"mission": "S1A"})
    assert sinks.save(files, str(tmp_path / "s")) == 9
    names = sorted(str(p.relative_to(tmp_path / "s")) for p in (tmp_path / "s").rglob("*") if p.is_file())
    assert names == ["diff0/20210101_20210113.base", "diff0/20210101_20210113.diff", "geo/20210101.lat", "geo/20210101.lon", "geo/20210101_dem.rdc", "rslc/20210101.rslc", "rslc/20210101.rslc.par", "rslc/20210113.rslc", "rslc/20210113.rslc.par"]
    par = (tmp_path / "s" / "rslc" / "20210113.rslc.par").read_text()
    back = products.read_gamma(spark, str(tmp_path / "s" / "rslc" / "20210113.rslc"), par)
    assert back.count() == 30 and back.agg(F.max("i")).first()[0] == 36.5
    assert np.frombuffer((tmp_path / "s" / "geo" / "20210101.lat").read_bytes(), ">f4")[-1] == 50


def test_tiff_xml_and_netcdf(spark, tmp_path):
    names = saved(sinks.geotiff(scene(spark).where("not (y = 0 and x = 0)"), ["v"], "out", {"a & b": "<1>"}, (1.0, 1.0, 0.0), (0.0, 0.0)), tmp_path / "x")
    assert names == ["out.tif", "out.xml"] and products.root_of((tmp_path / "x" / "out.xml").read_bytes()).find("attribute").text == "<1>"
    got, _ = tiff.decode((tmp_path / "x" / "out.tif").read_bytes())
    assert np.isnan(got[0, 0, 0]) and got[0, 5, 4] == 36.5
    saved(sinks.netcdf(scene(spark).withColumn("w", F.col("v") + 1), ["v", "w"], "out", {"title": "t"}), tmp_path / "n")
    raw = (tmp_path / "n" / "out.nc").read_bytes()
    assert raw[:4] == b"CDF\2" and np.frombuffer(raw[-240:], ">f4").reshape(2, 6, 5)[1, 5, 4] == 37.5
