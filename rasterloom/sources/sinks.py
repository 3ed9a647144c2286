"""Products as files: rows (name, part, content), the parts of a file in order, and their writing to any store that Arrow reaches.

A part holds a strip of lines of a band, so that no task holds a whole scene.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.graph import written
from . import tiff
from .formats import strip_lines

FILES = "name string, part long, content binary"
#: Bytes copied at once where parts become a file.
COPIED = 8 << 20


def save(files: DataFrame, folder: str) -> int:
    """Write every file below folder (a path or URI); returns how many. A file appears whole or not at all, also where a task runs twice."""

    def put(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = pafs.FileSystem.from_uri(folder)
        for pdf in it:
            places = []
            for name, content in zip(pdf["name"], pdf["content"], strict=True):
                folder_, _, own = f"{root}/{name}".rpartition("/")
                store.create_dir(folder_, recursive=True)
                places.append(f"{folder_}/_{own}.part{uuid.uuid4().hex}")
                with store.open_output_stream(places[-1]) as out:
                    out.write(content)
            yield pdf[["name", "part"]].assign(place=places)

    def join(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = pafs.FileSystem.from_uri(folder)
        for pdf in it:
            for name, places in zip(pdf["name"], pdf["places"], strict=True):
                folder_, _, own = f"{root}/{name}".rpartition("/")
                whole = f"{folder_}/_{own}.part{uuid.uuid4().hex}"
                with store.open_output_stream(whole) as out:
                    for place in places:
                        with store.open_input_stream(place) as part:
                            while data := part.read(COPIED):
                                out.write(data)
                store.move(whole, f"{folder_}/{own}")
            yield pdf[["name"]]

    spark, parts = files.sparkSession, {}
    for row in files.mapInPandas(put, "name string, part long, place string").collect():  # places only
        parts.setdefault(row["name"], []).append((row["part"], row["place"]))
    if not parts:
        return 0
    rows = [(name, [place for _, place in sorted(own)]) for name, own in sorted(parts.items())]
    made = spark.createDataFrame(rows, "name string, places array<string>").repartition(min(len(rows), 64)).mapInPandas(join, "name string").collect()
    store, _ = pafs.FileSystem.from_uri(folder)
    for _, places in rows:
        for place in places:
            store.delete_file(place)
    return len(made)


def texts(like: DataFrame, parts: Mapping[str, str]) -> DataFrame:
    return like.sparkSession.createDataFrame([(k, 0, v.encode()) for k, v in parts.items()], FILES)


def size(df: DataFrame) -> tuple[int, int]:
    """Lines and samples of a scene that starts at (0, 0)."""
    r = df.agg(F.max("y").alias("y"), F.max("x").alias("x")).first()
    return (0, 0) if r["y"] is None else (r["y"] + 1, r["x"] + 1)


def striped(df: DataFrame, columns: Sequence[str], lines: int, samples: int, encode) -> DataFrame:
    """Parts (name, part, content) of each strip: encode(strip, grid) gives them of the strip's (column, line, sample), absent pixels NaN."""
    step = strip_lines(samples)
    own = df.select("y", "x", *[F.col(c).cast("double").alias(c) for c in columns]).withColumn("strip", F.floor(F.col("y") / step))
    # a strip without pixels is there too
    every = df.sparkSession.range(-(-lines // step)).select(*[F.lit(None).cast(t).alias(c) for c, t in own.dtypes[:-1]], F.col("id").alias("strip"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        strip, pdf = int(pdf.strip.iloc[0]), pdf[pdf.y.notna()]
        a = np.full((len(columns), min(step, lines - strip * step), samples), np.nan)
        a[:, pdf.y.to_numpy(int) - strip * step, pdf.x.to_numpy(int)] = pdf[list(columns)].to_numpy(float).T
        return pd.DataFrame(encode(strip, a), columns=["name", "part", "content"])

    return own.unionByName(every).groupBy("strip").applyInPandas(pack, FILES)


def assembled(df: DataFrame, bands: Sequence[str], lines: int, samples: int, encode) -> DataFrame:
    """One file per band: encode(band, grid) is its name and the bytes of the lines of a strip; absent pixels are NaN."""

    def parts(strip: int, a: np.ndarray) -> list[tuple]:
        made = [encode(band, own) for band, own in zip(bands, a, strict=True)]
        return [(name, strip, content) for name, content in made]

    return striped(df, bands, lines, samples, parts)


def raw(suffix: str, order: str):
    """Plain floats, line by line."""
    return lambda band, a: (f"{band}{suffix}", a.astype(f"{order}f4").tobytes())


def complex_raw(df: DataFrame, name: str, lines: int, samples: int, order: str) -> DataFrame:
    """Pairs of floats of the columns i and q; absent pixels are 0."""
    return striped(df, ["i", "q"], lines, samples, lambda strip, a: [(name, strip, np.where(np.isnan(a), 0, a).transpose(1, 2, 0).astype(f"{order}f4").tobytes())])


def envi_header(lines: int, samples: int, bands: Sequence[str], big: bool = False) -> str:
    return f"ENVI\nsamples = {samples}\nlines = {lines}\nbands = {len(bands)}\nheader offset = 0\nfile type = ENVI Standard\ndata type = 4\ninterleave = bsq\nbyte order = {int(big)}\nband names = {{ {', '.join(bands)} }}\n"


def settings(values: Mapping[str, object]) -> str:
    """KEY value lines, without those of no value."""
    return "".join(f"{k}  {v}\n" for k, v in values.items() if v is not None)


def snaphu(df: DataFrame, name: str, meta: Mapping[str, float], mode: str = "DEFO", init: str = "MST", tiles: tuple[int, int] = (1, 1), overlap: tuple[int, int] = (0, 0), processors: int = 1) -> DataFrame:
    """Wrapped phase and coherence (columns phase, coherence) with their headers, that of the unwrapped phase to come, and the unwrapper's settings.

    meta: perpendicular baseline, wavelength, near_range, orbit and earth radius, range and azimuth spacing and resolution, looks.
    """
    lines, samples = size(df)
    files = assembled(df, ["phase", "coherence"], lines, samples, lambda band, a: (f"{band}_{name}.img", np.nan_to_num(a).astype("<f4").tobytes()))
    conf = {
        "INFILE": f"phase_{name}.img", "LINELENGTH": samples, "OUTFILE": f"unwrapped_{name}.img", "CORRFILE": f"coherence_{name}.img", "LOGFILE": f"{name}.log",
        "STATCOSTMODE": mode, "INITMETHOD": init, "VERBOSE": "TRUE", "INFILEFORMAT": "FLOAT_DATA", "CORRFILEFORMAT": "FLOAT_DATA", "OUTFILEFORMAT": "FLOAT_DATA", "TRANSMITMODE": "REPEATPASS",
        "BPERP": meta.get("baseline"), "ORBITRADIUS": meta.get("orbit_radius"), "EARTHRADIUS": meta.get("earth_radius"), "LAMBDA": meta.get("wavelength"), "NEARRANGE": meta.get("near_range"),
        "DR": meta.get("range_spacing"), "DA": meta.get("azimuth_spacing"), "RANGERES": meta.get("range_resolution"), "AZRES": meta.get("azimuth_resolution"), "NCORRLOOKS": meta.get("looks"),
        "NTILEROW": tiles[0], "NTILECOL": tiles[1], "ROWOVRLP": overlap[0], "COLOVRLP": overlap[1], "NPROC": processors, "TILECOSTTHRESH": 500,
    }
    headers = {f"{b}_{name}.hdr": envi_header(lines, samples, [f"{b}_{name}"]) for b in ("phase", "coherence", "unwrapped")}
    return files.union(texts(df, headers | {"snaphu.conf": settings(conf), f"snaphu_{name}.conf": settings(conf)}))


#: Keys of a parameter file by what they hold; units stand behind the values.
GAMMA = {
    "name": ("title", ""), "mission": ("sensor", ""), "date": ("date", ""), "start": ("start_time", "s"), "center": ("center_time", "s"), "end": ("end_time", "s"), "line_time": ("azimuth_line_time", "s"), "samples": ("range_samples", ""), "lines": ("azimuth_lines", ""),
    "range_looks": ("range_looks", ""), "azimuth_looks": ("azimuth_looks", ""), "format": ("image_format", ""), "geometry": ("image_geometry", ""), "latitude": ("center_latitude", "degrees"), "longitude": ("center_longitude", "degrees"), "heading": ("heading", "degrees"),
    "range_spacing": ("range_pixel_spacing", "m"), "azimuth_spacing": ("azimuth_pixel_spacing", "m"), "frequency": ("radar_frequency", "Hz"), "prf": ("prf", "Hz"), "bandwidth": ("azimuth_proc_bandwidth", "Hz"), "orbit_radius": ("sar_to_earth_center", "m"), "earth_radius": ("earth_radius_below_sensor", "m"),
    "major": ("earth_semi_major_axis", "m"), "minor": ("earth_semi_minor_axis", "m"), "near_range": ("near_range_slc", "m"), "center_range": ("center_range_slc", "m"), "far_range": ("far_range_slc", "m"),
}
GAMMA_DEM = {"name": "title", "format": "data_format", "projection": "DEM_projection", "height_offset": "DEM_hgt_offset", "scale": "DEM_scale", "samples": "width", "lines": "nlines", "north": "corner_north", "east": "corner_east", "post_north": "post_north", "post_east": "post_east", "datum": "datum_name"}


def gamma_par(meta: Mapping[str, object], vectors: Sequence[Sequence[float]] = ()) -> str:
    """Parameter file of an image; vectors: (seconds of the day, x, y, z, vx, vy, vz) at equal steps."""
    lines = [f"{key}:\t{meta[k]}" + (f"\t{unit}" if unit else "") for k, (key, unit) in GAMMA.items() if k in meta]
    if vectors:
        step = vectors[1][0] - vectors[0][0] if len(vectors) > 1 else 0.0
        lines += [f"number_of_state_vectors:\t{len(vectors)}", f"time_of_first_state_vector:\t{vectors[0][0]}\ts", f"state_vector_interval:\t{step}\ts"]
        for k, (_, x, y, z, vx, vy, vz) in enumerate(vectors, 1):
            lines += [f"state_vector_position_{k}:\t{x}\t{y}\t{z}\tm   m   m", f"state_vector_velocity_{k}:\t{vx}\t{vy}\t{vz}\tm/s m/s m/s"]
    return "\n".join(lines) + "\n"


def gamma(df: DataFrame, name: str, meta: Mapping[str, object], vectors: Sequence[Sequence[float]] = (), band: str | None = None) -> DataFrame:
    """A band as big-endian floats, or the columns i and q as complex ones, with its parameter file."""
    lines, samples = size(df)
    own = {"name": name, "lines": lines, "samples": samples, "format": "FLOAT" if band else "FCOMPLEX", **meta}
    files = assembled(df, [band], lines, samples, lambda b, a: (f"{name}.mli", np.nan_to_num(a).astype(">f4").tobytes())) if band else complex_raw(df.select("y", "x", "i", "q"), f"{name}.slc", lines, samples, ">")
    return files.union(texts(df, {f"{name}.{'mli' if band else 'slc'}.par": gamma_par(own, vectors)}))


def gamma_dem(df: DataFrame, name: str, meta: Mapping[str, object], band: str = "height") -> DataFrame:
    """Heights as big-endian floats with the parameter files of the grid and of the offsets between its image and another."""
    lines, samples = size(df)
    own = {"name": name, "lines": lines, "samples": samples, "format": "REAL*4", "height_offset": 0.0, "scale": 1.0, "datum": "WGS84", **meta}
    files = assembled(df, [band], lines, samples, lambda b, a: (f"{name}.dem", np.nan_to_num(a).astype(">f4").tobytes()))
    par = "".join(f"{key}:\t{own[k]}\n" for k, key in GAMMA_DEM.items() if k in own)
    diff = f"title:\t{name}\ninitial_range_offset:\t0\ninitial_azimuth_offset:\t0\nrange_samp_1:\t{samples}\naz_samp_1:\t{lines}\n"
    return files.union(texts(df, {f"{name}.dem_par": par, f"{name}.diff_par": diff}))


def stamps(reference: str, images: Mapping[str, DataFrame], differences: Mapping[str, DataFrame], located: DataFrame, baselines: Mapping[str, tuple[float, float]], meta: Mapping[str, object]) -> DataFrame:
    """The folders that a persistent-scatterer chain reads, dates as names: rslc, diff0 and geo, all big-endian.

    images: (y, x, i, q) of each date, the reference's among them; differences: interferograms of the reference
    with each other date; located: (y, x, lat, lon, height); baselines: of each other date, parallel and perpendicular.
    """
    lines, samples = size(located)
    both = lambda df, name: complex_raw(df.select("y", "x", "i", "q"), name, lines, samples, ">")
    par = lambda date: gamma_par({"name": date, "lines": lines, "samples": samples, "format": "FCOMPLEX", **meta})
    names = {"lat": f"geo/{reference}.lat", "lon": f"geo/{reference}.lon", "height": f"geo/{reference}_dem.rdc"}
    files = assembled(located, ["lat", "lon", "height"], lines, samples, lambda band, a: (names[band], np.nan_to_num(a).astype(">f4").tobytes()))
    for date, df in images.items():
        files = files.union(both(df, f"rslc/{date}.rslc"))
    for date, df in differences.items():
        files = files.union(both(df, f"diff0/{reference}_{date}.diff"))
    own = {f"rslc/{d}.rslc.par": par(d) for d in images} | {f"diff0/{reference}_{d}.base": f"initial_baseline(TCN):\t0.0\t{p}\t{n}\tm m m\n" for d, (p, n) in baselines.items()}
    return files.union(texts(located, own))


def polsarpro(df: DataFrame, elements: Sequence[str], kind: str = "full") -> DataFrame:
    """Matrix elements as little-endian floats with headers and the sizes (elements as c11, c12_re, c12_im ..)."""
    lines, samples = size(df)
    names = {e: e[0].upper() + e[1:].replace("_re", "_real").replace("_im", "_imag") for e in elements}
    files = assembled(df, elements, lines, samples, lambda band, a: (f"{names[band]}.bin", np.nan_to_num(a).astype("<f4").tobytes()))
    config = f"Nrow\n{lines}\n---------\nNcol\n{samples}\n---------\nPolarCase\nmonostatic\n---------\nPolarType\n{kind}\n"
    return files.union(texts(df, {f"{n}.bin.hdr": envi_header(lines, samples, [n]) for n in names.values()} | {"config.txt": config}))


def pyrate(df: DataFrame, pairs: Sequence[tuple[str, str]], wavelength: float, geo: Mapping[str, float], incidence: float) -> DataFrame:
    """Unwrapped phases and coherences of date pairs (yyyymmdd; columns unw_a_b and coh_a_b) as TIFF, with headers, baselines' epochs, lists and settings."""
    lines, samples = size(df)
    scale, corner = (geo["x_step"], geo["y_step"], 0.0), (geo["x_first"], geo["y_first"])
    bands = [f"{k}_{a}_{b}" for a, b in pairs for k in ("unw", "coh")]
    files = None
    for band in bands:
        one = tiffs(df, [band], f"{band}.tif", lines, samples, scale, corner)
        files = one if files is None else files.union(one)
    own = {}
    for a, b in pairs:
        own[f"unw_{a}_{b}.tif.rsc"] = settings({"WIDTH": samples, "FILE_LENGTH": lines, "X_FIRST": geo["x_first"], "X_STEP": geo["x_step"], "Y_FIRST": geo["y_first"], "Y_STEP": -abs(geo["y_step"]), "WAVELENGTH": wavelength, "DATE12": f"{a[2:]}-{b[2:]}", "INCIDENCE": incidence})
    epochs = sorted({d for p in pairs for d in p})
    own["ifgs.txt"] = "".join(f"unw_{a}_{b}.tif\n" for a, b in pairs)
    own["coherence.txt"] = "".join(f"coh_{a}_{b}.tif\n" for a, b in pairs)
    own["headers.txt"] = "".join(f"unw_{a}_{b}.tif.rsc\n" for a, b in pairs)
    own["pyrate.conf"] = "".join(f"{k}: {v}\n" for k, v in {"ifgfilelist": "ifgs.txt", "cohfilelist": "coherence.txt", "hdrfilelist": "headers.txt", "outdir": "out", "noDataValue": 0.0, "processor": 0, "epochs": len(epochs), "refest": 1, "parallel": 1}.items())
    return files.union(texts(df, own))


def tiffs(df: DataFrame, bands: Sequence[str], name: str, lines: int, samples: int, scale: tuple[float, float, float] | None, corner: tuple[float, float] | None) -> DataFrame:
    """The parts of a TIFF: deflated strips, and before them the header with their places."""
    count = -(-lines // strip_lines(samples))
    packed = lambda strip, a: [(name, 1 + k * count + strip, tiff.packed(b)) for k, b in enumerate(a)]
    strips = written(striped(df, bands, lines, samples, packed), "tiff")
    sizes = [r["n"] for r in strips.select("part", F.length("content").alias("n")).orderBy("part").collect()]
    if not sizes:
        return strips
    head = tiff.head(len(bands), lines, samples, strip_lines(samples), sizes, scale, corner)
    return strips.union(df.sparkSession.createDataFrame([(name, 0, head)], FILES))


def geotiff(df: DataFrame, bands: Sequence[str], name: str, meta: Mapping[str, object] | None = None, scale: tuple[float, float, float] | None = None, corner: tuple[float, float] | None = None) -> DataFrame:
    """One TIFF of all bands, and the product's metadata as XML beside it."""
    lines, samples = size(df)
    files = tiffs(df, bands, f"{name}.tif", lines, samples, scale, corner)
    if meta is None:
        return files
    escape = lambda v: str(v).replace("&", "&amp;").replace("<", "&lt;").replace('"', "&quot;")
    body = "".join(f'  <attribute name="{escape(k)}">{escape(v)}</attribute>\n' for k, v in meta.items())
    return files.union(texts(df, {f"{name}.xml": f'<?xml version="1.0" encoding="UTF-8"?>\n<product name="{escape(name)}" lines="{lines}" samples="{samples}">\n{body}</product>\n'}))


def netcdf_head(bands: Sequence[str], lines: int, samples: int, meta: Mapping[str, object]) -> bytes:
    """What stands before the values of a classic netCDF file (64-bit offsets): dimensions y and x, a float variable for each band, text attributes."""
    pad = lambda b: b + b"\0" * (-len(b) % 4)
    named = lambda s: struct.pack(">I", len(s.encode())) + pad(s.encode())
    attributes = b"".join(named(k) + struct.pack(">II", 2, len(str(v).encode())) + pad(str(v).encode()) for k, v in meta.items())
    head = struct.pack(">4sI", b"CDF\2", 0) + struct.pack(">II", 10, 2) + named("y") + struct.pack(">I", lines) + named("x") + struct.pack(">I", samples)
    head += struct.pack(">II", 12, len(meta)) + attributes if meta else struct.pack(">II", 0, 0)
    head += struct.pack(">II", 11, len(bands))
    each = 4 * lines * samples
    entry = lambda n, at: named(n) + struct.pack(">III", 2, 0, 1) + struct.pack(">IIII", 0, 0, 5, min(each, 2**32 - 1)) + struct.pack(">Q", at)
    start = len(head) + sum(len(entry(n, 0)) for n in bands)
    return head + b"".join(entry(n, start + k * each) for k, n in enumerate(bands))


def netcdf(df: DataFrame, bands: Sequence[str], name: str, meta: Mapping[str, object] | None = None) -> DataFrame:
    """One netCDF file of all bands."""
    lines, samples = size(df)
    count = -(-lines // strip_lines(samples))
    head = netcdf_head(bands, lines, samples, meta or {})
    values = lambda strip, a: [(f"{name}.nc", k * count + strip, (b"" if k or strip else head) + b.astype(">f4").tobytes()) for k, b in enumerate(a)]
    return striped(df, bands, lines, samples, values)
