"""Products of missions: metadata and tables from their XML or JSON, pixels from the files beside it.

Every reader takes a path that Spark's binary source takes; the XML of a product is one record. What
a mission calls the same thing stands in PATHS, so that a new mission is a new column of that table.
"""

from __future__ import annotations

import json
import struct
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from . import formats
from .orbits import days

# Where each mission's XML has what; the first element of a path that is there counts.
PATHS = {
    "sentinel1": {
        "mission": "adsHeader/missionId", "product_type": "adsHeader/productType", "polarisation": "adsHeader/polarisation", "mode": "adsHeader/mode", "swath": "adsHeader/swath", "start": "adsHeader/startTime", "stop": "adsHeader/stopTime", "orbit": "adsHeader/absoluteOrbitNumber",
        "pass": "generalAnnotation/productInformation/pass", "frequency": "generalAnnotation/productInformation/radarFrequency", "sampling_rate": "generalAnnotation/productInformation/rangeSamplingRate",
        "lines": "imageAnnotation/imageInformation/numberOfLines", "samples": "imageAnnotation/imageInformation/numberOfSamples", "range_spacing": "imageAnnotation/imageInformation/rangePixelSpacing", "azimuth_spacing": "imageAnnotation/imageInformation/azimuthPixelSpacing", "line_time": "imageAnnotation/imageInformation/azimuthTimeInterval", "range_time": "imageAnnotation/imageInformation/slantRangeTime",
    },
    "radarsat2": {
        "mission": "sourceAttributes/satellite", "product_type": "imageGenerationParameters/generalProcessingInformation/productType", "mode": "sourceAttributes/beamModeMnemonic", "start": "imageGenerationParameters/sarProcessingInformation/zeroDopplerTimeFirstLine", "stop": "imageGenerationParameters/sarProcessingInformation/zeroDopplerTimeLastLine", "polarisation": "sourceAttributes/radarParameters/polarizations",
        "pass": "sourceAttributes/orbitAndAttitude/orbitInformation/passDirection", "frequency": "sourceAttributes/radarParameters/radarCenterFrequency", "sampling_rate": "sourceAttributes/radarParameters/adcSamplingRate",
        "lines": "imageAttributes/rasterAttributes/numberOfLines", "samples": "imageAttributes/rasterAttributes/numberOfSamplesPerLine", "range_spacing": "imageAttributes/rasterAttributes/sampledPixelSpacing", "azimuth_spacing": "imageAttributes/rasterAttributes/sampledLineSpacing",
    },
    "rcm": {
        "mission": "sourceAttributes/satellite", "product_type": "imageGenerationParameters/generalProcessingInformation/productType", "mode": "sourceAttributes/beamModeMnemonic", "start": "imageGenerationParameters/sarProcessingInformation/zeroDopplerTimeFirstLine", "stop": "imageGenerationParameters/sarProcessingInformation/zeroDopplerTimeLastLine", "polarisation": "sourceAttributes/radarParameters/polarizations",
        "pass": "sourceAttributes/orbitAndAttitude/orbitInformation/passDirection", "frequency": "sourceAttributes/radarParameters/radarCenterFrequency", "sampling_rate": "sourceAttributes/radarParameters/adcSamplingRate",
        "lines": "sceneAttributes/imageAttributes/numLines", "samples": "sceneAttributes/imageAttributes/samplesPerLine", "range_spacing": "imageReferenceAttributes/rasterAttributes/sampledPixelSpacing", "azimuth_spacing": "imageReferenceAttributes/rasterAttributes/sampledLineSpacing",
    },
    "terrasarx": {
        "mission": "productInfo/missionInfo/mission", "product_type": "productInfo/productVariantInfo/productVariant", "mode": "productInfo/acquisitionInfo/imagingMode", "start": "productInfo/sceneInfo/start/timeUTC", "stop": "productInfo/sceneInfo/stop/timeUTC", "polarisation": "productInfo/acquisitionInfo/polarisationList/polLayer", "orbit": "productInfo/missionInfo/absOrbit",
        "pass": "productInfo/missionInfo/orbitDirection", "frequency": "instrument/radarParameters/centerFrequency", "lines": "productInfo/imageDataInfo/imageRaster/numberOfRows", "samples": "productInfo/imageDataInfo/imageRaster/numberOfColumns", "range_spacing": "productInfo/imageDataInfo/imageRaster/columnSpacing", "azimuth_spacing": "productInfo/imageDataInfo/imageRaster/rowSpacing", "range_time": "productInfo/sceneInfo/rangeTime/firstPixel",
        "calibration": "calibration/calibrationConstant/calFactor",
    },
}
PATHS["paz"], PATHS["spacety"] = PATHS["terrasarx"], PATHS["sentinel1"]
PATHS["gaofen3"] = {
    "mission": "satellite", "product_type": "productinfo/productType", "mode": "sensor/imagingMode", "start": "imageinfo/imagingTime/start", "stop": "imageinfo/imagingTime/end", "polarisation": "sensor/polarParams/polar/polarMode", "pass": "Direction",
    "frequency": "sensor/RadarCenterFrequency", "lines": "imageinfo/height", "samples": "imageinfo/width", "range_spacing": "imageinfo/widthspace", "azimuth_spacing": "imageinfo/heightspace",
}
PATHS["capella"] = {
    "mission": "collect/platform", "product_type": "product_type", "mode": "collect/mode", "start": "collect/start_timestamp", "stop": "collect/stop_timestamp", "polarisation": "collect/radar/transmit_polarization", "pass": "collect/state/direction", "frequency": "collect/radar/center_frequency",
    "lines": "collect/image/rows", "samples": "collect/image/columns", "range_spacing": "collect/image/pixel_spacing_column", "azimuth_spacing": "collect/image/pixel_spacing_row", "line_time": "collect/image/image_geometry/delta_line_time", "calibration": "collect/image/scale_factor",
}
#: Units that are not ours: factors to Hz.
FACTORS = {("gaofen3", "frequency"): 1e9}
#: Of each mission: the vectors' element, its time, position and velocity.
VECTORS = {
    "sentinel1": ("generalAnnotation/orbitList/orbit", "time", ("position/x", "position/y", "position/z"), ("velocity/x", "velocity/y", "velocity/z")),
    "radarsat2": ("sourceAttributes/orbitAndAttitude/orbitInformation/stateVector", "timeStamp", ("xPosition", "yPosition", "zPosition"), ("xVelocity", "yVelocity", "zVelocity")),
    "terrasarx": ("platform/orbit/stateVec", "timeUTC", ("posX", "posY", "posZ"), ("velX", "velY", "velZ")),
}
VECTORS["rcm"], VECTORS["paz"], VECTORS["spacety"] = VECTORS["radarsat2"], VECTORS["terrasarx"], VECTORS["sentinel1"]
VECTORS["gaofen3"] = ("GPS/GPSParam", "TimeStamp", ("xPosition", "yPosition", "zPosition"), ("xVelocity", "yVelocity", "zVelocity"))
VECTORS["capella"] = ("collect/state/state_vectors", "time", ("position/0", "position/1", "position/2"), ("velocity/0", "velocity/1", "velocity/2"))
TEXT = ("mission", "product_type", "polarisation", "mode", "swath", "pass", "start", "stop")
NUMBERS = ("orbit", "lines", "samples", "range_spacing", "azimuth_spacing", "line_time", "range_time", "frequency", "sampling_rate", "calibration")


def root_of(content: bytes) -> ET.Element:
    """The document without its name spaces."""
    root = ET.fromstring(content)
    for e in root.iter():
        e.tag = e.tag.rpartition("}")[2]
    return root


class Document:
    """Metadata by paths, whether it is XML or JSON; a step into a list is its number."""

    def __init__(self, node: ET.Element | dict | list):
        self.node = node

    @classmethod
    def of(cls, content: bytes) -> Document:
        return cls(json.loads(content) if content.lstrip()[:1] == b"{" else root_of(content))

    def at(self, path: str) -> object:
        if isinstance(self.node, ET.Element):
            return self.node.findtext(path)
        node = self.node
        for step in path.split("/"):
            node = node.get(step) if isinstance(node, dict) else node[int(step)] if isinstance(node, list) and int(step) < len(node) else None
        return node

    def text(self, path: str) -> str | None:
        found = self.at(path)
        return str(found).strip() or None if found is not None else None

    def every(self, path: str) -> list[Document]:
        if isinstance(self.node, ET.Element):
            return [Document(e) for e in self.node.findall(path)]
        return [Document(e) for e in self.at(path) or []]


def _rows(spark: SparkSession, path: str, parse, schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    found = list(parse(content))
                except (ET.ParseError, ValueError, AttributeError) as e:
                    raise ValueError(f"{name}: {e}") from e
                yield pd.DataFrame([(name, *r) for r in found], columns=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def metadata(spark: SparkSession, path: str, mission: str) -> DataFrame:
    """One row per product: file, what TEXT and NUMBERS name (null where the product does not say), start and stop also in days since 2000."""
    paths = PATHS[mission]

    def parse(content: bytes):
        product = Document.of(content)
        text = {k: product.text(p) for k, p in paths.items()}
        own = [text.get(k) for k in TEXT] + [float(text[k]) * FACTORS.get((mission, k), 1.0) if text.get(k) else None for k in NUMBERS]
        yield (*own, *(days(text[k].rstrip("Z")) if text.get(k) else None for k in ("start", "stop")))

    schema = "file string, " + ", ".join(f"{k} string" for k in TEXT) + ", " + ", ".join(f"{k} double" for k in NUMBERS) + ", start_day double, stop_day double"
    return _rows(spark, path, parse, schema)


def state_vectors(spark: SparkSession, path: str, mission: str) -> DataFrame:
    """(file, t, x, y, z, vx, vy, vz) of every product, t in days since 2000."""
    element, when, position, velocity = VECTORS[mission]

    def parse(content: bytes):
        for e in Document.of(content).every(element):
            yield (days(e.text(when).rstrip("Z")), *(float(e.text(p)) for p in (*position, *velocity)))

    return _rows(spark, path, parse, "file string, t double, x double, y double, z double, vx double, vy double, vz double")


def sentinel1_grid(spark: SparkSession, path: str) -> DataFrame:
    """Tie points (file, line, pixel, latitude, longitude, height, incidence, elevation, range_time)."""
    names = ("line", "pixel", "latitude", "longitude", "height", "incidenceAngle", "elevationAngle", "slantRangeTime")

    def parse(content: bytes):
        for e in root_of(content).iter("geolocationGridPoint"):
            yield tuple(float(e.findtext(n)) for n in names)

    return _rows(spark, path, parse, "file string, line double, pixel double, latitude double, longitude double, height double, incidence double, elevation double, range_time double")


def sentinel1_table(spark: SparkSession, path: str, vector: str = "calibrationVector", columns: tuple[str, ...] = ("sigmaNought", "betaNought", "gamma", "dn")) -> DataFrame:
    """Knots of a calibration or noise file: (file, line, pixel, columns); noise: vector="noiseRangeVector", columns=("noiseRangeLut",)."""

    def parse(content: bytes):
        for e in root_of(content).iter(vector):
            line, pixels = float(e.findtext("line")), [float(p) for p in e.findtext("pixel").split()]
            values = [[float(v) for v in e.findtext(c).split()] for c in columns]
            yield from ((line, p, *v) for p, *v in zip(pixels, *values, strict=True))

    return _rows(spark, path, parse, "file string, line double, pixel double, " + ", ".join(f"{c} double" for c in columns))


def gains(spark: SparkSession, path: str) -> DataFrame:
    """Look-up tables of range gains: (file, pixel, offset, gain); steps and the first pixel count where the table has them, descending steps too."""

    def parse(content: bytes):
        root = root_of(content)
        offset, values = float(root.findtext("offset") or 0), [float(v) for v in root.findtext("gains").split()]
        first, step = float(root.findtext("pixelFirstLutValue") or 0), float(root.findtext("stepSize") or 1)
        yield from ((first + k * step, offset, v) for k, v in enumerate(values))

    return _rows(spark, path, parse, "file string, pixel double, offset double, gain double")


def calibration_constants(spark: SparkSession, path: str) -> DataFrame:
    """(file, polarisation, factor) of products that have a constant for each channel."""

    def parse(content: bytes):
        for e in root_of(content).findall("calibration/calibrationConstant"):
            yield (e.findtext("polLayer") or "").strip(), float(e.findtext("calFactor"))

    return _rows(spark, path, parse, "file string, polarisation string, factor double")


def parameters(text: str) -> dict[str, str]:
    """`key: value` lines of a parameter file; units are left out."""
    out = {}
    for line in text.replace("\r", "").split("\n"):
        key, colon, value = line.partition(":")
        if colon and value.split():
            out[key.strip()] = value.split("\t")[1].strip() if value.startswith("\t") and "\t" in value[1:] and not key.startswith(("state_vector_position", "state_vector_velocity")) else value.strip()
    return out


def read_gamma(spark: SparkSession, path: str, par: str) -> DataFrame:
    """Pixels (file, y, x, i, q or v) of big-endian images under path, all of the parameter file's size and format."""
    meta = parameters(par)
    lines, samples, kind = int(meta["azimuth_lines"]), int(meta["range_samples"]), meta.get("image_format", "FLOAT")
    dtype = {"FCOMPLEX": ">f4", "SCOMPLEX": ">i2", "FLOAT": ">f4"}[kind]
    names = ["i", "q"] if "COMPLEX" in kind else ["v"]

    def decode(take, first: int, count: int) -> dict:
        line = samples * len(names) * np.dtype(dtype).itemsize
        a = np.frombuffer(take(first * line, count * line), dtype).reshape(-1, len(names)).astype(float)
        return {n: a[:, k] for k, n in enumerate(names)}

    return formats.read_strips(spark, path, lines, samples, ", ".join(f"{n} double" for n in names), decode)


def read_polsarpro(spark: SparkSession, folder: str, elements: list[str]) -> DataFrame:
    """Matrix elements (y, x, elements) of a folder of .bin files by the sizes in its config.txt."""
    config = spark.read.text(f"{folder}/config.txt", wholetext=True).first()[0].replace("\r", "").split("\n")
    lines, samples = (int(config[config.index(k) + 1]) for k in ("Nrow", "Ncol"))
    names = {e[0].upper() + e[1:].replace("_re", "_real").replace("_im", "_imag"): e for e in elements}

    files = spark.read.format("binaryFile").load(f"{folder}/*.bin")
    paths = {names[own]: p["path"] for p in files.select("path").collect() if (own := p["path"].rpartition("/")[2].removesuffix(".bin")) in names}
    if lines and paths and formats.reached(files):
        # all elements of a strip at once: nothing has to meet again
        step = formats.strip_lines(samples)

        def strips(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in it:
                for k in pdf["id"]:
                    count = min(step, lines - k * step)
                    yy, xx = np.mgrid[k * step : k * step + count, :samples]
                    out = {"y": yy.ravel(), "x": xx.ravel()}
                    for e in elements:
                        out[e] = np.full(count * samples, np.nan)
                        if e in paths:
                            with formats.opened(paths[e]) as take:
                                out[e] = np.frombuffer(take(4 * k * step * samples, 4 * count * samples), "<f4").astype(float)
                    yield pd.DataFrame(out)

        count = -(-lines // step)
        return spark.range(0, count, 1, min(count, int(spark.conf.get("spark.sql.shuffle.partitions")))).mapInPandas(strips, "y long, x long, " + ", ".join(f"{e} double" for e in elements))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                own = names.get(path.rpartition("/")[2].removesuffix(".bin"))
                if own:
                    a = np.frombuffer(content, "<f4").reshape(lines, samples).astype(float)
                    yy, xx = np.mgrid[:lines, :samples]
                    yield pd.DataFrame({"y": yy.ravel(), "x": xx.ravel(), "element": own, "v": a.ravel()})

    long = files.select("path", "content").mapInPandas(run, "y long, x long, element string, v double")
    return long.groupBy("y", "x").pivot("element", elements).max("v")


def sun_raster(content: bytes) -> np.ndarray:
    """Lines and samples of an 8-bit or 1-bit raster file, plain or run-length encoded (0x80 n v: n + 1 times v; 0x80 0: 0x80)."""
    magic, width, height, depth, _, kind, _, colours = struct.unpack_from(">8I", content)
    if magic != 0x59A66A95 or depth not in (1, 8):
        raise ValueError("not a raster file of 1 or 8 bits")
    data = content[32 + colours :]
    if kind == 2:
        out, k = bytearray(), 0
        while k < len(data):
            if data[k] != 0x80:
                out.append(data[k])
                k += 1
            elif data[k + 1] == 0:
                out.append(0x80)
                k += 2
            else:
                out += bytes([data[k + 2]]) * (data[k + 1] + 1)
                k += 3
        data = bytes(out)
    stride = -(-width * depth // 16) * 2
    a = np.frombuffer(data, np.uint8, stride * height).reshape(height, stride)
    return (np.unpackbits(a, axis=1) if depth == 1 else a)[:, :width]


def read_sun_raster(spark: SparkSession, path: str) -> DataFrame:
    """Pixels (file, y, x, v) of raster files."""

    def parse(content: bytes):
        a = sun_raster(content)
        yield from ((int(y), int(x), float(a[y, x])) for y in range(a.shape[0]) for x in range(a.shape[1]))

    return _rows(spark, path, parse, "file string, y long, x long, v double")
