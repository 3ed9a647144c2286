"""Baseline TIFF and BigTIFF as pixels, and pixels as TIFF: strips or tiles, plain, deflated or packed bits."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import formats

# Sizes of the field types, by number, and names of the tags that are read.
SIZES = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
WIDTH, HEIGHT, BITS, PACKING, STRIPS, SAMPLES, ROWS, COUNTS, PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_COUNTS, FORMAT = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325, 339
SCALE, TIE_POINTS = 33550, 33922
PLAIN, DEFLATED, DEFLATED_OLD, PACKED_BITS = 1, 8, 32946, 32773


def fields(take: Callable[[int, int], bytes]) -> tuple[str, dict[int, tuple]]:
    """Byte order and the tags of the first image of a file of which take(offset, size) gives bytes."""
    start = take(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(start[:2])
    if order is None:
        raise ValueError("not a TIFF file")
    big = struct.unpack_from(order + "H", start, 2)[0] == 43
    at = struct.unpack_from(order + ("Q" if big else "I"), start, 8 if big else 4)[0]
    count = struct.Struct(order + ("Q" if big else "H"))
    n = count.unpack(take(at, count.size))[0]
    step, room = (20, 8) if big else (12, 4)
    entries, out = take(at + count.size, n * step), {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + ("HHQ" if big else "HHI"), entries, k * step)
        if kind not in SIZES:
            continue
        form = order + SIZES[kind] * count
        value = entries[(k + 1) * step - room : (k + 1) * step]
        if struct.calcsize(form) > room:
            value = take(struct.unpack(order + ("Q" if big else "I"), value)[0], struct.calcsize(form))
        out[tag] = struct.unpack_from(form, value)
    return order, out


def unpack_bits(data: bytes) -> bytes:
    """Runs of bytes: n + 1 as they are, or one 1 - n times."""
    out, k = bytearray(), 0
    while k < len(data):
        n = data[k] - 256 if data[k] > 127 else data[k]
        if n >= 0:
            out += data[k + 1 : k + 2 + n]
            k += n + 2
        elif n > -128:
            out += data[k + 1 : k + 2] * (1 - n)
            k += 2
        else:
            k += 1
    return bytes(out)


class Image:
    """The first image of a file of which take(offset, size) gives bytes, by its strips or tiles."""

    def __init__(self, take: Callable[[int, int], bytes]):
        self.take = take
        order, tags = self.order, self.tags = fields(take)
        one = lambda tag, other: tags.get(tag, (other,))[0]
        self.width, self.height, self.samples, bits = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1), one(BITS, 1)
        kind, self.packing, self.apart = one(FORMAT, 1), one(PACKING, 1), one(PLANAR, 1) == 2
        if self.packing not in (PLAIN, DEFLATED, DEFLATED_OLD, PACKED_BITS) or bits % 8:
            raise ValueError(f"compression {self.packing} with {bits} bits is not read")
        self.dtype = np.dtype({1: f"u{bits // 8}", 2: f"i{bits // 8}", 3: f"f{bits // 8}", 5: f"i{bits // 16 or 1}", 6: f"c{bits // 8}"}[kind]).newbyteorder(order)
        self.pair, self.steps = 2 if kind == 5 else 1, one(PREDICTOR, 1) == 2
        self.tiled = TILES in tags
        self.w, self.h = (one(TILE_WIDTH, self.width), one(TILE_HEIGHT, self.height)) if self.tiled else (self.width, min(one(ROWS, self.height), self.height))
        self.starts, self.sizes = (tags[TILES], tags[TILE_COUNTS]) if self.tiled else (tags[STRIPS], tags[COUNTS])
        self.across, self.down = -(-self.width // self.w), -(-self.height // self.h)
        self.kind = self.dtype.newbyteorder("=") if self.pair == 1 else np.dtype(np.complex64)

    def places(self) -> int:
        """Strips or tiles of each band."""
        return self.across * self.down

    def piece(self, k: int) -> np.ndarray:
        """Bands (band, line, sample) of a stored strip or tile."""
        data = self.take(self.starts[k], self.sizes[k])
        data = zlib.decompress(data) if self.packing in (DEFLATED, DEFLATED_OLD) else unpack_bits(data) if self.packing == PACKED_BITS else data
        y, x = divmod(k % self.places(), self.across)
        lines, each = self.h if self.tiled else min(self.h, self.height - y * self.h), 1 if self.apart else self.samples
        a = np.frombuffer(data, self.dtype, lines * self.w * each * self.pair).reshape(lines, self.w, each, self.pair)
        if self.steps:
            a = np.cumsum(a, 1, dtype=a.dtype)
        a = a[..., 0] + 1j * a[..., 1] if self.pair == 2 else a[..., 0]
        return a[: self.height - y * self.h, : self.width - x * self.w].transpose(2, 0, 1)

    def at(self, place: int) -> tuple[int, int, np.ndarray]:
        """First line and sample of a place, and all its bands."""
        y, x = divmod(place, self.across)
        own = [self.piece(k) for k in (range(place, len(self.starts), self.places()) if self.apart else (place,))]
        return y * self.h, x * self.w, np.concatenate(own).astype(self.kind, copy=False)


def decode(content: bytes) -> tuple[np.ndarray, dict[int, tuple]]:
    """Bands (band, line, sample) of the first image, complex ones as complex, and its tags."""
    image = Image(lambda at, n: content[at : at + n])
    out = np.zeros((image.samples, image.height, image.width), image.kind)
    for k in range(image.places()):
        y, x, a = image.at(k)
        out[:, y : y + a.shape[1], x : x + a.shape[2]] = a
    return out, image.tags


def packed(strip: np.ndarray, deflate: bool = True) -> bytes:
    data = strip.astype("<f4").tobytes()
    return zlib.compress(data) if deflate else data


def encode(bands: np.ndarray, scale: tuple[float, float, float] | None = None, corner: tuple[float, float] | None = None, deflate: bool = True) -> bytes:
    """Bands (band, line, sample) as a little-endian TIFF of floats, one strip for each band; scale and upper left corner for maps."""
    strips = [packed(b, deflate) for b in bands]
    return head(*bands.shape, bands.shape[1], [len(s) for s in strips], scale, corner, deflate) + b"".join(strips)


def head(n: int, height: int, width: int, rows: int, sizes: list[int], scale: tuple[float, float, float] | None = None, corner: tuple[float, float] | None = None, deflate: bool = True) -> bytes:
    """What stands before the strips of `rows` lines, of the given sizes, band by band."""
    tags = {WIDTH: ("I", [width]), HEIGHT: ("I", [height]), BITS: ("H", [32] * n), PACKING: ("H", [DEFLATED if deflate else PLAIN]), 262: ("H", [1]), STRIPS: ("I", [0] * len(sizes)), SAMPLES: ("H", [n]), ROWS: ("I", [rows]), COUNTS: ("I", sizes), PLANAR: ("H", [2]), FORMAT: ("H", [3] * n)}
    if scale and corner:
        tags |= {SCALE: ("d", list(scale)), TIE_POINTS: ("d", [0, 0, 0, *corner, 0])}
    number = {"H": 3, "I": 4, "d": 12}
    start = 8 + 2 + 12 * len(tags) + 4
    long = {t: struct.calcsize("<" + f * len(v)) for t, (f, v) in tags.items()}
    data_at = start + sum(s for s in long.values() if s > 4)
    tags[STRIPS] = ("I", [data_at + at for at in accumulate(sizes[:-1], initial=0)])
    first, rest = struct.pack("<2sHIH", b"II", 42, 8, len(tags)), b""
    for tag, (f, v) in sorted(tags.items()):
        value = struct.pack("<" + f * len(v), *v)
        if len(value) > 4:
            rest, value = rest + value, struct.pack("<I", start + len(rest))
        first += struct.pack("<HHI", tag, number[f], len(v)) + value.ljust(4, b"\0")
    return first + struct.pack("<I", 0) + rest


def read(spark: SparkSession, path: str, names: list[str] | None = None, is_complex: bool = False) -> DataFrame:
    """Pixels (file, y, x, bands) of all TIFF files under path; complex bands as name_i and name_q. A task holds a strip or tile at once."""
    names = names or ["band1"]
    columns = [c for n in names for c in ((f"{n}_i", f"{n}_q") if is_complex else (n,))]

    def places(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for name in pdf["path"]:
                with formats.opened(name) as take:
                    yield pd.DataFrame({"path": name, "place": np.arange(Image(take).places()), "content": None})

    def pixels(name: str, image: Image, place: int) -> pd.DataFrame:
        y0, x0, a = image.at(place)
        yy, xx = np.mgrid[y0 : y0 + a.shape[1], x0 : x0 + a.shape[2]]
        own = [p for b in a[: len(names)] for p in ((b.real, b.imag) if is_complex else (b,))]
        return pd.DataFrame({"file": name, "y": yy.ravel(), "x": xx.ravel(), **{c: p.ravel().astype(float) for c, p in zip(columns, own, strict=True)}})

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for name, place, content in zip(pdf["path"], pdf["place"], pdf["content"], strict=True):
                if content is None:
                    with formats.opened(name) as take:
                        yield pixels(name, Image(take), place)
                else:
                    image = Image(lambda at, n, c=content: c[at : at + n])
                    for k in range(image.places()):
                        yield pixels(name, image, k)

    files = spark.read.format("binaryFile").load(path)
    if formats.reached(files):
        found = files.select("path").mapInPandas(places, "path string, place long, content binary").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    else:
        found = files.select("path", F.lit(0).cast("long").alias("place"), "content")
    return found.mapInPandas(run, "file string, y long, x long, " + ", ".join(f"{c} double" for c in columns))
