"""Raster files: band-sequential binary with a text header, read and written in parallel."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Data type codes of the header.
TYPES = {"1": "u1", "2": "i2", "3": "i4", "4": "f4", "5": "f8", "12": "u2", "13": "u4", "14": "i8", "15": "u8"}


def header(text: str) -> dict[str, str]:
    """key = value lines of a header; a value in braces may span lines."""
    out, rest = {}, text.replace("\r", "").split("\n")
    while rest:
        line = rest.pop(0)
        key, eq, value = line.partition("=")
        if not eq:
            continue
        while "{" in value and "}" not in value and rest:
            value += " " + rest.pop(0)
        out[key.strip().lower()] = value.strip()
    return out


#: Pixels of the strips in which scenes are written and read.
STRIP = 1 << 18


def strip_lines(samples: int) -> int:
    return max(1, STRIP // max(samples, 1))


@contextmanager
def opened(path: str) -> Iterator[Callable[[int, int], bytes]]:
    """take(offset, size) of a file in a store that Arrow reaches."""
    store, place = pafs.FileSystem.from_uri(path)
    with store.open_input_file(place) as f:
        yield lambda at, n: f.read_at(min(n, max(f.size() - at, 0)), at)


def reached(files: DataFrame) -> bool:
    """Whether Arrow reaches the store of these files, so that tasks can read parts of them; else a file is a record of Spark's source."""
    one = files.select("path").first()
    try:
        return one is not None and pafs.FileSystem.from_uri(one["path"])[0].get_file_info([pafs.FileSystem.from_uri(one["path"])[1]])[0].is_file
    except (pa.ArrowException, OSError):
        return False


def read_strips(spark: SparkSession, path: str, lines: int, samples: int, schema: str, decode: Callable[[Callable[[int, int], bytes], int, int], dict]) -> DataFrame:
    """Pixels (file, y, x and what the schema adds) of equal files, by strips: decode(take, first, count) gives the columns of those lines."""
    step = strip_lines(samples)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for name, own, content in zip(pdf["path"], pdf["first"], pdf["content"], strict=True):
                for first in range(0, lines, step) if content is not None else (own,):
                    count = min(step, lines - first)
                    if content is not None:
                        values = decode(lambda at, n, c=content: c[at : at + n], first, count)
                    else:
                        with opened(name) as take:
                            values = decode(take, first, count)
                    yy, xx = np.mgrid[first : first + count, :samples]
                    yield pd.DataFrame({"file": name, "y": yy.ravel(), "x": xx.ravel(), **values})

    files = spark.read.format("binaryFile").load(path)
    if lines and reached(files):
        tasks = min(-(-lines // step), int(spark.conf.get("spark.sql.shuffle.partitions")))
        parts = files.select("path", F.explode(F.sequence(F.lit(0), F.lit(lines - 1), F.lit(step))).alias("first"), F.lit(None).cast("binary").alias("content")).repartition(tasks)
    else:
        parts = files.select("path", F.lit(0).alias("first"), "content")
    return parts.mapInPandas(run, f"file string, y long, x long, {schema}")


def read_bsq(spark: SparkSession, path: str, meta: dict[str, str], names: list[str] | None = None) -> DataFrame:
    """Pixels (file, y, x, bands) of binary files under path, all with the header meta."""
    lines, samples, bands = (int(meta[k]) for k in ("lines", "samples", "bands"))
    kind = np.dtype(TYPES[meta.get("data type", "4")]).newbyteorder(">" if meta.get("byte order", "0") == "1" else "<")
    names = names or [f"band{k + 1}" for k in range(bands)]
    skip, line = int(meta.get("header offset", "0")), samples * kind.itemsize

    def decode(take: Callable[[int, int], bytes], first: int, count: int) -> dict:
        return {n: np.frombuffer(take(skip + (k * lines + first) * line, count * line), kind).astype(float) for k, n in enumerate(names)}

    return read_strips(spark, path, lines, samples, ", ".join(f"{n} double" for n in names), decode)


def encode_bsq(df: DataFrame, bands: list[str], tile: int = 256) -> DataFrame:
    """One row per tile (ty, tx, header, content) of the pixels' bands as little-endian floats; absent pixels are NaN."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        ty, tx = int(pdf.ty.iloc[0]), int(pdf.tx.iloc[0])
        a = np.full((len(bands), tile, tile), np.nan, "<f4")
        for k, b in enumerate(bands):
            a[k, pdf.y - ty * tile, pdf.x - tx * tile] = pdf[b]
        text = f"ENVI\nsamples = {tile}\nlines = {tile}\nbands = {len(bands)}\nheader offset = 0\ndata type = 4\ninterleave = bsq\nbyte order = 0\nband names = {{{', '.join(bands)}}}\n"
        return pd.DataFrame({"ty": [ty], "tx": [tx], "header": [text], "content": [a.tobytes()]})

    placed = df.withColumns({"ty": F.floor(F.col("y") / tile), "tx": F.floor(F.col("x") / tile)})
    return placed.groupBy("ty", "tx").applyInPandas(pack, "ty long, tx long, header string, content binary")


def write_partitioned(df: DataFrame, path: str, tile: int = 1024, by: tuple[str, ...] = ()) -> None:
    """Pixels as Parquet, one folder per tile (and acquisition)."""
    placed = df.withColumns({"ty": F.floor(F.col("y") / tile), "tx": F.floor(F.col("x") / tile)})
    placed.repartition(*by, "ty", "tx").write.partitionBy(*by, "ty", "tx").parquet(path)
