"""Orbit files as state vectors: (file, t, x, y, z, vx, vy, vz, valid_from, valid_to), t in days since 2000-01-01 UTC, metres, m/s.

Files are bounded records of Spark's binary source, so any store that Spark reads will do; each is
parsed in one task and files in parallel. A file that does not parse fails the query with its name.
"""

from __future__ import annotations

import io
import math
import re
import struct
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EPOCH = datetime(2000, 1, 1, tzinfo=UTC)
SCHEMA = "file string, t double, x double, y double, z double, vx double, vy double, vz double, valid_from double, valid_to double"
#: Days between 1985-01-01, which the arcs of the altimetry records count from, and 2000-01-01.
SINCE_1985 = (datetime(1985, 1, 1, tzinfo=UTC) - EPOCH).days
# Dates from which TAI - UTC has each number of seconds, from 1991 on.
LEAP_SECONDS = [("1991-01-01", 26), ("1992-07-01", 27), ("1993-07-01", 28), ("1994-07-01", 29), ("1996-01-01", 30), ("1997-07-01", 31), ("1999-01-01", 32), ("2006-01-01", 33), ("2009-01-01", 34), ("2012-07-01", 35), ("2015-07-01", 36), ("2017-01-01", 37)]
TDT_TAI = 32.184
#: Vectors of a parser: rows of t and six numbers, and the validity, both in days.
Parsed = tuple[list[tuple[float, ...]], float | None, float | None]


def days(when: str) -> float:
    """Days since 2000 of an ISO time, with or without a prefix such as UTC=."""
    return (datetime.fromisoformat(when.partition("=")[2] or when).replace(tzinfo=UTC) - EPOCH).total_seconds() / 86400


def utc_of_tdt(t: float) -> float:
    """Days UTC of days in terrestrial dynamic time."""
    tai = t - TDT_TAI / 86400
    return tai - next((s for since, s in reversed(LEAP_SECONDS) if tai >= days(since)), LEAP_SECONDS[0][1]) / 86400


def parse_eof(content: bytes) -> Parsed:
    """Earth observation files (precise and restituted orbits): OSV elements, validity in the header."""
    rows, ends = [], {}
    for _, e in ET.iterparse(io.BytesIO(content)):
        tag = e.tag.rpartition("}")[2]
        if tag in ("Validity_Start", "Validity_Stop"):
            ends[tag] = days(e.text.strip())
        elif tag == "OSV":
            own = {c.tag.rpartition("}")[2]: c.text for c in e}
            rows.append((days(own["UTC"]), *(float(own[k]) for k in ("X", "Y", "Z", "VX", "VY", "VZ"))))
            e.clear()
    return rows, ends.get("Validity_Start"), ends.get("Validity_Stop")


def parse_prare(content: bytes) -> Parsed:
    """Fixed-width records of 130 characters: identification, header, then trajectory records, inertial (STATE) ones first, terrestrial (STTERR) after."""
    text = content.decode("ascii").replace("\r", "").replace("\n", "")
    records = [text[k : k + 130] for k in range(0, len(text), 130)]
    rows = []
    for r in records[2:]:
        if not r.startswith("STTERR"):
            continue
        cuts = np.cumsum([6, 7, 1, 6, 11, 12, 12, 12, 11, 11, 11])
        f = [r[a:b].strip() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        t = utc_of_tdt(int(f[2]) * 0.1 + 0.5 + int(f[3]) * 1e-6 / 86400)
        rows.append((t, *(int(v) * 1e-3 for v in f[4:7]), *(int(v) * 1e-6 for v in f[7:10])))
    return rows, rows[0][0] if rows else None, rows[-1][0] if rows else None


def parse_odr(content: bytes) -> Parsed:
    """Big-endian arcs of latitude, longitude and height: positions on a sphere of the height about the centre, without velocities.

    As the arcs are only interpolated between their own points, positions are polar, not geodetic.
    """
    kind, count = content[:4], struct.unpack_from(">i", content, 24)[0]
    scale = {b"xODR": 1e7, b"@ODR": 1e6}.get(kind)
    if scale is None:
        raise ValueError(f"not an arc of orbital data records: {kind!r}")
    rows = []
    for t, lat, lon, height in struct.iter_unpack(">4i", content[32 : 32 + 16 * count]):
        lat, lon, r = math.radians(lat / scale), math.radians(lon / scale), height / 1000
        rows.append((t / 86400 + SINCE_1985, r * math.cos(lat) * math.cos(lon), r * math.cos(lat) * math.sin(lon), r * math.sin(lat), *[math.nan] * 3))
    return rows, rows[0][0] if rows else None, rows[-1][0] if rows else None


# Month names of the records.
MONTHS = "JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split()


def parse_doris(content: bytes) -> Parsed:
    """Text records of a day-month-year time, UT1 difference, orbit, position (m) and velocity (m/s)."""
    rows = []
    for m in re.finditer(rb"(\d\d)-([A-Z]{3})-(\d{4}) (\d\d):(\d\d):(\d\d\.\d+)\s+[+-]?\d*\.\d+\s+[+-]?\d+((?:\s+[+-]?\d+\.\d+){6})", content):
        day, month, year, hour, minute, second, vector = (g.decode() for g in m.groups())
        t = (datetime(int(year), MONTHS.index(month) + 1, int(day), int(hour), int(minute), tzinfo=UTC) - EPOCH).total_seconds() + float(second)
        rows.append((t / 86400, *map(float, vector.split())))
    return rows, rows[0][0] if rows else None, rows[-1][0] if rows else None


def parse_positions(content: bytes) -> Parsed:
    """Standard product orbits: lines of time (*), position (P, km) and velocity (V, dm/s)."""
    rows, now, position = [], None, None
    for line in content.decode("ascii", "replace").splitlines():
        if line.startswith("*"):
            year, month, day, hour, minute, *rest = line.split()[1:7]
            now = (datetime(int(year), int(month), int(day), int(hour), int(minute), tzinfo=UTC) - EPOCH).total_seconds() / 86400 + float(rest[0] if rest else 0) / 86400
        elif line.startswith("P") and now is not None:
            position = [float(v) * 1000 for v in line.split()[1:4]]
        elif line.startswith("V") and position is not None:
            rows.append((now, *position, *(float(v) * 0.1 for v in line.split()[1:4])))
            position = None
    return rows, rows[0][0] if rows else None, rows[-1][0] if rows else None


KINDS: dict[str, Callable[[bytes], Parsed]] = {"eof": parse_eof, "prare": parse_prare, "odr": parse_odr, "doris": parse_doris, "positions": parse_positions}


def read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """State vectors of all orbit files under path; a file without vectors gives no row."""
    parse = KINDS[kind]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows, start, stop = parse(content)
                except (ValueError, KeyError, ET.ParseError, struct.error) as e:
                    raise ValueError(f"{name}: {e}") from e
                out = pd.DataFrame(rows, columns=["t", "x", "y", "z", "vx", "vy", "vz"], dtype=float)
                yield out.assign(file=name, valid_from=start, valid_to=stop)[["file", "t", "x", "y", "z", "vx", "vy", "vz", "valid_from", "valid_to"]]

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SCHEMA)


def listed(pages: DataFrame, page: str = "html") -> DataFrame:
    """Orbit files named in listings: (name, mission, kind, made, valid_from, valid_to), the three in days, each name once."""
    name = r"[A-Z0-9]{3}_OPER_AUX_(?:POEORB|RESORB|PREORB)_[A-Z]{4}_\d{8}T\d{6}_V\d{8}T\d{6}_\d{8}T\d{6}\.EOF"
    found = pages.select(F.explode(F.regexp_extract_all(F.col(page), F.lit(f"({name})"))).alias("name")).distinct()
    at = lambda k: (F.unix_timestamp(F.regexp_extract("name", r"_(\d{8}T\d{6})_V(\d{8}T\d{6})_(\d{8}T\d{6})", k), "yyyyMMdd'T'HHmmss") - int(EPOCH.timestamp())) / 86400
    return found.select("name", F.substring("name", 1, 3).alias("mission"), F.regexp_extract("name", "AUX_([A-Z]{6})", 1).alias("kind"), at(1).alias("made"), at(2).alias("valid_from"), at(3).alias("valid_to"))


def choose(vectors: DataFrame, products: DataFrame) -> DataFrame:
    """The vectors of the file that holds each product's time (product, t): the one whose validity is centred nearest, the first name of equals.

    Adds `product`. A product outside all files has no rows. Files are few against vectors and are compared by their validity alone.
    """
    files = vectors.select("file", "valid_from", "valid_to").distinct()
    held = products.select("product", F.col("t").alias("_at")).join(files, F.col("_at").between(F.col("valid_from"), F.col("valid_to")))
    best = held.groupBy("product").agg(F.min_by("file", F.struct(F.abs(F.col("_at") - (F.col("valid_from") + F.col("valid_to")) / 2), "file")).alias("file"))
    return best.join(vectors, "file")


def interpolate(vectors: DataFrame, times: DataFrame, degree: int = 3, keys: tuple[str, ...] = ()) -> DataFrame:
    """Position and velocity at times (keys, t): the polynomial through the degree + 1 vectors about each time.

    The vectors of an orbit stand in order once, as runs of neighbours; a time meets the run that it lies
    in the middle of, at the ends the first or last run. Fewer vectors than degree + 1 give null.
    """
    n, names = degree + 1, ("x", "y", "z", "vx", "vy", "vz")
    w = Window.partitionBy(*keys).orderBy("t")
    run = F.collect_list(F.struct("t", *names)).over(w.rowsBetween(-(n // 2 - 1), n - n // 2))
    place, total = F.row_number().over(w), F.count("*").over(Window.partitionBy(*keys))
    runs = vectors.select(*keys, "t", *names).dropDuplicates([*keys, "t"]).select(*keys, F.col("t").alias("_from"), F.lead("t").over(w).alias("_to"), run.alias("_run"), place.alias("_k"), total.alias("_n"))
    runs = runs.where((F.size("_run") == n) & (F.col("_n") >= n))
    first, last = F.col("_k") == n // 2, F.col("_k") == F.col("_n") - (n - n // 2)
    runs = runs.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], "_run", F.when(~first, F.col("_from")).alias("_from"), F.when(~last, F.col("_to")).alias("_to"))
    met = (F.col("_from").isNull() | (F.col("t") >= F.col("_from"))) & (F.col("_to").isNull() | (F.col("t") < F.col("_to")))
    for i, k in enumerate(keys):
        met = met & (F.col(k) == F.col(f"_key{i}"))
    joined = times.join(runs, met, "left")

    def value(name: str) -> F.Column:
        terms = []
        for i in range(n):
            own = F.col("_run")[i]
            weight = F.lit(1.0)
            for j in range(n):
                if j != i:
                    other = F.col("_run")[j]["t"]
                    weight = weight * (F.col("t") - other) / (own["t"] - other)
            terms.append(weight * own[name])
        return sum(terms[1:], terms[0])

    return joined.select(*times.columns, *[value(c).alias(c) for c in names])
