"""Exact quantiles of whole scenes, without a sort in one task."""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Counts that a pass brings to the driver for each range, and rows of a range that are brought there singly.
BINS, FEW = 4096, 4096
LARGEST = sys.float_info.max


def quantiles(df: DataFrame, value: Column, shares: Sequence[float]) -> list[float | None]:
    """Quantiles of a column, interpolated between neighbouring ranks; nulls and NaN are left out, None without values.

    Each pass counts BINS equal ranges around all wanted ranks, so that a range shrinks by that factor; ranges
    of at most FEW rows are collected, all in one pass, and one of a single value is done. All passes are partial aggregates.
    """
    values = df.select(value.cast("double").alias("v")).where("v is not null and not isnan(v)")
    whole = values.agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    if not whole["n"]:
        return [None] * len(shares)
    at = [s * (whole["n"] - 1) for s in shares]
    ranks = sorted({int(k) for a in at for k in (math.floor(a), math.ceil(a))})
    found: dict[int, float] = {}
    few: list[tuple[float, float, int, list[int]]] = []
    # ranges (lo, hi, smaller values before, wanted ranks among them), none of which overlap
    wide: list[tuple[float, float, int, list[int]]] = []

    def sort_out(lo: float, hi: float, n: int, before: int, wanted: list[int]) -> None:
        if lo == hi:
            found.update(dict.fromkeys(wanted, lo))
        else:
            (few if n <= FEW else wide).append((lo, hi, before, wanted))

    def among(ranges: list) -> Column:
        """Number of the range that holds the value, null for none."""
        return F.coalesce(*[F.when(F.col("v").between(lo, hi), F.lit(k)) for k, (lo, hi, _, _) in enumerate(ranges)])

    def bin_of(lo: float, hi: float) -> Column:
        """Number of the value's bin from lo to hi, which are in different ones; infinite ends count as the largest numbers."""
        low, high = max(lo, -LARGEST), min(hi, LARGEST)
        width = high / 2 - low / 2
        if not width:
            return (F.col("v") > lo).cast("long")
        return F.least(F.floor((F.least(F.greatest(F.col("v"), F.lit(low)), F.lit(high)) / 2 - low / 2) / width * BINS), F.lit(BINS - 1))

    sort_out(whole["lo"], whole["hi"], whole["n"], 0, ranks)
    while wide:
        now, wide[:] = list(wide), []
        place = F.coalesce(*[F.when(F.col("r") == k, bin_of(lo, hi)) for k, (lo, hi, _, _) in enumerate(now)])
        bins = values.withColumn("r", among(now)).where("r is not null").groupBy("r", place.alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        for k, (_, _, before, wanted) in enumerate(now):
            for r in sorted((r for r in bins if r["r"] == k), key=lambda r: r["b"]):
                here = [w for w in wanted if before <= w < before + r["n"]]
                if here:
                    sort_out(r["lo"], r["hi"], r["n"], before, here)
                before += r["n"]
    if few:
        rows = values.withColumn("r", among(few)).where("r is not null").collect()
        for k, (_, _, before, wanted) in enumerate(few):
            own = sorted(r["v"] for r in rows if r["r"] == k)
            found.update({w: own[w - before] for w in wanted})
    return [found[math.floor(a)] + (a - math.floor(a)) * (found[math.ceil(a)] - found[math.floor(a)]) for a in at]
