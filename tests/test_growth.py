"""Steps that grew faster than their input: how often it is read, and what is made of each row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import coregistration, detection, filters, polarimetry


def image(spark, height=40, width=30):
    px = spark.range(height * width).select(F.expr(f"id div {width}").alias("y"), (F.col("id") % width).alias("x"))
    return px.select("y", "x", F.sin(F.col("y") / 3 + F.col("x") / 5).alias("i"), F.cos(F.col("y") / 4 - F.col("x") / 7).alias("q"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_place_stays_one_row_and_blocks_do_not_show(spark, monkeypatch):
    places = image(spark).select("y", "x", (F.col("y") + 0.3).alias("line"), (F.col("x") - 0.4).alias("sample"))
    out = coregistration.sinc_resample(places, image(spark))
    assert "3.14159" not in plan(out) and "FlatMapCoGroups" in plan(out)  # no weights by column
    want = {(r["y"], r["x"]): (r["i"], r["q"]) for r in out.collect()}
    monkeypatch.setattr(coregistration, "BLOCK", 8)
    got = {(r["y"], r["x"]): (r["i"], r["q"]) for r in coregistration.sinc_resample(places, image(spark)).collect()}
    assert got.keys() == want.keys() and len(got) == 1200
    assert all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-12) for k in got for a, b in zip(got[k], want[k], strict=True))
    assert got[3, 4][0] is not None and got[2, 4][0] is None and got[35, 26][0] is not None and got[36, 26][0] is None


@pytest.mark.parametrize("made", [
    lambda px: (detection, detection.forest_classes(px.select("y", "x", (F.col("y") % 7 + 1.0).alias("a"), (F.col("x") % 5 + 1.0).alias("b")), ["a", "b"], 2.0, 4.0)),
    lambda px: (polarimetry, polarimetry.builtup_index(px.select("y", "x", (F.col("y") + 1.0).alias("c11"), (F.col("x") + 1.0).alias("c22"), F.col("i").alias("c12_re"), F.col("q").alias("c12_im")))),
], ids=["forest_classes", "builtup_index"])
def test_rounds_and_passes_read_what_was_written_once(spark, made):
    seen = spark.sparkContext.accumulator(0)

    def count(it):
        for pdf in it:
            seen.add(len(pdf))
            yield pdf

    px = image(spark).mapInPandas(count, "y long, x long, i double, q double")
    assert made(px)[1].count() == 1200
    assert seen.value == 1200


def test_speeds_are_compared_without_a_row_of_structs(spark):
    df = spark.range(500).select(F.col("id").alias("y"), F.lit(0).cast("long").alias("x"), (F.col("id") / 1000).alias("v"))
    out = detection.wind_speed(df, 35.0, 0.8)
    assert "array_min" not in plan(out)
    table = detection.cmod5(detection.SPEEDS, 0.8, 35.0)
    assert all(r["speed"] == detection.SPEEDS[np.abs(r["y"] / 1000 - table).argmin()] for r in out.collect())
    tied = detection.wind_speed(df.where("y = 200"), 35.0, model={3.0: 0.1, 2.0: 0.3, 1.0: 0.9})
    assert tied.first()["speed"] == 2.0


def test_grown_regions_are_those_of_the_plain_search(spark):
    a = np.random.default_rng(5).gamma(4, 10, (20, 18))
    a[3, 4], a[5, 6] = np.nan, 0
    seed = np.nanmedian(np.lib.stride_tricks.sliding_window_view(np.pad(a, 1, constant_values=np.nan), (3, 3)), (-2, -1))
    near, far = 2 / 3 / 2, 1.0

    def plain(y, x):
        s, inside, edge, seen, front = seed[y, x], [a[y, x]], [], {(y, x)}, [(y, x)]
        while front and len(inside) < 50:
            grown = []
            for cy, cx in front:
                for p in ((cy + i, cx + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
                    if p in seen or not (0 <= p[0] < 20 and 0 <= p[1] < 18) or np.isnan(a[p]):
                        continue
                    seen.add(p)
                    off = abs(a[p] - s) / s
                    if off <= near and len(inside) < 50:
                        inside.append(a[p])
                        grown.append(p)
                    elif off <= far:
                        edge.append(a[p])
            front = grown
        mean = np.mean(inside)
        return np.mean(inside + [v for v in edge if mean and abs(v - mean) / mean <= far / 3])

    df = spark.createDataFrame([(y, x, None if np.isnan(a[y, x]) else float(a[y, x])) for y in range(20) for x in range(18)], "y long, x long, v double")
    got = {(r["y"], r["x"]): r["v"] for r in filters.idan(df, looks=4.0).collect()}
    assert all(got[k] == plain(*k) for k in got if not np.isnan(a[k])) and len(got) == 360
