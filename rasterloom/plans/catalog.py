"""All queries over the raster operators, and the same in SQL.

Each entry of QUERIES takes (spark, sf_dir); its SQL, where there is one, stands under the same
name. Results are rounded on both sides, since sums of doubles depend on their order.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cx import atan2
from ..operators import calibration, coregistration, detection, filters, geometry, insar, matrix_filters, missions, polarimetry, polarimetry_models, raster, soil, topsar
from ..sources import formats, orbits, products, sinks, tiff, views
from ..streaming import events as streams
from .graph import chain, shared_dir

DIGITS = 7

# Views of the tables as scenes, in SQL.
SCENE = "scene AS (SELECT event_id // 100 AS y, event_id % 100 AS x, value AS v FROM events)"
CPLX = "cplx AS (SELECT event_id // 100 AS y, event_id % 100 AS x, value - 60 AS i, CAST(json_extract(props, '$.k') AS DOUBLE) - 50 AS q FROM events)"
SECOND = "second AS (SELECT o_orderkey // 100 AS y, o_orderkey % 100 AS x, o_totalprice / 970 AS v FROM orders)"
PAIR = "pair AS (SELECT event_id // 100 AS y, event_id % 100 AS x, value - 60 AS i1, CAST(json_extract(props, '$.k') AS DOUBLE) - 50 AS q1, value - 60 + user_id % 7 - 3 AS i2, CAST(json_extract(props, '$.k') AS DOUBLE) - 50 + user_id % 5 - 2 AS q2 FROM events)"
QUAD = """quad AS (SELECT event_id // 100 AS y, event_id % 100 AS x, (value - 60) / 9.7 AS hh_i, (k - 50) / 9.7 AS hh_q, (user_id % 17 - 8) / 9.7 AS hv_i, (event_id * 7 % 13 - 6) / 9.7 AS hv_q,
  (user_id % 19 - 9) / 9.7 AS vh_i, (event_id * 5 % 11 - 5) / 9.7 AS vh_q, (user_id % 29 - 14 + k / 5) / 9.7 AS vv_i, (event_id % 11 - 5 + value / 20) / 9.7 AS vv_q
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events))"""
C3 = """c3 AS (SELECT y, x, hh_i * hh_i + hh_q * hh_q AS c11, ((hv_i + vh_i) * (hv_i + vh_i) + (hv_q + vh_q) * (hv_q + vh_q)) / 2 AS c22, vv_i * vv_i + vv_q * vv_q AS c33,
  hh_i * vv_i + hh_q * vv_q AS c13_re, hh_q * vv_i - hh_i * vv_q AS c13_im FROM quad)"""
C2 = """c2 AS (SELECT y, x, hh_i * hh_i + hh_q * hh_q AS c11, hv_i * hv_i + hv_q * hv_q AS c22, hh_i * hv_i + hh_q * hv_q AS c12_re, hh_q * hv_i - hh_i * hv_q AS c12_im FROM quad)"""
K3 = """k3 AS (SELECT y, x, (hh_i + vv_i) / sqrt(2) AS ai, (hh_q + vv_q) / sqrt(2) AS aq, (hh_i - vv_i) / sqrt(2) AS bi, (hh_q - vv_q) / sqrt(2) AS bq, (hv_i + vh_i) / sqrt(2) AS ci, (hv_q + vh_q) / sqrt(2) AS cq FROM quad)"""
T3 = """t3 AS (SELECT y, x, ai * ai + aq * aq AS t11, bi * bi + bq * bq AS t22, ci * ci + cq * cq AS t33, ai * bi + aq * bq AS t12_re, aq * bi - ai * bq AS t12_im,
  ai * ci + aq * cq AS t13_re, aq * ci - ai * cq AS t13_im, bi * ci + bq * cq AS t23_re, bq * ci - bi * cq AS t23_im FROM k3)"""
STOKES = "st AS (SELECT y, x, c11 + c22 AS g0, c11 - c22 AS g1, 2 * c12_re AS g2, 2 * c12_im AS g3, sqrt((c11 - c22) ** 2 + (2 * c12_re) ** 2 + (2 * c12_im) ** 2) AS pol FROM c2)"


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles rounded, without a negative zero."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def sql(ctes: list[str], keys: str, values: dict[str, str], source: str, tail: str = "", digits: int = DIGITS) -> str:
    """WITH ctes SELECT keys, rounded values FROM source."""
    cols = [keys] if keys else []
    cols += [f"round(CAST({e} AS DOUBLE), {digits}) + 0.0 AS {n}" for n, e in values.items()]
    return f"WITH {', '.join(ctes)} SELECT {', '.join(cols)} FROM {source} {tail}"


def window(cols: str, size_x: int, size_y: int | None = None, source: str = "scene", keep: str = "a.y, a.x") -> str:
    """A self-join over the window: the plain form of the separable frames."""
    size_y = size_y or size_x
    lo = lambda n: n // 2
    hi = lambda n: n - 1 - n // 2
    return f"SELECT {keep}, {cols} FROM {source} a JOIN {source} b ON b.y BETWEEN a.y - {lo(size_y)} AND a.y + {hi(size_y)} AND b.x BETWEEN a.x - {lo(size_x)} AND a.x + {hi(size_x)} GROUP BY {keep}"


def extent(df: DataFrame, column: str) -> int:
    """Largest value of a column; -1 where there are no rows."""
    top = df.agg(F.max(column)).first()[0]
    return -1 if top is None else int(top)


QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, text: str | None = None):
    def add(f):
        QUERIES[name] = f
        if text:
            ORACLE_SQL[name] = text
        return f

    return add


# --- raster -----------------------------------------------------------------------------


@query("multilook", sql([SCENE], "y, x", {"v": "v"}, "(SELECT y // 2 AS y, x // 2 AS x, avg(v) AS v FROM scene GROUP BY 1, 2 HAVING count(*) = 4)"))
def _(spark, d):
    return rounded(raster.multilook(views.scene(spark, d), 2, 2))


@query("multilook_complex", sql([CPLX], "y, x", {"v": "v"}, "(SELECT y // 4 AS y, x // 3 AS x, avg(i * i + q * q) AS v FROM cplx GROUP BY 1, 2 HAVING count(*) = 12)"))
def _(spark, d):
    z = views.scene_cplx(spark, d)
    return rounded(raster.multilook(z.select("y", "x", (z.i * z.i + z.q * z.q).alias("v")), 4, 3))


@query("multilook_amplitude", sql([SCENE], "y, x", {"v": "v"}, "(SELECT y // 2 AS y, x // 5 AS x, sqrt(avg(v * v)) AS v FROM scene GROUP BY 1, 2 HAVING count(*) = 10)"))
def _(spark, d):
    return rounded(raster.multilook(views.scene(spark, d), 2, 5, unit="amplitude"))


@query("multilook_db", sql([SCENE], "y, x", {"v": "v"}, "(SELECT y // 2 AS y, x // 2 AS x, 10 * log10(avg(10 ** (v / 100))) AS v FROM scene GROUP BY 1, 2 HAVING count(*) = 4)"))
def _(spark, d):
    s = views.scene(spark, d)
    return rounded(raster.multilook(s.withColumn("v", s.v / 10), 2, 2, unit="db"))


@query("band_select", f"WITH {QUAD} SELECT y, x, hv_i, hv_q FROM quad")
def _(spark, d):
    return raster.band_select(views.quad(spark, d), polarisations=["HV"])


@query("band_merge", f"WITH {SCENE}, {SECOND} SELECT a.y, a.x, a.v, b.v AS v_2 FROM scene a JOIN second b ON a.y = b.y AND a.x = b.x")
def _(spark, d):
    return raster.band_merge(views.scene(spark, d), views.second(spark, d))


@query("set_nodata", f"WITH {CPLX} SELECT y, x, i, nullif(q, 0) AS q FROM cplx")
def _(spark, d):
    return raster.set_nodata(views.scene_cplx(spark, d), ["q"], 0.0)


@query("data_analysis", sql([SCENE], "", {"min": "min(v)", "max": "max(v)", "mean": "avg(v)", "std": "stddev_pop(v)", "cv": "sqrt(avg(v ** 4) - avg(v * v) ** 2) / avg(v * v)", "enl": "avg(v * v) ** 2 / (avg(v ** 4) - avg(v * v) ** 2)"}, "scene"))
def _(spark, d):
    return rounded(raster.data_analysis(views.scene(spark, d), "v"))


@query("tile_statistics", sql([SCENE], "ty, tx, n", {"s": "s"}, "(SELECT ty, tx, count(*) AS n, sum(v) AS s FROM scene, (SELECT DISTINCT (y + d) // 16 AS ty FROM scene, (SELECT unnest([-2, 0, 2]) AS d) WHERE y + d >= 0) a, (SELECT unnest(range(0, 3)) AS tx) b WHERE y BETWEEN ty * 16 - 2 AND ty * 16 + 17 AND x BETWEEN tx * 40 - 2 AND tx * 40 + 41 GROUP BY 1, 2)"))
def _(spark, d):
    t = raster.tiles(views.scene(spark, d), 16, 40, 2)
    return rounded(t.groupBy("ty", "tx").agg(F.count("*").alias("n"), F.sum("v").alias("s")))


@query("subset", f"WITH {SCENE} SELECT y, x, v FROM scene WHERE y BETWEEN 2 AND 30 AND x BETWEEN 10 AND 59")
def _(spark, d):
    return raster.subset(views.scene(spark, d), 2, 31, 10, 60)


@query("undersample", f"WITH {SCENE} SELECT y // 3 AS y, x // 4 AS x, v FROM scene WHERE y % 3 = 0 AND x % 4 = 0")
def _(spark, d):
    return raster.undersample(views.scene(spark, d), 3, 4)


@query(
    "undersample_kernel",
    sql([SCENE, "o AS (SELECT unnest(range(0, (SELECT max(y) + 1 FROM scene) // 3)) AS ty)", "p AS (SELECT ty, tx, ty * 3 AS cy, tx * 3 AS cx FROM o, (SELECT unnest(range(0, 33)) AS tx))"], "ty AS y, tx AS x", {"v": "sum(v * CASE WHEN y = cy AND x = cx THEN 4 WHEN y = cy OR x = cx THEN 2 ELSE 1 END) / 9"}, "p JOIN scene ON y BETWEEN cy - 1 AND cy + 1 AND x BETWEEN cx - 1 AND cx + 1", "GROUP BY ty, tx"),
)
def _(spark, d):
    return rounded(raster.undersample_kernel(views.scene(spark, d), [[1, 2, 1], [2, 4, 2], [1, 2, 1]], 3, 3))


@query("oversample")
def _(spark, d):
    return rounded(raster.oversample(views.scene(spark, d), 2))


@query("mosaic", sql(["o AS (SELECT l_orderkey AS cell, l_extendedprice / 97 AS v, l_quantity AS w FROM lineitem)"], "cell, count(*) AS n", {"v": "sum(v * w) / sum(w)"}, "o WHERE v <> 0 AND w > 0", "GROUP BY cell"))
def _(spark, d):
    return rounded(raster.mosaic(views.overlap(spark, d), ["cell"]).select("cell", "n", "v"))


@query("multitemporal_composite", sql(["o AS (SELECT l_orderkey AS cell, l_extendedprice / 97 AS v, l_quantity AS a FROM lineitem)"], "cell", {"v": "sum(v / a) / sum(1 / a)"}, "o WHERE a > 0", "GROUP BY cell"))
def _(spark, d):
    return rounded(raster.multitemporal_composite(views.overlap(spark, d).withColumnRenamed("w", "a"), ["cell"]))


STACK = "stack AS (SELECT vec_id AS pixel, unnest(range(0, 64)) AS epoch, CAST(unnest(embedding) AS DOUBLE) + 1 AS v FROM embeddings)"
for _name, _sql in {"mean": "avg(v)", "min": "min(v)", "max": "max(v)", "std": "stddev_pop(v)", "cv": "sqrt(avg(v ** 4) - avg(v * v) ** 2) / avg(v * v)"}.items():
    query(f"stack_average_{_name}", sql([STACK], "pixel", {_name: _sql}, "stack", "GROUP BY pixel"))(lambda spark, d, s=_name: rounded(raster.stack_average(views.stack(spark, d), ["pixel"], s)))

for _name, _join in {"master": "LEFT", "minimum": "INNER", "maximum": "FULL"}.items():
    query(f"create_stack_{_name}", f"WITH {SCENE}, {SECOND}, m AS (SELECT y + 1 AS y, x - 2 AS x, v AS v_sec FROM second) SELECT y, x, v, v_sec FROM scene {_join} JOIN m USING (y, x)")(lambda spark, d, e=_name: raster.create_stack(views.scene(spark, d), views.second(spark, d), 1, -2, e))


@query("slice_assembly", f"WITH {SCENE} SELECT y, x, v FROM scene")
def _(spark, d):
    s = views.scene(spark, d).select(F.expr("y div 4").alias("slice"), (F.col("y") % 4).alias("y"), "x", "v")
    table = s.select("slice", (4 * F.col("slice")).alias("start"), (4 * F.col("slice") + 4).alias("end")).distinct()
    return raster.slice_assembly(s, table)


@query("srgr_linear", sql([SCENE, "g AS (SELECT DISTINCT y FROM scene)", "t AS (SELECT y, unnest(range(0, 120)) AS x FROM g)", "u AS (SELECT y, x, 0.5 + 0.8 * x + 0.0005 * x * x AS pos FROM t)", "w AS (SELECT y, x, CAST(floor(pos) AS BIGINT) AS s, pos - floor(pos) AS t FROM u)"], "w.y, w.x", {"v": "CASE WHEN t > 0 THEN a.v * (1 - t) + b.v * t ELSE a.v END"}, "w JOIN scene a ON a.y = w.y AND a.x = s LEFT JOIN scene b ON b.y = w.y AND b.x = s + 1", "WHERE t = 0 OR b.v IS NOT NULL"))
def _(spark, d):
    return rounded(raster.resample_line(views.scene(spark, d), [0.5, 0.8, 0.0005], 120))


@query("srgr_nearest", sql([SCENE, "g AS (SELECT DISTINCT y FROM scene)", "t AS (SELECT y, unnest(range(0, 120)) AS x FROM g)", "u AS (SELECT y, x, CAST(floor(0.25 + 0.8 * x + 0.5) AS BIGINT) AS s FROM t)"], "u.y, u.x", {"v": "v"}, "u JOIN scene ON scene.y = u.y AND scene.x = s"))
def _(spark, d):
    return rounded(raster.resample_line(views.scene(spark, d), [0.25, 0.8], 120, "nearest"))


@query("srgr_cubic")
def _(spark, d):
    return rounded(raster.resample_line(views.scene(spark, d), [0.5, 0.8], 120, "cubic"))


@query("tie_points", sql([SCENE], "y, x", {"value": "30 + y * 0.1 + x * 0.05"}, "scene"))
def _(spark, d):
    s = views.scene(spark, d)
    lines = spark.range(extent(s, "y") // 5 + 2).withColumnRenamed("id", "gy")
    grid = lines.crossJoin(spark.range(11).withColumnRenamed("id", "gx")).withColumn("value", 30 + F.col("gy") * 0.5 + F.col("gx") * 0.5)
    return rounded(raster.bilinear(s, grid, 5.0, 10.0))


# --- filters ----------------------------------------------------------------------------

M5 = f"m AS ({window('any_value(a.v) AS v, count(b.v) AS n, avg(b.v) AS mean, var_samp(b.v) AS var', 5, keep='a.y, a.x')})"


@query("boxcar", sql([SCENE, M5], "y, x", {"v": "mean"}, "m"))
def _(spark, d):
    return rounded(filters.boxcar(views.scene(spark, d), 5))


@query("lee", sql([SCENE, M5, "r AS (SELECT *, sqrt(coalesce(var, 0)) / mean AS ci, 0.5 AS cu FROM m)"], "y, x", {"v": "CASE WHEN mean = 0 THEN 0 WHEN ci < cu THEN mean ELSE v * (1 - cu * cu / (ci * ci)) + mean * cu * cu / (ci * ci) END"}, "r"))
def _(spark, d):
    return rounded(filters.lee(views.scene(spark, d), 5, looks=4.0))


@query("lee_scene_looks")
def _(spark, d):
    return rounded(filters.lee(views.scene(spark, d), 7))


@query("gamma_map", sql([SCENE, M5, "r AS (SELECT *, sqrt(coalesce(var, 0)) / mean AS ci, 0.5 AS cu, (1 + 0.25) / (var / (mean * mean) - 0.25) AS al FROM m)"], "y, x", {"v": "CASE WHEN mean = 0 THEN 0 WHEN ci <= cu THEN mean WHEN ci < sqrt(2) * cu THEN ((al - 5) * mean + sqrt(mean * mean * (al - 5) ** 2 + 16 * al * mean * v)) / (2 * al) ELSE v END"}, "r"))
def _(spark, d):
    return rounded(filters.gamma_map(views.scene(spark, d), 5, looks=4.0))


@query("median", sql([SCENE, f"m AS ({window('list_sort(list(b.v)) AS l', 3)})"], "y, x", {"v": "l[len(l) // 2 + 1]"}, "m"))
def _(spark, d):
    return rounded(filters.median(views.scene(spark, d), 3))


@query("frost", sql([SCENE, f"m AS ({window('avg(b.v) AS mean, var_samp(b.v) AS var', 3)})"], "m.y, m.x", {"v": "sum(exp(-2 * coalesce(var, 0) / (mean * mean) * greatest(abs(b.y - m.y), abs(b.x - m.x))) * b.v) / sum(exp(-2 * coalesce(var, 0) / (mean * mean) * greatest(abs(b.y - m.y), abs(b.x - m.x))))"}, "m JOIN scene b ON b.y BETWEEN m.y - 1 AND m.y + 1 AND b.x BETWEEN m.x - 1 AND m.x + 1", "GROUP BY m.y, m.x"))
def _(spark, d):
    return rounded(filters.frost(views.scene(spark, d), 3))


@query("multitemporal_speckle", sql([SCENE, SECOND, "st AS (SELECT 0 AS epoch, y, x, v FROM scene UNION ALL SELECT 1, y, x, v FROM second)", "f AS (SELECT a.epoch, a.y, a.x, any_value(a.v) AS v, avg(b.v) AS f FROM st a JOIN st b ON a.epoch = b.epoch AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 GROUP BY 1, 2, 3)", "r AS (SELECT y, x, avg(CASE WHEN f <> 0 THEN v / f END) AS r FROM f GROUP BY 1, 2)"], "epoch, y, x", {"v": "f * r"}, "f JOIN r USING (y, x)"))
def _(spark, d):
    st = views.scene(spark, d).withColumn("epoch", F.lit(0)).unionByName(views.second(spark, d).withColumn("epoch", F.lit(1)))
    return rounded(filters.multitemporal(st, 3))


query("refined_lee")(lambda spark, d: rounded(filters.refined_lee(views.scene(spark, d), looks=4.0)))
query("lee_sigma")(lambda spark, d: rounded(filters.lee_sigma(views.scene(spark, d), looks=4.0)))
query("idan")(lambda spark, d: rounded(filters.idan(views.scene(spark, d), looks=4.0)))
query("mulog")(lambda spark, d: rounded(filters.mulog(views.scene(spark, d), looks=4.0)))


# --- detection --------------------------------------------------------------------------

BOTH = "p AS (SELECT scene.y, scene.x, scene.v AS a, second.v AS b FROM scene JOIN second ON scene.y = second.y AND scene.x = second.x)"


def both(spark, d):
    a, b = views.scene(spark, d), views.second(spark, d)
    return a.withColumnRenamed("v", "a").join(b.withColumnRenamed("v", "b"), ["y", "x"])


for _name, _sql in {"difference": "a - b", "ratio": "a / b", "log_ratio": "ln(greatest(a / b, 1e-15))", "normalised": "(a - b) / (a + b)"}.items():
    query(f"change_{_name}", sql([SCENE, SECOND, BOTH, f"c AS (SELECT y, x, CASE WHEN a > 0 AND b > 0 THEN {_sql} ELSE 0 END AS c FROM p)"], "y, x, CASE WHEN c > 2 THEN 1 WHEN c < 0.5 THEN -1 ELSE 0 END AS mask", {"change": "c"}, "c"))(lambda spark, d, k=_name: rounded(detection.change(both(spark, d), kind=k).select("y", "x", "mask", "change")))


@query("flood", f"WITH {SCENE} SELECT y, x, v / 1000 > 0 AND v / 1000 < 0.05 AS flood FROM scene")
def _(spark, d):
    return detection.flood(views.scene(spark, d).withColumn("v", F.col("v") / 1000))


@query("decision_tree", f"WITH {SCENE} SELECT y, x, CAST(CASE WHEN v > 60 THEN CASE WHEN x % 2 = 0 THEN 1 ELSE 2 END ELSE 3 END AS SMALLINT) AS class FROM scene")
def _(spark, d):
    return detection.decision_tree(views.scene(spark, d), {"if": "v > 60", "then": {"if": "x % 2 = 0", "then": 1, "else": 2}, "else": 3})


@query("oil_spill", f"WITH {SCENE}, m AS ({window('any_value(a.v) AS v, avg(b.v) AS mean', 9)}) SELECT y, x, CASE WHEN v < mean / {10**0.2} THEN 1 ELSE 0 END AS spill FROM m")
def _(spark, d):
    return detection.oil_spill(views.scene(spark, d), 9)


@query("adaptive_threshold", f"""WITH {SCENE}, b AS ({window('count(*) AS n, sum(b.v) AS s, sum(b.v * b.v) AS q', 11)}), g AS ({window('count(*) AS n, sum(b.v) AS s, sum(b.v * b.v) AS q', 5)}),
  r AS (SELECT a.y, a.x, a.v, b.n - g.n AS n, b.s - g.s AS s, b.q - g.q AS q FROM scene a JOIN b ON a.y = b.y AND a.x = b.x JOIN g ON a.y = g.y AND a.x = g.x)
  SELECT y, x, CASE WHEN n > 0 AND s / n >= 0.005 AND v > s / n + 1.6448536269514715 * sqrt(greatest(q / n - (s / n) * (s / n), 0)) THEN 1 ELSE 0 END AS ship FROM r""")
def _(spark, d):
    return detection.adaptive_threshold(views.scene(spark, d), 1, 5, 11, pfa=-math.log10(0.05))


MASK = "mk AS (SELECT y, x FROM scene WHERE v > 120)"
REACH = "e AS (SELECT a.y * 1000 + a.x AS a, b.y * 1000 + b.x AS b FROM mk a JOIN mk b ON abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1), reach AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a), cl AS (SELECT a, min(b) AS c FROM reach GROUP BY a)"


@query("object_clusters", f"WITH RECURSIVE {SCENE}, {MASK}, {REACH} SELECT a // 1000 AS y, a % 1000 AS x, c // 1000 AS cy, c % 1000 AS cx FROM cl")
def _(spark, d):
    c = detection.clusters(views.scene(spark, d).where("v > 120").select("y", "x"))
    return c.select("y", "x", F.expr(f"cluster div {1 << 31}").alias("cy"), (F.col("cluster") % (1 << 31)).alias("cx"))


@query("oil_spill_clusters", f"WITH RECURSIVE {SCENE}, {MASK}, {REACH}, n AS (SELECT c, count(*) AS size FROM cl GROUP BY c) SELECT a // 1000 AS y, a % 1000 AS x, size FROM cl JOIN n USING (c) WHERE size >= 2")
def _(spark, d):
    return detection.oil_spill_clusters(views.scene(spark, d).where("v > 120").select("y", "x"), 2).select("y", "x", "size")


@query("object_discrimination", f"WITH RECURSIVE {SCENE}, {MASK}, {REACH}, n AS (SELECT min(a // 1000) AS y, min(a % 1000) AS x, (max(a // 1000) - min(a // 1000) + 1) * 10.0 AS length, (max(a % 1000) - min(a % 1000) + 1) * 10.0 AS width, count(*) AS pixels FROM cl GROUP BY c) SELECT y, x, CAST(length AS DOUBLE) AS length, CAST(width AS DOUBLE) AS width, pixels, round(sqrt(length * length + width * width), 7) AS size FROM n WHERE sqrt(length * length + width * width) BETWEEN 15 AND 60")
def _(spark, d):
    return rounded(detection.discriminate(views.scene(spark, d).where("v > 120").select("y", "x"), 10.0, 10.0, 15.0, 60.0).drop("cluster"))


@query("speckle_divergence", sql([SCENE, f"m AS ({window('avg(CASE WHEN b.v > 0.4 THEN b.v END) AS mean, stddev_samp(CASE WHEN b.v > 0.4 THEN b.v END) AS s', 7)})"], "y, x", {"divergence": "coalesce(s, 0) / mean - 0.3"}, "m"))
def _(spark, d):
    return rounded(detection.speckle_divergence(views.scene(spark, d), 7, 0.3))


query("gabor")(lambda spark, d: rounded(detection.gabor(views.scene(spark, d))))


@query("forest_area", f"WITH {SCENE}, {SECOND}, {BOTH}, m AS ({window('sum(b.a) AS sa, sum(b.b) AS sb, avg(b.a) AS ma', 5, source='p')}), r AS (SELECT y, x, 10 * log10(sa / sb) AS ratio, ma FROM m) SELECT y, x, round(ratio, 7) + 0.0 AS ratio, ratio BETWEEN -3 AND 3 AND ma > 20 AS forest FROM r")
def _(spark, d):
    return rounded(detection.forest_area(both(spark, d), 5, -3.0, 3.0, floor=20.0))


@query("reactiv", f"WITH {STACK}, p AS (SELECT pixel, arg_max(epoch, (v, -epoch)) AS w, max(v) AS peak, stddev_pop(v) / avg(v) AS cv FROM stack GROUP BY pixel), s AS (SELECT avg(peak) AS mp, stddev_pop(peak) AS sp FROM p) SELECT pixel, round(0.9 * w / 63.0, 7) + 0.0 AS hue, round(greatest(0, least(1, (cv - 0.2286) / 1.616 + 0.25)), 7) + 0.0 AS saturation, round(least(1, peak / (mp + sp)), 7) + 0.0 AS value FROM p, s")
def _(spark, d):
    return rounded(detection.reactiv(views.stack(spark, d), ["pixel"], t="epoch"))


query("robust_pca")(lambda spark, d: rounded(detection.robust_pca(views.stack(spark, d).select(F.expr("pixel div 20").alias("y"), (F.col("pixel") % 20).alias("x"), "epoch", "v"))))
query("forest_classes")(lambda spark, d: detection.forest_classes(both(spark, d), ["a", "b"], 20.0, 60.0))


WIND = """c AS (SELECT 0.8 AS cs, (35.0 - 40) / 25 AS x), w AS (SELECT k / 10.0 AS v FROM (SELECT unnest(range(1, 201)) AS k)),
  s1 AS (SELECT v, cs, x, (0.111 + 0.0162 * x) * v AS s, 0.4 - 0.6 * x AS s0 FROM w, c),
  s2 AS (SELECT *, 1 / (1 + exp(-greatest(s, s0))) AS g FROM s1), s3 AS (SELECT *, CASE WHEN s < s0 THEN g * (s / s0) ** (s0 * (1 - g)) ELSE g END AS a3, v / (8.39 - 3.44 * x + 1.36 * x * x) + 1 AS u FROM s2),
  s4 AS (SELECT *, a3 ** (6.7329 + 2.7541 * x - 2.2918 * x * x) * 10 ** (-0.688 - 0.793 * x + 0.338 * x * x - 0.173 * x * x * x + 0.004 * x * v) AS b0,
    (0.045 * (1 + x) - 0.007 * v * (0.5 + x - tanh(4 * (x + 0.33 + 0.012 * v)))) / (exp(0.34 * (v - 22)) + 1) AS b1, CASE WHEN u < 1.95 THEN 1.95 - 0.95 / 3 + (u - 1) ** 3 / (3 * 0.95 ** 2) ELSE u END AS v2 FROM s3),
  m AS (SELECT v AS s, b0 * (1 + b1 * cs + ((3.8 + 1.53 * x) * v2 - (5.35 + 1.99 * x + 0.29 * x * x)) * exp(-v2) * (2 * cs * cs - 1)) ** 1.6 AS m FROM s4)"""


@query("wind_speed", f"WITH {SCENE}, {WIND} SELECT y, x, round(CAST(arg_min(s, (abs(v / 1000 - m), s)) AS DOUBLE), 7) AS speed FROM scene, m GROUP BY y, x")
def _(spark, d):
    return rounded(detection.wind_speed(views.scene(spark, d).withColumn("v", F.col("v") / 1000), 35.0, 0.8))


query("wind_field")(lambda spark, d: rounded(detection.wind_field(views.scene(spark, d).select("y", "x", (F.col("v") / 1000).alias("v"), (30 + F.col("x") / 20).alias("theta")), 10, 10.0), 5))


# --- interferometry ---------------------------------------------------------------------


@query("interferogram", sql([PAIR], "y, x", {"i": "i1 * i2 + q1 * q2", "q": "q1 * i2 - i1 * q2", "phase": "atan2(round(q1 * i2 - i1 * q2, 9) + 0.0, i1 * i2 + q1 * q2)"}, "pair"))
def _(spark, d):
    """An imaginary part of nothing has no sign, on both sides."""
    return rounded(insar.interferogram(views.pair(spark, d)).withColumn("phase", atan2(F.round("q", 9) + F.lit(0.0), F.col("i"))))


@query("interferogram_flattened", sql([PAIR, "f AS (SELECT *, 0.01 + 0.02 * y + 0.03 * x AS p FROM pair)", "g AS (SELECT *, i2 * cos(p) - q2 * sin(p) AS u, i2 * sin(p) + q2 * cos(p) AS w FROM f)"], "y, x", {"i": "i1 * u + q1 * w", "q": "q1 * u - i1 * w"}, "g"))
def _(spark, d):
    return rounded(insar.interferogram(views.pair(spark, d), insar.polynomial_phase([0.01, 0.02, 0.03], 1)).drop("phase"))


@query("coherence", sql([PAIR, f"m AS ({window('sum(b.i1 * b.i2 + b.q1 * b.q2) AS re, sum(b.q1 * b.i2 - b.i1 * b.q2) AS im, sum(b.i1 * b.i1 + b.q1 * b.q1) AS pa, sum(b.i2 * b.i2 + b.q2 * b.q2) AS pb', 5, 3, 'pair')})"], "y, x", {"coherence": "CASE WHEN pa * pb > 0 THEN sqrt(re * re + im * im) / sqrt(pa * pb) ELSE 0 END"}, "m"))
def _(spark, d):
    return rounded(insar.coherence(views.pair(spark, d), 3, 5))


@query("multi_master", sql(["e AS (SELECT epoch, event_id // 100 AS y, event_id % 100 AS x, value - 60 + epoch * (user_id % 7) / 3.1 AS i, CAST(json_extract(props, '$.k') AS DOUBLE) - 50 - epoch AS q FROM events, (SELECT unnest([1, 2, 3]) AS epoch))", "p AS (SELECT a.epoch AS pair, a.y, a.x, a.i * b.i + a.q * b.q AS i, a.q * b.i - a.i * b.q AS q, a.i * a.i + a.q * a.q AS pa, b.i * b.i + b.q * b.q AS pb FROM e a JOIN e b ON b.epoch = a.epoch + 1 AND a.y = b.y AND a.x = b.x)", "m AS (SELECT a.pair, a.y, a.x, any_value(a.i) AS i, any_value(a.q) AS q, sum(b.i) AS re, sum(b.q) AS im, sum(b.pa) AS sa, sum(b.pb) AS sb FROM p a JOIN p b ON a.pair = b.pair AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 GROUP BY 1, 2, 3)"], "pair, y, x", {"i": "i", "q": "q", "coherence": "sqrt(re * re + im * im) / sqrt(sa * sb)"}, "m"))
def _(spark, d):
    e = views.read(spark, d, "events").withColumn("epoch", F.explode(F.array(*map(F.lit, (1, 2, 3)))))
    e = e.select("epoch", F.expr("event_id div 100").alias("y"), (F.col("event_id") % 100).alias("x"), (F.col("value") - 60 + F.col("epoch") * (F.col("user_id") % 7) / 3.1).alias("i"), (F.get_json_object("props", "$.k").cast("double") - 50 - F.col("epoch")).alias("q"), F.lit(0.0).alias("phase"))
    pairs = insar.consecutive_pairs(spark.createDataFrame([(1,), (2,), (3,)], "epoch int")).withColumn("pair", F.col("ref"))
    return rounded(insar.multi_master(e, pairs, 3).select("pair", "y", "x", "i", "q", "coherence"))


@query("consecutive_pairs", "SELECT ref, sec FROM (SELECT d AS ref, lead(d) OVER (ORDER BY d) AS sec FROM (SELECT DISTINCT CAST(date_part('year', l_shipdate) AS INTEGER) AS d FROM lineitem)) WHERE sec IS NOT NULL")
def _(spark, d):
    return insar.consecutive_pairs(views.read(spark, d, "lineitem").select(F.year("l_shipdate").alias("epoch")))


NATION = "a AS (SELECT n_nationkey AS epoch, n_nationkey * 12 AS day, n_regionkey * 37.5 - n_nationkey * 3.0 AS perp, n_regionkey * 11.0 AS doppler FROM nation)"


@query("insar_overview", sql([NATION, "p AS (SELECT a.epoch AS ref, b.epoch AS sec, b.perp - a.perp AS perp, b.day - a.day AS days, b.doppler - a.doppler AS doppler FROM a JOIN a b ON a.epoch <> b.epoch)", "m AS (SELECT *, greatest(1 - abs(perp) / 1200, 0) * greatest(1 - abs(days) / 1000, 0) * greatest(1 - abs(doppler) / 900, 0) AS m FROM p)"], "ref, sec, days", {"perp": "perp", "doppler": "doppler", "modelled": "m", "reference_score": "avg(m) OVER (PARTITION BY ref)"}, "m"))
def _(spark, d):
    n = views.read(spark, d, "nation")
    a = n.select(F.col("n_nationkey").alias("epoch"), (F.col("n_nationkey") * 12).alias("day"), (F.col("n_regionkey") * 37.5 - F.col("n_nationkey") * 3.0).alias("perp"), (F.col("n_regionkey") * 11.0).alias("doppler"))
    return rounded(insar.overview(a))


PHASES = "ph AS (SELECT event_id // 100 AS y, event_id % 100 AS x, value / 50 AS phase1, user_id / 300.0 AS phase2, value / 50 AS phase, user_id * 1.0 AS height, (event_id % 100) / 100.0 AS coherence FROM events)"


def phases(spark, d):
    e = views.read(spark, d, "events")
    return e.select(F.expr("event_id div 100").alias("y"), (F.col("event_id") % 100).alias("x"), (F.col("value") / 50).alias("phase1"), (F.col("user_id") / 300.0).alias("phase2"), (F.col("value") / 50).alias("phase"), F.col("user_id").cast("double").alias("height"), ((F.col("event_id") % 100) / 100.0).alias("coherence"))


@query("phase_to_displacement", sql([PHASES], "y, x", {"displacement": "-0.0555 / (4 * pi()) * phase"}, "ph"))
def _(spark, d):
    return rounded(insar.phase_to_displacement(phases(spark, d), 0.0555))


@query("integer_interferogram", sql([PHASES], "y, x", {"i": "cos(2 * phase1 - phase2)", "q": "sin(2 * phase1 - phase2)"}, "ph"))
def _(spark, d):
    return rounded(insar.integer_interferogram(phases(spark, d), 2, -1))


@query("horizontal_vertical", sql([PHASES, "k AS (SELECT -sin(radians(35)) * cos(radians(-10)) AS a11, cos(radians(35)) AS a12, -sin(radians(40)) * cos(radians(190)) AS a21, cos(radians(40)) AS a22)", "r AS (SELECT phase1 AS ra, phase2 AS rd FROM ph WHERE y = 0 AND x = 0)"], "y, x", {"east": "(a22 * (phase1 - ra) - a12 * (phase2 - rd)) / (a11 * a22 - a12 * a21)", "up": "(a11 * (phase2 - rd) - a21 * (phase1 - ra)) / (a11 * a22 - a12 * a21)"}, "ph, k, r"))
def _(spark, d):
    p = phases(spark, d)
    return rounded(insar.horizontal_vertical(p.select("y", "x", F.col("phase1").alias("los")), p.select("y", "x", F.col("phase2").alias("los")), (35, 40), (-10, 190), (0, 0)))


@query("empirical_tropo_quadratic", sql([PHASES, "g AS (SELECT phase AS p, height AS z FROM ph WHERE y % 2 = 0 AND x % 2 = 0 AND coherence >= 0.3 AND height > 10)", "m AS (SELECT avg(z) AS mz FROM g)",
  "s AS (SELECT any_value(mz) AS mz, avg(z - mz) AS z1, avg((z - mz) ** 2) AS z2, avg((z - mz) ** 3) AS z3, avg((z - mz) ** 4) AS z4, avg(p) AS p0, avg(p * (z - mz)) AS p1, avg(p * (z - mz) ** 2) AS p2 FROM g, m)",
  "f AS (SELECT mz, p1 / z2 - (p2 - p0 * z2 - z3 / z2 * p1) / (z4 - z2 * z2 - z3 * z3 / z2) * z3 / z2 AS b, (p2 - p0 * z2 - z3 / z2 * p1) / (z4 - z2 * z2 - z3 * z3 / z2) AS c, p0 - z2 * (p2 - p0 * z2 - z3 / z2 * p1) / (z4 - z2 * z2 - z3 * z3 / z2) AS a FROM s)"], "y, x", {"phase": "phase - a - b * (height - mz) - c * (height - mz) ** 2"}, "ph, f", digits=5))
def _(spark, d):
    return rounded(insar.tropo(phases(spark, d), 0.3, 10.0, 2, degree=2), 5)


@query("empirical_tropo", sql([PHASES, "f AS (SELECT regr_slope(phase, height) AS b, regr_intercept(phase, height) AS a FROM ph WHERE y % 2 = 0 AND x % 2 = 0 AND coherence >= 0.3 AND height > 10)"], "y, x", {"phase": "phase - a - b * height"}, "ph, f"))
def _(spark, d):
    return rounded(insar.tropo(phases(spark, d), 0.3, 10.0, 2))


@query("split_band_ionosphere", sql([PHASES], "y, x", {"ionosphere": "(phase1 * 1.3 - phase2 * 1.2) * 1.2 * 1.3 / (1.25 * (1.3 * 1.3 - 1.2 * 1.2))"}, "ph"))
def _(spark, d):
    return rounded(insar.split_band_ionosphere(phases(spark, d), 1.2, 1.3, 1.25, "phase1", "phase2"))


DEM_PHASE = "(-2 * pi() * 20 * y * 0.001 - pi() * 300 * (y * 0.001) * (y * 0.001))"


@query("demodulate", sql([CPLX], "y, x", {"i": f"i * cos({DEM_PHASE}) - q * sin({DEM_PHASE})", "q": f"i * sin({DEM_PHASE}) + q * cos({DEM_PHASE})"}, "cplx"))
def _(spark, d):
    return rounded(insar.demodulate(views.scene_cplx(spark, d), 20.0, 300.0, 0.001))


@query("remodulate", sql([CPLX], "y, x", {"i": "i", "q": "q"}, "cplx"))
def _(spark, d):
    z = insar.demodulate(views.scene_cplx(spark, d), 20.0, 300.0, 0.001)
    return rounded(insar.demodulate(z, 20.0, 300.0, 0.001, inverse=True))


@query("topsar_deramp", sql([CPLX, "f AS (SELECT *, (y * 0.001 - 0.05) * (y * 0.001 - 0.05) * (-pi() * 1500) + (y * 0.001 - 0.05) * (-2 * pi() * 15) AS p FROM cplx)"], "y, x", {"i": "i * cos(p) - q * sin(p)", "q": "i * sin(p) + q * cos(p)"}, "f"))
def _(spark, d):
    return rounded(topsar.deramp(views.scene_cplx(spark, d), 1500.0, 15.0, 0.05, 0.001))


@query("three_pass_dinsar", sql([CPLX, PHASES, "f AS (SELECT cplx.y, cplx.x, i, q, -(0.5 + 0.001 * cplx.y + 0.002 * cplx.x) * phase AS p FROM cplx JOIN ph ON cplx.y = ph.y AND cplx.x = ph.x)"], "y, x", {"i": "i * cos(p) - q * sin(p)", "q": "i * sin(p) + q * cos(p)"}, "f"))
def _(spark, d):
    return rounded(insar.three_pass(views.scene_cplx(spark, d), phases(spark, d).select("y", "x", "phase"), [0.5, 0.001, 0.002]))


@query("phase_to_elevation", sql([PHASES, "s AS (SELECT arg_min({'p': phase, 'h': height}, (abs(phase2 - 1), y, x)) AS s FROM ph WHERE height > 0)"], "y, x", {"elevation": "s.h - 800000 * sin(0.6) / (4 * pi() / 0.0555 * (40 * sin(0.001 * (x - 50)) + 150 * cos(0.001 * (x - 50)))) * (phase - s.p)"}, "ph, s"))
def _(spark, d):
    p = phases(spark, d).select("y", "x", "phase", F.lit(800000.0).alias("slant"), F.lit(0.6).alias("theta"), F.lit(150.0).alias("perp"), F.lit(40.0).alias("parallel"), (0.001 * (F.col("x") - 50)).alias("flat"), F.col("height").alias("dem"), F.abs(F.col("phase2") - 1).alias("slope"))
    return rounded(insar.phase_to_elevation(p, 0.0555))


@query("principal_components", sql([SCENE, SECOND, BOTH, "c AS (SELECT var_pop(a) AS s, var_pop(b) AS t, covar_pop(a, b) AS u FROM p)", "l AS (SELECT *, (s + t + sqrt((s - t) ** 2 + 4 * u * u)) / 2 AS l FROM c)", "n AS (SELECT *, CASE WHEN abs(u) > abs(l - s) THEN sign(u) ELSE 1 END AS sg, sqrt(u * u + (l - s) ** 2) AS nn FROM l)", "v AS (SELECT u / nn * sg AS va, (l - s) / nn * sg AS vb FROM n)", "z AS (SELECT y, x, (va * a + vb * b) * CASE WHEN greatest(va, vb) < abs(least(va, vb)) THEN -1 ELSE 1 END AS pc FROM p, v)"], "y, x", {"pc1": "pc - (SELECT min(pc) FROM z)"}, "z"))
def _(spark, d):
    out, _, _ = insar.principal_components(both(spark, d), ["a", "b"], 50.0)
    return rounded(out.select("y", "x", "pc1"))


query("goldstein")(lambda spark, d: rounded(insar.goldstein(views.scene_cplx(spark, d))))
query("band_pass")(lambda spark, d: rounded(insar.band_pass(views.scene_cplx(spark, d), 0.1, 0.5, 1.0)))
query("azimuth_filter")(lambda spark, d: rounded(insar.azimuth_filter(views.scene_cplx(spark, d), 30.0, 50.0, 400.0, 500.0)))
query("range_filter")(lambda spark, d: rounded(insar.range_filter(views.scene_cplx(spark, d), 5.0, 60.0, 80.0)))


SBAS_PAIRS = [*((k, k + 1) for k in range(63)), *((k, k + 2) for k in range(0, 62, 2)), (0, 63)]


@query("sbas_inversion")
def _(spark, d):
    st = views.stack(spark, d)
    pairs = spark.createDataFrame(SBAS_PAIRS, "ref int, sec int")
    a, b = (st.select("pixel", F.col("epoch").alias(k), F.col("v").alias(f"v_{k}")) for k in ("ref", "sec"))
    obs = pairs.join(a, "ref").join(b, ["sec", "pixel"]).select(F.expr("pixel div 100").alias("y"), (F.col("pixel") % 100).alias("x"), "ref", "sec", (F.col("v_sec") - F.col("v_ref")).alias("phase"), F.lit(0.9).alias("coherence"))
    out = insar.sbas(obs, [12 * k for k in range(64)], 2, 0.0555)
    return rounded(out.select("y", "x", "velocity", "temporal_coherence", "pairs", *[F.col("phase")[k].alias(f"phase{k}") for k in range(64)]))


ORACLE_SQL["sbas_inversion"] = sql([STACK, "q AS (SELECT pixel, list(v ORDER BY epoch) AS v, regr_slope(v, epoch * 12 / 365.25) AS regr_s FROM stack GROUP BY pixel)"], f"pixel // 100 AS y, pixel % 100 AS x, CAST({len(SBAS_PAIRS)} AS BIGINT) AS pairs", {"velocity": "-regr_s * 0.0555 / (4 * pi()) * 1000", "temporal_coherence": "1", **{f"phase{k}": f"v[{k + 1}] - v[3]" for k in range(64)}}, "q")


@query("closure_phase", sql([STACK, "i AS (SELECT a.pixel, a.epoch AS r, b.epoch AS s, (b.v - a.v) * 3 + sin(a.epoch * b.epoch + a.pixel) AS p FROM stack a JOIN stack b ON a.pixel = b.pixel AND b.epoch BETWEEN a.epoch + 1 AND a.epoch + 2)",
    "t AS (SELECT x.pixel, x.p + y.p - z.p AS c FROM i x JOIN i y ON x.pixel = y.pixel AND x.s = y.r JOIN i z ON x.pixel = z.pixel AND x.r = z.r AND y.s = z.s)", "w AS (SELECT pixel, c - 2 * pi() * ceil((c - pi()) / (2 * pi())) AS c FROM t)"], "pixel // 100 AS y, pixel % 100 AS x, count(*) AS triplets", {"rms": "sqrt(avg(c * c))"}, "w", "GROUP BY pixel", digits=5))
def _(spark, d):
    st = views.stack(spark, d)
    a, b = (st.select("pixel", F.col("epoch").alias(k), F.col("v").alias(f"v_{k}")) for k in ("ref", "sec"))
    near = a.select("*", F.explode(F.array(F.col("ref") + 1, F.col("ref") + 2)).alias("sec")).join(b, ["pixel", "sec"])
    phase = (F.col("v_sec") - F.col("v_ref")) * 3 + F.sin(F.col("ref") * F.col("sec") + F.col("pixel"))
    obs = near.select(F.expr("pixel div 100").alias("y"), (F.col("pixel") % 100).alias("x"), "ref", "sec", phase.alias("phase"))
    return rounded(insar.closure_phase(obs), 5)


query("phase_to_height")(lambda spark, d: rounded(insar.phase_to_height(phases(spark, d), orbit(spark), orbit(spark, -300_200.0), SENSOR, 0.0555, 1000, 100), 3))
query("baselines")(lambda spark, d: rounded(insar.baselines(terrain(spark, d), orbit(spark), orbit(spark, -300_200.0)), 4))


@query("phase_linking")
def _(spark, d):
    p = views.read(spark, d, "events").select(F.expr("event_id div 100").alias("y"), (F.col("event_id") % 100).alias("x"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("epoch"), "value", "user_id")
    z = p.select("y", "x", "epoch", F.cos(F.col("epoch") * 0.4 + F.col("user_id") / 5000).alias("i"), F.sin(F.col("epoch") * 0.4 + F.col("user_id") / 5000).alias("q"))
    out = insar.phase_linking(z, 4)
    return rounded(out.select("y", "x", "temporal_coherence", *[F.col("phase")[k].alias(f"phase{k}") for k in range(4)]))


@query("cross_correlation")
def _(spark, d):
    s = views.scene(spark, d)
    b = s.select((F.col("y") + 2).alias("y"), (F.col("x") + 3).alias("x"), F.col("v").alias("b"))
    # the last chip of a line or column ends at the border, so that every chip is whole
    last = {c: extent(s, c) // 32 for c in ("y", "x")}
    start = {c: max(extent(s, c) - 31, 0) for c in ("y", "x")}
    chips = lambda c: F.explode(F.array_distinct(F.array(F.expr(f"{c} div 32"), F.when(F.col(c) >= start[c], F.lit(last[c]).cast("long")).otherwise(F.expr(f"{c} div 32")))))
    at = lambda c: (F.col(c) - F.when(F.col(f"k{c}") == last[c], start[c]).otherwise(32 * F.col(f"k{c}"))).alias(c)
    met = s.join(b, ["y", "x"], "left").withColumn("ky", chips("y")).withColumn("kx", chips("x"))
    met = met.select((F.col("ky") * (last["x"] + 1) + F.col("kx")).alias("gcp"), at("y"), at("x"), F.col("v").alias("a"), F.coalesce("b", F.lit(0.0)).alias("b"))
    return rounded(insar.cross_correlation(met))


@query("warp_fit", "SELECT CAST(k AS BIGINT) AS k, v[k] AS dy, w[k] AS dx FROM (SELECT unnest(range(1, 4)) AS k, [0.5, 0.01, -0.02] AS v, [-1.0, 0.0, 0.03] AS w)")
def _(spark, d):
    g = views.scene(spark, d).select("y", "x", (0.5 + 0.01 * F.col("y") - 0.02 * F.col("x")).alias("dy"), (-1.0 + 0.03 * F.col("x")).alias("dx"))
    cy, cx = insar.fit_warp(g)
    return rounded(spark.createDataFrame([(k + 1, float(cy[k]), float(cx[k])) for k in range(3)], "k long, dy double, dx double"))


@query("offset_velocity", sql(["g AS (SELECT event_id // 100 AS gy, event_id % 100 AS gx, value / 40 AS dy, user_id / 800.0 AS dx FROM events)", "h AS (SELECT *, sqrt((dy * 10) ** 2 + (dx * 10) ** 2) / 12 <= 3 AS ok FROM g)", "m AS (SELECT a.gy, a.gx, avg(b.dy) AS y, avg(b.dx) AS x FROM h a JOIN h b ON abs(a.gy - b.gy) <= 1 AND abs(a.gx - b.gx) <= 1 WHERE a.ok AND b.ok GROUP BY 1, 2)"], "g.gy, g.gx", {"velocity": "sqrt((m.y * 10) ** 2 + (m.x * 10) ** 2) / 12"}, "g LEFT JOIN m ON g.gy = m.gy AND g.gx = m.gx"))
def _(spark, d):
    e = views.read(spark, d, "events")
    g = e.select(F.expr("event_id div 100").alias("gy"), (F.col("event_id") % 100).alias("gx"), (F.col("value") / 40).alias("dy"), (F.col("user_id") / 800.0).alias("dx"))
    return rounded(insar.offset_velocity(g, 10.0, 10.0, 12.0, 3.0))


# --- burst mode -------------------------------------------------------------------------

BURSTS = "bu AS (SELECT y // 4 AS burst, y % 4 + 1 * (y // 4 > 0)::INT * 0 AS line, x, v FROM scene WHERE y < 12)"


@query("topsar_split", f"WITH {SCENE} SELECT y, x, v FROM scene WHERE x < 50 AND y // 4 BETWEEN 1 AND 2")
def _(spark, d):
    s = views.scene(spark, d).withColumns({"swath": F.when(F.col("x") < 50, "IW1").otherwise("IW2"), "burst": F.expr("y div 4")})
    return topsar.split(s, "IW1", 1, 2).select("y", "x", "v")


@query("topsar_deburst", f"WITH {SCENE}, b AS (SELECT y // 6 AS burst, y % 6 + (y // 6) * 4 AS t, x, v FROM scene) SELECT t AS y, x, arg_max(v, burst) AS v FROM b WHERE (burst = 0 OR t > burst * 4 + 1) AND (burst = (SELECT max(burst) FROM b) OR t <= burst * 4 + 5) AND t < burst * 4 + 6 GROUP BY t, x")
def _(spark, d):
    s = views.scene(spark, d).select(F.expr("y div 6").alias("burst"), (F.col("y") % 6).alias("line"), "x", "v")
    bursts = s.select("burst", (4 * F.col("burst")).cast("double").alias("first"), (4 * F.col("burst") + 6).cast("double").alias("last")).distinct()
    return topsar.deburst(s, bursts, 1.0)


@query("topsar_merge", f"WITH {SCENE}, s AS (SELECT 1 AS w, y, x, v FROM scene WHERE x < 60 UNION ALL SELECT 2, y, x, v + 1 FROM scene WHERE x >= 40) SELECT y, x, v FROM s WHERE (w = 1 AND x < 50) OR (w = 2 AND x >= 50)")
def _(spark, d):
    s = views.scene(spark, d)
    swaths = s.where("x < 60").withColumn("swath", F.lit(1)).unionByName(s.where("x >= 40").withColumns({"v": F.col("v") + 1, "swath": F.lit(2)}))
    return topsar.merge(swaths, spark.createDataFrame([(1, 0, 49), (2, 50, 99)], "swath int, first long, last long"))


@query("etad_deburst", "SELECT l_orderkey % 1000 AS y, l_partkey % 100 AS x, max((l_suppkey, l_linenumber)) AS s, arg_max(l_quantity, (l_suppkey, l_linenumber, l_orderkey, l_partkey)) AS v FROM lineitem GROUP BY 1, 2".replace("max((l_suppkey, l_linenumber)) AS s, ", ""))
def _(spark, d):
    line = views.read(spark, d, "lineitem")
    layers = line.select((F.col("l_orderkey") % 1000).alias("y"), (F.col("l_partkey") % 100).alias("x"), F.col("l_suppkey").alias("swath"), F.struct("l_linenumber", "l_orderkey", "l_partkey").alias("burst"), F.col("l_quantity").alias("v"))
    return topsar.etad_deburst(layers).select("y", "x", "v")


@query("double_difference", sql([PAIR], "y, x", {"phase": "atan2(q2 * i1 - i2 * q1, i1 * i2 + q1 * q2)"}, "pair"))
def _(spark, d):
    return rounded(topsar.double_difference(views.pair(spark, d)))


ESD = "b AS (SELECT event_id // 100 AS overlap, cos(0.3 + user_id / 2000.0) AS i, sin(0.3 + user_id / 2000.0) AS q, (event_id % 100) / 100.0 AS coherence FROM events)"


def blocks(spark, d):
    e = views.read(spark, d, "events")
    p = 0.3 + F.col("user_id") / 2000.0
    return e.select(F.expr("event_id div 100").alias("overlap"), F.cos(p).alias("i"), F.sin(p).alias("q"), ((F.col("event_id") % 100) / 100.0).alias("coherence"))


@query("spectral_diversity", sql([ESD], "overlap", {"shift": "atan2(sum(q * coherence), sum(i * coherence)) / (2 * pi() * 4500 * 0.002)", "coherence": "avg(coherence)"}, "b", "GROUP BY overlap"))
def _(spark, d):
    return rounded(topsar.spectral_diversity(blocks(spark, d), 4500.0, 0.002))


query("spectral_diversity_periodogram")(lambda spark, d: rounded(topsar.periodogram_shift(blocks(spark, d), 4500.0, 0.002)))


@query("arc_integration", "SELECT * FROM (VALUES (CAST(0 AS BIGINT), 0.0::DOUBLE), (1, 0.1), (2, 0.3), (3, 0.2)) t(image, shift)")
def _(spark, d):
    x = topsar.integrate_arcs([(0, 1, 0.1, 1.0), (1, 2, 0.2, 1.0), (2, 3, -0.1, 1.0), (0, 2, 0.3, 2.0), (1, 3, 0.1, 1.0), (0, 3, 9.0, 1e-9)], 4, "L1")
    return rounded(spark.createDataFrame([(k, float(v)) for k, v in enumerate(x)], "image long, shift double"))


@query("orbit_interpolation", sql(["t AS (SELECT event_id * 0.0103 AS t FROM events)"], "", {"t": "t", "px": "7000 + 3 * t - 0.1 * t * t", "py": "t ** 3 / 97", "pz": "5 - t"}, "t"))
def _(spark, d):
    points = views.read(spark, d, "events").select((F.col("event_id") * 0.0103).alias("t"))
    end = extent(points, "t")
    step = max(1, end // 5000 + 1)  # the orbit's size stays bounded
    vectors = spark.createDataFrame([(float(t), 7000 + 3.0 * t - 0.1 * t * t, t**3 / 97, 5.0 - t) for t in range(-10 * step, end + 11 * step, step)], "t double, px double, py double, pz double")
    return rounded(topsar.lagrange_orbit(points, vectors))


# --- calibration ------------------------------------------------------------------------

KNOTS = "k AS (SELECT p_size AS k, avg(p_retailprice) / 100 AS v FROM part GROUP BY 1)"


@query("lut_asof", sql([SCENE, KNOTS, "iv AS (SELECT k, v, lead(k) OVER (ORDER BY k) AS k2, lead(v) OVER (ORDER BY k) AS v2 FROM k)", "ends AS (SELECT min(k) AS lo, max(k) AS hi, arg_min(v, k) AS vlo, arg_max(v, k) AS vhi FROM k)"], "y, x", {"lut": "CASE WHEN x / 1.5 <= lo THEN vlo WHEN x / 1.5 >= hi THEN vhi ELSE iv.v + (x / 1.5 - k) / (k2 - k) * (v2 - iv.v) END"}, "scene JOIN ends ON true LEFT JOIN iv ON x / 1.5 >= k AND x / 1.5 < k2"))
def _(spark, d):
    knots = views.read(spark, d, "part").groupBy(F.col("p_size").alias("k")).agg((F.avg("p_retailprice") / 100).alias("lut"))
    pts = views.scene(spark, d).select("y", "x", (F.col("x") / 1.5).alias("at"))
    return rounded(calibration.asof(pts, knots, "at", "k", "lut").select("y", "x", "lut"))


@query("calibration_lut", sql([SCENE], "y, x", {"sigma": "v * v / ((100.3 + 2 * y + x) * (100.3 + 2 * y + x))"}, "scene"))
def _(spark, d):
    s = views.scene(spark, d)
    lines = spark.range(extent(s, "y") // 50 + 2).select((50 * F.col("id")).alias("line"))
    lut = lines.crossJoin(spark.range(4).select((40 * F.col("id")).alias("pixel"))).withColumn("lut", 100.3 + 2 * F.col("line") + F.col("pixel"))
    return rounded(calibration.calibrate(calibration.lut_bilinear(s, lut, "lut"), calibration.factor("lut_squared")))


_theta = "(0.5 + x / 1000.0)"
#: Mission, samples, output, what the product gives, and the same in SQL of i, q and x.
MISSIONS = {
    "terrasarx_sigma": ("terrasarx", "complex", "sigma", {"constant": 0.02, "noise": True}, f"0.02 * abs(i * i + q * q - x) * sin{_theta}"),
    "terrasarx_gamma": ("terrasarx", "complex", "gamma", {"constant": 0.02}, f"0.02 * (i * i + q * q) * tan{_theta}"),
    "paz_beta": ("paz", "complex", "beta", {"constant": 0.03}, "0.03 * (i * i + q * q)"),
    "radarsat2_sigma": ("radarsat2", "complex", "sigma", {}, "(i * i + q * q) / (10.3 + x) ** 2"),
    "radarsat2_detected": ("radarsat2", "amplitude", "sigma", {"offset": 2.0}, "(v * v + 2) / (10.3 + x)"),
    "rcm_gamma": ("rcm", "complex", "gamma", {}, f"(i * i + q * q) / (10.3 + x) ** 2 / cos{_theta}"),
    "kompsat5_sigma": ("kompsat5", "complex", "sigma", {"rescale": 3.0, "constant": 0.1, "cell": 4.0}, f"(i * i + q * q) * 9 * 0.1 / 4 * sin{_theta}"),
    "nisar_sigma": ("nisar", "complex", "sigma", {"retro": True}, "(i * i + q * q) * (1.013 + 0.01 * x) / 0.5"),
    "biomass_beta": ("biomass", "complex", "beta", {}, f"(i * i + q * q) * (1.013 + 0.01 * x) / sin{_theta}"),
    "spacety_sigma": ("spacety", "complex", "sigma", {"retro": True}, "(i * i + q * q) / (1.013 + 0.01 * x) ** 2 * 0.25"),
    "ers_sigma": ("ers", "complex", "sigma", {"constant": 100.0, "reference": 0.4, "reference_range": 800.0, "gain": True}, f"(i * i + q * q) * sin{_theta} / (100 * sin(0.4)) * ((800 + x) / 800) ** 3 / (10.3 + x) ** 2"),
    "asar_gamma": ("asar", "complex", "gamma", {"constant": 100.0}, f"(i * i + q * q) / 100 * tan{_theta}"),
}
for _name, (_mission, _unit, _output, _meta, _sql) in MISSIONS.items():
    query(f"calibrate_{_name}", sql([CPLX, SCENE] if _unit == "complex" else [SCENE], "y, x", {_output: _sql}, "cplx" if _unit == "complex" else "scene"))(
        lambda spark, d, m=_mission, u=_unit, o=_output, k=_meta: rounded(missions.calibrate((views.scene_cplx if u == "complex" else views.scene)(spark, d).withColumns({"theta": 0.5 + F.col("x") / 1000, "gain": 10.3 + F.col("x"), "noise": F.col("x").cast("double"), "lut": 1.013 + 0.01 * F.col("x"), "retro": F.lit(0.5), "range": 800.0 + F.col("x")}), m, u, o, **k))
    )


@query("adc_saturation", sql([CPLX, "b AS (SELECT y // 8 AS ky, x // 8 AS kx, 10 * log10(avg(i * i + q * q) / 100) AS l FROM cplx GROUP BY 1, 2)", "f AS (SELECT ky, kx, CASE WHEN l <= 0 THEN 1 WHEN l >= 20 THEN 1.5 ELSE 1 + l / 40 END AS f FROM b)"], "y, x", {"dn2": "(i * i + q * q) * f.f"}, "cplx JOIN f ON ky = y // 8 AND kx = x // 8"))
def _(spark, d):
    table = spark.createDataFrame([(0.0, 1.0), (20.0, 1.5)], "level double, loss double")
    return rounded(missions.window_mean_adc(views.scene_cplx(spark, d).select("y", "x", (F.col("i") ** 2 + F.col("q") ** 2).alias("dn2")), table, 8, 100.0))


def stored(spark, files) -> str:
    """A new folder with these files."""
    folder = f"{shared_dir(spark)}/rasterloom-files-{uuid.uuid4().hex}"
    sinks.save(files, folder)
    return folder


@query("tiff_files", f"WITH {SCENE} SELECT y, x, round(CAST(CAST(v AS FLOAT) AS DOUBLE), 4) + 0.0 AS v FROM scene")
def _(spark, d):
    folder = stored(spark, sinks.geotiff(views.scene(spark, d).select("y", "x", "v"), ["v"], "scene", {"mission": "x"}))
    return rounded(tiff.read(spark, f"{folder}/scene.tif", ["v"]).select("y", "x", "v"), 4)


@query("gamma_files", f"WITH {CPLX} SELECT y, x, round(CAST(CAST(i AS FLOAT) AS DOUBLE), 4) + 0.0 AS i, round(CAST(CAST(q AS FLOAT) AS DOUBLE), 4) + 0.0 AS q FROM cplx")
def _(spark, d):
    folder = stored(spark, sinks.gamma(views.scene_cplx(spark, d), "scene", {"mission": "x"}))
    par = spark.read.text(f"{folder}/scene.slc.par", wholetext=True).first()[0]
    return rounded(products.read_gamma(spark, f"{folder}/scene.slc", par).select("y", "x", "i", "q"), 4)


@query("polsarpro_files", sql([QUAD, C2], "y, x", {k: f"CAST({k} AS FLOAT)" for k in ("c11", "c12_re", "c12_im", "c22")}, "c2", digits=4))
def _(spark, d):
    names = ["c11", "c12_re", "c12_im", "c22"]
    return rounded(products.read_polsarpro(spark, stored(spark, sinks.polsarpro(c2(spark, d), names)), names), 4)


@query("unwrapper_files", sql([PHASES], "y, x", {"phase": "CAST(phase AS FLOAT)"}, "ph", digits=4))
def _(spark, d):
    p = phases(spark, d).select("y", "x", "phase", F.lit(0.5).alias("coherence"))
    folder = stored(spark, sinks.snaphu(p, "ifg", {"baseline": 150.0, "wavelength": 0.0555}))
    head = formats.header(spark.read.text(f"{folder}/phase_ifg.hdr", wholetext=True).first()[0])
    return rounded(formats.read_bsq(spark, f"{folder}/phase_ifg.img", head, ["phase"]).select("y", "x", "phase"), 4)


@query("scatterer_files", f"WITH {CPLX} SELECT y, x, round(CAST(CAST(i AS FLOAT) AS DOUBLE), 4) + 0.0 AS i, round(CAST(CAST(q AS FLOAT) AS DOUBLE), 4) + 0.0 AS q FROM cplx")
def _(spark, d):
    z = views.scene_cplx(spark, d)
    where = z.select("y", "x", (45 + F.col("y") / 1000).alias("lat"), (7 + F.col("x") / 1000).alias("lon"), F.lit(0.0).alias("height"))
    folder = stored(spark, sinks.stamps("20210101", {"20210101": z, "20210113": z}, {"20210113": z}, where, {"20210113": (12.5, -150.0)}, {"mission": "x"}))
    par = spark.read.text(f"{folder}/rslc/20210113.rslc.par", wholetext=True).first()[0]
    return rounded(products.read_gamma(spark, f"{folder}/diff0/20210101_20210113.diff", par).select("y", "x", "i", "q"), 4)


@query("netcdf_files", sql([SCENE], "", {"bytes": "count(*) * 4 + 100"}, "scene", digits=0))
def _(spark, d):
    """Size of the file: the header and four bytes for each pixel."""
    files = sinks.netcdf(views.scene(spark, d).select("y", "x", "v"), ["v"], "scene")
    return rounded(files.groupBy("name").agg(F.sum(F.length("content")).cast("double").alias("bytes")).select("bytes"), 0)


@query("orbit_polynomials", sql(["t AS (SELECT DISTINCT event_id // 100 * 0.013 AS t FROM events)"], "", {"t": "t", "x": "7000 + 3 * t - 0.1 * t * t", "y": "t ** 3 * 0.01", "z": "5 - t", "vx": "3 - 0.2 * t", "vy": "0.03 * t * t", "vz": "-1"}, "t", digits=5))
def _(spark, d):
    times = views.read(spark, d, "events").select((F.expr("event_id div 100") * 0.013).alias("t")).distinct()
    end = extent(times, "t")
    v = spark.range(-3, end + 5).select(F.col("id").cast("double").alias("t"))
    t = F.col("t")
    vectors = v.select("t", (7000 + 3 * t - 0.1 * t * t).alias("x"), (t**3 * 0.01).alias("y"), (5 - t).alias("z"), (3 - 0.2 * t).alias("vx"), (0.03 * t * t).alias("vy"), F.lit(-1.0).alias("vz"))
    return rounded(orbits.interpolate(vectors, times), 5)


CAL = {
    "decibel_constant": ({"k": -8.3}, "10 ** (-0.83)"),
    "constant": ({"k": 0.02}, "0.02"),
    "constant_sine": ({"k": 0.02}, "0.02 * sin(0.5 + x / 1000.0)"),
    "centre_sine": ({"k": 0.02, "centre": 0.55}, "0.02 * sin(0.55)"),
    "sine_ratio": ({"k": 50.0, "centre": 0.55}, "sin(0.5 + x / 1000.0) / (50 * sin(0.55))"),
    "reference_range": ({"range": 8.0, "exponent": 2.0, "reference": 0.5, "rescale": 3.0, "k": 100.0}, "8.0 ** 4 * sin(0.5) / (9 * 100)"),
    "inverse_square": ({"k": 7.0}, "1 / 49.0"),
}
for _name, (_args, _sql) in CAL.items():
    query(f"calibration_{_name}", sql([SCENE], "y, x", {"sigma": f"v * v * {_sql}"}, "scene"))(lambda spark, d, k=_name, a=_args: rounded(calibration.calibrate(views.scene(spark, d).withColumn("theta", 0.5 + F.col("x") / 1000.0), calibration.factor(k, **a))))


@query("calibration_db", sql([SCENE], "y, x", {"sigma": "10 * log10(greatest(v * v * 0.02, 1e-30))"}, "scene"))
def _(spark, d):
    return rounded(calibration.calibrate(views.scene(spark, d), F.lit(0.02), decibel=True))


@query("calibration_complex", sql([CPLX], "y, x", {"i": "i * sqrt(0.02)", "q": "q * sqrt(0.02)"}, "cplx"))
def _(spark, d):
    return rounded(calibration.calibrate(views.scene_cplx(spark, d), F.lit(0.02), unit="complex", phase=True))


@query("thermal_noise", sql([SCENE, "n AS (SELECT *, (x % 10) * 50 AS noise FROM scene)"], "y, x", {"v": "CASE WHEN noise = 0 THEN v * v ELSE greatest(v * v - noise, 0) END"}, "n"))
def _(spark, d):
    return rounded(calibration.remove_noise(views.scene(spark, d).withColumn("noise", F.col("x") % 10 * 50)))


@query("border_noise", f"WITH {SCENE}, e AS (SELECT max(y) AS my, max(x) AS mx FROM scene) SELECT y, x, CASE WHEN (y < 3 OR x < 3 OR y > my - 3 OR x > mx - 3) AND (sqrt(greatest(v * v - 100, 0)) < 20 OR v < 30) THEN NULL ELSE v END AS v FROM scene, e")
def _(spark, d):
    return calibration.border_noise(views.scene(spark, d).withColumn("noise", F.lit(100.0)), 3, 20.0)


@query("antenna_pattern", sql([SCENE], "y, x", {"v": "v / ((1 + x / 200.0) * (1 + x / 200.0))"}, "scene"))
def _(spark, d):
    gains = spark.createDataFrame([(x, 1 + x / 200.0) for x in range(100)], "x long, gain double")
    return rounded(calibration.antenna_pattern(views.scene(spark, d), gains))


def soils(spark, d):
    """Dielectric constants 3 to 27, sand and clay by column and line."""
    return views.scene(spark, d).select("y", "x", (3 + F.col("v") / 8).alias("rdc"), (F.col("x") * 0.5).alias("sand"), (F.col("y") % 40).cast("double").alias("clay"))


SOILS = "so AS (SELECT y, x, 3 + v / 8 AS rdc, x * 0.5 AS sand, y % 40 * 1.0 AS clay FROM scene)"


@query("hallikainen_moisture", sql([SCENE, SOILS, "k AS (SELECT *, 1.993 + 0.002 * sand + 0.015 * clay - rdc AS a, 38.086 - 0.176 * sand - 0.633 * clay AS b, 10.72 + 1.256 * sand + 1.522 * clay AS c FROM so)",
    "r AS (SELECT y, x, b * b - 4 * a * c >= 0 AS real, (-b + sqrt(greatest(b * b - 4 * a * c, 0))) / (2 * c) AS m FROM k)"], "y, x, CASE WHEN real AND m BETWEEN 0 AND 0.55 THEN 0 ELSE 3 END AS quality", {"moisture": "CASE WHEN real AND m BETWEEN 0 AND 0.55 THEN m END"}, "r"))
def _(spark, d):
    return rounded(soil.hallikainen_moisture(soils(spark, d)))


query("mironov_moisture")(lambda spark, d: rounded(soil.mironov_moisture(soils(spark, d), 5.405e9), 6))


@query("lut_inversion", sql([SCENE, "l AS (SELECT k * 2.0 AS s, k * 0.01 AS rdc FROM (SELECT unnest(range(0, 100)) AS k))", "r AS (SELECT y, x, rdc, row_number() OVER (PARTITION BY y, x ORDER BY (s - v) * (s - v), rdc) AS n FROM scene, l)"], "y, x", {"rdc": "avg(rdc)"}, "r WHERE n <= 3", "GROUP BY y, x"))
def _(spark, d):
    lut = spark.createDataFrame([(k * 2.0, k * 0.01) for k in range(100)], "v double, rdc double")
    return rounded(calibration.nearest_neighbours(views.scene(spark, d), lut, ["v"], ["rdc"], 3).select("y", "x", "rdc"))


# --- polarimetry ------------------------------------------------------------------------


@query("matrix_c3", sql([QUAD, C3], "y, x", {k: k for k in ("c11", "c22", "c33", "c13_re", "c13_im")}, "c3"))
def _(spark, d):
    return rounded(polarimetry.matrix(views.quad(spark, d), "C3").select("y", "x", "c11", "c22", "c33", "c13_re", "c13_im"))


@query("matrix_c2", sql([QUAD, C2], "y, x", {k: k for k in ("c11", "c22", "c12_re", "c12_im")}, "c2"))
def _(spark, d):
    return rounded(polarimetry.matrix(views.quad(spark, d), "C2"))


@query("matrix_t3", sql([QUAD, K3, T3], "y, x", {k: k for k in ("t11", "t22", "t33", "t12_re", "t12_im", "t13_re", "t13_im", "t23_re", "t23_im")}, "t3"))
def _(spark, d):
    return rounded(polarimetry.matrix(views.quad(spark, d), "T3"))


@query("matrix_c4", sql([QUAD], "y, x", {"c11": "hh_i * hh_i + hh_q * hh_q", "c14_re": "hh_i * vv_i + hh_q * vv_q", "c23_im": "hv_q * vh_i - hv_i * vh_q", "c44": "vv_i * vv_i + vv_q * vv_q"}, "quad"))
def _(spark, d):
    return rounded(polarimetry.matrix(views.quad(spark, d), "C4").select("y", "x", "c11", "c14_re", "c23_im", "c44"))


query("matrix_t4")(lambda spark, d: rounded(polarimetry.matrix(views.quad(spark, d), "T4")))


@query("pauli", sql([QUAD], "y, x", {"pauli_r": "10 * log10(greatest(((hh_i - vv_i) ** 2 + (hh_q - vv_q) ** 2) / 2, 1e-15))", "pauli_g": "10 * log10(greatest(((hv_i + vh_i) ** 2 + (hv_q + vh_q) ** 2) / 2, 1e-15))", "pauli_b": "10 * log10(greatest(((hh_i + vv_i) ** 2 + (hh_q + vv_q) ** 2) / 2, 1e-15))"}, "quad"))
def _(spark, d):
    return rounded(polarimetry.pauli(views.quad(spark, d)))


@query("sinclair", sql([QUAD], "y, x", {"sinclair_r": "10 * log10(greatest(vv_i ** 2 + vv_q ** 2, 1e-15))", "sinclair_g": "10 * log10(greatest(((hv_i + vh_i) / 2) ** 2 + ((hv_q + vh_q) / 2) ** 2, 1e-15))", "sinclair_b": "10 * log10(greatest(hh_i ** 2 + hh_q ** 2, 1e-15))"}, "quad"))
def _(spark, d):
    return rounded(polarimetry.sinclair(views.quad(spark, d)))


def c3(spark, d):
    return polarimetry.matrix(views.quad(spark, d), "C3")


def t3(spark, d):
    return polarimetry.matrix(views.quad(spark, d), "T3")


def c2(spark, d):
    return polarimetry.matrix(views.quad(spark, d), "C2")


@query("van_zyl", sql([QUAD, C3, "z AS (SELECT *, sqrt((c33 / c11 - 1) ** 2 + 4 * (c13_re ** 2 + c13_im ** 2) / c11 ** 2) AS r FROM c3)"], "y, x", {"surface": "c11 / 2 * (c33 / c11 + 1 + r)", "double": "c11 / 2 * (c33 / c11 + 1 - r)", "volume": "c22"}, "z"))
def _(spark, d):
    return rounded(polarimetry.van_zyl(c3(spark, d)))


@query("generalized_freeman_durden", sql([QUAD, K3, T3, "z AS (SELECT *, t11 - 2 * t33 + t22 - t33 AS s, t11 - 2 * t33 - t22 + t33 AS dd FROM t3)"], "y, x", {"ms": "(s + sqrt(dd * dd + 4 * (t12_re ** 2 + t12_im ** 2))) / 2", "md": "(s - sqrt(dd * dd + 4 * (t12_re ** 2 + t12_im ** 2))) / 2", "pv": "4 * t33"}, "z"))
def _(spark, d):
    return rounded(polarimetry.generalized_freeman_durden(t3(spark, d)))


@query("huynen", sql([QUAD, K3, T3], "y, x", {"a0_2": "t11", "b0": "(t12_re ** 2 + t12_im ** 2 + t13_re ** 2 + t13_im ** 2) / (2 * t11)", "b": "(t12_re ** 2 + t12_im ** 2 - t13_re ** 2 - t13_im ** 2) / (2 * t11)", "e": "(t12_re * t13_re + t12_im * t13_im) / t11", "f": "(t12_re * t13_im - t12_im * t13_re) / t11"}, "t3"))
def _(spark, d):
    return rounded(polarimetry.huynen(t3(spark, d)))


# Three powers of c11, c22, c33, c13_re, c13_im in the form of the textbook, for a named source.
THREE = """f3 AS (SELECT *, 4 * c22 AS fv, c11 - 1.5 * c22 AS a, c33 - 1.5 * c22 AS b, c13_re - c22 / 2 AS r0, c13_im AS i0 FROM {source}),
  h3 AS (SELECT *, CASE WHEN a > 1e-15 AND b > 1e-15 AND a * b < r0 * r0 + i0 * i0 THEN sqrt(a * b) / sqrt(r0 * r0 + i0 * i0) ELSE 1 END AS k FROM f3),
  g3 AS (SELECT *, r0 * k AS r, i0 * k AS i, CASE WHEN k < 1 THEN 0 ELSE a * b - r0 * r0 - i0 * i0 END AS left_ FROM h3),
  fs AS (SELECT *, CASE WHEN r < 0 THEN abs(left_ / (a + b - 2 * r)) ELSE abs(b - abs(left_ / (a + b + 2 * r))) END AS fs, CASE WHEN r < 0 THEN abs(b - abs(left_ / (a + b - 2 * r))) ELSE abs(left_ / (a + b + 2 * r)) END AS fd FROM g3),
  three AS (SELECT *, CASE WHEN a <= 1e-15 OR b <= 1e-15 THEN 0 WHEN r < 0 THEN 2 * fs ELSE fs * (1 + ((r + fd) ** 2 + i * i) / fs ** 2) END AS ps3, CASE WHEN a <= 1e-15 OR b <= 1e-15 THEN 0 WHEN r < 0 THEN fd * (1 + ((r - fs) ** 2 + i * i) / fd ** 2) ELSE 2 * fd END AS pd3 FROM fs)"""


@query("freeman_durden", sql([QUAD, C3, THREE.format(source="c3")], "y, x", {"surface": "ps3", "double": "pd3", "volume": "fv"}, "three", digits=5))
def _(spark, d):
    return rounded(polarimetry.freeman_durden(c3(spark, d)), 5)


@query("span_decibels", sql([QUAD, C3, "e AS (SELECT min(c11 + c22 + c33) AS lo, max(c11 + c22 + c33) AS hi FROM c3)"], "y, x", {"c11": "10 * log10(least(greatest(c11, lo), hi))", "c33": "10 * log10(least(greatest(c33, lo), hi))"}, "c3, e"))
def _(spark, d):
    return rounded(polarimetry.span_db(c3(spark, d), ["c11", "c33"], F.col("c11") + F.col("c22") + F.col("c33")))


query("krogager")(lambda spark, d: rounded(polarimetry.krogager(views.quad(spark, d))))
YAMAGUCHI = f"""q AS (SELECT *, (t11 + t22) / 2 + t12_re AS c11, t33 AS c22, (t11 + t22) / 2 - t12_re AS c33, (t11 - t22) / 2 AS c13_re, -t12_im AS c13_im, t11 + t22 + t33 AS span, 2 * abs(t23_im) AS pc FROM t3m),
  {THREE.format(source="q")},
  w AS (SELECT *, 10 * log10(c33 / c11) AS ratio FROM three),
  k AS (SELECT *, CASE WHEN ratio <= -2 THEN 1 / 6.0 WHEN ratio > 2 THEN -1 / 6.0 ELSE 0 END AS k1, CASE WHEN ratio <= -2 OR ratio > 2 THEN 7 / 30.0 ELSE 0.25 END AS k2, (t33 - pc / 2) / CASE WHEN ratio <= -2 OR ratio > 2 THEN 4 / 15.0 ELSE 0.25 END AS pv FROM w),
  z AS (SELECT *, t11 - pv / 2 AS s, t22 - k2 * pv - pc / 2 AS d, (t12_re - k1 * pv) ** 2 + t12_im ** 2 AS c, pv + pc < span AS full_, c13_re - t33 / 2 + pc / 2 < 0 AS neg FROM k),
  n AS (SELECT *, CASE WHEN neg THEN s - c / d ELSE s + c / s END AS p1, CASE WHEN neg THEN d + c / d ELSE d - c / s END AS p2 FROM z)"""
T3_NAMES = ("t11", "t22", "t33", "t12_re", "t12_im", "t13_re", "t13_im", "t23_re", "t23_im")
T3M = f"t3m AS ({window(', '.join(f'avg(b.{k}) AS {k}' for k in T3_NAMES), 5, source='t3')})"


@query("yamaguchi", sql([QUAD, K3, T3, T3M, YAMAGUCHI], "y, x", {
    "surface": "CASE WHEN pv <= 0 THEN ps3 WHEN NOT full_ OR p1 < 0 THEN 0 WHEN p1 > 0 AND p2 < 0 THEN span - pv - pc ELSE p1 END",
    "double": "CASE WHEN pv <= 0 THEN pd3 WHEN NOT full_ OR p2 < 0 THEN 0 WHEN p2 > 0 AND p1 < 0 THEN span - pv - pc ELSE p2 END",
    "volume": "CASE WHEN pv <= 0 THEN fv WHEN NOT full_ OR (p1 < 0 AND p2 < 0) THEN span - pc ELSE pv END",
    "helix": "CASE WHEN pv <= 0 THEN 0 ELSE pc END"}, "n", digits=5))
def _(spark, d):
    return rounded(polarimetry.yamaguchi(polarimetry.averaged(t3(spark, d), 3, "t", 5)), 5)


BARAKAT = """dt AS (SELECT *, t11 * t22 * t33 + 2 * ((t12_re * t23_re - t12_im * t23_im) * t13_re + (t12_re * t23_im + t12_im * t23_re) * t13_im) - t11 * (t23_re ** 2 + t23_im ** 2) - t22 * (t13_re ** 2 + t13_im ** 2) - t33 * (t12_re ** 2 + t12_im ** 2) AS det, t11 + t22 + t33 AS s, t22 + t33 AS h FROM t3m),
  mf AS (SELECT *, sqrt(greatest(1 - 27 * greatest(det, 0) / s ** 3, 0)) AS m FROM dt),
  th AS (SELECT *, atan(m * s * (t11 - h) / (t11 * h + m * m * s * s)) AS theta, atan(2 * abs(t23_im) / s) AS tau FROM mf)"""
query("cloude")(lambda spark, d: rounded(polarimetry.cloude(polarimetry.averaged(t3(spark, d), 3, "t", 5))))
query("touzi")(lambda spark, d: rounded(polarimetry.touzi(polarimetry.averaged(t3(spark, d), 3, "t", 5))))


@query("mf3cf", sql([QUAD, K3, T3, T3M, BARAKAT], "y, x", {"surface": "m * s / 2 * (1 + sin(2 * theta))", "double": "m * s / 2 * (1 - sin(2 * theta))", "volume": "s * (1 - m)", "theta": "degrees(theta)"}, "th", digits=5))
def _(spark, d):
    return rounded(polarimetry.mf3cf(polarimetry.averaged(t3(spark, d), 3, "t", 5)), 5)


@query("mf4cf", sql([QUAD, K3, T3, T3M, BARAKAT, "o AS (SELECT *, m * s * sin(2 * tau) AS pc FROM th)"], "y, x", {"surface": "(m * s - pc) / 2 * (1 + sin(2 * theta))", "double": "(m * s - pc) / 2 * (1 - sin(2 * theta))", "volume": "s * (1 - m)", "helix": "pc", "theta": "degrees(theta)", "tau": "degrees(tau)"}, "o", digits=5))
def _(spark, d):
    return rounded(polarimetry.mf4cf(polarimetry.averaged(t3(spark, d), 3, "t", 5)), 5)


query("h_a_alpha")(lambda spark, d: rounded(polarimetry.h_a_alpha(polarimetry.averaged(t3(spark, d), 3, "t", 5))))
query("polarimetric_parameters")(lambda spark, d: rounded(polarimetry.parameters(polarimetry.averaged(t3(spark, d), 3, "t", 5))))
query("faraday_rotation")(lambda spark, d: rounded(polarimetry.faraday(views.quad(spark, d), 5), 6))
query("orientation_angle")(lambda spark, d: rounded(polarimetry.orientation(t3(spark, d))))
query("snr_correction")(lambda spark, d: rounded(polarimetry.snr_correction(views.quad(spark, d), 5)))
query("polarimetric_calibration")(lambda spark, d: rounded(polarimetry_models.polarimetric_calibration(views.quad(spark, d)), 5))
query("eigen_angles")(lambda spark, d: rounded(polarimetry_models.eigen_angles(polarimetry.averaged(t3(spark, d), 3, "t", 5)), 5))
query("yang")(lambda spark, d: rounded(polarimetry_models.yang(polarimetry.averaged(t3(spark, d), 3, "t", 5))))
query("yang_decibels")(lambda spark, d: rounded(polarimetry_models.yang_decibels(polarimetry.averaged(t3(spark, d), 3, "t", 5))))
C2M = f"cm AS ({window('avg(b.c11) AS c11, avg(b.c22) AS c22, avg(b.c12_re) AS c12_re, avg(b.c12_im) AS c12_im', 5, source='c2')})"
MODEL = """ms0 AS (SELECT *, c11 + c22 AS s0, c11 - c22 AS s1, 4 * (c12_re ** 2 + c12_im ** 2) AS s23 FROM cm), ms1 AS (SELECT *, s1 - 2 * s0 AS b, s0 * s0 - s1 * s1 - s23 AS c FROM ms0),
  ms2 AS (SELECT *, CASE WHEN b * b >= 3 * c THEN sqrt(b * b - 3 * c) END AS r FROM ms1),
  ms3 AS (SELECT *, CASE WHEN (r - b) / 1.5 BETWEEN 0 AND s0 THEN (r - b) / 1.5 WHEN (-b - r) / 1.5 BETWEEN 0 AND s0 THEN (-b - r) / 1.5 ELSE 0 END AS mv FROM ms2)"""


@query("model_based_dual_pol", sql([QUAD, C2, C2M, MODEL], "y, x", {"surface": "CASE WHEN s0 > mv THEN 10 * log10(s0 - mv) END", "volume": "CASE WHEN mv > 0 THEN 10 * log10(mv) END", "ratio": "CASE WHEN s0 > mv AND mv > 0 THEN 10 * log10(s0 - mv) - 10 * log10(mv) END",
    "alpha": "CASE WHEN s0 <> mv AND abs((s1 - mv / 2) / (s0 - mv)) <= 1 THEN degrees(acos((s1 - mv / 2) / (s0 - mv)) / 2) END", "delta": "degrees(atan2(c12_im, c12_re))", "rho": "sqrt(s23 / 4) / sqrt(c11 * c22)", "span": "s0"}, "ms3", digits=5))
def _(spark, d):
    return rounded(polarimetry_models.model_based(polarimetry.averaged(c2(spark, d), 2, "c", 5)), 5)


@query("compact_random_volume", sql([QUAD, C2, C2M, "sv AS (SELECT *, c11 + c22 AS g0, c11 - c22 AS g1, 2 * c12_re AS g2, 2 * c12_im AS g3 FROM cm)", "sm AS (SELECT *, sqrt(g1 * g1 + g2 * g2 + g3 * g3) / g0 AS m, atan2(sqrt(g1 * g1 + g2 * g2), g3) / 2 AS a FROM sv)"], "y, x", {"alpha": "a", "mv": "g0 * (1 - m) / 2", "ms": "2 * g0 * m", "phi": "atan2(g2, g1)", "double": "m * g0 * (1 - cos(2 * a)) / 2", "volume": "(1 - m) * g0", "surface": "m * g0 * (1 + cos(2 * a)) / 2"}, "sm"))
def _(spark, d):
    return rounded(polarimetry_models.random_volume(polarimetry.averaged(c2(spark, d), 2, "c", 5)))


_own = {"11": "(t11 + t22 + t33) / 2", "22": "(t11 + t22 - t33) / 2", "33": "(t11 - t22 + t33) / 2", "44": "(t22 + t33 - t11) / 2", "12": "t12_re", "13": "t13_re", "14": "t23_im", "23": "t23_re", "24": "(t13_im + t23_im) / 2", "34": "-t12_im"}
_weigh = lambda a, x, y: f"{1 if a[0] == a[1] else 2} * ({x}) * ({y})"
_volume = {"11": "(v11 + 2 * v22) / 2", "22": "v11 / 2", "33": "v11 / 2", "44": "(2 * v22 - v11) / 2", "12": "v12"}


def _distance(other: dict[str, str]) -> str:
    inner, size = " + ".join(_weigh(a, f"k{a}", v) for a, v in other.items()), " + ".join(_weigh(a, v, v) for a, v in other.items())
    return f"2 * acos(greatest(-1, least(1, ({inner}) / (nk * sqrt({size}))))) / pi()"


_targets = [_distance({a: str(x) for a, x in zip(("11", "22", "33", "44", "12"), t, strict=True)}) for t in polarimetry_models.TARGETS.values()]


@query("generalized_vegetation_index", sql([QUAD, K3, T3, T3M, f"ke AS (SELECT y, x, {', '.join(f'{v} AS k{a}' for a, v in _own.items())}, ((t11 + t22) / 2 + t12_re) / ((t11 + t22) / 2 - t12_re) AS g FROM t3m)",
    f"kn AS (SELECT *, sqrt({' + '.join(_weigh(a, f'k{a}', f'k{a}') for a in _own)}) AS nk, 1 / (1.5 * (1 + g) - 0.5 * sqrt(g)) AS r FROM ke)", "kv AS (SELECT *, r * ((1 + g) / 2 + sqrt(g) / 3) AS v11, r * ((1 + g) / 2 - sqrt(g) / 3) AS v22, r * (g - 1) / 2 AS v12 FROM kn)",
    f"gd AS (SELECT y, x, {_distance(_volume)} AS gd, least({', '.join(_targets)}) AS lo, greatest({', '.join(_targets)}) AS hi FROM kv)"], "y, x", {"vegetation": "(1 - gd) * pow((lo / hi) * (lo / hi), gd)"}, "gd", digits=6))
def _(spark, d):
    return rounded(polarimetry_models.generalized_vegetation(polarimetry.averaged(t3(spark, d), 3, "t", 5)), 6)


for _name, _filter in {"refined_lee": matrix_filters.refined_lee, "lee_sigma": matrix_filters.lee_sigma, "idan": matrix_filters.idan, "non_local": matrix_filters.non_local}.items():
    query(f"matrix_{_name}")(lambda spark, d, f=_filter: rounded(f(t3(spark, d), 3, "t"), 5))
    query(f"matrix_{_name}_c2")(lambda spark, d, f=_filter: rounded(f(c2(spark, d), 2, "c"), 5))
query("dual_pol_zones")(lambda spark, d: polarimetry.h_alpha_zones(polarimetry.averaged(c2(spark, d), 2, "c", 5), 2, "c"))


@query("dual_pol_wishart")
def _(spark, d):
    m = polarimetry.averaged(c2(spark, d), 2, "c", 5)
    return polarimetry.wishart(m, polarimetry.h_alpha_zones(m, 2, "c"), n=2, name="c")


@query("freeman_wishart")
def _(spark, d):
    m, c = polarimetry.averaged(t3(spark, d), 3, "t", 5), polarimetry.averaged(c3(spark, d), 3, "c", 5)
    return polarimetry.scattering_wishart(m, polarimetry.freeman_durden(c))


@query("general_wishart")
def _(spark, d):
    m = polarimetry.averaged(t3(spark, d), 3, "t", 5)
    return polarimetry.scattering_wishart(m, polarimetry.mf3cf(m))


query("h_alpha_zones")(lambda spark, d: polarimetry.h_alpha_zones(polarimetry.averaged(t3(spark, d), 3, "t", 5)))


@query("channel_parameters", sql([QUAD, C3], "y, x", {"span": "2 * (c11 + c33 + c22)", "rfdi": "(c11 - c22 / 2) / (c11 + c22 / 2)", "csi": "c33 / (c11 + c33)", "vsi": "c22 / 2 / (c22 / 2 + (c11 + c33) / 2)", "bmi": "(c11 + c33) / 2", "hhvv_ratio": "c11 / c33", "hvhh_ratio": "c22 / 2 / c11", "coherence": "sqrt(c13_re ** 2 + c13_im ** 2) / sqrt(c11 * c33)", "phase": "atan2(c13_im, c13_re)"}, "c3"))
def _(spark, d):
    return rounded(polarimetry.channel_parameters(c3(spark, d)))


@query("matrix_boxcar", sql([QUAD, C2, f"m AS ({window('avg(b.c11) AS c11, avg(b.c22) AS c22, avg(b.c12_re) AS c12_re, avg(b.c12_im) AS c12_im', 3, source='c2')})"], "y, x", {k: k for k in ("c11", "c12_re", "c12_im", "c22")}, "m"))
def _(spark, d):
    return rounded(polarimetry.averaged(c2(spark, d), 2, "c", 3))


@query("stokes", sql([QUAD, C2, STOKES], "y, x", {"g0": "g0", "g1": "g1", "g2": "g2", "g3": "g3", "m": "pol / g0", "linear": "sqrt(g1 ** 2 + g2 ** 2) / g0", "cpr": "(g0 - g3) / (g0 + g3)", "lpr": "(g0 - g1) / (g0 + g1)", "delta": "atan2(round(g3, 9) + 0.0, round(g2, 9) + 0.0)", "chi": "CASE WHEN pol > 0 THEN asin(greatest(-1, least(1, -g3 / pol))) / 2 ELSE 0 END", "psi": "atan2(round(g2, 9) + 0.0, g1) / 2"}, "st"))
def _(spark, d):
    return rounded(polarimetry.stokes(c2(spark, d)).withColumn("delta", atan2(F.round("g3", 9) + F.lit(0.0), F.round("g2", 9) + F.lit(0.0))).withColumn("psi", atan2(F.round("g2", 9) + F.lit(0.0), F.col("g1")) / 2))


@query("compact_m_delta", sql([QUAD, C2, STOKES], "y, x", {"a": "sqrt(greatest(pol * (1 - sin(atan2(g3, g2))) / 2, 0))", "b": "sqrt(greatest(pol * (1 + sin(atan2(g3, g2))) / 2, 0))", "random": "sqrt(greatest((1 - pol / g0) * g0, 0))"}, "st", digits=4))
def _(spark, d):
    return rounded(polarimetry.compact(c2(spark, d), "m_delta"), 4)


query("compact_m_chi")(lambda spark, d: rounded(polarimetry.compact(c2(spark, d), "m_chi"), 4))
query("compact_m_alpha")(lambda spark, d: rounded(polarimetry.compact(c2(spark, d), "m_alpha"), 4))
query("compact_h_alpha")(lambda spark, d: rounded(polarimetry.h_a_alpha(polarimetry.averaged(c2(spark, d), 2, "c", 5), 2, "c"), 5))
query("compact_mf3cc")(lambda spark, d: rounded(polarimetry.mf3cc(c2(spark, d)), 5))
query("compact_simulation")(lambda spark, d: rounded(polarimetry.simulate_compact(views.quad(spark, d))))
query("compact_vegetation_index")(lambda spark, d: rounded(polarimetry.compact_vegetation(polarimetry.averaged(c2(spark, d), 2, "c", 5)), 6))


@query("dual_pol_ratio_indices", sql([QUAD, C2], "y, x", {"rfdi": "CASE WHEN c11 + c22 > 0 AND c11 > 0 THEN (c11 - c22) / (c11 + c22) END", "cross_ratio": "CASE WHEN c11 > 0 THEN c22 / c11 END", "cross_ratio_db": "CASE WHEN c11 > 0 AND c22 > 0 THEN 10 * log10(c22 / c11) END", "span": "c11 + c22"}, "c2"))
def _(spark, d):
    return rounded(polarimetry.ratio_indices(c2(spark, d)))


@query("radar_vegetation_index", sql([QUAD, C2, f"m AS ({window('avg(b.c11) AS c11, avg(b.c22) AS c22, avg(b.c12_re) AS re, avg(b.c12_im) AS im', 5, source='c2')})", "r AS (SELECT *, c11 + c22 AS s FROM m)"], "y, x", {"rvi": "1 - sqrt(greatest(1 - 4 * (c11 * c22 - re * re - im * im) / (s * s), 0)) * (s + sqrt((c11 - c22) ** 2 + 4 * (re * re + im * im))) / 2 / s"}, "r"))
def _(spark, d):
    return rounded(polarimetry.radar_vegetation(polarimetry.averaged(c2(spark, d), 2, "c", 5)))


for _name, (_a, _b) in polarimetry.VOLUMES.items():
    _fv = f"least(c22 / {_b!r}, greatest(c11, 0) / {_a!r})"
    query(f"dual_pol_y3_{_name}", sql([QUAD, C2, f"v AS (SELECT *, {_fv} AS fv FROM c2)", f"r AS (SELECT *, greatest(c11 - fv * {_a!r}, 0) + greatest(c22 - fv * {_b!r}, 0) AS rest FROM v)"], "y, x", {"surface": "CASE WHEN c12_re >= 0 THEN rest ELSE 0 END", "double": "CASE WHEN c12_re < 0 THEN rest ELSE 0 END", "volume": f"fv * {_a + _b!r}"}, "r"))(lambda spark, d, k=_name: rounded(polarimetry.y3(c2(spark, d), k)))


@query("builtup_index", sql([QUAD, C2, STOKES, "q AS (SELECT quantile_cont(abs(g1), [0.05, 0.95]) AS q1, quantile_cont(abs(g2), [0.05, 0.95]) AS q2, quantile_cont(abs(g3), [0.05, 0.95]) AS q3 FROM st)"], "y, x", {"builtup": "sqrt((" + " + ".join(f"(least(greatest(abs(g{k}), q{k}[1]), q{k}[2]) / q{k}[2]) ** 2" for k in (1, 2, 3)) + ") / 3)"}, "st, q"))
def _(spark, d):
    return rounded(polarimetry.builtup_index(c2(spark, d)))


@query("surface_index", sql([QUAD, C2, f"m AS ({window('avg(b.c11) AS c11, avg(b.c22) AS c22, avg(b.c12_re) AS re, avg(b.c12_im) AS im', 5, source='c2')})", "e AS (SELECT *, (c11 + c22 + sqrt((c11 - c22) ** 2 + 4 * (re * re + im * im))) / 2 / (c11 + c22) AS p FROM m)",
  "q AS (SELECT quantile_cont(abs(c11 - c22), [0.05, 0.95]) AS q FROM m)", "g AS (SELECT y, x, c11, p, sqrt(greatest(1 - (least(greatest(abs(c11 - c22), q[1]), q[2]) / q[2]) ** 2, 0)) AS g FROM e, q)"], "y, x", {"surface_index": "CASE WHEN 10 * log10(c11) > -5 THEN (1 + p * log2(greatest(p, 1e-15)) + (1 - p) * log2(greatest(1 - p, 1e-15))) * g ELSE g END"}, "g"))
def _(spark, d):
    return rounded(polarimetry.surface_index(polarimetry.averaged(c2(spark, d), 2, "c", 5), nesz=-5.0))


@query("polarimetric_change")
def _(spark, d):
    a = polarimetry.averaged(c2(spark, d), 2, "c", 5)
    b = a.withColumns({"c11": F.col("c11") * (1 + F.col("x") % 3), "c22": F.col("c22") * (1 + F.col("x") % 3)})
    return rounded(polarimetry.change_test(a, b, 5.0), 5)


@query("h_alpha_wishart")
def _(spark, d):
    t = polarimetry.averaged(t3(spark, d), 3, "t", 5)
    return polarimetry.wishart(t, polarimetry.h_alpha_zones(t))


@query("supervised_wishart")
def _(spark, d):
    centres = {1: np.diag([4.0, 1.0, 0.5]).astype(complex), 2: np.diag([1.0, 4.0, 0.5]).astype(complex), 3: np.diag([1.0, 1.0, 2.0]).astype(complex)}
    return polarimetry.supervised_wishart(t3(spark, d), centres, 5)


query("cameron")(lambda spark, d: rounded(polarimetry.cameron(views.quad(spark, d)), 4))

DPX = "dp AS (SELECT event_id // 100 AS y, event_id % 100 AS x, value AS g0, user_id / 1601.0 AS rbi, (event_id % 97) / 97.0 AS rsi, (event_id % 89) / 89.0 AS dop FROM events)"


def dp(spark, d):
    e = views.read(spark, d, "events")
    return e.select(F.expr("event_id div 100").alias("y"), (F.col("event_id") % 100).alias("x"), F.col("value").alias("g0"), (F.col("user_id") / 1601.0).alias("rbi"), (F.col("event_id") % 97 / 97.0).alias("rsi"), (F.col("event_id") % 89 / 89.0).alias("dop"))


@query("dual_pol_decomposition", sql([DPX, "a AS (SELECT *, atan2(rbi, 1 - rbi) + atan2(1 - rsi, rsi) AS an FROM dp)"], "y, x", {"surface": "dop * g0 / 2 * (1 + cos(an))", "double": "dop * g0 / 2 * (1 - cos(an))", "rest": "(1 - dop) * g0"}, "a"))
def _(spark, d):
    return rounded(polarimetry.dual_pol_powers(dp(spark, d)))


@query("dual_pol_factorization", sql([DPX, "a AS (SELECT *, CASE WHEN rsi > rbi THEN g0 * rsi ELSE g0 * (1 - rbi) * rsi END AS ps, CASE WHEN rsi > rbi THEN g0 * (1 - rsi) * rbi ELSE g0 * rbi END AS pd FROM dp)"], "y, x", {"surface": "ps", "double": "pd", "rest": "g0 - ps - pd"}, "a"))
def _(spark, d):
    return rounded(polarimetry.dual_pol_powers(dp(spark, d), factorised=True))


# --- the same in SQL for queries above that have closed forms --------------------------------

ORACLE_SQL["srgr_cubic"] = sql([SCENE, "g AS (SELECT DISTINCT y FROM scene)", "t AS (SELECT y, unnest(range(0, 120)) AS x FROM g)", "u AS (SELECT y, x, CAST(floor(0.5 + 0.8 * x) AS BIGINT) AS s, 0.5 + 0.8 * x - floor(0.5 + 0.8 * x) AS t FROM t)"], "u.y, u.x", {"v": "a.v * (-0.5 * t ** 3 + t * t - 0.5 * t) + b.v * (1.5 * t ** 3 - 2.5 * t * t + 1) + c.v * (-1.5 * t ** 3 + 2 * t * t + 0.5 * t) + d.v * (0.5 * t ** 3 - 0.5 * t * t)"}, "u JOIN scene a ON a.y = u.y AND a.x = s - 1 JOIN scene b ON b.y = u.y AND b.x = s JOIN scene c ON c.y = u.y AND c.x = s + 1 JOIN scene d ON d.y = u.y AND d.x = s + 2")
_k4 = {"1": ("(hh_i + vv_i)", "(hh_q + vv_q)"), "2": ("(hh_i - vv_i)", "(hh_q - vv_q)"), "3": ("(hv_i + vh_i)", "(hv_q + vh_q)"), "4": ("(vh_q - hv_q)", "(hv_i - vh_i)")}
_t4 = {}
for _i in "1234":
    (_a, _b), _t4[f"t{_i}{_i}"] = _k4[_i], ""
    _t4[f"t{_i}{_i}"] = f"({_a} * {_a} + {_b} * {_b}) / 2"
    for _j in "1234":
        if _j > _i:
            _c, _d = _k4[_j]
            _t4[f"t{_i}{_j}_re"], _t4[f"t{_i}{_j}_im"] = f"({_a} * {_c} + {_b} * {_d}) / 2", f"({_b} * {_c} - {_a} * {_d}) / 2"
ORACLE_SQL["matrix_t4"] = sql([QUAD], "y, x", _t4, "quad")
ORACLE_SQL["krogager"] = sql([QUAD, "d AS (SELECT *, (hh_i - vv_i) / 2 AS di, (hh_q - vv_q) / 2 AS dq, (hv_i + vh_i) / 2 AS ci, (hv_q + vh_q) / 2 AS cq FROM quad)", "r AS (SELECT *, sqrt((di - cq) ** 2 + (dq + ci) ** 2) AS rr, sqrt((di + cq) ** 2 + (dq - ci) ** 2) AS ll FROM d)"], "y, x", {"sphere": "sqrt((hh_i + vv_i) ** 2 + (hh_q + vv_q) ** 2) / 2", "diplane": "least(rr, ll)", "helix": "abs(rr - ll)"}, "r")
ORACLE_SQL["orientation_angle"] = sql([QUAD, K3, T3, "o AS (SELECT *, (atan2(2 * t23_re, t33 - t22) + pi()) / 4 AS a FROM t3)", "p AS (SELECT *, CASE WHEN a > pi() / 4 THEN a - pi() / 2 ELSE a END AS th FROM o)", "w AS (SELECT *, cos(2 * th) AS c, sin(2 * th) AS s FROM p)"], "y, x", {"theta": "degrees(th)", "t11": "t11", "t12_re": "t12_re * c + t13_re * s", "t12_im": "t12_im * c + t13_im * s", "t13_re": "t13_re * c - t12_re * s", "t13_im": "t13_im * c - t12_im * s", "t22": "t22 * c * c + t33 * s * s + 2 * t23_re * s * c", "t23_re": "t23_re * (c * c - s * s) + (t33 - t22) * s * c", "t23_im": "t23_im", "t33": "t22 * s * s + t33 * c * c - 2 * t23_re * s * c"}, "w")
ORACLE_SQL["snr_correction"] = sql([QUAD, "z AS (SELECT *, hv_i * vh_i + hv_q * vh_q AS re, hv_q * vh_i - hv_i * vh_q AS im, hv_i ** 2 + hv_q ** 2 AS pa, vh_i ** 2 + vh_q ** 2 AS pb FROM quad)", f"m AS ({window('any_value(a.hv_i) AS hv_i, any_value(a.hv_q) AS hv_q, any_value(a.vh_i) AS vh_i, any_value(a.vh_q) AS vh_q, sum(b.re) AS re, sum(b.im) AS im, sum(b.pa) AS pa, sum(b.pb) AS pb', 5, source='z')})", "g AS (SELECT *, CASE WHEN pa * pb > 0 THEN sqrt(re * re + im * im) / sqrt(pa * pb) ELSE 0 END AS g FROM m)"], "y, x", {f"{p}_{e}": f"{p}_{e} * g" for p in ("hv", "vh") for e in "iq"}, "g")
_turn = lambda e: {
    f"hh_{e}": f"hh_{e} * c * c + (vh_{e} - hv_{e}) * n * c - vv_{e} * n * n", f"hv_{e}": f"hv_{e} * c * c + vh_{e} * n * n + (hh_{e} + vv_{e}) * n * c",
    f"vh_{e}": f"vh_{e} * c * c + hv_{e} * n * n - (hh_{e} + vv_{e}) * n * c", f"vv_{e}": f"vv_{e} * c * c + (vh_{e} - hv_{e}) * n * c - hh_{e} * n * n",
}
_eight = ", ".join(f"any_value(a.{p}_{e}) AS {p}_{e}" for p in ("hh", "hv", "vh", "vv") for e in "iq")
ORACLE_SQL["faraday_rotation"] = sql([QUAD, "l AS (SELECT *, hv_i - vh_i - hh_q - vv_q AS ar, hv_q - vh_q + hh_i + vv_i AS ai, vh_i - hv_i - hh_q - vv_q AS br, vh_q - hv_q + hh_i + vv_i AS bi FROM quad)", "z AS (SELECT *, ar * br + ai * bi AS re, ai * br - ar * bi AS im FROM l)", f"m AS ({window(_eight + ', sum(b.re) AS re, sum(b.im) AS im', 5, source='z')})", "w AS (SELECT *, -atan2(im, re) / 4 AS omega, cos(-atan2(im, re) / 4) AS c, sin(-atan2(im, re) / 4) AS n FROM m)"], "y, x", {"omega": "omega", **_turn("i"), **_turn("q")}, "w", digits=6)
_parts = {"a": "sqrt(greatest((pol + g3) / 2, 0))", "b": "sqrt(greatest((pol - g3) / 2, 0))", "random": "sqrt(greatest(g0 - pol, 0))"}
ORACLE_SQL["compact_m_chi"] = ORACLE_SQL["compact_m_alpha"] = sql([QUAD, C2, STOKES], "y, x", _parts, "st", digits=4)
ORACLE_SQL["compact_mf3cc"] = sql([QUAD, C2, STOKES, "u AS (SELECT *, atan(pol * g3 / ((g0 * g0 - g3 * g3) / 4 + pol * pol)) AS t FROM st)"], "y, x", {"surface": "pol / 2 * (1 + sin(2 * t))", "double": "pol / 2 * (1 - sin(2 * t))", "volume": "g0 - pol"}, "u", digits=5)
ORACLE_SQL["compact_simulation"] = sql([QUAD, "r AS (SELECT y, x, hh_i + (hv_q + vh_q) / 2 AS ai, hh_q - (hv_i + vh_i) / 2 AS aq, (hv_i + vh_i) / 2 + vv_q AS bi, (hv_q + vh_q) / 2 - vv_i AS bq FROM quad)"], "y, x", {"c11": "(ai * ai + aq * aq) / 2", "c12_re": "(ai * bi + aq * bq) / 2", "c12_im": "(aq * bi - ai * bq) / 2", "c22": "(bi * bi + bq * bq) / 2"}, "r")
ORACLE_SQL["compact_vegetation_index"] = sql([QUAD, C2, C2M, "v AS (SELECT y, x, c11 + c22 AS g0, c11 - c22 AS g1, 2 * c12_re AS g2, 2 * c12_im AS g3 FROM cm)", "w AS (SELECT *, 3 / pi() * acos(least(g0 / sqrt(g0 * g0 + g1 * g1 + g2 * g2 + g3 * g3), 1)) AS l FROM v)"], "y, x", {"vegetation": "(1 - l) * pow((g0 - abs(g3)) / (g0 + abs(g3)), 2 * l)"}, "w", digits=6)
ORACLE_SQL["compact_h_alpha"] = sql([QUAD, C2, C2M, "e AS (SELECT *, (c11 + c22 + sqrt((c11 - c22) ** 2 + 4 * (c12_re ** 2 + c12_im ** 2))) / 2 AS l1, (c11 + c22 - sqrt((c11 - c22) ** 2 + 4 * (c12_re ** 2 + c12_im ** 2))) / 2 AS l2 FROM cm)", "p AS (SELECT *, l1 / (l1 + l2) AS p, degrees(acos(least(sqrt(greatest((l1 - c22) / (l1 - l2), 0)), 1))) AS a FROM e)"], "y, x", {"entropy": "-(p * log2(p) + (1 - p) * log2(1 - p))", "anisotropy": "2 * p - 1", "alpha": "p * a + (1 - p) * (90 - a)", "lambda1": "l1", "lambda2": "l2"}, "p", digits=5)
ORACLE_SQL["polarimetric_change"] = f"WITH {QUAD}, {C2}, {C2M}, f AS (SELECT *, 1 + x % 3 AS k FROM cm), d AS (SELECT *, c11 * c22 - c12_re ** 2 - c12_im ** 2 AS da, k * k * c11 * c22 - c12_re ** 2 - c12_im ** 2 AS db, (1 + k) ** 2 / 4.0 * c11 * c22 - c12_re ** 2 - c12_im ** 2 AS dm FROM f), t AS (SELECT y, x, greatest(-10 * (ln(greatest(da, 1e-15)) + ln(greatest(db, 1e-15)) - 2 * ln(greatest(dm, 1e-15))), 0) AS t FROM d) SELECT y, x, round(t, 5) + 0.0 AS statistic, round(1 - exp(-t / 2) * (1 + t / 2), 5) + 0.0 AS probability, 1 - exp(-t / 2) * (1 + t / 2) >= 0.99 AS changed FROM t"
ORACLE_SQL["cameron"] = sql([QUAD, K3, "c AS (SELECT *, atan2(2 * (bi * ci + bq * cq), bi ** 2 + bq ** 2 - ci ** 2 - cq ** 2) / 2 AS chi FROM k3)", "s AS (SELECT *, ai ** 2 + aq ** 2 AS pa, (bi * cos(chi) + ci * sin(chi)) ** 2 + (bq * cos(chi) + cq * sin(chi)) ** 2 AS ps, ai ** 2 + aq ** 2 + bi ** 2 + bq ** 2 + ci ** 2 + cq ** 2 AS p FROM c)"], "y, x", {"tau": "acos(least(CASE WHEN p > 0 THEN sqrt(pa + ps) / sqrt(p) ELSE 0 END, 1))", "psi": "-chi / 2"}, "s", digits=4)


# --- geometry ---------------------------------------------------------------------------

SENSOR = geometry.Sensor(0.0, 0.0148, 761_577.0, 31.0)


def orbit(spark, east=-300_000.0):
    """A straight pass to the north, west of 45 N 7 E."""
    g = geometry.ecef(np.array([45.0]), np.array([7.0]), np.array([0.0]))[0]
    up = g / np.linalg.norm(g)
    east_ = np.array([-math.sin(math.radians(7)), math.cos(math.radians(7)), 0.0])
    north = np.cross(up, east_)
    rows = [(float(t), *(float(v) for v in g + 700_000 * up + east * east_ + 7500 * t * north)) for t in range(-10, 31)]
    return spark.createDataFrame(rows, "t double, px double, py double, pz double")


def terrain(spark, d):
    return views.scene(spark, d).select("y", "x", (45 + F.col("y") * 0.001).alias("lat"), (7 + F.col("x") * 0.001).alias("lon"), F.col("v").alias("h"))


query("terrain_correction")(lambda spark, d: rounded(geometry.terrain_correction(terrain(spark, d), views.scene(spark, d), orbit(spark), SENSOR).select("y", "x", "line", "sample", "v"), 3))
query("ellipsoid_correction")(lambda spark, d: rounded(geometry.ellipsoid_correction(terrain(spark, d), views.scene(spark, d), orbit(spark), SENSOR).select("y", "x", "line", "sample", "v"), 3))
query("dem_coregistration")(lambda spark, d: rounded(geometry.coregister(terrain(spark, d), views.scene(spark, d), orbit(spark), orbit(spark, -300_200.0), SENSOR, SENSOR).select("y", "x", "dy", "dx", "v"), 3))
query("back_geocoding")(lambda spark, d: rounded(coregistration.back_geocode(terrain(spark, d), views.scene_cplx(spark, d), orbit(spark), orbit(spark, -300_200.0), SENSOR, SENSOR, 1500.0, 15.0, 0.05), 3))
query("geocoded_slc")(lambda spark, d: rounded(coregistration.geocoded_slc(terrain(spark, d), views.scene_cplx(spark, d), orbit(spark), SENSOR, 0.0555).select("y", "x", "line", "sample", "i", "q"), 2))
query("simulation_terrain_correction")(lambda spark, d: rounded(coregistration.simulation_correction(terrain(spark, d), views.scene(spark, d), orbit(spark), SENSOR, 8700.0, 8).select("y", "x", "line", "sample", "v"), 3))
query("azimuth_spectrum")(lambda spark, d: rounded(coregistration.azimuth_spectrum(views.scene_cplx(spark, d), 1700.0), 3))


@query("range_shift", sql([CPLX], "y, x", {"i": "i", "q": "q"}, "cplx", digits=5))
def _(spark, d):
    """A whole sample there and, as two halves, back: the scene again."""
    z = views.scene_cplx(spark, d)
    moved = coregistration.fractional_shift(z, 1.0)
    return rounded(coregistration.fractional_shift(coregistration.fractional_shift(moved, -0.5), -0.5), 5)


@query("azimuth_shift", sql([CPLX, "n AS (SELECT max(y) + 1 AS n FROM cplx)"], "(y + n - 1) % n AS y, x", {"i": "i", "q": "q"}, "cplx, n", digits=5))
def _(spark, d):
    return rounded(coregistration.azimuth_shift(views.scene_cplx(spark, d), 1.0), 5)


@query("warp_resampling", sql([CPLX], "a.y, a.x", {"i": "b.i", "q": "b.q"}, "cplx a LEFT JOIN cplx b ON b.y = a.y + 2 AND b.x = a.x - 1", digits=5))
def _(spark, d):
    return rounded(coregistration.warp(views.scene_cplx(spark, d), [2.0, 1.0], [-1.0, 0.0, 1.0]), 5)


@query("cubic_terrain_correction")
def _(spark, d):
    return rounded(geometry.terrain_correction(terrain(spark, d), views.scene(spark, d), orbit(spark), SENSOR, "cubic").select("y", "x", "line", "sample", "v"), 3)


@query("block_shifts")
def _(spark, d):
    z = views.scene_cplx(spark, d)
    return rounded(coregistration.block_shifts(z, coregistration.fractional_shift(z, 0.4), 10), 4)


@query("tie_point_geocoding", sql([SCENE], "y, x", {"line": "y + 0.0", "sample": "x + 0.0", "v": "v"}, "scene", digits=4))
def _(spark, d):
    s = views.scene(spark, d)
    lines = max(1, extent(s, "y") // 100 + 1)
    place = lambda y, x: (45 + 0.001 * y + 0.0002 * x, 7 - 0.0003 * y + 0.0012 * x)
    ties = spark.createDataFrame([(float(y), float(x), *place(y, x)) for y in range(0, 100 * lines + 1, 20 * lines) for x in range(0, 101, 20)], "line double, pixel double, lat double, lon double")
    lat, lon = place(F.col("y"), F.col("x"))
    return rounded(coregistration.tie_point_geocoding(s.select("y", "x", lat.alias("lat"), lon.alias("lon")), s, ties).select("y", "x", "line", "sample", "v"), 4)


query("sar_simulation")(lambda spark, d: rounded(geometry.simulate(terrain(spark, d), orbit(spark), SENSOR, 8700.0), 3))
query("terrain_flattening")(lambda spark, d: rounded(geometry.terrain_flattening(views.scene(spark, d), terrain(spark, d), orbit(spark), SENSOR, 8700.0, 8700.0), 3))
query("update_geo_reference")(lambda spark, d: rounded(geometry.geo_reference(terrain(spark, d), orbit(spark), SENSOR), 6))


@query("deskew", f"WITH {SCENE} SELECT y + CAST(floor(0.5 + 0.03 * x + 0.5) AS BIGINT) AS y, x, v FROM scene")
def _(spark, d):
    return geometry.deskew(views.scene(spark, d), (0.5, 0.03))


@query("deburst_scan", sql([SCENE, "l AS (SELECT y AS line, x, v, CASE WHEN y % 3 = 2 THEN y - 1.9 ELSE y * 1.0 END AS t FROM scene)"], "CAST(floor(t / 0.5 + 0.5) AS BIGINT) AS y, x", {"v": "avg(v)"}, "l WHERE v <> 0", "GROUP BY 1, 2"))
def _(spark, d):
    s = views.scene(spark, d)
    times = s.select(F.col("y").alias("line")).distinct().withColumn("t", F.when(F.col("line") % 3 == 2, F.col("line") - 1.9).otherwise(F.col("line") * 1.0))
    return rounded(geometry.deburst_scan(s.withColumnRenamed("y", "line"), times, 0.5))


@query("bsq_encode")
def _(spark, d):
    tiles = formats.encode_bsq(views.scene(spark, d), ["v"], 64)
    return tiles.select("ty", "tx", F.length("content").alias("bytes"), F.crc32("content").alias("crc"))


@query("topo_phase_removal", sql([CPLX, "f AS (SELECT *, 4 * pi() / 0.0555 * (y * 0.001 - x * 0.0007) AS p FROM cplx)"], "y, x", {"i": "i * cos(p) - q * sin(p)", "q": "i * sin(p) + q * cos(p)"}, "f"))
def _(spark, d):
    z = views.scene_cplx(spark, d)
    located = z.select("y", "x", (F.col("y") * 0.001).alias("range1"), (F.col("x") * 0.0007).alias("range2"))
    return rounded(insar.topo_phase_removal(z, located, 0.0555))


@query("cross_resample", f"WITH {SCENE}, p AS (SELECT y, x, CAST(floor(1.3 + 0.99 * y + 0.5) AS BIGINT) AS sy, CAST(floor(-2.2 + 1.01 * x + 0.5) AS BIGINT) AS sx FROM scene) SELECT p.y, p.x, v FROM p JOIN scene ON scene.y = sy AND scene.x = sx")
def _(spark, d):
    return insar.cross_resample(views.scene(spark, d), [1.3, 0.99, 0.0], [-2.2, 0.0, 1.01])


@query("unwrapping_export", sql([CPLX, PHASES], "cplx.y, cplx.x", {"phase": "atan2(round(q, 9) + 0.0, i)", "coherence": "coherence"}, "cplx JOIN ph ON cplx.y = ph.y AND cplx.x = ph.x"))
def _(spark, d):
    return rounded(insar.unwrapping_export(views.scene_cplx(spark, d).withColumn("q", F.round("q", 9) + F.lit(0.0)), phases(spark, d)))


@query("unwrapping_import", sql([PHASES], "y, x, user_turns AS turns", {"wrapped": "phase", "unwrapped": "phase + 2 * pi() * user_turns"}, "(SELECT *, CAST(x % 5 - 2 AS BIGINT) AS user_turns FROM ph)"))
def _(spark, d):
    p = phases(spark, d)
    return rounded(insar.unwrapping_import(p, p.withColumn("phase", F.col("phase") + 2 * math.pi * (F.col("x") % 5 - 2))))


@query("ionosphere_smoothing", sql([SCENE], "a.y, a.x", {"v": "sum(b.v * (1 + b.x % 3) * exp(-((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / 2.0)) / sum((1 + b.x % 3) * exp(-((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / 2.0))"}, "scene a JOIN scene b ON abs(a.y - b.y) <= 3 AND abs(a.x - b.x) <= 3", "GROUP BY a.y, a.x"))
def _(spark, d):
    return rounded(insar.smooth_gaussian(views.scene(spark, d).withColumn("w", 1.0 + F.col("x") % 3), 1.0))


@query("soil_moisture", sql([SCENE, "r AS (SELECT y, x, 3 + v / 10 AS rdc, 30 + x * 0.3 AS sand, 20 + y % 10 AS clay FROM scene)", "k AS (SELECT *, 2.0 + 0.01 * sand + 0.005 * clay - rdc AS a, 10 + 0.1 * sand + 0.05 * clay AS b, 60 - 0.1 * sand + 0.02 * clay AS c FROM r)", "m AS (SELECT *, (-b + sqrt(greatest(b * b - 4 * a * c, 0))) / (2 * c) AS m FROM k)"], "y, x, CASE WHEN m BETWEEN 0 AND 0.55 AND b * b - 4 * a * c >= 0 THEN 0 ELSE 3 END AS quality", {"moisture": "CASE WHEN m BETWEEN 0 AND 0.55 AND b * b - 4 * a * c >= 0 THEN m END"}, "m"))
def _(spark, d):
    s = views.scene(spark, d).select("y", "x", (3 + F.col("v") / 10).alias("rdc"), (30 + F.col("x") * 0.3).alias("sand"), (20 + F.col("y") % 10).cast("double").alias("clay"))
    return rounded(calibration.soil_moisture(s, [2.0, 0.01, 0.005, 10, 0.1, 0.05, 60, -0.1, 0.02]))


@query("antenna_phase", sql([CPLX, "f AS (SELECT *, CAST(floor((30 + x * 0.0131371 + y * 0.001 * 2) * 100 + 0.5) AS BIGINT) AS an FROM cplx)", "g AS (SELECT *, CASE WHEN an BETWEEN 2900 AND 3099 THEN -(an * 0.0007) ELSE 0 END AS p FROM f)"], "y, x", {"i": "i * cos(p) - q * sin(p)", "q": "i * sin(p) + q * cos(p)"}, "g"))
def _(spark, d):
    table = spark.createDataFrame([(k, k * 0.0007) for k in range(2900, 3100)], "angle long, phase double")
    return rounded(topsar.antenna_phase(views.scene_cplx(spark, d).withColumn("elevation", 30 + F.col("x") * 0.0131371), table, 0.001, 2.0))


@query("timing_correction", f"WITH {SCENE}, p AS (SELECT y, x, y + CAST(floor(y * 0.002 / 0.01 + 0.5) AS BIGINT) AS sy, x + CAST(floor(x * 0.003 / 0.07 + 0.5) AS BIGINT) AS sx FROM scene) SELECT p.y, p.x, v FROM p JOIN scene ON scene.y = sy AND scene.x = sx")
def _(spark, d):
    s = views.scene(spark, d)
    layers = s.select("y", "x", (F.col("y") * 0.002).alias("azimuth"), (F.col("x") * 0.003).alias("range"))
    return topsar.timing_correction(s, layers, 0.01, 0.07)


@query("graph_of_operators", sql([SCENE, "m AS (SELECT y // 2 AS y, x // 2 AS x, avg(v) AS v FROM scene GROUP BY 1, 2 HAVING count(*) = 4)"], "y, x", {"v": "avg(v) OVER (PARTITION BY y, x)"}, "m", "WHERE x >= 10 AND x < 30 AND y < 100"))
def _(spark, d):
    steps = chain(lambda df: raster.multilook(df, 2, 2), lambda df: raster.subset(df, 0, 100, 10, 30), rounded)
    return steps(views.scene(spark, d))


# --- streams ----------------------------------------------------------------------------

query("stream_multilook", ORACLE_SQL["multilook"])(streams.multilook)
