"""Blocks of a stream share their states: unfinished ones wait, whole ones are emitted once."""

from pyspark.sql import functions as F

from rasterloom.streaming import events


def test_unfinished_blocks_share_a_state(spark, tmp_path):
    px = spark.range(20 * 12).select(F.expr("id div 12").alias("y"), (F.col("id") % 12).alias("x"), (F.col("id") % 7 + 0.5).alias("v"))
    px.where("y < 11").coalesce(1).write.parquet(str(tmp_path / "in" / "a"))
    px.where("y >= 11").coalesce(1).write.parquet(str(tmp_path / "in" / "b"))
    source = spark.readStream.schema("y long, x long, v double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    run = events.whole_blocks(source, 2).writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    states = [p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress if p["stateOperators"]]
    assert max(states) == 1 and states[-1] == 0  # six unfinished blocks of line 10 in one state, then none
    got = {(r["y"], r["x"]): r["v"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r["y"], r["x"]): r["v"] for r in px.groupBy(F.expr("y div 2").alias("y"), F.expr("x div 2").alias("x")).agg(F.avg("v").alias("v")).collect()}
    assert got == want and spark.read.parquet(str(tmp_path / "out")).count() == 60
