"""Joins with frequent keys, and staged tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from linewright.llm import common


def test_spread_join(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    left = spark.range(2000).select("id", F.when(F.col("id") % 3 > 0, F.lit(1)).otherwise(F.col("id")).alias("k"), F.when(F.col("id") % 5 > 0, "x").alias("l"))
    right = spark.range(0, 2000, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")).union(spark.createDataFrame([(1, -1)], "k long, v long"))
    for how in ("inner", "left"):
        for options in ({}, {"counts": left.groupBy("k").agg(F.count("*").alias("n"))}):
            found = sorted(map(str, common.spread_join(left, right, ["k"], how, share=20, **options).collect()))
            assert found == sorted(map(str, left.join(right, ["k"], how).collect())) and len(found) > 1000
    assert common.spread_join(left.limit(0), right, ["k"]).count() == 0


def test_staged_tables_go(spark):
    kept = common.staged(spark.range(5).toDF("id"), "five")
    assert kept.count() == 5 and common.remove_staged(spark) >= 1 and not common._STAGED
