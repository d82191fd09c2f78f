"""Nearest places without a row for each pair, whatever the crowd of a cube."""

import random

import pytest
from pyspark.sql import functions as F

from shoal.operators import maintain as M


def peak(spark, since):
    """(largest memory of a task in bytes from a stage on, stages so far)"""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    seen = [stages.apply(k) for k in range(stages.size())]
    tasks = [store.taskList(s.stageId(), s.attemptId(), 100) for s in seen if s.stageId() >= since and s.status().toString() == "COMPLETE"]
    return max([t.apply(k).taskMetrics().get().peakExecutionMemory() for t in tasks for k in range(t.size())], default=0), max([s.stageId() for s in seen], default=-1) + 1


def test_no_task_sorts_pairs(spark):
    """250,000 points of one partition and 4,000 places: 6 million pairs."""
    k = F.col("id")
    points = spark.range(0, 250_000, 1, 1).select("id", (k * 37 % 1700 / 10 - 84.97).alias("lat"), (k * 53 % 3590 / 10 - 179.53).alias("lon"))
    gazetteer = spark.range(0, 4000, 1, 1).select(k.alias("gid"), F.lit("p").alias("city"), F.lit("").alias("state"), F.lit("X").alias("cc"), (k * 71 % 1700 / 10 - 85).alias("glat"), (k * 113 % 3590 / 10 - 179.5).alias("glon"))
    _, since = peak(spark, 0)
    assert M.nearest_place(points, gazetteer).count() == 250_000
    assert peak(spark, since)[0] < 250e6


@pytest.mark.parametrize("places", [1, 5, 1024])
def test_lists_of_a_crowd(spark, monkeypatch, places):
    """Most places and points in one cube, ties settled by the lesser id, lists cut anywhere."""
    for name, size in (("PLACES", places), ("SPREAD", 20), ("POINTS", 30)):
        monkeypatch.setattr(M, name, size, raising=False)
    random.seed(places)
    crowd = lambda: (48 + random.randint(0, 30) / 1000, 11 + random.randint(0, 30) / 1000)
    far = lambda: (random.uniform(-90, 90), random.uniform(-180, 180))
    rows = [(k, f"p{k}", "", "X", *(far() if k % 10 == 0 else crowd())) for k in range(150)] + [(900, "null", "", "", None, 3.0)]
    points = [(k, *(far() if k % 7 == 0 else crowd())) for k in range(90)]
    gaz = spark.createDataFrame(rows, "gid long, city string, state string, cc string, glat double, glon double")
    at = spark.createDataFrame(points, "id long, lat double, lon double")
    km = M.haversine(F.col("lat"), F.col("lon"), F.col("glat"), F.col("glon"))
    want = at.crossJoin(gaz.where("glat is not null")).groupBy("id").agg(F.min(F.struct(km.alias("km"), "gid")).alias("b")).select("id", F.concat(F.lit("p"), F.col("b.gid").cast("string"), F.lit(", X")).alias("place"), "b.km")
    assert sorted(map(tuple, M.nearest_place(at, gaz).collect())) == sorted(map(tuple, want.collect()))
