"""Tickets within an area, of large tables: a box is made and measured once, however often its corners are asked for."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from orderweave.functions import geometry as G
from orderweave.operators import interim
from orderweave.operators import tracking as K
from orderweave.plans import tracks
from orderweave.sources.tables import Tables


def test_corners_are_not_computed_again_for_each_edge(spark):
    made = spark.range(4).select((F.col("id") * 0).alias("session"), F.lit(0).alias("frame"), F.col("id").alias("det"), F.lit("order_ticket").alias("cls"), F.array(*((F.col("id") + k).cast("double") * 12345.0 for k in (0, 0, 2, 0, 2, 2, 0, 2))).alias("quad"))
    kept = K.tickets_by_place(made, [-1.0, -1.0, 30000.0, -1.0, 30000.0, 30000.0, -1.0, 30000.0], True)
    assert [r.det for r in kept.collect()] == [0, 1]
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert 8 <= plan.count("12345.0") <= 32  # once for the filter, once for the rows


def test_held_centres_are_those_of_the_plain_form(spark):
    r = random.Random(4)
    quads = [[r.uniform(0, 60) + v for v in (0, 0, 30, r.uniform(-5, 5), 33, 25, -2, 22)] for _ in range(200)] + [None, [None] * 8, [float("nan")] * 8]
    rows = spark.createDataFrame([(k, q) for k, q in enumerate(quads)], "k int, q array<double>").repartition(3).cache()
    area = F.array(*map(F.lit, (10.0, 10.0, 60.0, 12.0, 62.0, 55.0, 8.0, 50.0)))
    c = G.centroid(F.col("q"))
    got = rows.select(G.contains_centre(area, F.col("q")).alias("a"), G.contains(area, c["x"], c["y"]).alias("b"))
    assert got.where("not (a <=> b)").count() == 0 and 20 < got.where("a").count() < 180


def test_sessions_are_dealt_to_many_tasks_though_their_rows_are_few_bytes(spark):
    assert tracks.tracked_in_area(Tables(spark, "/root/testdata/sf0.001")).rdd.getNumPartitions() == interim.tasks(spark)
