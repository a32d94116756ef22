"""Tickets of large tables: their boxes are sorted and walked through once, and give what plain forms give."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from orderweave.functions import text as X
from orderweave.operators import runs, tickets
from orderweave.sources.tables import Tables

BOXES = "ticket long, pos int, cy double, h double, cx double, text string, inside boolean, number int, raw string, flipped boolean, theta double"


def test_boxes_are_not_grouped_into_lists(spark):
    rows = tickets.rows_of(tickets.read(Tables(spark, "/root/testdata/sf0.001").ticket_boxes))
    plan = rows._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[1]
    assert "ObjectHashAggregate" not in plan
    assert plan.count("Window [") == 3  # numbers of lines, skew, what a ticket says


def test_white_space_is_what_the_expression_for_it_says(spark):
    points = spark.range(1, 0x10000).where("id < 55296 or id > 57343").select(F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')").alias("c"))
    texts = points.select(F.concat("c", F.lit("a"), "c", F.lit("b "), "c").alias("t")).union(spark.createDataFrame([("",), (" 　",), ("\n a\r\n",), (None,)], "t string"))
    assert texts.where(~X.stripped("t").eqNullSafe(F.regexp_replace("t", r"(?U)^\s+|\s+$", ""))).count() == 0


def test_headers_are_found_as_by_splitting_and_folding_every_text(spark):
    r = random.Random(5)
    texts = ["".join(r.choices("ティクアウト数枚 a\t", k=r.randrange(0, 12))) for _ in range(600)] + ["a 数 b", "ティクアウト", "x ティクアウト y", "数量", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for header in ("ティクアウト", "数"):
        for least in (-1.0, 0.0, 60.0):
            plain = F.array_contains(F.split("t", r"\s+"), header) | (X.ratio_to(F.col("t"), header) > least)
            assert df.where(tickets._says(F.col("t"), header, least) != F.coalesce(plain, F.lit(False))).count() == 0
    ends = df.union(spark.createDataFrame([("No 123",), ("12a",), ("１２３",), ("0",)], "t string"))
    assert ends.where(X.order_number(F.col("t")).isNotNull() | X.only_digits(F.col("t"))).where(~X.ends_with_digit(X.stripped("t"))).count() == 0


def test_rows_of_text_in_small_batches_are_those_of_grouped_boxes(spark):
    r, rows = random.Random(8), []
    for t in range(60):
        turned = t % 3 == 0
        for _ in range(r.randrange(1, 14)):
            digit = r.choice((None, None, None, 3, 7))
            cy, h = r.choice((None, float("nan"), *[10.0 * r.randrange(6) + r.random() for _ in range(20)])), r.choice((None, 8.0, 12.0, 9.5, 20.0))
            rows.append((t, r.randrange(12), cy, h, r.choice((None, 1.0, 2.5, 40.0)), r.choice((None, "", "a", "bc", "数")), r.random() < 0.8, digit, digit and str(digit), turned, float(t)))
    boxes = spark.createDataFrame(rows, BOXES).repartition(3)
    digits = boxes.where("raw is not null").groupBy("ticket").agg(F.collect_list(F.struct("cy", "pos", "number", "raw")).alias("_d"))
    placed = runs.row_clusters(boxes.where("inside"), ["ticket"], ["pos"], "cy", "h", carry=["cx", "text"], whole=["theta", "flipped"])
    parts = F.array_sort(F.collect_list(F.struct(F.when(F.col("flipped"), -F.col("cx")).otherwise(F.col("cx")).alias("at"), "pos", "text")))
    want = placed.groupBy("ticket", "text_row").agg(parts.alias("_p"), F.avg("cy").alias("cy"), F.avg("h").alias("h"), F.max(F.struct(F.length("text"), -F.col("pos"))).alias("_l"), F.first("theta").alias("theta"))
    near = F.array_min(F.transform("_d", lambda d: F.struct(F.abs(d["cy"] - F.col("cy")).alias("away"), d["pos"].alias("pos"), d["number"].alias("number"), d["raw"].alias("raw"))))
    want = want.join(digits, "ticket", "left").select("ticket", "text_row", F.array_join("_p.text", "").alias("text"), F.round("cy", 6), F.round("h", 6), F.col("theta"), near["pos"].alias("p"), near["raw"].alias("raw"), F.round(near["away"], 6))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("3", before):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = tickets.rows_of(boxes, ["theta"]).select("ticket", "text_row", "text", F.round("cy", 6), F.round("h", 6), "theta", "near.pos", "near.raw", F.round("near.away", 6))
            assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want.collect())))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
