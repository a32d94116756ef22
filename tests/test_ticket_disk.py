"""Tickets of large tables take little disk: lines are dealt instead of the boxes made of them, sorts fit a task's memory, rows of text stay where they are."""

from __future__ import annotations

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orderweave.operators import interim, tickets
from orderweave.plans import catalogue
from orderweave.sources import tables
from orderweave.sources.tables import Tables

SF = "/root/testdata/sf0.001"
WHOLE = ["order_number", "count_at", "theta", "px", "py"]


@pytest.fixture
def large(spark):
    """Plans as for tables that are too large for a broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def rows(df) -> list[str]:
    return sorted(map(str, map(tuple, df.collect())))


def test_boxes_are_not_dealt(large):
    boxes, ways = Tables(large, SF).dealt_boxes()
    plan = tickets.rows_of(tickets.read(boxes), WHOLE, ways)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" in plan
    assert "Exchange" not in plan.split("Generate")[0]  # what is done with boxes stands above the step that makes them


def test_dealt_boxes_are_the_same(large):
    t = Tables(large, SF)
    boxes, ways = t.dealt_boxes()
    assert ways == interim.tasks(large) and rows(boxes) == rows(t.ticket_boxes) != []


def test_large_tables_go_to_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(tables, "LINES", 100)
    t = Tables(spark, SF)
    boxes, ways = t.dealt_boxes()
    assert ways == -(-t.lineitem.count() // 100) > interim.tasks(spark)
    monkeypatch.undo()
    assert rows(boxes) == rows(t.ticket_boxes)


def test_lines_are_those_of_all_columns_in_order(spark):
    t = Tables(spark, SF)
    again = t.lineitem.withColumn("l_linenumber", F.lit(1)).withColumn("l_partkey", F.col("l_partkey") % 3 + 1)  # many that are alike
    t.lineitem = again.union(again.withColumn("l_tax", F.col("l_tax") + 1))
    every = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus")
    want = t.lineitem.withColumn("line", F.row_number().over(W.partitionBy("l_orderkey").orderBy(*every)) - 1).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    assert rows(t.ticket_lines.select("ticket", "line", "name", "quantity")) == rows(want.select("l_orderkey", "line", "p_name", F.col("l_quantity").cast("int")))


def test_rows_of_text_stay_where_they_are(large, monkeypatch):
    few = catalogue.QUERIES["ticket_parse"](large, SF)
    assert "BroadcastHashJoin [text" in few._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(tickets, "FEW_TEXTS", 0)
    many = catalogue.QUERIES["ticket_parse"](large, SF)
    assert "BroadcastHashJoin [text" not in many._jdf.queryExecution().executedPlan().toString()
    assert rows(few) == rows(many) != []


def test_filed_rows_are_the_same_and_shared(spark):
    df = spark.range(20).select("id", F.struct(F.when(F.col("id") % 2 == 0, F.lit(7)).alias("a")).alias("s"), F.when(F.col("id") % 3 == 0, F.lit("x")).alias("t"))
    kept = interim.filed(df)
    assert rows(kept) == rows(df) and kept.schema.simpleString() == df.schema.simpleString()
    assert all(spark.sparkContext.getCheckpointDir().removeprefix("file:") in f for f in kept.inputFiles())
