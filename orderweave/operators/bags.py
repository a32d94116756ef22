"""Bags of items for each order: rows key..., item, n. Every operation is one grouping, which combines before its shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counted(rows: DataFrame, keys: list[str], item: str = "item", n: Column | None = None) -> DataFrame:
    return rows.groupBy(*keys, item).agg(F.sum(n if n is not None else F.lit(1)).cast("long").alias("n"))


def compared(left: DataFrame, right: DataFrame, keys: list[str], item: str = "item") -> DataFrame:
    """Rows key..., item, n_left, n_right: both bags in one grouping, so neither is joined."""
    sides = left.select(*keys, item, F.col("n").alias("l"), F.lit(0).cast("long").alias("r")).union(right.select(*keys, item, F.lit(0).cast("long"), F.col("n")))
    return sides.groupBy(*keys, item).agg(F.sum("l").alias("n_left"), F.sum("r").alias("n_right"))


def minus(left: DataFrame, right: DataFrame, keys: list[str], item: str = "item") -> DataFrame:
    """What is left of a bag; never below nothing."""
    both = compared(left, right, keys, item).where("n_left > n_right")
    return both.select(*keys, item, (F.col("n_left") - F.col("n_right")).alias("n"))


def plus(left: DataFrame, right: DataFrame, keys: list[str], item: str = "item") -> DataFrame:
    return compared(left, right, keys, item).select(*keys, item, (F.col("n_left") + F.col("n_right")).alias("n"))


def retracted(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Single rows: each row of gone takes away one equal row."""
    return rows.exceptAll(gone)


def expanded(items: DataFrame, menu: DataFrame, item: str = "item") -> DataFrame:
    """An item that the menu has becomes its parts, each as often; others stay. menu: pos, name, sub_items; of a name listed twice the last counts.

    The menu is a dimension; whether it is broadcast is left to its measured size.
    """
    last = menu.groupBy("name").agg(F.max_by("sub_items", "pos").alias("sub_items"))
    joined = items.join(last, F.col(item) == F.col("name"), "left").drop("name")
    return joined.withColumn(item, F.explode(F.coalesce("sub_items", F.array(item)))).drop("sub_items")


def verified(expected: DataFrame, checked: DataFrame, wrong: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each order: totals, distinct items, remaining, surplus, wrong items and the status that follows."""
    none = F.lit(0).cast("long")
    rows = expected.select(*keys, "item", F.col("n").alias("e"), none.alias("c"), none.alias("w"))
    rows = rows.union(checked.select(*keys, "item", none, "n", none)).union(wrong.select(*keys, "item", none, none, "n"))
    by_item = rows.groupBy(*keys, "item").agg(F.sum("e").alias("e"), F.sum("c").alias("c"), F.sum("w").alias("w"))
    totals = by_item.groupBy(*keys).agg(
        F.sum("e").alias("expected"),
        F.count(F.when(F.col("e") > 0, 1)).alias("expected_items"),
        F.sum("c").alias("checked"),
        F.sum(F.greatest(F.col("e") - F.col("c"), none)).alias("remaining"),
        F.sum(F.greatest(F.col("c") - F.col("e"), none)).alias("surplus"),
        F.sum("w").alias("wrong"),
    )
    done = (F.col("remaining") == 0) & (F.col("surplus") == 0)
    return totals.withColumn("status", F.when(F.col("expected") == 0, "WAITING_TICKET").when(done & (F.col("wrong") == 0), "COMPLETED").when(done, "BLOCKED").otherwise("WAITING_STICKERS"))
