"""Ordered state of tracked things: runs, streaks and folds over frames.

What depends on the neighbour alone is a window; what carries state along is a fold over
the sorted rows of one thing, which stay in the JVM. A thing's life is bounded by how long
it is in view, so its rows fit a fold.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def runs(rows: DataFrame, key: list[str], order: list[str], same: Column, name: str = "run") -> DataFrame:
    """With the number of the run of each row (from 0, within its key) and how many rows of the run came before it.

    same: whether a row goes on with the run of the row before, over `prev(column)`.
    """
    w = W.partitionBy(*key).orderBy(*order)
    new = F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)
    numbered = rows.withColumn("_new", new).withColumn(name, F.sum("_new").over(w) - 1)
    return numbered.withColumn(f"{name}_pos", F.row_number().over(W.partitionBy(*key, name).orderBy(*order)) - 1).drop("_new")


def prev(column: str, key: list[str], order: list[str]) -> Column:
    return F.lag(column).over(W.partitionBy(*key).orderBy(*order))


def promoted(rows: DataFrame, k: int, name: str = "run") -> DataFrame:
    """The row with which a run reaches k sightings."""
    return rows.where(F.col(f"{name}_pos") == k - 1)


def departures(rows: DataFrame, key: list[str], order: str, gap: Column, most: Column) -> DataFrame:
    """Stretches of presence: a key is gone once it isn't seen for longer than `most`."""
    w = W.partitionBy(*key).orderBy(order)
    cut = rows.withColumn("_gap", gap).withColumn("visit", F.sum(F.when(F.col("_gap") <= most, 0).otherwise(1)).over(w) - 1)
    return cut.groupBy(*key, "visit").agg(F.min(order).alias("first_seen"), F.max(order).alias("last_seen"), F.count(F.lit(1)).alias("sightings"))


def folded(rows: DataFrame, key: list[str], order: list[str], values: list[str], start: Column, step: Callable[[Column, Column], Column], finish: Callable[[Column], Column] | None = None) -> DataFrame:
    """For each key a fold of its rows in order: step(state, row) -> state."""
    sorted_rows = F.array_sort(F.collect_list(F.struct(*order, *values)))
    return rows.groupBy(*key).agg(sorted_rows.alias("_rows")).select(*key, F.aggregate("_rows", start, step, finish).alias("state"))


def throttled(rows: DataFrame, key: list[str], at: str, interval: float) -> DataFrame:
    """Of each key's rows those that come at least `interval` seconds after the last one that was let through; `at`: seconds, in order.

    After a gap of the interval a row is always let through, whatever was before, so the rows are cut there first, and a fold
    sees only those between two gaps.
    """
    w = W.partitionBy(*key).orderBy(at)
    cut = rows.select(*key, at).withColumn("_new", F.when(F.col(at) - F.lag(at).over(w) < interval, 0).otherwise(1)).withColumn("_cut", F.sum("_new").over(w))
    times = cut.groupBy(*key, "_cut").agg(F.array_sort(F.collect_list(at)).alias("_at"))

    def step(state, time):
        due = state["last"].isNull() | (time - state["last"] >= interval)
        return F.struct(F.when(due, time).otherwise(state["last"]).alias("last"), F.concat(state["let"], F.when(due, F.array(time)).otherwise(F.array().cast("array<double>"))).alias("let"))

    start = F.struct(F.lit(None).cast("double").alias("last"), F.array().cast("array<double>").alias("let"))
    return times.select(*key, F.explode(F.aggregate("_at", start, step)["let"]).alias(at))


def first_near(share: float) -> Callable[[float | None, float | None], int]:
    """A function that takes places and heights of boxes one after another, in order, and says to which row of text each belongs."""
    rows: list[list] = []  # boxes, sum of places, sum of heights

    def of(a: float | None, h: float | None) -> int:
        if a is None or h is None:
            rows.append([1, float("inf"), 0.0])  # near nothing
            return len(rows) - 1
        for k, row in enumerate(rows):
            n, x, y = row
            if abs(a - x / n) < share * y / n:
                row[0], row[1], row[2] = n + 1, x + a, y + h
                return k
        rows.append([1, a, h])
        return len(rows) - 1

    return of


def _row_numbers(share: float):
    """For each list of places and heights, which go in order, the row of text that each belongs to."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def run(at: pa.Array, height: pa.Array) -> pa.Array:
        ends, of = at.offsets.to_pylist(), []
        at, height = at.values.to_pylist(), height.values.to_pylist()
        for lo, hi in zip(ends, ends[1:], strict=False):
            of.extend(map(first_near(share), at[lo:hi], height[lo:hi]))
        return pa.ListArray.from_arrays(pa.array([e - ends[0] for e in ends], pa.int32()), pa.array(of, pa.int32()))

    return run


def row_clusters(rows: DataFrame, key: list[str], order: list[str], at: str, height: str, share: float = 0.5, carry: list[str] | None = None, whole: list[str] | None = None) -> DataFrame:
    """Puts each box, in order, into the first row of text whose mean place is nearer than a share of the row's mean height; else begins a new row.

    The key is a ticket or a frame, which holds a few hundred boxes at most. carry: further columns of the result; whole: those that are the same over all of a key.
    """
    carry, whole = carry or [], whole or []
    sorted_rows = F.array_sort(F.collect_list(F.struct(*order, F.col(at).cast("double").alias(at), F.col(height).cast("double").alias(height), *carry)))
    grouped = rows.groupBy(*key).agg(sorted_rows.alias("_rows"), *(F.first(c).alias(c) for c in whole))
    grouped = grouped.withColumn("_of", _row_numbers(share)(F.col("_rows")[at], F.col("_rows")[height]))
    pairs = grouped.select(*key, *whole, F.explode(F.arrays_zip("_rows", "_of")).alias("_p"))
    return pairs.select(*key, *whole, *(F.col("_p._rows")[c].alias(c) for c in [*order, at, height, *carry]), F.col("_p._of").alias("text_row"))
