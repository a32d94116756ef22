"""The course of orders as a stream: state is kept for each order.

Orders are dealt to groups, and a group is what the stream calls its function for and keeps a row of state of: so a call, which
costs far more than an order's few rows, is made for many orders at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from orderweave.operators.verification import Course, advance

EVENTS = "order long, frame long, status string, item string"
#: For each order of a group its number of items and its marks (ready 1, done 2, reading 4); then the items of one order after another.
STATE = "orders array<long>, sizes array<int>, marks array<int>, items array<string>, ordered array<int>, there array<int>, held array<int>"
#: Groups that orders are dealt to. It stays the same as long as a stream's state is kept.
GROUPS = 1 << 14


def _loaded(orders, sizes, marks, items, *counts) -> dict[int | None, Course]:
    found, k = {}, 0
    for order, size, mark in zip(orders, sizes, marks, strict=True):
        own = {items[i]: [int(c[i]) for c in counts] for i in range(k, k + size)}
        found[order], k = Course(own, bool(mark & 1), bool(mark & 2), bool(mark & 4)), k + size
    return found


def _packed(courses: dict[int | None, Course]) -> tuple:
    values = [(x, v) for c in courses.values() for x, v in c.items.items()]
    marks = [c.ready + 2 * c.done + 4 * c.reading for c in courses.values()]
    return (list(courses), [len(c.items) for c in courses.values()], marks, [x for x, _ in values], *([v[k] for _, v in values] for k in range(3)))


def _whole(values: pd.Series) -> list[int | None]:
    """Numbers, which pandas holds as fractions where some are null."""
    return [None if v != v else int(v) for v in values.tolist()] if values.dtype.kind == "f" else [None if v is None else int(v) for v in values.tolist()]


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Rows of one group of orders: state holds their courses."""
    courses = _loaded(*state.get) if state.exists else {}
    rows = pd.concat(list(batches)).sort_values(["order", "frame"], kind="stable")
    out = []
    for order, *row in zip(_whole(rows["order"]), _whole(rows["frame"]), rows["kind"].tolist(), rows["item"].tolist(), strict=True):
        course = courses.get(order)
        if course is None:
            course = courses[order] = Course()
        out += [(order, *e) for e in advance(course, *row)]
    state.update(_packed(courses))
    numbers = lambda k: pd.array([x[k] for x in out], dtype="Int64")
    yield pd.DataFrame({"order": numbers(0), "frame": numbers(1), "status": [x[2] for x in out], "item": [x[3] for x in out]})


def status_events(seen: DataFrame, groups: int = GROUPS) -> DataFrame:
    """seen: a stream of order, frame, kind, item. Within a batch rows are put in order by frame; batches follow each other."""
    rows = seen.selectExpr("cast(order as long) as order", "cast(frame as long) as frame", "kind", "cast(item as string) as item")
    # Rows without an order are a group of their own, as a null makes fractions of all of a group's numbers.
    group = F.coalesce(F.when(F.col("order").isNotNull(), F.pmod(F.xxhash64("order"), F.lit(groups))), F.lit(-1))
    return rows.withColumn("_group", group.cast("long")).groupBy("_group").applyInPandasWithState(_advance, EVENTS, STATE, "append", GroupStateTimeout.NoTimeout)
