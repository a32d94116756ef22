"""The course of an order: what its tickets and stickers, in order, lead to.

Observations are rows order, frame, kind, item; frames are distinct within an order. Kinds:
`ticket` (an expected item), `sticker` (an item is seen), `gone` (an item leaves the tray).
`advance` takes one observation of an order; the batch form walks through sorted orders with
it, and streaming/order_state.py keeps its state between batches, so both give the same events.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


@dataclass
class Course:
    """Of an order: for each item how often it is ordered, lies on the tray, and was seen while the order was completed."""

    items: dict[str | None, list[int]] = field(default_factory=dict)
    ready: bool = False
    done: bool = False
    reading: bool = False  # the last row that counted was a ticket


def advance(course: Course, frame: int, kind: str, item: str | None) -> list[tuple]:
    """Events frame, status, item of one observation."""
    if course.done and kind != "ticket":
        # No event now, but a ticket that opens the order again finds what lies there.
        held = course.items.setdefault(item, [0, 0, 0])
        held[2] = held[2] + 1 if kind == "sticker" else max(held[2] - 1, 0)
        return []
    out = []
    if kind == "ticket":
        if not course.reading:
            out.append((frame, "TICKET_READY", None))
        course.ready, course.done, course.reading = True, False, True
        own = course.items.setdefault(item, [0, 0, 0])
        own[0] += 1
        if own[2] and own[1] < own[0]:
            own[1:] = own[1] + 1, own[2] - 1
            out.append((frame, "ITEM_CHECKED", item))
        return out
    course.reading = False
    own = course.items.setdefault(item, [0, 0, 0])
    if kind != "sticker" and own[2]:
        own[2] -= 1
    elif kind != "sticker":
        own[1] -= own[1] > own[0]
    else:
        out.append((frame, "ITEM_CHECKED" if own[1] < own[0] else "WRONG_ITEM_DETECTED", item))
        own[1] += 1
    for name, v in course.items.items():
        out += [(frame, "WRONG_ITEM_DETECTED", name)] * v[2]
        v[1:] = v[1] + v[2], 0
    if course.ready and all(there == ordered for ordered, there, _ in course.items.values()):
        out.append((frame, "TRAY_COMPLETED", None))
        course.done = True
    return out


def status_events(seen: DataFrame) -> DataFrame:
    """order, frame, status, item: TICKET_READY at the first ticket and at each that comes after other rows; ITEM_CHECKED
    or WRONG_ITEM_DETECTED for each sticker, by what its item has left; TRAY_COMPLETED once all is checked and no wrong
    item is on the tray. After that only a ticket counts, which opens the order again; stickers seen in between are
    checked with it, or are wrong at the next row if it doesn't name them."""
    types = T.StructType([seen.schema["order"], seen.schema["frame"], T.StructField("status", T.StringType()), T.StructField("item", T.StringType())])
    arrow = to_arrow_schema(types)

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, course = None, Course()
        for batch in batches:
            out = []
            for order, *row in zip(*(batch.column(c).to_pylist() for c in ("order", "frame", "kind", "item")), strict=True):
                if order != now:
                    now, course = order, Course()
                out += [(order, *e) for e in advance(course, *row)]
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in out], f.type) for k, f in enumerate(arrow)], schema=arrow)

    rows = seen.select("order", "frame", "kind", F.col("item").cast("string").alias("item"))
    return rows.repartition("order").sortWithinPartitions("order", "frame").mapInArrow(walked, types)
