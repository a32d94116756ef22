"""The whole course of an order: what is read and what leaves, from the first sight of its tray to its record.

Observations: order, frame, at (seconds), kind, ref, number, items; several of a frame stand in the order of `seq`. Kinds:

    seen            the tray, or in single mode the ticket, came into view
    ticket          ticket `ref` was read: its order number and its items, one entry for each piece
    ticket_gone     ticket `ref` left the view for good
    sticker         sticker `ref` was read as items[0], or as nothing (no items)
    known           thing `ref` is known by sight as items[0]: surplus ones are wrong even once all is checked
    sticker_gone    sticker `ref` left the view for good
    tick            time went on
    reset           by command: the order begins anew at its place
    gone            the tray, or in single mode the ticket, left

Events: order, frame, status, items (item, n), number. Of a later ticket with another number, or none, nothing is taken; one
with the same number adds its items, also to a completed order, and takes them back when it leaves. A sticker that no
item is left for is wrong, which is said again every `HEARTBEAT` seconds until it leaves; meanwhile the order isn't
completed. What can't be read is read again. `gone` writes the record: RECORD, with items (what was expected), checked, and started (the frame of the first sight).
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from orderweave.operators.interim import spread, values

HEARTBEAT = 1.5
OUT = "order long, frame long, status string, items array<struct<item:string,n:long>>, number string, checked array<struct<item:string,n:long>>, started long"
_COLUMNS = ("frame", "at", "kind", "ref", "number", "items")


@dataclass
class Course:
    """An order's state; counts are of items, `checked` and `wrong` by sticker."""

    state: str = "NONE"
    number: str | None = None
    expected: dict[str, int] = field(default_factory=dict)
    tickets: dict[str, dict[str, int]] = field(default_factory=dict)
    checked: dict[str, int] = field(default_factory=dict)
    known: list[str] = field(default_factory=list)  # stickers that are checked
    wrong: dict[str, list] = field(default_factory=dict)  # sticker: item, when it was said last
    started: int | None = None

    def begin(self, state: str) -> None:
        started = self.started if state != "NONE" else None
        for name, value in vars(Course(state, started=started)).items():
            setattr(self, name, value)

    def left(self, item: str) -> int:
        return self.expected.get(item, 0) - self.checked.get(item, 0)

    def completed(self) -> bool:
        return self.state == "WAITING_STICKERS" and not self.wrong and bool(self.expected) and sum(self.checked.values()) == sum(self.expected.values())


def _listed(counts: dict[str, int]) -> list[dict]:
    return [{"item": i, "n": n} for i, n in counts.items() if n]


def _added(counts: dict[str, int], more: dict[str, int], sign: int = 1) -> dict[str, int]:
    both = {i: counts.get(i, 0) + sign * more.get(i, 0) for i in [*counts, *(i for i in more if i not in counts)]}
    return {i: n for i, n in both.items() if n > 0}


def advance(c: Course, frame: int, at: float, kind: str, ref: int | None, number: str | None, items: list[str] | None) -> list[tuple]:
    """Events status, items, number, checked, started of one observation."""
    return [(status, _listed(bag), num, None if checked is None else _listed(checked), started) for status, bag, num, checked, started in _events(c, frame, at, kind, ref, number, items)]


def _events(c: Course, frame: int, at: float, kind: str, ref: int | None, number: str | None, items: list[str] | None) -> list[tuple]:
    """The same with counts for lists; some are the course's own, so they are to be read before it goes on."""
    out: list[tuple] = []
    if kind == "reset" or kind == "gone":
        if kind == "gone" and c.state != "NONE":
            out += [("RECORD", c.expected, c.number, c.checked, c.started), ("TRAY_REMOVED", {}, c.number, None, None)]
        if kind == "reset":
            out += [("TRAY_RESET", {}, None, None, None), ("WAITING_TICKET", {}, None, None, None)]
        c.begin("WAITING_TICKET" if kind == "reset" else "NONE")
        return out
    if kind == "seen" and c.state == "NONE":
        c.state, c.started = "WAITING_TICKET", frame
        return [("NEW_TRAY_DETECTED", {}, None, None, None)]
    if c.state == "NONE":  # a late result of an order that has left
        return out
    key, items = str(ref), [i for i in items if i is not None] if items else []
    if kind == "ticket" and items and c.state == "WAITING_TICKET":
        c.tickets[key] = dict(Counter(items))
        c.expected, c.number, c.state = dict(c.tickets[key]), number or "000", "WAITING_STICKERS"
        out.append(("TICKET_READY", c.expected, c.number, None, None))
    elif kind == "ticket" and c.state != "WAITING_TICKET" and key not in c.tickets and number is not None and number == c.number:
        c.tickets[key] = dict(Counter(items))
        c.expected, c.state = _added(c.expected, c.tickets[key]), "WAITING_STICKERS"
        out.append(("TICKET_READY", c.expected, c.number, None, None))
    elif kind == "ticket_gone" and len(c.tickets) > 1 and key in c.tickets:
        c.expected = _added(c.expected, c.tickets.pop(key), -1)
        out.append(("TICKET_READY", c.expected, c.number, None, None))
    elif kind in ("sticker", "known") and items and c.state == "WAITING_STICKERS" and key not in c.known:
        item = items[0]
        if c.left(item) > 0:
            c.wrong.pop(key, None)
            c.known.append(key)
            c.checked[item] = c.checked.get(item, 0) + 1
            out.append(("ITEM_CHECKED", c.checked, c.number, None, None))
        elif kind == "known" or sum(c.checked.values()) < sum(c.expected.values()):
            c.wrong[key] = [item, at]
            out.append(("WRONG_ITEM_DETECTED", {item: 1}, c.number, None, None))
    elif kind == "sticker_gone":
        c.wrong.pop(key, None)
    for said in c.wrong.values():
        if at - said[1] >= HEARTBEAT:
            said[1] = at
            out.append(("WRONG_ITEM_DETECTED", {said[0]: 1}, c.number, None, None))
    if c.completed():
        c.state = "COMPLETED"
        out.append(("TRAY_COMPLETED", c.checked, c.number, None, None))
    return out


def order_events(seen: DataFrame) -> DataFrame:
    """Events of all orders: each order's observations are walked through in order."""
    types = T.StructType.fromDDL(OUT)
    arrow = to_arrow_schema(types)

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, course = None, Course()
        for batch in batches:
            plain, bags, records = [], _Bags(), _Bags()
            for order, frame, *row in zip(*(values(batch[c]) for c in ("order", *_COLUMNS)), strict=True):
                if order != now:
                    now, course = order, Course()
                for status, bag, number, checked, started in _events(course, frame, *row):
                    plain.append((order, frame, status, number, started))
                    bags.add(bag)
                    records.add(checked)
            columns = dict(zip(("order", "frame", "status", "number", "started"), zip(*plain, strict=True) if plain else [()] * 5, strict=True))
            made = {"items": bags.array(), "checked": records.array()}
            yield pa.RecordBatch.from_arrays([made[f.name].cast(f.type) if f.name in made else pa.array(columns[f.name], f.type) for f in arrow], schema=arrow)

    return spread(_rows(seen), "order").sortWithinPartitions("order", "frame", "seq").mapInArrow(walked, types)


class _Bags:
    """A column of bags, filled without an object for each entry."""

    def __init__(self):
        self.items, self.n, self.ends, self.missing = [], [], [0], []

    def add(self, bag: dict[str, int] | None) -> None:
        if bag:
            self.items += bag
            self.n += bag.values()
        self.ends.append(len(self.items))
        self.missing.append(bag is None)

    def array(self) -> pa.Array:
        entries = pa.StructArray.from_arrays([pa.array(self.items, pa.string()), pa.array(self.n, pa.int64())], ["item", "n"])
        return pa.ListArray.from_arrays(pa.array(self.ends, pa.int32()), entries, mask=pa.array(self.missing, pa.bool_()))


def stream_order_events(seen: DataFrame) -> DataFrame:
    """The same over a stream; within a batch rows are put in order, batches follow each other."""
    names = [c.split(" ")[0] for c in OUT.split(", ")]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        course = Course(**json.loads(state.get[0])) if state.exists else Course()
        rows = pd.concat(list(batches)).sort_values(["frame", "seq"])
        out = []
        for frame, at, kind, ref, number, items in rows[list(_COLUMNS)].itertuples(index=False, name=None):
            ref = None if pd.isna(ref) else int(ref)
            out += [(key[0], frame, *e) for e in advance(course, frame, at, kind, ref, number, None if items is None else list(items))]
        if course != Course():
            state.update((json.dumps(asdict(course)),))
        elif state.exists:  # the order has left: nothing is kept of it
            state.remove()
        yield pd.DataFrame(out, columns=names).astype({"started": "Int64"})

    return _rows(seen).groupBy("order").applyInPandasWithState(run, OUT, "course string", "append", GroupStateTimeout.NoTimeout)


def _rows(seen: DataFrame) -> DataFrame:
    return seen.select(*(F.col(c).cast(t).alias(c) for c, t in (("order", "long"), ("frame", "long"), ("seq", "long"), ("at", "double"), ("kind", "string"), ("ref", "long"), ("number", "string"), ("items", "array<string>"))))


def final_states(events: DataFrame) -> DataFrame:
    """order, status (that of the order's last change), events, wrong (how often something wrong was said)."""
    told = ["NEW_TRAY_DETECTED", "TICKET_READY", "TRAY_COMPLETED", "TRAY_REMOVED", "TRAY_RESET"]
    rank = F.array_position(F.array(*map(F.lit, told)), F.col("status"))
    change = F.max_by("status", F.when(rank > 0, F.struct("frame", rank)))
    return events.groupBy("order").agg(change.alias("status"), F.count(F.lit(1)).alias("events"), F.count(F.when(F.col("status") == "WRONG_ITEM_DETECTED", 1)).alias("wrong"))


def record_lines(events: DataFrame) -> DataFrame:
    """order, number, start_frame, end_frame, expected, expected_count (distinct items), checked: a row for each time that an order left."""
    rows = events.where("status = 'RECORD'")
    return rows.select("order", "number", F.col("started").alias("start_frame"), F.col("frame").alias("end_frame"), F.col("items").alias("expected"), F.size("items").cast("long").alias("expected_count"), "checked")
