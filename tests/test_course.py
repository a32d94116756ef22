"""The course of orders against scenes made by hand, and a stream's batches against the batch form."""

from __future__ import annotations

import json
import os
import random

from orderweave.operators import course as C
from orderweave.operators.course import Course, advance
from orderweave.sources import tables
from orderweave.streaming import runner

SCHEMA = "order long, frame long, seq long, at double, kind string, ref long, number string, items array<string>"


def played(*steps):
    """steps: at, kind, ref, number, items. Status and items of the events."""
    c = Course()
    return [(s, {x["item"]: x["n"] for x in items}) for step in steps for s, items, *_ in advance(c, 0, *step)]


def ticket(at, ref, number, *items):
    return at, "ticket", ref, number, list(items)


def sticker(at, ref, *items, kind="sticker"):
    return at, kind, ref, None, list(items)


def simple(at, kind, ref=None):
    return at, kind, ref, None, None


SEEN = simple(0.0, "seen")


def test_from_sight_to_record():
    got = played(SEEN, ticket(1.0, 1, "123", "a", "a", "b"), sticker(2.0, 1, "a"), sticker(3.0, 2, "b"), sticker(3.5, 2, "b"), sticker(4.0, 3, "a"), simple(5.0, "gone"))
    assert got == [
        ("NEW_TRAY_DETECTED", {}), ("TICKET_READY", {"a": 2, "b": 1}), ("ITEM_CHECKED", {"a": 1}), ("ITEM_CHECKED", {"a": 1, "b": 1}), ("ITEM_CHECKED", {"a": 2, "b": 1}),
        ("TRAY_COMPLETED", {"a": 2, "b": 1}), ("RECORD", {"a": 2, "b": 1}), ("TRAY_REMOVED", {}),
    ]


def test_what_cannot_be_read_changes_nothing():
    assert played(SEEN, ticket(1.0, 1, None), ticket(2.0, 1, None, "a"), sticker(3.0, 1), sticker(4.0, 1, "a")) == [("NEW_TRAY_DETECTED", {}), ("TICKET_READY", {"a": 1}), ("ITEM_CHECKED", {"a": 1}), ("TRAY_COMPLETED", {"a": 1})]


def test_a_wrong_item_is_said_again_and_blocks():
    got = played(SEEN, ticket(1.0, 1, "123", "a"), sticker(2.0, 7, "x"), simple(3.0, "tick"), simple(3.5, "tick"), sticker(4.0, 1, "a"), simple(5.0, "tick"), simple(5.2, "sticker_gone", 7), simple(9.0, "tick"))
    wrong = ("WRONG_ITEM_DETECTED", {"x": 1})
    assert got[2:] == [wrong, wrong, ("ITEM_CHECKED", {"a": 1}), wrong, ("TRAY_COMPLETED", {"a": 1})]


def test_surplus_once_all_is_checked():
    base = (SEEN, ticket(1.0, 1, "123", "a", "b"), sticker(2.0, 7, "x"), sticker(3.0, 1, "a"), sticker(3.1, 2, "b"))
    assert [s for s, _ in played(*base, sticker(3.2, 3, "c"))][-1] == "ITEM_CHECKED"  # nothing is left, so it isn't judged
    assert [s for s, _ in played(*base, sticker(3.2, 3, "c", kind="known"))][-1] == "WRONG_ITEM_DETECTED"


def test_more_tickets():
    got = played(SEEN, ticket(1.0, 1, "123", "a"), sticker(2.0, 1, "a"), ticket(3.0, 2, "124", "b"), ticket(3.5, 3, None, "b"), ticket(4.0, 4, "123", "b"), ticket(4.5, 4, "123", "b"), simple(5.0, "ticket_gone", 4), simple(6.0, "ticket_gone", 1))
    assert got[3:] == [("TRAY_COMPLETED", {"a": 1}), ("TICKET_READY", {"a": 1, "b": 1}), ("TICKET_READY", {"a": 1}), ("TRAY_COMPLETED", {"a": 1})]


def test_reset_and_late_results():
    got = played(ticket(0.0, 1, "123", "a"), SEEN, ticket(1.0, 1, "123", "a"), simple(2.0, "reset"), sticker(3.0, 1, "a"), ticket(4.0, 1, "125", "b"), simple(5.0, "gone"), sticker(6.0, 1, "b"))
    assert [s for s, _ in got] == ["NEW_TRAY_DETECTED", "TICKET_READY", "TRAY_RESET", "WAITING_TICKET", "TICKET_READY", "RECORD", "TRAY_REMOVED"]


def test_stream_gives_the_same_events(spark, tmp_path):
    rng, rows = random.Random(6), []
    for order in range(12):
        for frame in range(40):
            kind = rng.choice(["tick", "sticker", "sticker", "known", "sticker_gone", "ticket", "ticket_gone"] + ["gone", "reset"] * (rng.random() < 0.1))
            kind = "seen" if frame == 0 or rng.random() < 0.03 else kind
            items = rng.choices("abcx", k=rng.randint(0, 3)) if kind in ("ticket", "sticker", "known") else None
            rows.append((order, frame, 0, frame * 0.4, kind, rng.randint(1, 4), rng.choice(["123", "123", "9", None]), items))
    whole = sorted(map(repr, C.order_events(spark.createDataFrame(rows, SCHEMA)).collect()))
    names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
    for k in range(4):
        (tmp_path / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(names, r, strict=True))) for r in rows if r[1] // 10 == k))
        os.utime(tmp_path / f"{k}.json", (1e9 + k, 1e9 + k))
    got = runner.finished(C.stream_order_events(tables.replay(spark, str(tmp_path), SCHEMA)))
    assert sorted(map(repr, got.collect())) == whole and len(whole) > 100
    events = spark.createDataFrame(rows, SCHEMA).transform(C.order_events)
    assert C.record_lines(events).count() == events.where("status = 'RECORD'").count()


def test_nothing_is_kept_of_an_order_that_left(spark, tmp_path):
    names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
    rows = [(1, 0, 0, 0.0, "seen", None, None, None), (2, 0, 0, 0.0, "seen", None, None, None), (1, 1, 0, 1.0, "gone", None, None, None)]
    for k in range(2):
        (tmp_path / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(names, r, strict=True))) for r in rows if r[1] == k))
        os.utime(tmp_path / f"{k}.json", (1e9 + k, 1e9 + k))
    stream = C.stream_order_events(tables.replay(spark, str(tmp_path), SCHEMA)).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    stream.awaitTermination()
    assert [p.stateOperators[0].numRowsTotal for p in stream.recentProgress if p.stateOperators][:2] == [2, 1]


def test_a_record_has_both_bags_and_its_frames(spark):
    rows = [(1, 3, 0, 0.0, "seen", None, None, None), (1, 5, 0, 1.0, "ticket", 1, "7", ["a", "a", "b"]), (1, 6, 0, 2.0, "reset", None, None, None), (1, 7, 0, 3.0, "ticket", 1, "8", ["a", "a", "b"]), (1, 8, 0, 4.0, "sticker", 1, None, ["a"]), (1, 9, 0, 5.0, "gone", None, None, None)]
    (r,) = C.record_lines(C.order_events(spark.createDataFrame(rows, SCHEMA))).collect()
    bag = lambda b: {x["item"]: x["n"] for x in b}
    assert (r["number"], r["start_frame"], r["end_frame"], bag(r["expected"]), r["expected_count"], bag(r["checked"])) == ("8", 3, 9, {"a": 2, "b": 1}, 2, {"a": 1})
