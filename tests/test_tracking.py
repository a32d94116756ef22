"""Tracking against scenes made by hand, and a stream's batches against the batch form."""

from __future__ import annotations

import random

from orderweave.operators import tracking as K
from orderweave.operators.tracking import Rules, View, advance
from orderweave.streaming.runner import several_states


def quad(x, y, w, h):
    return [float(v) for v in (x, y, x + w, y, x + w, y + h, x, y + h)]


TRAY = quad(0, 0, 100, 80)


def played(frames, rules=Rules()):
    """Rows kind, track, holder, det, status, stable, frozen, missing of each frame."""
    view = View()
    return [advance(view, rules, [(k, c, q) for k, (c, q) in enumerate(f)]) for f in frames]


def kinds(rows, kind):
    return [(r[4], r[5], r[7]) for r in rows if r[0] == kind]


def test_a_tray_needs_frames_in_a_row():
    out = played([[("tray", TRAY)]] * 14 + [[]] + [[("tray", TRAY)]] * 15)
    assert [kinds(r, "candidate") for r in out[:2]] == [[("new", 0, 0)], [("seen", 0, 0)]]
    assert [kinds(r, "tray") for r in out] == [[]] * 29 + [[("promoted", 0, 0)]]


def test_a_tray_keeps_its_place_until_it_has_drifted_thrice_and_is_lost():
    moved = quad(10, 0, 100, 80)
    out = played([[("tray", TRAY)]] * 15 + [[("tray", moved)]] * 4 + [[]] * 17)
    seen = [s for r in out for s, *_ in kinds(r, "tray")]
    assert seen == ["promoted", "seen", "seen", "snapped", "seen", *["missing"] * 15, "lost"]


def test_trays_choose_one_after_another_and_crowding_isnt_new():
    a, b = quad(0, 0, 100, 80), quad(200, 0, 100, 80)
    view = View()
    for _ in range(15):
        advance(view, Rules(), [(0, "tray", a), (1, "tray", b)])
    rows = advance(view, Rules(), [(7, "tray", quad(5, 0, 100, 80)), (8, "tray", a), (9, "tray", b)])
    assert [(r[1], r[3], r[4]) for r in rows if r[0] == "tray"] == [(1, 8, "seen"), (2, 9, "seen")]
    assert not [r for r in rows if r[0] == "candidate"]


def test_tickets_and_stickers_in_a_tray():
    ticket, far, sticker, outside = quad(10, 10, 20, 10), quad(60, 10, 20, 10), quad(10, 40, 10, 10), quad(300, 40, 10, 10)
    lay = [("tray", TRAY), ("order_ticket", ticket), ("order_sticker", sticker), ("order_sticker", outside)]
    out = played([[("tray", TRAY)]] * 14 + [lay] * 3 + [[("tray", TRAY), ("order_ticket", far), ("order_sticker", quad(14, 40, 10, 10))]] + [[("tray", TRAY)]] * 16 + [lay])
    assert [kinds(r, "ticket") for r in out[14:18]] == [[("new", 0, 0)], [("seen", 1, 0)], [("seen", 2, 0)], [("replaced", 0, 0)]]
    stickers = [[r for r in rows if r[0] == "sticker"] for rows in out]
    assert [(r[4], r[5], r[6]) for rows in stickers[14:18] for r in rows] == [("new", 0, 0), ("seen", 1, 1), ("seen", 2, 2), ("seen", 3, 0)]
    assert [(k, r[4], r[7]) for k, rows in enumerate(stickers[18:]) for r in rows] == [(15, "lost", 16), (16, "seen", 0)]


def test_known_classes_are_confirmed_front_and_back_alike():
    at = quad(10, 40, 10, 10)
    base = [[("tray", TRAY)]] * 15
    flicker = [[("tray", TRAY), (c, at)] for c in ("sesame_front", "sesame_back", "sesame_front")]
    out = played(base + flicker)
    assert [r[4] for rows in out[15:] for r in rows if r[0] == "pending"] == ["new", "seen"]
    assert [r[4] for rows in out[15:] for r in rows if r[0] == "sticker"] == ["promoted"]
    out = played(base + flicker[:2] + [[("tray", TRAY)]] + flicker[:2])
    assert [r[4] for rows in out[15:] for r in rows if r[0] == "pending"] == ["new", "seen", "new", "seen"]


def test_one_order_at_a_time():
    rules, a, b = Rules(mode="single"), quad(0, 0, 40, 30), quad(100, 0, 40, 30)
    out = played([[("order_ticket", a)]] * 2 + [[("order_ticket", a), ("order_ticket", b)]] * 2 + [[]] * 31 + [[("order_ticket", a)]], rules)
    assert [kinds(r, "ticket")[0][0] for r in out] == ["new", "seen", "seen", "seen", *["missing"] * 30, "lost", "new"]
    assert [s for r in out for s, *_ in kinds(r, "extra")] == ["new", "seen", "lost"]
    assert [kinds(r, "tray") for r in out[33:35]] == [[], [("lost", 0, 0)]]
    # A sticker keeps its class and is met whatever the class of the detection.
    out = played([[("order_sticker", a)], [("cream_front", a)]], rules)
    assert [r[4] for rows in out for r in rows if r[0] == "sticker"] == ["new", "seen"]


def scene(seed):
    rng = random.Random(seed)
    rows = []
    for session in range(4):
        for frame in range(30):
            things = [("tray", 0, 0, 100, 80), ("order_ticket", 10, 10, 20, 10), ("order_sticker", 50, 40, 10, 10), ("sesame_front", 70, 40, 12, 12)]
            shown = [t for t in things if rng.random() < 0.9] or [(None, 0, 0, 1, 1)]
            for k, (c, x, y, w, h) in enumerate(shown):
                rows.append((session, frame, k, c, quad(x + rng.random(), y + rng.random(), w, h)))
    return rows


def test_stream_gives_the_same_rows(spark, tmp_path):
    schema = "session long, frame long, det long, cls string, quad array<double>"
    rows, rules = scene(1), Rules(new_frames=3, sticker_missing=2)
    whole = sorted(map(repr, K.tracked(spark.createDataFrame(rows, schema), rules).collect()))
    for k, (lo, hi) in enumerate(((0, 7), (7, 19), (19, 30))):
        spark.createDataFrame([r for r in rows if lo <= r[1] < hi], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    out = []
    with several_states(spark):
        query = K.stream_tracked(stream, rules).writeStream.foreachBatch(lambda df, n: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
    assert sorted(map(repr, out)) == whole and len(whole) > 300


def test_no_frames(spark):
    schema = "session long, frame long, det long, cls string, quad array<double>"
    assert K.tracked(spark.createDataFrame([], schema)).count() == 0


def test_places_of_tickets_and_of_results(spark):
    schema = "session long, frame long, det long, cls string, quad array<double>"
    a, b, far = quad(0, 0, 40, 30), quad(100, 0, 40, 30), quad(300, 300, 10, 10)
    dets = spark.createDataFrame([(1, 0, 0, "order_ticket", a), (1, 0, 1, "order_ticket", b), (1, 0, 2, "order_sticker", b), (1, 1, 0, None, far)], schema)
    roi = [-10.0, -10.0, 60.0, -10.0, 60.0, 60.0, -10.0, 60.0]
    assert {(r.frame, r.det) for r in K.tickets_by_place(dets, roi, True).collect()} == {(0, 0), (0, 2), (1, 0)}
    assert {(r.frame, r.det) for r in K.tickets_by_place(dets, roi, False).collect()} == {(0, 1), (0, 2), (1, 0)}
    rows = K.tracked(dets, Rules(mode="single"))
    results = spark.createDataFrame([(1, 0, quad(5, 0, 40, 30), "x"), (1, 0, quad(98, 0, 40, 30), "y"), (1, 0, far, "z")], "session long, frame long, quad array<double>, text string")
    got = {r.text: r.kind for r in K.results_of(results, rows, dets).collect()}
    assert got == {"x": "ticket", "y": "extra"}
