from __future__ import annotations

import csv
import json
import math
import os
import random
from pathlib import Path

import pandas as pd
from pyspark.sql import functions as F

from orderweave.functions import geometry
from orderweave.operators import bags, detections, matching, runs, verification
from orderweave.plans import catalogue
from orderweave.sources import sinks, tables
from orderweave.streaming import order_state, runner


def test_menu_takes_the_last_of_a_name(spark):
    menu = spark.createDataFrame([(1, "set", ["a"]), (5, "set", ["b", "c"]), (3, "set", ["d"])], "pos int, name string, sub_items array<string>")
    items = spark.createDataFrame([(1, "set", 2), (1, "tea", 1)], "tray int, item string, n long")
    assert {tuple(r) for r in bags.expanded(items, menu).select("item", "n").collect()} == {("b", 2), ("c", 2), ("tea", 1)}


def test_bags(spark):
    bag = lambda rows: spark.createDataFrame(rows, "tray int, item string, n long")
    a, b = bag([(1, "x", 3), (1, "y", 1), (2, "x", 1)]), bag([(1, "x", 1), (1, "z", 4), (2, "x", 2)])
    assert {tuple(r) for r in bags.minus(a, b, ["tray"]).collect()} == {(1, "x", 2), (1, "y", 1)}
    assert {tuple(r) for r in bags.plus(bags.minus(a, b, ["tray"]), b, ["tray"]).collect()} == {(1, "x", 3), (1, "y", 1), (1, "z", 4), (2, "x", 2)}
    none = bag([])
    got = {r.tray: r.status for r in bags.verified(bag([(1, "x", 1), (2, "x", 1), (3, "x", 2)]), bag([(1, "x", 1), (2, "x", 1), (4, "q", 1)]), bag([(2, "w", 1)]), ["tray"]).collect()}
    assert got == {1: "COMPLETED", 2: "BLOCKED", 3: "WAITING_STICKERS", 4: "WAITING_TICKET"} and bags.minus(none, none, ["tray"]).count() == 0


def boxes(spark, n=120, seed=1):
    rng = random.Random(seed)
    rows = [(1, k, rng.choice("ab"), round(rng.random(), 2), (rng.uniform(0, 60), rng.uniform(0, 60), rng.uniform(2, 12), rng.uniform(2, 12), rng.uniform(0, 3))) for k in range(n)]
    return spark.createDataFrame(rows, "frame int, det int, cls string, score double, box struct<cx:double,cy:double,w:double,h:double,r:double>")


def test_suppression_is_the_same_for_any_partitioning(spark):
    df = boxes(spark)
    other = df.select(F.col("cls").alias("c"), F.col("det").alias("d"), F.col("score").alias("s"), F.col("box").alias("b"))
    hit = (F.col("cls") == F.col("c")) & ((F.col("s") > F.col("score")) | ((F.col("s") == F.col("score")) & (F.col("d") < F.col("det")))) & (geometry.prob_iou(F.col("b"), F.col("box")) >= 0.3)
    want = {r.det for r in df.join(other, hit, "left_anti").collect()}
    for k in (1, 7):
        got = detections.suppressed(df.repartition(k), ["frame"], 0.3, F.col("cls"))
        assert got.columns == df.columns and {r.det for r in got.collect()} == want
    assert 0 < len(want) < 120


def test_votes_and_thresholds(spark):
    df = boxes(spark, 10)
    assert detections.confident(df, {"a": 0.5}).where("cls = 'b' or score <= 0.5").count() == 0
    assert detections.best(df, ["frame"], [F.col("score").desc(), F.col("det")], 3).count() == 3
    two = spark.createDataFrame([(1, 10.0), (1, 1.0), (2, 10.0), (2, 7.5), (2, 7.4)], "k int, h double")
    assert sorted(tuple(r) for r in detections.tallest(two, ["k"], "h").collect()) == [(1, 1.0), (1, 10.0), (2, 7.5), (2, 10.0)]
    row = detections.vote(two, ["k"], F.col("h") > 9, 0.5, True).where("k = 1").first()
    assert (row.share, row.yes) == (0.5, False)


def test_nearest(spark):
    rng = random.Random(4)
    rows = [(rng.randint(1, 3), k, rng.uniform(0, 50), rng.uniform(1, 6)) for k in range(80)]
    marks = [(rng.randint(1, 2), float(rng.randint(0, 25) * 2), rng.randint(0, 9)) for k in range(30)]
    got = detections.nearest(spark.createDataFrame(rows, "k int, det int, y double, h double"), spark.createDataFrame(marks, "k int, m double, v int"), "k", "y", "m", "v", F.col("h"))
    got = {r.det: r.nearest_value for r in got.collect()}
    for k, det, y, h in rows:
        near = sorted((abs(m - y), m, v) for j, m, v in marks if j == k)
        assert got[det] == (near[0][2] if near and near[0][0] < h else None)


def test_row_clusters(spark):
    rng = random.Random(5)
    rows = [(f, k, rng.uniform(0, 60), rng.uniform(2, 12)) for f in range(6) for k in range(25)]
    got = {(r.f, r.k): r.text_row for r in runs.row_clusters(spark.createDataFrame(rows, "f int, k int, y double, h double"), ["f"], ["k"], "y", "h").collect()}
    for f in range(6):
        groups = []
        for _, k, y, h in [r for r in rows if r[0] == f]:
            at = next((i for i, g in enumerate(groups) if abs(y - sum(a for a, _ in g) / len(g)) < 0.5 * sum(b for _, b in g) / len(g)), len(groups))
            groups += [] if at < len(groups) else [[]]
            groups[at].append((y, h))
            assert got[f, k] == at


def test_runs_and_throttle(spark):
    df = spark.createDataFrame([(1, k, c) for k, c in enumerate("aabbbab")], "key int, t int, c string")
    r = runs.runs(df.withColumn("before", runs.prev("c", ["key"], ["t"])), ["key"], ["t"], F.col("c") == F.col("before"))
    assert [(x.run, x.run_pos) for x in r.orderBy("t").collect()] == [(0, 0), (0, 1), (1, 0), (1, 1), (1, 2), (2, 0), (3, 0)]
    assert [x.t for x in runs.promoted(r, 3).collect()] == [4]
    at = spark.createDataFrame([(1, x) for x in (0.0, 1.0, 1.5, 2.9, 3.0, 9.0)], "key int, at double")
    assert sorted(x.at for x in runs.throttled(at, ["key"], "at", 1.5).collect()) == [0.0, 1.5, 3.0, 9.0]


def test_matching(spark):
    texts = spark.createDataFrame([("green tee",), ("grean tea",), ("zzz",), ("green tee",)], "text string")
    menu = spark.createDataFrame([("green tea", 2), ("black tea", 1), ("green tex", 3)], "name string, pos int")
    got = {r.text: r.name for r in matching.most_similar(texts, menu).collect()}
    assert got == {"green tee": "green tea", "grean tea": "green tea"}


def course(seed, orders=30):
    rng = random.Random(seed)
    rows = []
    for o in range(orders):
        items = [rng.choice("abc") for _ in range(rng.randint(1, 3))]
        seen = items + [rng.choice("abcx") for _ in range(rng.randint(0, 2))]
        rng.shuffle(seen)
        steps = [("ticket", i) for i in items] + [("sticker", i) for i in seen]
        for k in range(rng.randint(0, 2)):
            steps.insert(rng.randint(len(items), len(steps)), ("gone", rng.choice("abx")))
        rows += [(o, f, kind, item) for f, (kind, item) in enumerate(steps)]
    return rows


def test_course_as_batch_and_as_stream(spark, tmp_path):
    """One file or many, the stream's events are those of the batch."""
    rows = course(1)
    schema = "order long, frame long, kind string, item string"
    want = {tuple(r) for r in verification.status_events(spark.createDataFrame(rows, schema)).collect()}
    assert {s for _, _, s, _ in want} == {"TICKET_READY", "ITEM_CHECKED", "WRONG_ITEM_DETECTED", "TRAY_COMPLETED"}
    for parts in (1, 4):
        folder = tmp_path / str(parts)
        folder.mkdir()
        for k in range(parts):
            own = [r for r in rows if r[1] * parts // 12 == k or (k == parts - 1 and r[1] * parts // 12 > k)]
            (folder / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(("order", "frame", "kind", "item"), r, strict=True))) for r in own))
            os.utime(folder / f"{k}.json", (1e9 + k, 1e9 + k))  # streams take files by their age
        stream = tables.replay(spark, str(folder), schema)
        assert {tuple(r) for r in runner.finished(order_state.status_events(stream)).collect()} == want


def test_sources(spark):
    names = spark.createDataFrame([(x,) for x in ("img10.png", "IMG2.png", "img2b.png", "a100", "a20", "7", "007b")], "n string")
    assert [r.n for r in names.orderBy(tables.natural_key(F.col("n")), "n").collect()] == ["7", "007b", "a20", "a100", "IMG2.png", "img2b.png", "img10.png"]
    feed = spark.createDataFrame([(1, "s/cmd/RESET", '{"tray_id": "3", "type": "a"}'), (2, "s/cmd/plot", '{"enable": "TRUE"}'), (3, "s/cmd/x", "{broken"), (4, "s/other", "{}")], "ts int, topic string, payload string")
    assert [tuple(r) for r in tables.commands(feed, "s").orderBy("ts").collect()] == [(1, "reset", "3", "a", None), (2, "plot", None, None, True)]


def test_records(spark, tmp_path):
    orders = spark.sql("select 7 tray_id, timestamp_ntz'2024-01-02 03:04:05' start_time, map('x', 2) expected_item, 1.005d expected_item_count, cast(null as string) checked_item, 'lost' extra, date'2024-01-02' day")
    for batch in ("1", "1", "2"):  # a batch that is written again counts once
        sinks.write_records(orders, str(tmp_path / "csv"), F.col("day"), batch, sinks.FULL_RECORD, "kitchen7")
    files = list(Path(tmp_path / "csv").glob("20240102_hen7_*.csv"))
    rows = [r for f in files for r in csv.DictReader(f.open(encoding="utf-8-sig"))]
    assert len(rows) == 2 and list(rows[0]) == list(sinks.FULL_RECORD) and rows[0]["expected_item"].replace("\\", "") .count("x") == 1 and rows[0]["start_time"] == "2024-01-02T03:04:05" and not rows[0]["checked_item"] and not rows[0]["order_number"] and "extra" not in rows[0]
    assert sinks.event_messages(spark.sql("select 1 a, 'b' c"), "r", "t").first() == ("r/t", '{"a":1,"c":"b"}')


def corners_of(cx, cy, w, h, r):
    c, s = math.cos(r), math.sin(r)
    return [(cx + x * w / 2 * c - y * h / 2 * s, cy + x * w / 2 * s + y * h / 2 * c) for x, y in ((1, 1), (-1, 1), (-1, -1), (1, -1))]


def area_of(p):
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1], strict=True))) / 2


def overlap(a, b):
    """Shared area over joint area, by cutting one box along each edge of the other."""
    p, q, left = corners_of(*a), corners_of(*b), corners_of(*a)
    for (ax, ay), (bx, by) in zip(q, q[1:] + q[:1], strict=True):
        side = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for x, y in left]
        cut = []
        for k, (x, y) in enumerate(left):
            n, (u, v) = side[k - 1], left[k - 1]
            if side[k] * n < 0:
                cut.append((u + (x - u) * n / (n - side[k]), v + (y - v) * n / (n - side[k])))
            cut += [(x, y)] if side[k] >= 0 else []
        left = cut
    both = area_of(left) if len(left) > 2 else 0.0
    return both / (area_of(p) + area_of(q) - both + 1e-9)


def test_turned_trays(spark, tmp_path):
    """Assignment and new trays against plain loops over turned boxes; the angle changes both."""
    rng = random.Random(6)
    rows = [(k, rng.randint(1, 12), rng.choice(["view", "signup", "click", "view"]), rng.uniform(1, 400), json.dumps({"k": rng.choice([1, 2, 11, 12])})) for k in range(400)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string").selectExpr("*", "timestamp_ntz'2024-01-02 03:04:05' + make_dt_interval(0, 0, 0, event_id) ts").write.parquet(str(tmp_path / "events.parquet"))
    boxes = [(k, tray, cls, (json.loads(p)["k"] % 10 * 10, json.loads(p)["k"] // 10 * 10, v % 20 + 5, k % 15 + 5, k % 8 * math.pi / 16)) for k, tray, cls, v, p in rows]

    def plain(turn):
        links, new = set(), set()
        for frame in sorted({b[1] for b in boxes}):
            own = [(k, cls, (*b[:4], b[4] * turn)) for k, tray, cls, b in boxes if tray == frame]
            small = {k: (b[0], b[1], b[2] * 0.9, b[3] * 0.9, b[4]) for k, _, b in own}
            new |= {k for k, cls, _ in own if cls == "view" and not any(c == "signup" and overlap(small[k], small[j]) > 0.1 for j, c, _ in own)}
            taken = set()
            for k, cls, b in own:
                best = max(((overlap(b, a), -j) for j, c, a in own if cls == "view" and c != "view" and j not in taken), default=(0, 0))
                if best[0] >= 0.3:
                    taken.add(-best[1])
                    links.add((k, -best[1]))
        return links, new

    got = {tuple(r) for r in catalogue.QUERIES["greedy_assignment"](spark, str(tmp_path)).collect()}, {r.det for r in catalogue.QUERIES["new_turned_trays"](spark, str(tmp_path)).collect()}
    assert got == plain(1)
    assert all(x != y for x, y in zip(plain(0), plain(1), strict=True)) and all(got)


def test_late_tickets(spark, tmp_path):
    """A ticket opens a completed order again, in batch and as a stream over one file and over a file for each row."""
    steps = {
        1: ["ticket a", "sticker a", "ticket b", "sticker b"],
        2: ["ticket a", "sticker a", "sticker b", "sticker x", "gone x", "ticket b", "sticker c", "gone c"],
        3: ["ticket a", "sticker b", "gone b", "ticket b", "sticker a", "sticker b", "sticker z"],
        4: ["ticket a", "gone x", "sticker x", "gone x", "sticker a"],
    }
    rows = [(o, f, *s.split()) for o, own in steps.items() for f, s in enumerate(own)]
    ready, done = "TICKET_READY", "TRAY_COMPLETED"
    want = {
        (1, 0, ready, None), (1, 1, "ITEM_CHECKED", "a"), (1, 1, done, None), (1, 2, ready, None), (1, 3, "ITEM_CHECKED", "b"), (1, 3, done, None),
        (2, 0, ready, None), (2, 1, "ITEM_CHECKED", "a"), (2, 1, done, None), (2, 5, ready, None), (2, 5, "ITEM_CHECKED", "b"), (2, 6, "WRONG_ITEM_DETECTED", "c"), (2, 7, done, None),
        (3, 0, ready, None), (3, 1, "WRONG_ITEM_DETECTED", "b"), (3, 3, ready, None), (3, 4, "ITEM_CHECKED", "a"), (3, 5, "ITEM_CHECKED", "b"), (3, 5, done, None),
        (4, 0, ready, None), (4, 2, "WRONG_ITEM_DETECTED", "x"), (4, 4, "ITEM_CHECKED", "a"), (4, 4, done, None),
    }
    schema = "order long, frame long, kind string, item string"
    got = verification.status_events(spark.createDataFrame(rows, schema)).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    for parts in (1, 8):
        folder = tmp_path / str(parts)
        folder.mkdir()
        for k in range(parts):
            own = [r for r in rows if r[1] % parts == k or parts == 1]
            (folder / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(("order", "frame", "kind", "item"), r, strict=True))) for r in own))
            os.utime(folder / f"{k}.json", (1e9 + k, 1e9 + k))  # streams take files by their age
            os.utime(folder / f"{k}.json", (10**9 + k, 10**9 + k))  # files come by their time
        got = runner.finished(order_state.status_events(tables.replay(spark, str(folder), schema))).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_small_sources_and_sinks(spark, tmp_path):
    (tmp_path / "dict.txt").write_bytes("a\r\nb\nあ\n".encode())
    assert [(r.token, r.ch) for r in tables.dictionary(spark, str(tmp_path / "dict.txt")).collect()] == [(0, ""), (1, "a"), (2, "b"), (3, "あ"), (4, " ")]
    (tmp_path / "menu.json").write_text(json.dumps([{"name": "set", "sub_items": ["tea", "rice"]}, {"name": "tea", "sub_items": ["tea"]}]))
    assert [tuple(r) for r in tables.menu_file(spark, str(tmp_path / "menu.json")).collect()] == [(0, "set", ["tea", "rice"]), (1, "tea", ["tea"])]
    frames = spark.sql("SELECT timestamp'2024-01-02 11:05:06' AS ts UNION ALL SELECT timestamp'2024-01-02 20:00:00'")
    sinks.write_stamps(frames, str(tmp_path / "stamps"), F.col("ts"))
    back = spark.read.schema("stamp string, dt string, period int").csv(str(tmp_path / "stamps")).collect()
    assert [(r.stamp, r.dt, r.period) for r in back] == [("11:05:06", "20240102", 1)]
    rows = sinks.order_records(spark.createDataFrame([("7", "abc")], "tray_id string, ticket_capture string"), sinks.FULL_RECORD).collect()
    assert rows[0].ticket_capture == "abc" and rows[0].final_tray_capture == "" and len(rows[0]) == 9


def test_status_events_as_a_stream_call_once_for_many_orders(spark, tmp_path, monkeypatch):
    """Over several batches, with orders that share a group, without an order, and with numbers that fractions can't hold."""
    from orderweave.operators import verification

    big = 2**60
    rows = [(o, f, k, i) for o in (1, 2, 3, big + 1, big + 3) for f, k, i in ((1, "ticket", "a"), (2, "ticket", "b"), (3, "sticker", "a"), (4, "sticker", "x"), (5, "gone", "x"), (6, "sticker", "b"))]
    rows += [(None, 1, "ticket", "a"), (None, 2, "sticker", None), (None, 3, "sticker", "a")]
    schema = "order long, frame long, kind string, item string"
    want = sorted(map(tuple, verification.status_events(spark.createDataFrame(rows, schema)).collect()), key=repr)
    for k, part in enumerate(([r for r in rows if r[1] < 3], [r for r in rows if 3 <= r[1] < 5], [r for r in rows if r[1] >= 5])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/part={k}"))
    for groups in (1, 2):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
        got = runner.finished(order_state.status_events(stream, groups)).collect()
        assert sorted(map(tuple, got), key=repr) == want

    calls = []
    state = type("S", (), {"exists": False, "update": lambda self, row: calls.append(row)})()
    order_state._advance((0,), iter([pd.DataFrame(rows[:30], columns=["order", "frame", "kind", "item"])]), state).__next__()
    assert len(calls) == 1 and calls[0][0] == [1, 2, 3, big + 1, big + 3]
