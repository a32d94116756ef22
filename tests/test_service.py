"""The whole run from detections to records: scenes made by hand, a plain version, and streams cut at any place."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from orderweave.operators import service as S
from orderweave.operators.tracking import Rules
from orderweave.streaming.runner import finished


def quad(x, y, w, h):
    return [float(v) for v in (x, y, x + w, y, x + w, y + h, x, y + h)]


TRAY, TICKET = quad(0, 0, 400, 300), quad(10, 10, 60, 40)
SPOTS = [quad(100 + 70 * k, 100, 50, 30) for k in range(4)]
RULES = Rules(new_frames=2, tray_missing=3, sticker_missing=2, ticket_leave=3, confirm_frames=2)
NOW = S.Service(RULES, settled=2, margin=3, delay=1)


def det(cls, box, number=None, items=None):
    return ("det", None, cls, box, number, items, None, None)


def played(frames, service=NOW, step=0.1, line=None):
    """Events (frame, order, status, items, number, what) of frames 0, 1, ... of one session."""
    line, out = line or S.Line(), []
    for k, rows in enumerate(frames):
        dets = [(r[0], i, *r[2:]) for i, r in enumerate(rows)]
        out += line.step(service, k, k * step, dets or [("frame", 0, *[None] * 6)])
    return [(e[1], e[3], e[4], {i["item"]: i["n"] for i in e[5]}, e[7], e[8]) for e in out]


def of(events, status):
    return [e for e in events if e[2] == status]


def lay(*stickers, ticket=("101", ["a", "b", "c"])):
    return [det("tray", TRAY), det("order_ticket", TICKET, *ticket), *(det("order_sticker", SPOTS[k], None, [i]) for k, i in enumerate(stickers))]


def test_a_ticket_and_three_stickers_are_four_tasks():
    events = played([lay("a", "b", "c")] * 14)
    assert [(e[0], e[5]) for e in of(events, "TASK")] == [(3, "ticket"), (4, "sticker"), (5, "sticker"), (6, "sticker")]
    assert [e[3] for e in of(events, "ITEM_CHECKED")] == [{"a": 1}, {"a": 1, "b": 1}, {"a": 1, "b": 1, "c": 1}]
    assert [e[2] for e in events if e[2] != "TASK"] == ["NEW_TRAY_DETECTED", "TICKET_READY", *["ITEM_CHECKED"] * 3, "TRAY_COMPLETED"]


def test_a_recogniser_that_takes_long_reads_one_thing_at_a_time():
    service = S.Service(RULES, settled=2, delay=5)
    events = played([lay("a", "b", "c")] * 30, service)
    frames = [e[0] for e in of(events, "TASK")]
    assert frames == [3, 8, 13, 18]
    assert len(of(events, "TRAY_COMPLETED")) == 1


def test_what_cant_be_read_settles_and_is_read_again():
    frames = [lay(ticket=(None, []))] * 8 + [lay()] * 6
    events = played(frames)
    assert [e[0] for e in of(events, "TASK")] == [3, 5, 7, 9]
    assert [e[0] for e in of(events, "TICKET_READY")] == [10]
    bad = [lay("a")[:2] + [det("order_sticker", SPOTS[0], None, None)]] * 12
    assert [(e[0], e[5]) for e in of(played(bad), "TASK")] == [(3, "ticket"), (4, "sticker"), (6, "sticker"), (8, "sticker"), (10, "sticker")]


def test_two_trays_share_the_recogniser_in_order():
    other = [v + (1000 if k % 2 == 0 else 0) for k, v in enumerate(TRAY)]
    there = [v + (1000 if k % 2 == 0 else 0) for k, v in enumerate(TICKET)]
    frames = [[det("tray", TRAY), det("tray", other), det("order_ticket", TICKET, "1", ["a"]), det("order_ticket", there, "2", ["b"])]] * 8
    events = played(frames)
    assert [(e[0], e[1]) for e in of(events, "TASK")] == [(3, 1), (4, 2)]
    assert [(e[1], e[4]) for e in of(events, "TICKET_READY")] == [(1, "1"), (2, "2")]


def test_wrong_items_are_said_again_and_block_completion_until_they_leave():
    frames = [lay("a", ticket=("1", ["a"]))[:2] + [det("order_sticker", SPOTS[0], None, ["z"]), det("order_sticker", SPOTS[1], None, ["a"])]] * 24 + [lay(ticket=("1", ["a"])) + [det("order_sticker", SPOTS[1], None, ["a"])]] * 6
    events = played(frames)
    assert [e[3] for e in of(events, "WRONG_ITEM_DETECTED")] == [{"z": 1}, {"z": 1}]
    assert [e[0] for e in of(events, "WRONG_ITEM_DETECTED")] == [5, 19]  # due at 2.0 seconds, before the frame of that moment
    assert [e[0] for e in of(events, "TRAY_COMPLETED")] == [26]


def test_items_known_by_sight_wait_longer_when_they_are_wrong():
    frames = [lay(ticket=("1", ["マヨネーズ", "a"])) + [det("cream_front", SPOTS[0]), det("sesame_front", SPOTS[1])]] * 20
    events = played(frames)
    right, wrong = of(events, "ITEM_CHECKED")[0], of(events, "WRONG_ITEM_DETECTED")[0]
    assert right[3] == {"マヨネーズ": 1} and wrong[3] == {"ごまドレッシング": 1}
    assert (right[0], wrong[0]) == (4, 7)   # confirmed at frame 2; 2 sightings from there, or 2 + 3
    assert not of(events, "TASK")[1:]


ONE = S.Service(Rules(mode="single", ticket_leave=3, sticker_missing=2), settled=2, delay=1)


def test_a_further_ticket_adds_and_takes_back_its_items():
    second = det("order_ticket", SPOTS[3], "1", ["b"])
    first = det("order_ticket", TICKET, "1", ["a"])
    events = played([[first]] * 5 + [[first, second]] * 8 + [[first]] * 6, ONE)
    assert [e[3] for e in of(events, "TICKET_READY")] == [{"a": 1}, {"a": 1, "b": 1}, {"a": 1}]
    events = played([[first]] * 5 + [[first, det("order_ticket", SPOTS[3], "2", ["b"])]] * 6, ONE)
    assert len(of(events, "TICKET_READY")) == 1 and [e[5] for e in of(events, "TASK")] == ["ticket", "extra", "extra"]


def test_a_further_ticket_takes_the_first_ones_place():
    first, second = det("order_ticket", TICKET, "1", ["a"]), det("order_ticket", SPOTS[3], "1", ["b"])
    events = played([[first, second]] * 9 + [[second]] * 12 + [[]] * 5, ONE)
    # The first one's items are taken back once it is gone; the order ends when the second one has left too.
    assert [e[3] for e in of(events, "TICKET_READY")] == [{"a": 1}, {"a": 1, "b": 1}, {"b": 1}]
    assert [e[0] for e in of(events, "RECORD")] == [24]
    # Seen again, it is known already: nothing is read or added anew.
    events = played([[first, second]] * 9 + [[second]] * 2 + [[first, second]] * 6, ONE)
    assert len(of(events, "TICKET_READY")) == 2 and len(of(events, "TASK")) == 2


def test_departure_writes_a_record():
    events = played([lay("a", "b", "c")] * 10 + [[]] * 6)
    assert [(e[2], e[3]) for e in events[-2:]] == [("RECORD", {"a": 1, "b": 1, "c": 1}), ("TRAY_REMOVED", {})]
    events = played([[det("order_ticket", TICKET, "1", ["a"])]] * 5 + [[]] * 5, ONE)
    assert [e[2] for e in events[-4:]] == ["RECORD", "TRAY_RESET", "WAITING_TICKET", "TRAY_REMOVED"]


def command(what, kind, order=None):
    return ("command", None, kind, None, None, None, order, what)


def test_commands():
    begun = [lay("a")] * 8
    events = played(begun + [[command("reset", "b", 1), *lay("a")]] + [lay("a")] * 4)
    assert [e[0] for e in of(events, "TICKET_READY")] == [4, 11]
    events = played(begun + [[command("reset", "a", 1), *lay("a")]] + [lay("a")] * 3)
    assert [(e[0], e[1]) for e in of(events, "NEW_TRAY_DETECTED")] == [(1, 1), (9, events[-1][1])]
    assert played(begun + [[command("reset", "a", 9), *lay("a")]] + [lay("a")] * 3) == played(begun + [lay("a")] * 4)
    assert played(begun + [[command("reset", "x", 1), command("capture", None), *lay("a")]] + [lay("a")] * 3) == played(begun + [lay("a")] * 4)
    single = [[det("order_ticket", TICKET, "1", ["a"])]]
    for kind in ("a", "b", "all"):
        events = played(single * 6 + [[command("reset", kind, 7), *single[0]]] + single * 4, ONE)
        assert [e[2] for e in events if e[0] == 6] == ["TRAY_RESET", "WAITING_TICKET", "NEW_TRAY_DETECTED"] and len(of(events, "TICKET_READY")) == 2


def test_a_reset_drops_what_was_read_but_not_looked_at():
    frames = [lay()] * 4 + [[command("reset", "b", 1), *lay()]] + [lay()] * 4
    assert [e[0] for e in of(played(frames), "TICKET_READY")] == [7]


def test_modes_may_change():
    area = tuple(quad(0, 0, 90, 90))
    service = S.Service(RULES, area=area, settled=2, delay=1)
    inside, outside = det("order_ticket", TICKET, "1", ["a"]), det("order_ticket", SPOTS[3], "2", ["b"])
    events = played([lay()] * 5 + [[command("mode", "preset_roi"), inside, outside]] + [[inside, outside]] * 5, service)
    assert [(e[0], e[4]) for e in of(events, "TICKET_READY")] == [(4, "101"), (8, "1")]
    events = played([[command("mode", "single"), inside, outside]] + [[inside, outside]] * 5, service)
    assert [e[4] for e in of(events, "TICKET_READY")] == ["2"]
    assert played([lay()] * 3 + [[command("mode", "tray"), command("mode", "other"), *lay()]] * 3) == played([lay()] * 6)


def result(task, number, items):
    return ("result", None, None, task[9], number, items, task[3], task[8])


def test_results_as_rows_late_and_repeated():
    service, line, out, tasks = S.Service(RULES, settled=2, patience=1.0), S.Line(), [], []
    for k in range(30):
        rows = []
        if k in (9, 10, 12) and tasks:  # the ticket's result comes late, and again
            rows = [result(tasks[0], "1", ["a", "b"])]
        new = line.step(service, k, k / 10, rows + [(r[0], i, *r[2:]) for i, r in enumerate(lay("a"))])
        tasks += [e for e in new if e[4] == "TASK"]
        out += new
    assert [e[1] for e in out if e[4] == "TICKET_READY"] == [9]
    # The sticker's result never comes: it is read again.
    assert [(t[1], t[8]) for t in tasks] == [(3, "ticket"), (9, "sticker"), (21, "sticker")]


def test_time_goes_on_without_frames():
    line = S.Line()
    events = played([lay(ticket=("1", ["a"])) + [det("order_sticker", SPOTS[0], None, ["z"])]] * 6, line=line)
    wrong = of(events, "WRONG_ITEM_DETECTED")
    assert len(wrong) == 1
    later = line.until(NOW, 4.0)
    assert [(e[4], round(e[2], 6)) for e in later] == [("WRONG_ITEM_DETECTED", 2.0), ("WRONG_ITEM_DETECTED", 3.5)]
    gone = line.until(NOW, 1000.0)
    assert [e[4] for e in gone[-2:]] == ["RECORD", "TRAY_REMOVED"] and gone[-1][2] == pytest.approx(60.5)
    assert line == S.Line() and line.due(NOW) is None


# A plain version, for boxes whose sides lie along the axes


def overlap(a, b):
    w = min(a[2], b[2]) - max(a[0], b[0])
    h = min(a[5], b[5]) - max(a[1], b[1])
    both = max(w, 0) * max(h, 0)
    area = lambda q: (q[2] - q[0]) * (q[5] - q[1])
    return both / (area(a) + area(b) - both + 1e-9)


def plain(frames, settled, leave, missing, delay):
    """Statuses of single mode over frames of (cls, quad, number, items), without known classes or commands: (frame, status, bag)."""
    out, number, tasks = [], 0, None
    order = None

    def fresh():
        return {"state": "wait", "ticket": None, "extras": [], "stickers": [], "want": [], "have": [], "number": None}

    order = fresh()
    for k, dets in enumerate(frames):
        if tasks and k >= tasks["due"]:
            t, tasks = tasks, None
            if t["order"] is order:
                items, num = t["read"]
                if t["what"] == "ticket" and order["state"] == "read":
                    if order["ticket"]:
                        order["ticket"]["busy"] = False
                    if items:
                        order.update(state="open", want=list(items), number=num or "000")
                        order["ticket"].update(given=list(items), merged=True)
                        out.append((k, "TICKET_READY", Counter(items)))
                    else:
                        order.update(state="wait", ticket=None)
                elif t["what"] == "extra":
                    e = next((e for e in order["extras"] if overlap(e["quad"], t["quad"]) > 0.1), None)
                    if e:
                        e["busy"] = False
                        if num is None or num != order["number"]:
                            order["extras"].remove(e)
                        else:
                            order["want"] = order["want"] + items
                            e.update(given=items, merged=True)
                            order["state"] = "open" if order["state"] == "done" else order["state"]
                            out.append((k, "TICKET_READY", Counter(order["want"])))
                elif t["what"] == "sticker" and order["state"] == "check":
                    s = next((s for s in order["stickers"] if overlap(s["quad"], t["quad"]) > 0.1), None)
                    if s:
                        s["busy"] = False
                    rest = Counter(order["want"]) - Counter(order["have"])
                    item = items[0] if items and rest else None
                    if item is not None and rest[item]:
                        order["have"].append(item)
                        if s:
                            s["checked"] = True
                        out.append((k, "ITEM_CHECKED", Counter(order["have"])))
                        if len(order["have"]) == len(order["want"]) and not any(x["wrong"] for x in order["stickers"]):
                            order["state"] = "done"
                            out.append((k, "TRAY_COMPLETED", Counter(order["have"])))
                    else:
                        if s:
                            s["stable"] = 0
                        if item is not None:
                            out.append((k, "WRONG_ITEM_DETECTED", Counter([item])))
                            if s:
                                s.update(wrong=True, item=item)
                    if order["state"] != "done":
                        order["state"] = "open"
        new = lambda q: {"quad": q, "stable": 0, "missing": 0, "busy": False, "merged": False, "given": [], "gone": False, "told": False, "checked": False, "wrong": False, "read": None}
        main, met = False, []
        for cls, q, num, items in dets:
            if cls != "order_ticket":
                continue
            if order["ticket"] and overlap(q, order["ticket"]["quad"]) > 0.4:
                order["ticket"].update(quad=q, stable=order["ticket"]["stable"] + 1, missing=0, read=(items or [], num))
                main = True
                continue
            best = max((e for e in order["extras"] if e not in met), key=lambda e: overlap(q, e["quad"]), default=None)
            if best and overlap(q, best["quad"]) > 0.4:
                best.update(quad=q, stable=best["stable"] + 1, missing=0)
            elif order["ticket"] is None:
                best = order["ticket"] = new(q)
                main = True
                out.append((k, "NEW_TRAY_DETECTED", Counter()))
            else:
                best = new(q)
                order["extras"].append(best)
            best["read"] = (items or [], num)
            met.append(best)
        if order["ticket"] and not main:
            heir = next((e for e in order["extras"] if e["merged"] and any(e is m for m in met)), None)
            if heir:
                old = order["ticket"]
                order["extras"] = [e for e in order["extras"] if e is not heir]
                order["ticket"] = heir
                if old["given"]:
                    old["merged"] = True
                    order["extras"].append(old)
            elif not order["ticket"]["busy"]:
                order["ticket"].update(stable=0, missing=order["ticket"]["missing"] + 1)
        for e in order["extras"]:
            if not any(e is m for m in met):
                if not e["busy"]:
                    e.update(stable=0, missing=e["missing"] + 1)
                e["gone"] = e["gone"] or e["missing"] > missing
        order["extras"] = [e for e in order["extras"] if not (e["gone"] and e["told"])]
        taken, made = [], []
        for cls, q, num, items in dets:
            if cls != "order_sticker":
                continue
            free = [s for s in order["stickers"] if not any(s is t for t in taken)]
            best = max(free, key=lambda s: overlap(q, s["quad"]), default=None)
            if best and overlap(q, best["quad"]) > 0.1:
                best.update(quad=q, stable=best["stable"] + 1)
                taken.append(best)
            else:
                best = new(q)
                order["stickers"].append(best)
                made.append(best)
            best["read"] = (items or [], num)
        for s in order["stickers"]:
            if any(s is t for t in taken + made):
                s.update(missing=0, gone=False, told=False)
                continue
            if not s["checked"] and not s["busy"]:
                s["stable"] = 0
            if not s["busy"]:
                s["missing"] += 1
            s["gone"] = s["gone"] or s["missing"] > missing
        order["stickers"] = [s for s in order["stickers"] if not (s["gone"] and s["told"])]
        full = lambda: order["want"] and len(order["have"]) == len(order["want"])
        left = [s for s in order["stickers"] if s["wrong"] and s["gone"] and not s["told"]]
        for s in left:
            s["told"] = True
        if left and order["state"] == "open" and full() and not any(s["wrong"] and not s["told"] for s in order["stickers"]):
            order["state"] = "done"
            out.append((k, "TRAY_COMPLETED", Counter(order["have"])))
        for e in order["extras"]:
            if e["gone"] and not e["told"]:
                e["told"] = True
                if e["merged"] and e["given"]:
                    rest, want = Counter(e["given"]), []
                    for i in order["want"]:
                        if rest[i]:
                            rest[i] -= 1
                        else:
                            want.append(i)
                    order["want"] = want
                    out.append((k, "TICKET_READY", Counter(want)))
                    if order["state"] != "done" and full() and not any(s["wrong"] for s in order["stickers"]):
                        order["state"] = "done"
                        out.append((k, "TRAY_COMPLETED", Counter(order["have"])))
        waiting = []
        if order["state"] == "wait" and order["ticket"] and order["ticket"]["stable"] >= settled and not order["ticket"]["busy"]:
            waiting.append(("ticket", order["ticket"]))
        elif order["state"] == "open":
            waiting += [("sticker", s) for s in order["stickers"] if s["stable"] >= settled and not s["checked"] and not s["busy"]][:1]
        if order["state"] in ("open", "check", "done"):
            waiting += [("extra", e) for e in order["extras"] if e["stable"] >= settled and not e["busy"] and not e["merged"]][:1]
        if order["ticket"] and order["ticket"]["missing"] > leave:
            out.append((k, "RECORD", Counter(order["want"])))
            out += [(k, s, Counter()) for s in ("TRAY_RESET", "WAITING_TICKET", "TRAY_REMOVED")]
            order, waiting = fresh(), []
        if waiting and not tasks:
            what, thing = waiting[0]
            tasks = {"what": what, "quad": thing["quad"], "read": thing["read"], "due": k + delay, "order": order}
            thing["busy"] = True
            order["state"] = {"ticket": "read", "sticker": "check"}.get(what, order["state"])
            out.append((k, "TASK", Counter()))
    return out


def shaky(dice, frames):
    """Frames of (cls, quad, number, items): tickets and stickers that come, stay, flicker, move and leave."""
    out, things = [], []
    for _ in range(frames):
        if dice.random() < 0.2 and len(things) < 6:
            x, y = dice.randrange(5) * 60, dice.randrange(3) * 60
            if dice.random() < 0.45:
                things.append(("order_ticket", x, y, dice.choice(["1", "1", None]), dice.choices("abc", k=dice.randint(0, 3))))
            else:
                things.append(("order_sticker", x, y, None, dice.choices("abcz", k=dice.randint(0, 1))))
        things = [t for t in things if dice.random() > 0.05]
        out.append([(c, quad(x + dice.randrange(8), y + dice.randrange(8), 50, 40), n, i) for c, x, y, n, i in things if dice.random() > 0.15])
    return out


def test_single_orders_against_a_plain_version():
    found = Counter()
    for seed in range(60):
        dice = random.Random(seed)
        scene, delay = shaky(dice, 150), dice.choice([1, 2, 4])
        service = S.Service(Rules(mode="single", ticket_leave=4, sticker_missing=2), settled=2, delay=delay, again=1e9, silence=1e9)
        ours = [(f, s, Counter(b)) for f, _, s, b, *_ in played([[det(*d) for d in f] for f in scene], service)]
        assert ours == plain(scene, 2, 4, 2, delay)
        found.update(s for _, s, _ in ours)
    assert all(found[s] > 20 for s in ("TASK", "TICKET_READY", "ITEM_CHECKED", "WRONG_ITEM_DETECTED", "TRAY_COMPLETED", "RECORD"))


def test_states_come_back_as_they_were():
    for seed in range(20):
        dice = random.Random(seed)
        line, other = S.Line(), S.Line()
        service = ONE if seed % 2 else S.Service(RULES, settled=1, delay=2)
        for k, dets in enumerate(shaky(dice, 60)):
            rows = [("det", i, *d, None, None) for i, d in enumerate([*dets, ("tray", TRAY, None, None), ("cream_front", SPOTS[2], None, None)])]
            assert line.step(service, k, k * 0.3, rows) == other.step(service, k, k * 0.3, rows)
            other = S.unpacked(*S.packed(other))
            assert other == line


# Batch and stream


def feed_rows(seed, sessions=4, frames=40):
    dice, rows = random.Random(seed), []
    for session in range(sessions):
        for k, dets in enumerate(shaky(dice, frames)):
            at = 1 + k * 0.5 + (100 if k >= 25 else 0)
            own = [(c, q, n, i) for c, q, n, i in dets] + ([("tray", TRAY, None, None), ("cream_front", SPOTS[2], None, None)] if session == 2 else [])
            rows += [(session, k, at, "det", i, c, q, n, it, None, None) for i, (c, q, n, it) in enumerate(own)]
            if not own:
                rows.append((session, k, at, "frame", 0, *[None] * 6))
            if k == 20 and session == 3:
                rows.append((session, k, at, "command", 0, "all", None, None, None, None, "reset"))
            if k == 10 and session == 0:
                rows.append((session, k, at, "command", 0, "tray", None, None, None, None, "mode"))
    return rows


@pytest.mark.parametrize("cuts", [(15,), (7, 8, 31)])
def test_stream_gives_what_the_batch_gives_however_it_is_cut(spark, tmp_path, cuts):
    service = S.Service(Rules(mode="single", new_frames=2, ticket_leave=4, sticker_missing=2), settled=2, margin=2, delay=2, silence=20.0)
    rows = feed_rows(1)
    whole = spark.createDataFrame(rows, S.FEED)
    edges = [0, *cuts, 10**9]
    for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
        part = tmp_path / f"part{k}"
        spark.createDataFrame([r for r in rows if lo <= r[1] < hi], S.FEED).coalesce(1).write.parquet(str(part))
        (file,) = part.glob("*.parquet")
        (tmp_path / "in").mkdir(exist_ok=True)
        file.rename(tmp_path / "in" / f"{k}.parquet")
    stream = spark.readStream.schema(S.FEED).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    ours = sorted(map(tuple, finished(S.stream_events(stream, service)).collect()), key=lambda r: r[:4])
    assert spark.conf.get(key) == before
    last = max(r[2] for r in rows)
    theirs = sorted(map(tuple, S.events(whole, service, until=last).collect()), key=lambda r: r[:4])
    assert ours == theirs and {"RECORD", "TASK", "ITEM_CHECKED", "TRAY_RESET"} <= {r[5] for r in ours}


def test_nothing_is_kept_of_sessions_that_have_left(spark, tmp_path):
    """A later session's frames move time on; of the others no state is left, as their timers found them silent."""
    service = S.Service(Rules(mode="single"), settled=1, delay=1, silence=20.0)
    rows = feed_rows(2, frames=12)
    for k, part in enumerate((rows, [(9, 1, 500.0, "frame", 0, *[None] * 6)], [(9, 2, 1000.0, "frame", 0, *[None] * 6)])):
        spark.createDataFrame(part, S.FEED).coalesce(1).write.parquet(str(tmp_path / f"part{k}"))
        (file,) = (tmp_path / f"part{k}").glob("*.parquet")
        (tmp_path / "in").mkdir(exist_ok=True)
        file.rename(tmp_path / "in" / f"{k}.parquet")
    stream = spark.readStream.schema(S.FEED).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    from orderweave.streaming.runner import several_states

    with several_states(spark):
        query = S.stream_events(stream, service).writeStream.outputMode("append").format("noop").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
    kept = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    state = spark.read.format("statestore").option("path", str(tmp_path / "state")).option("stateVarName", "things").load()
    heads = spark.read.format("statestore").option("path", str(tmp_path / "state")).option("stateVarName", "head").load()
    assert max(kept) > 4 and {r["key"][0] for r in heads.collect()} <= {9} and {r["key"][0] for r in state.collect()} <= {9}


def test_commands_for_all_reach_every_known_session(spark):
    commands = spark.createDataFrame([(None, 5, "all"), (2, 6, "b")], "session long, frame long, cls string")
    sessions = spark.createDataFrame([(k,) for k in range(3)], "session long")
    assert sorted(map(tuple, S.fanned(commands, sessions).collect())) == [(0, 5, "all"), (1, 5, "all"), (2, 5, "all"), (2, 6, "b")]
