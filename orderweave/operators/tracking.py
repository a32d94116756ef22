"""Which detections of successive frames are the same thing.

Identity depends on where a thing was last seen, so it is a fold over a session's frames in order. The fold does this
alone and keeps what is in view: what follows from it (what is stable, gone or may be read) are columns of its rows, for
Spark to filter and group. `advance` takes one frame; the batch form walks through sorted sessions with it, a stream keeps
its state between batches, so both give the same rows.

Detections: session, frame, det (their order within the frame), cls, quad (x1, y1, ... x4, y4). Result: a row for each thing that a frame shows or loses:
session, frame, kind (tray, candidate, ticket, extra, sticker, pending), track, holder (the tray that it lies in), det (null if it isn't seen), status, stable
(sightings in a row, from 0), frozen (of those, how many in a row hardly moved), missing (frames in a row without it).
Status: new, seen, snapped (a tray's place is taken over anew), replaced (a ticket elsewhere), promoted (a candidate or
pending thing that has been seen often enough), lost (missing for too long), missing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.stateful_processor import MapState, StatefulProcessor, StatefulProcessorHandle

from orderweave.functions import geometry as G
from orderweave.functions.geometry import quad_iou, quad_overlap, quad_overlaps
from orderweave.operators.interim import spread, values

#: Classes that are told apart by sight, and the item that each stands for.
KNOWN_ITEMS = {
    "sesame_front": "ごまドレッシング",
    "sesame_back": "ごまドレッシング",
    "wafusauce_front": "和風ドレッング",
    "wafusauce_back": "和風ドレッング",
    "cream_front": "マヨネーズ",
    "cream_back": "マヨネーズ",
}

OUT = "session long, frame long, kind string, track long, holder long, det long, status string, stable long, frozen long, missing long"


@dataclass(frozen=True)
class Rules:
    """Overlaps from which on two boxes are one thing, and numbers of frames. mode: tray, or single (one order, whatever the place)."""

    mode: str = "tray"
    tray: float = 0.3
    candidate: float = 0.8
    drift: float = 0.95
    ticket: float = 0.7
    single_ticket: float = 0.4
    sticker: float = 0.1
    frozen: float = 0.97
    crowd: float = 0.1
    shrink: float = 0.1
    drift_frames: int = 3
    new_frames: int = 15
    confirm_frames: int = 3
    tray_missing: int = 15
    sticker_missing: int = 15
    ticket_leave: int = 30
    trays: tuple[str, ...] = ("tray",)
    tickets: tuple[str, ...] = ("order_ticket",)
    stickers: tuple[str, ...] = ("order_sticker",)
    known: dict[str, str] = field(default_factory=lambda: dict(KNOWN_ITEMS))


@dataclass
class Thing:
    track: int
    cls: str
    quad: list[float]
    count: int = 1
    stable: int = 0
    frozen: int = 0
    missing: int = 0
    drift: int = 0
    # What recognition knows of it; see service.py.
    busy: bool = False  # it is being read
    checked: bool = False
    wrong: bool = False
    merged: bool = False  # a ticket whose items count
    gone: bool = False
    told: bool = False  # what follows from that has been done
    item: str | None = None
    said: float = 0.0  # when it was last said to be wrong
    given: list[str] = field(default_factory=list)  # a ticket's items
    read: tuple | None = None  # what a recogniser would read of it: number, items
    ticket: Thing | None = None
    extras: list[Thing] = field(default_factory=list)
    stickers: list[Thing] = field(default_factory=list)
    pending: list[Thing] = field(default_factory=list)


@dataclass
class View:
    """What a session has in view."""

    trays: list[Thing] = field(default_factory=list)
    candidates: list[Thing] = field(default_factory=list)
    named: int = 0


def _overlaps(quad: list[float], others: list[Thing], free: set[int]) -> dict[int, float]:
    """Overlaps of a box with the free ones of the others, by place."""
    places = sorted(free)
    return dict(zip(places, quad_overlaps([quad], [others[k].quad for k in places])[0].tolist(), strict=True)) if places else {}


def _best(overlaps: np.ndarray | dict[int, float], free: set[int], least: float, strict: bool) -> int | None:
    """The free place with the largest overlap, the first of equal ones, if it is enough."""
    k = max(sorted(free), key=lambda i: overlaps[i], default=None)
    return k if k is not None and overlaps[k] > 0 and (overlaps[k] > least or not strict and overlaps[k] == least) else None


def _centre(quad: list[float]) -> tuple[float, float]:
    x0, y0, x1, y1, x2, y2, x3, y3 = quad
    return (x0 + x1 + x2 + x3) / 4, (y0 + y1 + y2 + y3) / 4


def _smaller(quad: list[float], share: float) -> list[float]:
    c = _centre(quad)
    return [v + (c[k % 2] - v) * share for k, v in enumerate(quad)]


def _holds(quad: list[float], inner: list[float]) -> bool:
    """Whether the centroid of the inner box lies within the outer one; boundaries don't count. Boxes are rectangles, so corners average to it."""
    cx, cy = _centre(inner)
    x0, y0, x1, y1, x2, y2, x3, y3 = quad
    side = [(u - x) * (cy - y) - (v - y) * (cx - x) for x, y, u, v in ((x0, y0, x1, y1), (x1, y1, x2, y2), (x2, y2, x3, y3), (x3, y3, x0, y0))]
    return all(s > 0 for s in side) or all(s < 0 for s in side)


class _Frame:
    """One frame's detections (det, cls, quad), and the rows that they lead to."""

    def __init__(self, view: View, rules: Rules, dets: list[tuple[int, str, list[float]]]):
        self.view, self.rules, self.dets, self.rows = view, rules, dets, []

    def of(self, classes) -> list[tuple[int, str, list[float]]]:
        return [d for d in self.dets if d[1] in classes]

    def say(self, kind: str, thing: Thing, holder: Thing | None, det: int | None, status: str) -> None:
        self.rows.append((kind, thing.track, holder.track if holder else None, det, status, thing.stable, thing.frozen, thing.missing))

    def met(self, thing: Thing) -> None:
        """A sticker that is in view."""
        thing.missing = 0

    def unseen(self, sticker: Thing) -> None:
        """A sticker that isn't."""
        sticker.stable, sticker.frozen, sticker.missing = 0, 0, sticker.missing + 1

    def fresh(self, cls: str, quad: list[float]) -> Thing:
        self.view.named += 1
        return Thing(self.view.named, cls, quad)

    def place(self) -> None:
        """Trays take their best free detection, one after another; what is left over may become a tray."""
        r, found = self.rules, self.of(self.rules.trays)
        free = set(range(len(found)))
        overlaps = quad_overlaps([t.quad for t in self.view.trays], [d[2] for d in found])
        for t, row in zip(self.view.trays, overlaps, strict=True):
            j = _best(row, free, r.tray, False)
            if j is None:
                t.missing, t.drift, t.stable = t.missing + 1, 0, 0
                self.say("tray", t, None, None, "lost" if t.missing > r.tray_missing else "missing")
                continue
            free.discard(j)
            t.missing, t.stable, t.drift = 0, t.stable + 1, t.drift + 1 if row[j] < r.drift else 0
            snapped = t.drift >= r.drift_frames
            if snapped:
                t.quad, t.drift = found[j][2], 0
            self.say("tray", t, None, found[j][0], "snapped" if snapped else "seen")
        on = []
        for det, cls, quad in (found[j] for j in sorted(free)):
            known = [_smaller(t.quad, r.shrink) for t in self.view.trays]
            if (quad_overlaps([_smaller(quad, r.shrink)], known) > r.crowd).any():
                continue
            near = np.flatnonzero(quad_overlaps([quad], [c.quad for c in self.view.candidates])[0] >= r.candidate)
            c = self.view.candidates[near[0]] if len(near) else self.fresh(cls, quad)
            if len(near):
                c.count, c.quad = c.count + 1, quad
            if len(near) and c.count >= r.new_frames:
                tray = Thing(c.track, cls, quad)
                self.view.trays.append(tray)
                self.say("tray", tray, None, det, "promoted")
            else:
                on.append(c)
                self.say("candidate", c, None, det, "seen" if len(near) else "new")
        self.view.candidates = on

    def tickets(self, tray: Thing, found: list) -> None:
        """With trays: the first ticket goes on where it was, or is another one."""
        if not found:
            if tray.ticket and not tray.ticket.busy:
                tray.ticket.stable = 0
            return
        det, cls, quad = found[0]
        if tray.ticket and quad_overlap(quad, tray.ticket.quad) > self.rules.ticket:
            tray.ticket.quad, tray.ticket.stable = quad, tray.ticket.stable + 1
            self.say("ticket", tray.ticket, tray, det, "seen")
        else:
            status = "replaced" if tray.ticket else "new"
            tray.ticket = self.fresh(cls, quad)
            self.say("ticket", tray.ticket, tray, det, status)

    def single_tickets(self, tray: Thing, found: list) -> None:
        """Without trays: a detection goes on with the first ticket, else with the best of the extra ones, else is a new one; a ticket that left ends the order."""
        r, seen, free = self.rules, False, set(range(len(tray.extras)))
        for det, cls, quad in found:
            if tray.ticket and quad_overlap(quad, tray.ticket.quad) > r.single_ticket:
                tray.ticket.quad, tray.ticket.stable, tray.ticket.missing, seen = quad, tray.ticket.stable + 1, 0, True
                self.say("ticket", tray.ticket, tray, det, "seen")
                continue
            k = _best(_overlaps(quad, tray.extras, free), free, r.single_ticket, True)
            if k is not None:
                free.discard(k)
                e = tray.extras[k]
                e.quad, e.stable, e.missing = quad, e.stable + 1, 0
                self.say("extra", e, tray, det, "seen")
            elif tray.ticket is None:
                tray.ticket, seen = self.fresh(cls, quad), True
                self.say("ticket", tray.ticket, tray, det, "new")
            else:
                tray.extras.append(self.fresh(cls, quad))
                self.say("extra", tray.extras[-1], tray, det, "new")
        if tray.ticket and not seen:
            tray.ticket.stable, tray.ticket.missing = 0, tray.ticket.missing + 1
            self.say("ticket", tray.ticket, tray, None, "lost" if tray.ticket.missing > r.ticket_leave else "missing")
        for e in (tray.extras[k] for k in free):
            e.stable, e.missing = 0, e.missing + 1
            if e.missing > r.sticker_missing:
                self.say("extra", e, tray, None, "lost")
        tray.extras = [e for e in tray.extras if e.missing <= r.sticker_missing]

    def confirmed(self, tray: Thing, det: int, cls: str, quad: list[float], free: set[int]) -> bool:
        """A class known by sight counts once it was seen often enough in a row, front and back alike."""
        r, item = self.rules, self.rules.known[cls]
        near = {k for k in free if r.known[tray.pending[k].cls] == item}
        k = _best(_overlaps(quad, tray.pending, near), near, r.sticker, True)
        if k is None:
            tray.pending.append(self.fresh(cls, quad))
            self.say("pending", tray.pending[-1], tray, det, "new")
            return False
        free.discard(k)
        p = tray.pending[k]
        p.quad, p.cls, p.count = quad, cls, p.count + 1
        if p.count < r.confirm_frames:
            self.say("pending", p, tray, det, "seen")
        return p.count >= r.confirm_frames

    def stickers(self, tray: Thing, found: list) -> None:
        """Detections take the best free sticker (of their class, with trays), one after another; lost ones come back if they are seen again."""
        r, old, waiting = self.rules, len(tray.stickers), len(tray.pending)
        free, open_ = set(range(old)), set(range(waiting))
        for det, cls, quad in found:
            mine = {k for k in free if r.mode == "single" or tray.stickers[k].cls == cls}
            overlaps = _overlaps(quad, tray.stickers, mine)
            k = _best(overlaps, mine, r.sticker, True)
            if k is not None:
                free.discard(k)
                s = tray.stickers[k]
                s.frozen = s.frozen + 1 if overlaps[k] >= r.frozen else 0
                s.quad, s.stable = quad, s.stable + 1
                self.met(s)
                self.say("sticker", s, tray, det, "seen")
            elif cls not in r.known or self.confirmed(tray, det, cls, quad, open_):
                tray.stickers.append(self.fresh(cls, quad))
                free.add(len(tray.stickers) - 1)  # like any other one, it may be met again in this frame
                self.say("sticker", tray.stickers[-1], tray, det, "promoted" if cls in r.known else "new")
        tray.pending = [p for k, p in enumerate(tray.pending) if k not in open_ and p.count < r.confirm_frames]
        for k in sorted(k for k in free if k < old):
            s = tray.stickers[k]
            self.unseen(s)
            if s.missing == r.sticker_missing + 1:
                self.say("sticker", s, tray, None, "lost")


def advance(view: View, rules: Rules, dets: list[tuple[int, str, list[float]]]) -> list[tuple]:
    """Rows kind, track, holder, det, status, stable, frozen, missing of one frame of a session."""
    f, r = _Frame(view, rules, dets), rules
    shown = (*r.stickers, *r.known)
    if r.mode == "single":
        if not view.trays:
            view.trays.append(f.fresh("order", []))
        tray = view.trays[0]
        f.single_tickets(tray, f.of(r.tickets))
        f.stickers(tray, f.of(shown))
        if tray.ticket and tray.ticket.missing > r.ticket_leave:
            f.say("tray", tray, None, None, "lost")
            view.trays = []
    else:
        f.place()
        for tray in view.trays:
            if not tray.missing:
                f.tickets(tray, [d for d in f.of(r.tickets) if _holds(tray.quad, d[2])])
                f.stickers(tray, [d for d in f.of(shown) if _holds(tray.quad, d[2])])
        view.trays = [t for t in view.trays if t.missing <= r.tray_missing]
    return f.rows


def tracked(detections: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Frames without a row of a session don't count as frames: give a row with a null class for each that shows nothing."""
    types = T.StructType.fromDDL(OUT)
    arrow = to_arrow_schema(types)

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, view, at, dets, out = None, View(), None, [], []

        def closed() -> None:
            if at is not None:
                out.extend((now, at, *row) for row in advance(view, rules, dets))

        for batch in batches:
            for session, frame, *det in zip(*(values(batch[c]) for c in ("session", "frame", "det", "cls", "quad")), strict=True):
                if (session, frame) != (now, at):
                    closed()
                    view = view if session == now else View()
                    now, at, dets = session, frame, []
                dets.append(tuple(det))
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in out], f.type) for k, f in enumerate(arrow)], schema=arrow)
            out = []
        closed()
        yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in out], f.type) for k, f in enumerate(arrow)], schema=arrow)

    return spread(_rows(detections), "session").sortWithinPartitions("session", "frame", "det").mapInArrow(walked, types)


#: A thing as a row of state, by its number.
THING = (
    "role string, holder long, place int, class string, quad array<double>, count int, stable int, frozen int, missing int, drift int, busy boolean, checked boolean, wrong boolean, merged boolean, "
    "gone boolean, told boolean, item string, said double, given array<string>, has_read boolean, read_number string, read_items array<string>"
)
_PLAIN = ("cls", "quad", "count", "stable", "frozen", "missing", "drift", "busy", "checked", "wrong", "merged", "gone", "told", "item", "said", "given")
_ROLES = {"extra": "extras", "sticker": "stickers", "pending": "pending"}


def packed(view: View) -> dict[int, tuple]:
    """All things in view as rows of THING."""
    things = {}

    def put(role: str, holder: int | None, place: int, x: Thing) -> None:
        things[x.track] = (role, holder, place, *(getattr(x, c) for c in _PLAIN), x.read is not None, *(x.read or (None, None)))

    for place, tray in enumerate(view.trays):
        put("tray", None, place, tray)
        if tray.ticket:
            put("ticket", tray.track, 0, tray.ticket)
        for role, name in _ROLES.items():
            for k, x in enumerate(getattr(tray, name)):
                put(role, tray.track, k, x)
    for place, c in enumerate(view.candidates):
        put("candidate", None, place, c)
    return things


def unpacked(named: int, things: dict[int, tuple]) -> View:
    view, made, trays = View(named=named), [], {}
    for track, (role, holder, place, *values) in things.items():
        plain, (has_read, number, items) = dict(zip(_PLAIN, values, strict=False)), values[len(_PLAIN) :]
        plain["quad"], plain["given"] = list(plain["quad"]), list(plain["given"])
        made.append((role, holder, place, Thing(track, **plain, read=(number, None if items is None else list(items)) if has_read else None)))
    made.sort(key=lambda m: m[2])
    for role, _, _, x in made:
        if role == "tray":
            view.trays.append(x)
            trays[x.track] = x
        elif role == "candidate":
            view.candidates.append(x)
    for role, holder, _, x in made:
        if role == "ticket":
            trays[holder].ticket = x
        elif role in _ROLES:
            getattr(trays[holder], _ROLES[role]).append(x)
    return view


def loaded(state: MapState) -> dict[int, tuple]:
    return {k[0]: tuple(v) for k, v in state.iterator()}


def replaced(state: MapState, before: dict[int, tuple], after: dict[int, tuple]) -> None:
    """Writes what has changed, and removes what has left."""
    for k in before.keys() - after.keys():
        state.removeKey((k,))
    for k, v in after.items():
        if before.get(k) != v:
            state.updateValue((k,), v)


class _Tracker(StatefulProcessor):
    def __init__(self, rules: Rules):
        self.rules, self.names = rules, T.StructType.fromDDL(OUT).names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.named = handle.getValueState("named", "named long")
        self.things = handle.getMapState("things", "track long", THING)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = loaded(self.things)
        view = unpacked(self.named.get()[0] if self.named.exists() else 0, before)
        out, row = [], Row(*self.names)
        for frame, own in groupby(sorted(rows, key=lambda r: (r["frame"], r["det"] or 0)), key=lambda r: r["frame"]):
            out += [row(key[0], frame, *e) for e in advance(view, self.rules, [(r["det"], r["class"], r["quad"]) for r in own])]
        self.named.update((view.named,))
        replaced(self.things, before, packed(view))
        return iter(out)


def stream_tracked(detections: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The same over a stream, with a row of state for each thing in view. All detections of a frame come in one batch; within a
    batch frames are put in order, batches follow each other. Needs a state store that has several states (streaming/runner.py)."""
    return _rows(detections).withColumnRenamed("cls", "class").groupBy("session").transformWithState(_Tracker(rules), OUT, "append", "None")


def tickets_by_place(detections: DataFrame, roi: list[float], inside: bool, tickets: tuple[str, ...] = Rules.tickets) -> DataFrame:
    """Without the tickets whose centre lies on the wrong side of a convex area: with a preset area they must lie in it, with a single order outside; all else stays."""
    holds = G.contains_centre(F.array(*map(F.lit, roi)), F.col("quad"))
    return detections.where(~F.coalesce(F.col("cls").isin(*tickets), F.lit(False)) | F.coalesce(holds if inside else ~holds, F.lit(False)))


def results_of(results: DataFrame, rows: DataFrame, detections: DataFrame, least: float = 0.1) -> DataFrame:
    """results (session, frame, quad, others) with the thing of that frame that each belongs to: the first one by track, of tickets,
    extra tickets and stickers, that the box of the result overlaps enough; results without one go."""
    seen = rows.where(F.col("kind").isin("ticket", "extra", "sticker") & F.col("det").isNotNull()).select("session", "frame", "kind", "track", "holder", "det")
    boxes = seen.join(detections.select("session", "frame", "det", F.col("quad").alias("_quad")), ["session", "frame", "det"]).drop("det")
    numbered = results.withColumn("_of", F.struct(*results.columns))
    near = numbered.join(boxes, ["session", "frame"]).withColumn("_iou", quad_iou(F.col("quad"), F.col("_quad"))).where(F.col("_iou") > least)
    return near.groupBy("_of").agg(F.min(F.struct("track", "kind", "holder")).alias("t")).select("_of.*", "t.track", "t.kind", "t.holder")


def _rows(detections: DataFrame) -> DataFrame:
    return detections.select(F.col("session").cast("long").alias("session"), F.col("frame").cast("long").alias("frame"), F.col("det").cast("long").alias("det"), "cls", "quad")
