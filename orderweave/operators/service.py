"""One run from what a camera sees, and what is read of it, to events, tasks and records.

Four kinds of rows about a session meet in one feed: commands, results of a recogniser, detections, and frames without any.
Within a frame commands come first, then results, then detections. Each frame goes through

1. commands: reset of one tray (a: it is forgotten, b: it begins anew at its place) or of all, and change of mode; what was
   read but not yet looked at is dropped;
2. results, which count only while what they are of is being checked;
3. tracking (tracking.py), whose things also know whether they are being read, are checked, or are gone;
4. things that are known by sight, wrong things that have left, further tickets that have left, and wrong things that are said again;
5. departure, with a record;
6. admission: a recogniser reads one thing at a time. Everything that is ready and unread waits; of that, trays in order,
   tickets before stickers before further tickets, the first one is read, and is busy until its result comes. What
   couldn't be read has to settle again and is read again. A result that is late, repeated or of something else than what
   is being read doesn't count; one that doesn't come for `patience` seconds counts as unreadable.

Time goes on without frames too: a wrong thing is said again every `again` seconds, and a session from which nothing comes
for `silence` seconds has left, with all its orders; then nothing of it is kept. Both happen at the moment when they are due, so
it makes no difference whether the next frame finds them due or a timer.

`Line.step` takes a frame, `Line.until` lets time go on. The batch form walks through sorted sessions with them; the stream
keeps them as typed states, a row for each tray and thing, between batches; both give the same rows however the input is cut.

Commands have what (reset or mode), cls (a, b, all; or the mode) and, for one tray, order. Results have what, order and quad of the task, as
it was put out, with number and items that were read. Detections have cls and quad, and number and items that would be read.
A frame of a session without any of these is a row of kind frame.

Output, in the order of `frame` and `n` within a session: at, at, order, status, items (item, n), checked (the same, of records), number,
what and quad (of tasks), started (frame, of records). Statuses: NEW_TRAY_DETECTED, TICKET_READY, ITEM_CHECKED, WRONG_ITEM_DETECTED,
TRAY_COMPLETED, TRAY_RESET, WAITING_TICKET, TRAY_REMOVED, and TASK, RECORD.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from orderweave.functions.geometry import quad_overlap, quad_overlaps
from orderweave.operators import tracking
from orderweave.operators.interim import spread, values
from orderweave.operators.tracking import Rules, Thing, View, _best, _Frame, _holds, _overlaps

BAG = "array<struct<item:string,n:long>>"
OUT = f"session long, n long, frame long, at double, order long, status string, items {BAG}, checked {BAG}, number string, what string, quad array<double>, started long"
FEED = "session long, frame long, at double, kind string, seq long, cls string, quad array<double>, number string, items array<string>, order long, what string"
MODES = ("tray", "single", "preset_roi")
_KINDS = {"command": 0, "result": 1, "frame": 2, "det": 2}
_WAITING, _READING, _OPEN, _CHECKING, _DONE = "WAITING_TICKET", "CHECKING_TICKET", "WAITING_STICKERS", "CHECKING_STICKERS", "COMPLETED"


@dataclass(frozen=True)
class Service:
    """tracking: rules, whose mode is the one that sessions begin with. area: four corners; in mode preset_roi tickets must lie within, in mode
    single without. settled, margin: sightings in a row until a thing is read, and how many more until one known by sight is
    wrong. delay: frames until what a detection's row says would be read is the result; None: results come as rows. smallest: side of a box that
    can be read. again, silence, patience: seconds; see above.
    """

    tracking: Rules = Rules()
    area: tuple[float, ...] | None = None
    settled: int = 6
    margin: int = 10
    delay: int | None = None
    smallest: float = 10.0
    overlap: float = 0.1
    again: float = 1.5
    silence: float = 60.0
    patience: float = 30.0


@dataclass
class Order:
    """What is known of a tray's order; expected and checked are bags in the order in which items came."""

    state: str = _WAITING
    number: str | None = None
    started: int = 0
    expected: list[str] = field(default_factory=list)
    checked: list[str] = field(default_factory=list)

    def remaining(self) -> Counter:
        return Counter(self.expected) - Counter(self.checked)

    def all_there(self) -> bool:
        return bool(self.expected) and len(self.checked) == len(self.expected)


@dataclass
class Task:
    """What is being read: its result is due at frame `due` if the feed's own readings are used."""

    order: int
    what: str
    quad: list[float]
    due: int = 0
    asked: float = 0.0
    number: str | None = None
    items: list[str] | None = None


def _bag(items: Iterable[str]) -> list[dict]:
    return [{"item": i, "n": n} for i, n in Counter(items).items()]


def _size(quad: list[float]) -> float:
    """The shorter side."""
    edge = lambda a, b: ((quad[2 * a] - quad[2 * b]) ** 2 + (quad[2 * a + 1] - quad[2 * b + 1]) ** 2) ** 0.5
    return min(edge(0, 1), edge(1, 2))


class _Seen(_Frame):
    """Tracking of one frame, for things that may be busy, checked or gone."""

    def __init__(self, line: Line, rules: Rules, dets: list[tuple]):
        super().__init__(line.view, rules, [d[:3] for d in dets])
        self.readings = {d[0]: d[3:] for d in dets}
        self.begun: list[Thing] = []

    def say(self, kind: str, thing: Thing, holder: Thing | None, det: int | None, status: str) -> None:
        if det is not None:
            thing.read = self.readings[det]
        if (kind, status) == ("tray", "promoted"):
            self.begun.append(thing)

    def met(self, thing: Thing) -> None:
        thing.missing, thing.gone, thing.told = 0, False, False

    def unseen(self, sticker: Thing) -> None:
        if not sticker.checked and not sticker.busy:
            sticker.stable = 0
        if not sticker.busy:
            sticker.missing, sticker.frozen = sticker.missing + 1, 0
        sticker.gone = sticker.gone or sticker.missing > self.rules.sticker_missing

    def stickers(self, tray: Thing, found: list) -> None:
        super().stickers(tray, found)
        tray.stickers = [s for s in tray.stickers if not (s.gone and s.told)]

    def single_tickets(self, tray: Thing, found: list) -> None:
        """As without recognition; but where the first ticket is out of sight, a further one that counts and is in sight takes its
        place, and the first one goes on among the further ones. A ticket that is being read isn't missed."""
        r, seen, met = self.rules, False, set()
        for det, cls, quad in found:
            if tray.ticket and quad_overlap(quad, tray.ticket.quad) > r.single_ticket:
                tray.ticket.quad, tray.ticket.stable, tray.ticket.missing, seen = quad, tray.ticket.stable + 1, 0, True
                self.say("ticket", tray.ticket, tray, det, "seen")
                continue
            free = {k for k, e in enumerate(tray.extras) if e.track not in met}
            k = _best(_overlaps(quad, tray.extras, free), free, r.single_ticket, True)
            if k is not None:
                e = tray.extras[k]
                e.quad, e.stable, e.missing = quad, e.stable + 1, 0
            elif tray.ticket is None:
                e = tray.ticket = self.fresh(cls, quad)
                seen = True
                self.begun.append(tray)
            else:
                e = self.fresh(cls, quad)
                tray.extras.append(e)
            met.add(e.track)
            self.say("extra", e, tray, det, "seen")
        if tray.ticket and not seen:
            heir = next((e for e in tray.extras if e.merged and e.track in met), None)
            if heir:
                old, tray.ticket = tray.ticket, heir
                tray.extras = [e for e in tray.extras if e is not heir]
                if old.given:
                    old.merged = True
                    tray.extras.append(old)
            elif not tray.ticket.busy:
                tray.ticket.stable, tray.ticket.missing = 0, tray.ticket.missing + 1
        for e in tray.extras:
            if e.track not in met:
                if not e.busy:
                    e.stable, e.missing = 0, e.missing + 1
                e.gone = e.gone or e.missing > r.sticker_missing
        tray.extras = [e for e in tray.extras if not (e.gone and e.told)]


@dataclass
class Line:
    """All that is known of a session."""

    mode: str = "tray"
    view: View = field(default_factory=View)
    orders: dict[int, Order] = field(default_factory=dict)
    task: Task | None = None
    n: int = 0
    frame: int | None = None
    at: float = 0.0

    def empty(self) -> bool:
        return self.frame is None

    # What comes of a frame

    def step(self, s: Service, frame: int, at: float, rows: list[tuple]) -> list[tuple]:
        """rows of one frame, in order: kind, seq, cls, quad, number, items, order, what. Gives rows of OUT without the session."""
        out = self.until(s, at)
        if self.empty():
            self.mode = s.tracking.mode
        self.frame, self.at = frame, at
        commands, results, dets = [], [], []
        for kind, seq, cls, quad, number, items, order, what in rows:
            if kind == "command":
                commands.append((what, cls, order))
            elif kind == "result":
                results.append((order, what, quad, number, items))
            elif cls is not None:
                dets.append((seq, cls, quad, number, items))
        drained = False
        for command, kind, order in commands:
            drained |= self._command(s, command, kind, order, out)
        if t := self.task:
            if s.delay is not None:
                results = [(t.order, t.what, t.quad, t.number, t.items)] if frame >= t.due else []
            elif at - t.asked > s.patience:
                results.append((t.order, t.what, t.quad, None, None))
        for result in results:
            if self.task and result[:3] == (self.task.order, self.task.what, self.task.quad):
                self.task = None
                if not drained:
                    self._result(s, *result, out)
        self._track(s, dets, out)
        for tray in self.view.trays:
            self._known(s, tray, out)
        for tray in self.view.trays:
            self._wrong_left(tray, out)
        for tray in self.view.trays:
            self._extras_left(tray, out)
        self._again(s, at, out)
        waiting = self._waiting(s)
        self._depart(s, out)
        self._admit(s, waiting, out)
        return out

    def until(self, s: Service, at: float) -> list[tuple]:
        """What is due up to a moment without a frame."""
        out: list[tuple] = []
        while (due := self.due(s)) is not None and due <= at:
            if due >= self.at + s.silence:
                for tray in list(self.view.trays):
                    self._leave(tray, out, due)
                for name, value in vars(Line()).items():
                    setattr(self, name, value)
            else:
                self._again(s, due, out)
        return out

    def due(self, s: Service) -> float | None:
        """When something happens if no frame comes."""
        if self.empty():
            return None
        said = [x.said + s.again for t in self.view.trays for x in t.stickers if x.wrong and not x.gone]
        return min([self.at + s.silence, *said])

    def _say(self, out: list[tuple], order: int, status: str, items: list[dict] | None = None, *, at: float | None = None, checked=None, number=None, what=None, quad=None, started=None) -> None:
        out.append((self.n, self.frame, self.at if at is None else at, order, status, items or [], checked or [], number, what, quad, started))
        self.n += 1

    # Steps

    def _single(self) -> bool:
        return self.mode != "tray"

    def _order(self, tray: Thing) -> Order:
        if tray.track not in self.orders:
            self.orders[tray.track] = Order(started=self.frame)
        return self.orders[tray.track]

    def _begin_anew(self, tray: Thing, out: list[tuple]) -> None:
        """The order of a tray begins anew at its place."""
        order = self._order(tray)
        keep = {"number": order.number} if not self._single() else {}
        self.orders[tray.track] = Order(started=self.frame, **keep)
        tray.ticket, tray.stickers, tray.missing, tray.drift = None, [], 0, 0
        if self._single():
            tray.extras = []
            self._say(out, tray.track, "TRAY_RESET")
            self._say(out, tray.track, "WAITING_TICKET")
        else:
            tray.pending = []

    def _command(self, s: Service, command: str, kind: str | None, order: int | None, out: list[tuple]) -> bool:
        """Whether results that wait are dropped."""
        if command == "mode":
            if kind not in MODES or kind == self.mode:
                return False
            self.mode, self.view, self.orders = kind, View(named=self.view.named), {}
            return True
        if command != "reset" or kind not in ("a", "b", "all") or kind != "all" and order is None:
            return False
        for tray in list(self.view.trays):
            if kind == "all" or self._single() or tray.track == order:
                if kind == "b":
                    self._begin_anew(tray, out)
                else:
                    self.view.trays.remove(tray)
                    self.orders.pop(tray.track, None)
                    if self._single():
                        self._say(out, tray.track, "TRAY_RESET")
                        self._say(out, tray.track, "WAITING_TICKET")
        return True

    def _result(self, s: Service, number_of: int | None, what: str, quad: list[float], number: str | None, items: list[str] | None, out: list[tuple]) -> None:
        tray = next((t for t in self.view.trays if t.track == number_of), None)
        if tray is None:
            return
        order, items = self._order(tray), [i for i in items or [] if i is not None]
        if what == "ticket" and order.state == _READING:
            self._ticket_read(tray, order, number, items, out)
        elif what == "extra":
            self._extra_read(s, tray, order, quad, number, items, out)
        elif what == "sticker" and order.state == _CHECKING:
            thing = next((x for x in self._near(tray.stickers, quad, s)), None)
            if thing:
                thing.busy = False
            item = items[0] if items and order.remaining() else None
            self._settle(tray, order, thing, item, item is not None and order.remaining()[item] > 0, self.at, out)

    def _near(self, things: list[Thing], quad: list[float], s: Service) -> list[Thing]:
        return [x for x, iou in zip(things, quad_overlaps([quad], [x.quad for x in things])[0], strict=True) if iou > s.overlap]

    def _ticket_read(self, tray: Thing, order: Order, number: str | None, items: list[str], out: list[tuple]) -> None:
        ticket = tray.ticket
        if ticket:
            ticket.busy = False
        if items:
            order.expected, order.number, order.state = list(items), number or "000", _OPEN
            if ticket:
                ticket.given, ticket.merged = list(items), True
            self._say(out, tray.track, "TICKET_READY", _bag(order.expected), number=order.number)
        else:
            order.state = _WAITING
            if ticket:
                ticket.stable = 0
            if self._single():  # so that it is announced anew
                tray.ticket = None

    def _extra_read(self, s: Service, tray: Thing, order: Order, quad: list[float], number: str | None, items: list[str], out: list[tuple]) -> None:
        extra = next(iter(self._near(tray.extras, quad, s)), None)
        if extra is None:
            return
        extra.busy = False
        if number is None or number != order.number:
            tray.extras.remove(extra)
            return
        order.expected, extra.given, extra.merged = order.expected + items, list(items), True
        if order.state == _DONE:
            order.state = _OPEN
        self._say(out, tray.track, "TICKET_READY", _bag(order.expected), number=order.number)

    def _settle(self, tray: Thing, order: Order, thing: Thing | None, item: str | None, right: bool, at: float, out: list[tuple]) -> None:
        """What follows from knowing a sticker's item (None: it couldn't be read)."""
        if thing and right:
            thing.checked, thing.item = True, item
        elif thing:
            thing.stable = 0
            if item is not None:
                thing.wrong, thing.item, thing.said = True, item, at
        if right:
            order.checked.append(item)
            self._say(out, tray.track, "ITEM_CHECKED", _bag(order.checked), number=order.number)
            if len(order.checked) == len(order.expected) and not any(x.wrong for x in tray.stickers):
                self._completed(tray, order, out)
        elif item is not None:
            self._say(out, tray.track, "WRONG_ITEM_DETECTED", _bag([item]), number=order.number)
        if order.state != _DONE:
            order.state = _OPEN

    def _completed(self, tray: Thing, order: Order, out: list[tuple]) -> None:
        order.state = _DONE
        self._say(out, tray.track, "TRAY_COMPLETED", _bag(order.checked), number=order.number)

    def _track(self, s: Service, dets: list[tuple], out: list[tuple]) -> None:
        mode = "single" if self._single() else "tray"
        rules = s.tracking if s.tracking.mode == mode else replace(s.tracking, mode=mode)
        if s.area and self._single():
            dets = [d for d in dets if d[1] not in rules.tickets or _holds(list(s.area), d[2]) == (self.mode == "preset_roi")]
        f = _Seen(self, rules, dets)
        shown = (*rules.stickers, *rules.known)
        if self._single():
            if not self.view.trays:
                self.view.trays.append(f.fresh("order", []))
            self._order(self.view.trays[0])
            f.single_tickets(self.view.trays[0], f.of(rules.tickets))
            f.stickers(self.view.trays[0], f.of(shown))
        else:
            f.place()
            for tray in self.view.trays:
                self._order(tray)
                if not tray.missing:
                    f.tickets(tray, [d for d in f.of(rules.tickets) if _holds(tray.quad, d[2])])
                    f.stickers(tray, [d for d in f.of(shown) if _holds(tray.quad, d[2])])
        for tray in f.begun:
            self._say(out, tray.track, "NEW_TRAY_DETECTED", quad=tray.quad or None)

    def _known(self, s: Service, tray: Thing, out: list[tuple]) -> None:
        """Things known by sight: right ones count once they have settled, others are wrong only after some more frames."""
        order = self._order(tray)
        if order.state != _OPEN:
            return
        for x in tray.stickers:
            item = s.tracking.known.get(x.cls)
            if item is None or x.checked:
                continue
            right = order.remaining()[item] > 0
            if x.stable >= s.settled + (0 if right else s.margin):
                self._settle(tray, order, x, item, right, self.at, out)

    def _wrong_left(self, tray: Thing, out: list[tuple]) -> None:
        left = [x for x in tray.stickers if x.wrong and x.gone and not x.told]
        for x in left:
            x.told = True
        order = self._order(tray)
        if left and order.state == _OPEN and order.all_there() and not any(x.wrong and not x.told for x in tray.stickers):
            self._completed(tray, order, out)

    def _extras_left(self, tray: Thing, out: list[tuple]) -> None:
        for e in tray.extras:
            if not e.gone or e.told:
                continue
            e.told = True
            if not e.merged or not e.given:
                continue
            order, less = self._order(tray), Counter(e.given)
            kept = []
            for item in order.expected:
                if less[item] > 0:
                    less[item] -= 1
                else:
                    kept.append(item)
            order.expected = kept
            self._say(out, tray.track, "TICKET_READY", _bag(kept), number=order.number)
            if order.state != _DONE and order.all_there() and not any(x.wrong for x in tray.stickers):
                self._completed(tray, order, out)

    def _again(self, s: Service, at: float, out: list[tuple]) -> None:
        for tray in self.view.trays:
            for x in tray.stickers:
                if x.wrong and not x.gone and at - x.said >= s.again - 1e-9:
                    x.said = at
                    self._say(out, tray.track, "WRONG_ITEM_DETECTED", _bag([x.item]), at=at, number=self._order(tray).number)

    def _waiting(self, s: Service) -> list[tuple[Thing, str, Thing]]:
        """What may be read, in the order in which it is."""
        ready = lambda x: x.stable >= s.settled and not x.busy
        out = []
        for tray in self.view.trays:
            state = self._order(tray).state
            if state == _WAITING and tray.ticket and ready(tray.ticket):
                out.append((tray, "ticket", tray.ticket))
            elif state == _OPEN:
                out += [(tray, "sticker", x) for x in tray.stickers if x.cls not in s.tracking.known and ready(x) and not x.checked][:1]
            if state in (_OPEN, _CHECKING, _DONE):
                out += [(tray, "extra", x) for x in tray.extras if ready(x) and not x.merged][:1]
        return out

    def _admit(self, s: Service, waiting: list[tuple[Thing, str, Thing]], out: list[tuple]) -> None:
        waiting = [w for w in waiting if w[0] in self.view.trays and _size(w[2].quad) >= s.smallest]
        if self.task or not waiting:
            return
        tray, what, thing = waiting[0]
        number, items = thing.read or (None, None)
        self.task = Task(tray.track, what, thing.quad, self.frame + (s.delay or 0), self.at, number, items)
        order, thing.busy = self._order(tray), True
        order.state = {"ticket": _READING, "sticker": _CHECKING}.get(what, order.state)
        self._say(out, tray.track, "TASK", what=what, quad=thing.quad)

    def _depart(self, s: Service, out: list[tuple]) -> None:
        for tray in list(self.view.trays):
            if tray.ticket is not None and tray.ticket.missing > s.tracking.ticket_leave if self._single() else tray.missing > s.tracking.tray_missing:
                self._leave(tray, out)

    def _leave(self, tray: Thing, out: list[tuple], at: float | None = None) -> None:
        order = self._order(tray)
        if not self._single() or tray.ticket or order.expected:
            self._say(out, tray.track, "RECORD", _bag(order.expected), checked=_bag(order.checked), number=order.number, started=order.started, at=at)
            if self._single():
                self._say(out, tray.track, "TRAY_RESET", at=at)
                self._say(out, tray.track, "WAITING_TICKET", at=at)
            self._say(out, tray.track, "TRAY_REMOVED", number=order.number, at=at)
        self.view.trays.remove(tray)
        self.orders.pop(tray.track)


def _frames(rows: Iterable[tuple]) -> Iterator[tuple[int, float, list[tuple]]]:
    """rows: frame, at, kind, ...: by frame, those of a frame in order."""
    for frame, own in groupby(rows, key=lambda r: r[0]):
        own = list(own)
        yield frame, max(r[1] for r in own), [r[2:] for r in own]


def _sorted_feed(feed: DataFrame) -> tuple[DataFrame, list[Column]]:
    types = T.StructType.fromDDL(FEED)
    rank = F.coalesce(F.element_at(F.create_map(*(F.lit(v) for p in _KINDS.items() for v in p)), F.col("kind")), F.lit(2))
    return feed.select(*(F.col(f.name).cast(f.dataType) for f in types), rank.alias("rank")), [F.col("session"), F.col("frame"), F.col("rank"), F.col("seq")]


_COLUMNS = ("frame", "at", "kind", "seq", "cls", "quad", "number", "items", "order", "what")


def events(feed: DataFrame, service: Service = Service(), until: float | None = None) -> DataFrame:
    """Rows of OUT for a feed with the columns FEED. until: the moment up to which time goes on after a session's last frame."""
    types = T.StructType.fromDDL(OUT)
    arrow = to_arrow_schema(types)

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, line, at, rows, out = None, Line(), None, [], []

        def closed() -> None:
            for frame, seconds, own in _frames(rows):
                out.extend((now, *e) for e in line.step(service, frame, seconds, own))

        def ended() -> None:
            if until is not None:
                out.extend((now, *e) for e in line.until(service, until))

        for batch in batches:
            for session, *row in zip(*(values(batch[c]) for c in ("session", *_COLUMNS)), strict=True):
                if (session, row[0]) != (now, at):
                    closed()
                    if session != now:
                        ended()
                        line = Line()
                    now, at, rows = session, row[0], []
                rows.append(tuple(row))
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in out], f.type) for k, f in enumerate(arrow)], schema=arrow)
            out = []
        closed()
        ended()
        yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in out], f.type) for k, f in enumerate(arrow)], schema=arrow)

    rows, order = _sorted_feed(feed)
    return spread(rows, "session").sortWithinPartitions(*order).drop("rank").mapInArrow(walked, types)


# The same as a stream

_HEAD = "mode string, named long, n long, frame long, at double, task_order long, task_what string, task_quad array<double>, task_due long, task_asked double, task_number string, task_items array<string>"
_ORDER = "state string, number string, started long, expected array<string>, checked array<string>"


def packed(line: Line) -> tuple[tuple, dict[int, tuple], dict[int, tuple]]:
    """A session's rows of _HEAD, and of _ORDER and tracking.THING by number."""
    t = line.task
    head = (line.mode, line.view.named, line.n, line.frame, line.at, *((t.order, t.what, t.quad, t.due, t.asked, t.number, t.items) if t else (None,) * 7))
    return head, {k: (o.state, o.number, o.started, o.expected, o.checked) for k, o in line.orders.items()}, tracking.packed(line.view)


def unpacked(head: tuple, orders: dict[int, tuple], things: dict[int, tuple]) -> Line:
    mode, named, n, frame, at, *task = head
    known = {k: Order(state, number, started, list(expected), list(checked)) for k, (state, number, started, expected, checked) in orders.items()}
    line = Line(mode, tracking.unpacked(named, things), known, None, n, frame, at)
    if task[0] is not None:
        line.task = Task(task[0], task[1], list(task[2]), *task[3:6], None if task[6] is None else list(task[6]))
    return line


class Processor(StatefulProcessor):
    """A session's frames, with a timer for what is due next. What hasn't changed isn't written, and what has left is removed."""

    def __init__(self, service: Service):
        self.service, self.names = service, T.StructType.fromDDL(OUT).names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", _HEAD)
        self.orders = handle.getMapState("orders", "track long", _ORDER)
        self.things = handle.getMapState("things", "track long", tracking.THING)

    def _load(self) -> tuple[Line, tuple]:
        if not self.head.exists():
            return Line(), (None, {}, {})
        old = (tuple(self.head.get()), tracking.loaded(self.orders), tracking.loaded(self.things))
        return unpacked(*old), old

    def _save(self, line: Line, old: tuple) -> None:
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        head, orders, things = packed(line) if not line.empty() else (None, {}, {})
        if head is None:
            if old[0] is not None:
                self.head.clear()
        else:
            self.head.update(head)
            self.handle.registerTimer(int(-(-line.due(self.service) * 1000 // 1)))
        tracking.replaced(self.orders, old[1], orders)
        tracking.replaced(self.things, old[2], things)

    def _rows(self, session: int, found: list[tuple]) -> Iterator[Row]:
        row, bag = Row(*self.names), lambda b: [Row(**e) for e in b]
        for n, frame, at, order, status, items, checked, *rest in found:
            yield row(session, n, frame, at, order, status, bag(items), bag(checked), *rest)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        line, old = self._load()
        own = sorted(rows, key=lambda r: (r["frame"], r["rank"], r["seq"] or 0))
        found = []
        for frame, at, frame_rows in _frames([tuple(r[c] for c in _COLUMNS) for r in own]):
            found += line.step(self.service, frame, at, frame_rows)
        self._save(line, old)
        return self._rows(key[0], found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        line, old = self._load()
        found = line.until(self.service, timerValues.getCurrentWatermarkInMs() / 1000)
        self._save(line, old)
        return self._rows(key[0], found)


def stream_events(feed: DataFrame, service: Service = Service(), late: str = "0 seconds") -> DataFrame:
    """The same over a stream, in append mode. All rows of a frame come in one batch; batches of a session follow each other, and rows of other
    sessions may lag by `late`. Needs a state store that has several states: spark.sql.streaming.stateStore.providerClass."""
    rows, _ = _sorted_feed(feed)
    timed = rows.withColumn("_moment", F.timestamp_micros((F.col("at") * 1_000_000).cast("long"))).withWatermark("_moment", late)
    return timed.groupBy("session").transformWithState(Processor(service), OUT, "append", "EventTime")


def fanned(commands: DataFrame, sessions: DataFrame) -> DataFrame:
    """Commands of FEED for all sessions (those with a null session) as one row for each of the known sessions; others stay as they are."""
    names = [c for c in commands.columns if c != "session"]
    each = commands.where("session is null").select(F.lit(1).alias("_k"), *names).join(sessions.select("session").withColumn("_k", F.lit(1)), "_k")
    return commands.where("session is not null").unionByName(each.select(commands.columns))


def records(out: DataFrame) -> DataFrame:
    """session, order, number, start_frame, end_frame, expected, expected_count (distinct items), checked of the orders that left."""
    rows = out.where("status = 'RECORD'")
    return rows.select("session", "order", "number", F.col("started").alias("start_frame"), F.col("frame").alias("end_frame"), F.col("items").alias("expected"), F.size("items").cast("long").alias("expected_count"), "checked")
