"""Tickets: from recognised text boxes to ordered items.

Input are boxes: ticket, pos (reading order), quad (x1, y1, ... x4, y4, clockwise from the upper left), text, score; for tickets that stand on their
head also flipped, and width of the picture: their boxes are in reverse order, the item area lies above its anchors, and texts go from right to left. All
that is said of a whole ticket (its skew, its headers, its order number) is a window over its boxes, which are few, and rows of text
are written in a walk over them; everything runs over one exchange by ticket, and only distinct row texts meet the menu.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderweave.functions import geometry as G
from orderweave.functions import text as X
from orderweave.operators import matching, runs
from orderweave.operators.interim import filed, values, written


@dataclass(frozen=True)
class Layout:
    """What a ticket's headers say and how far things may be apart."""

    # Texts of the deployed forms.
    area_header: str = "ティクアウト"
    count_header: str = "数"
    synonyms: dict[str, str] = field(default_factory=lambda: {"枚": "数"})
    prefixes: tuple[str, ...] = ("ねぎ",)
    header_score: float = 60.0
    box_score: float = 0.5
    prefix_score: float = 0.3
    left: float = 30.0
    right: float = 40.0


def _of_ticket(value: Column) -> Column:
    return value.over(W.partitionBy("ticket"))


def skew(rows: DataFrame, most_spread: float = 15.0, most: float = 30.0) -> DataFrame:
    """With theta (radians) and pivot px, py of each ticket: the median angle of the boxes' upper edges, or 0 if the angles
    are spread too far or the median is too large."""
    q = F.col("quad")
    dx, dy = F.get(q, F.lit(2)) - F.get(q, F.lit(0)), F.get(q, F.lit(3)) - F.get(q, F.lit(1))
    angle = F.when((dx != 0) | (dy != 0), F.atan2(dy, dx))
    rows = rows.withColumns({"_angle": angle, "_x": _middle(q, 0), "_y": _middle(q, 1)})
    # All in one step, which is one window for Spark.
    of = {"_median": F.median("_angle"), "_spread": F.stddev_pop("_angle"), "px": F.avg("_x"), "py": F.avg("_y")}
    rows = rows.withColumns({k: _of_ticket(v) for k, v in of.items()})
    straight = (F.degrees("_spread") > most_spread) | (F.abs(F.degrees("_median")) > most)
    theta = F.when(straight, 0.0).otherwise(F.coalesce("_median", F.lit(0.0)))
    return rows.withColumn("theta", theta).drop("_angle", "_x", "_y", "_median", "_spread")


def _middle(quad: Column, odd: int) -> Column:
    """The mean of a box's x (0) or y (1). Of eight numbers it is compiled, as functions of an array's elements aren't."""
    whole = F.aggregate(F.filter(quad, lambda _, i: i % 2 == odd), F.lit(0.0), lambda t, v: t + v)
    return F.when(F.size(quad) == 8, sum((F.get(quad, F.lit(k)) for k in range(odd, 8, 2)), F.lit(0.0))).otherwise(whole) / 4


def levelled(rows: DataFrame) -> DataFrame:
    """With cx, cy, x_min, x_max, h of each box after its ticket's skew is taken out."""
    turn = rows.withColumns({"_cos": F.cos(-F.col("theta")), "_sin": F.sin(-F.col("theta"))})
    c, s, px, py = F.col("_cos"), F.col("_sin"), F.col("px"), F.col("py")
    at = [(F.get("quad", F.lit(2 * k)) - px, F.get("quad", F.lit(2 * k + 1)) - py) for k in range(4)]
    at = {f"_{n}{k}": v for k, (dx, dy) in enumerate(at) for n, v in (("x", px + dx * c - dy * s), ("y", py + dx * s + dy * c))}
    x, y = ([F.col(f"_{n}{k}") for k in range(4)] for n in "xy")
    high = F.abs(F.least(y[2], y[3]) - F.greatest(y[0], y[1]))
    out = turn.withColumns(at).withColumns({"cx": sum(x[1:], x[0]) / 4, "cy": sum(y[1:], y[0]) / 4, "x_min": F.least(*x), "x_max": F.greatest(*x), "h": high})
    return out.drop("_cos", "_sin", *at)


def _says(text: Column, header: str, least: float) -> Column:
    """Whether a text is a header: as one of its words, or by its similarity. Most texts have none of its characters or are
    too long or short to be alike, which is soon seen; only the others are split and folded, which isn't compiled."""
    n, m = len(header), F.length(text)
    shared = F.lit(least < 0)
    for c in dict.fromkeys(header):
        shared = shared | F.contains(text, F.lit(c))
    alike = F.when(shared & (200.0 * F.least(F.lit(n), m) / (n + m) > least), X.ratio_to(text, header) > least)
    word = F.when(F.contains(text, F.lit(header)), F.array_contains(F.split(text, r"\s+"), header))
    return F.coalesce(word, F.lit(False)) | F.coalesce(alike, F.lit(False))


def read(boxes: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """The boxes within the item area (inside) and, wherever they are, those that are numbers (number, raw: what they say), levelled, with what
    their ticket says: order_number, count_at (where the quantity column lies, null without one), theta, px, py.

    The area begins below the last of two anchors: the first order number, and area headers.
    """
    sure = F.col("score") >= layout.box_score
    clean, named = F.col("_clean"), F.col("_named")
    synonym = F.coalesce(F.try_element_at(F.create_map(*(F.lit(v) for p in layout.synonyms.items() for v in p)), clean), clean) if layout.synonyms else clean
    boxes = boxes.withColumn("flipped", F.coalesce("flipped", F.lit(False)) if "flipped" in boxes.columns else F.lit(False))
    boxes = boxes.withColumn("pos", F.when(F.col("flipped"), -F.col("pos")).otherwise(F.col("pos")))
    width = F.col("width") if "width" in boxes.columns else F.lit(None).cast("double")
    # What is used several times is a column of its own, or Spark computes it again for each use.
    rows = levelled(skew(boxes)).withColumn("_clean", X.stripped(F.col("text")))
    rows = rows.withColumns({"_named": synonym, "_ends": sure & X.ends_with_digit(clean)})
    number = F.when(F.col("_ends"), X.order_number(clean))
    says = lambda h: F.coalesce(sure & _says(named, h, layout.header_score), F.lit(False))
    rows = rows.withColumns({"_number": number, "_area": says(layout.area_header), "_count": says(layout.count_header)})
    first = _of_ticket(F.min(F.when(F.col("_number").isNotNull(), F.struct("pos", "_number", "x_min", "x_max", "cy"))))
    header = _of_ticket(F.max(F.when(F.col("_area"), F.struct("pos", "x_min", "x_max", "cy"))))
    count = _of_ticket(F.max(F.when(F.col("_count"), F.struct("pos", "cx"))))
    digit = F.col("_ends") & X.only_digits(clean)
    rows = rows.withColumns({"_first": first, "_header": header, "count_at": count["cx"], "number": F.when(digit, X.first_number(clean)), "raw": F.when(digit, clean)})
    by_header = F.col("_header").isNotNull() & (F.col("_first").isNull() | (F.col("_header.pos") >= F.col("_first.pos")))
    flipped = F.col("flipped")
    top = F.when(by_header, F.col("_header.cy")).otherwise(F.col("_first.cy") + F.when(flipped, -100).otherwise(100))
    left = F.when(by_header, F.col("_header.x_min")).when(flipped, F.col("_first.x_min") + 60).otherwise(F.lit(80.0))
    right = F.when(by_header, F.col("_header.x_max")).when(flipped, width - 80).otherwise(F.col("_first.x_max") - 60)
    before, after = F.when(flipped, layout.right).otherwise(layout.left), F.when(flipped, layout.left).otherwise(layout.right)
    below = F.when(flipped, F.col("cy") <= top).otherwise(F.col("cy") >= top)
    prefixed = F.lit(False)
    for p in layout.prefixes:
        prefixed = prefixed | F.col("text").startswith(p)
    scored = F.col("score") >= F.when(prefixed, layout.prefix_score).otherwise(layout.box_score)
    inside = top.isNull() | (below & (F.col("cx") >= left - before) & (right.isNull() | (F.col("cx") <= right + after)))
    rows = rows.withColumn("inside", F.coalesce(scored & inside, F.lit(False))).where(F.col("inside") | F.col("raw").isNotNull())
    return rows.withColumn("order_number", F.col("_first._number")).drop("_clean", "_named", "_ends", "_number", "_area", "_count", "_first", "_header")


def rows_of(boxes: DataFrame, whole: list[str] | None = None, ways: int | None = None) -> DataFrame:
    """A row for each row of text: ticket, text_row, text (from left to right), cy, h, longest (height and place of its longest text), near (the number box of its ticket that is
    nearest to cy: away, pos, number, raw), and columns that hold for a whole ticket. boxes: as read gives them; if they are dealt by ticket to so many `ways` already, they stay there."""
    whole, types = [*(whole or []), "flipped"], boxes.schema
    out = T.StructType([types["ticket"], *T._parse_datatype_string("text_row int, text string, cy double, h double, longest struct<cy double, h double>, near struct<away double, pos long, number int, raw string>").fields, *(types[c] for c in whole)])
    number = [F.col(c).cast("double").alias(c) for c in ("cy", "h", "cx")]
    rows = boxes.select("ticket", F.col("pos").cast("long").alias("pos"), *number, "text", "inside", "number", "raw", *whole)
    # Boxes in order are walked through: lists of a ticket's boxes would be sorted twice more and dealt again for the groups of its rows.
    rows = rows.repartition(ways, "ticket") if ways else rows.repartition("ticket")
    return rows.sortWithinPartitions("ticket", "pos", "cy", "h", "cx", "text").mapInArrow(_written_rows(["ticket", *whole]), out)


def _written_rows(whole: list[str], share: float = 0.5):
    """Rows of text of sorted boxes, a batch at once; what is left of a batch's last ticket waits for the next one. A row has the place
    in order of its ticket, as runs.row_clusters says, and takes what holds for the whole ticket from the ticket's first box."""

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            tickets = values(batch.column("ticket"))
            if not tickets:
                continue
            last = len(tickets)  # where the batch's last ticket begins
            while last and tickets[last - 1] == tickets[-1]:
                last -= 1
            if last or held and held[0].column("ticket")[0].as_py() != tickets[0]:
                yield from finished([*held, batch.slice(0, last)])
                held = []
            held.append(batch.slice(last))
        yield from finished(held)

    def finished(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts).combine_chunks() if parts else None
        if not table:
            return
        tickets, pos, cy, h, cx, text, raw = (values(table.column(c).chunk(0)) for c in ("ticket", "pos", "cy", "h", "cx", "text", "raw"))
        inside, flipped = (values(table.column(c).chunk(0).cast(pa.int8())) for c in ("inside", "flipped"))
        said = table.column("number").chunk(0)
        at = [-x if f and x is not None else x for x, f in zip(cx, flipped, strict=True)]
        # Tuples of what Spark would compare; where something is missing it needs a place in the order.
        across, length = list(zip(at, pos, text, strict=True)), [(-1 if t is None else len(t), p and -p) for t, p in zip(text, pos, strict=True)]
        if any(table.column(c).null_count for c in ("pos", "cx", "text")) or any(x != x for x in cx):
            across, length = [[tuple(map(_ordered, key)) for key in keys] for keys in (across, length)]
        across, length = across.__getitem__, length.__getitem__
        first, number, texts, ys, heights, longest, near, before = [], [], [], [], [], [], [], object()
        rows: list[list[int]] = []
        digits: list[tuple] = []  # cy, pos, number, raw
        start = 0

        def close() -> None:
            for k, members in enumerate(rows):
                first.append(start)
                number.append(k)
                if len(members) == 1:
                    i = members[0]
                    texts.append(text[i] or "")
                    ys.append(cy[i])
                    heights.append(h[i])
                    longest.append(i)
                else:
                    members.sort(key=across)
                    texts.append("".join([text[i] for i in members if text[i] is not None]))
                    ys.append(_mean([cy[i] for i in members]))
                    heights.append(_mean([h[i] for i in members]))
                    longest.append(max(members, key=length))
                near.append(_nearest(digits, ys[-1]))

        for i, ticket in enumerate(tickets):
            if ticket != before:
                close()
                rows, digits, start, before, of = [], [], i, ticket, runs.first_near(share)
            if raw[i] is not None:
                digits.append((cy[i], pos[i], said[i].as_py(), raw[i]))
            if not inside[i]:
                continue
            k = of(cy[i], h[i])
            if k == len(rows):
                rows.append([])
            rows[k].append(i)
        close()
        there = pa.array(first, pa.int64())
        longest = table.select(["cy", "h"]).take(pa.array(longest, pa.int64())).combine_chunks()
        longest = pa.StructArray.from_arrays([longest.column(c).chunk(0) for c in ("cy", "h")], ["cy", "h"])
        fields = zip(*(n or (None,) * 4 for n in near), strict=True) if near else ((),) * 4
        kinds = (pa.float64(), pa.int64(), pa.int32(), pa.string())
        near = pa.StructArray.from_arrays([pa.array(v, k) for v, k in zip(fields, kinds, strict=True)], ["away", "pos", "number", "raw"], mask=pa.array([n is None for n in near], pa.bool_()))
        own = [table.column(c).chunk(0).take(there) for c in whole]
        made = [pa.array(number, pa.int32()), pa.array(texts, pa.string()), pa.array(ys, pa.float64()), pa.array(heights, pa.float64()), longest, near]
        yield pa.RecordBatch.from_arrays([own[0], *made, *own[1:]], [whole[0], "text_row", "text", "cy", "h", "longest", "near", *whole[1:]])

    return walked


def _ordered(value) -> tuple:
    """To sort by as Spark does: null, values, what isn't a number."""
    return (False, False, None) if value is None else (True, True, None) if value != value else (True, False, value)


def _nearest(digits: list[tuple], at: float | None) -> tuple | None:
    """away, pos, number, raw of the first of cy, pos, number, raw by how far it is from a place, and by the rest."""
    if len(digits) < 2:
        return (None if at is None or digits[0][0] is None else abs(digits[0][0] - at), *digits[0][1:]) if digits else None
    away = [(None if at is None or d[0] is None else abs(d[0] - at), *d[1:]) for d in digits]
    if all(a[0] is not None and a[0] == a[0] for a in away):
        least = min([a[0] for a in away])
        away = [a for a in away if a[0] == least]
    return away[0] if len(away) == 1 else min(away, key=lambda a: tuple(map(_ordered, a)))


def _mean(numbers: list) -> float | None:
    """Of those that are there."""
    there = [v for v in numbers if v is not None]
    return sum(there) / len(there) if there else None


#: Bytes of row texts and their names up to which these go to all tasks, so that rows of text stay where they are.
FEW_TEXTS = 16 << 20


def parsed(boxes: DataFrame, menu: DataFrame, layout: Layout = Layout(), counts: DataFrame | None = None, ways: int | None = None) -> DataFrame:
    """ticket, text_row, item, quantity, order_number ('000' without one), crop: a row for each row of text that is like a name of the menu.

    The quantity is a number that leads the text, unless the name has digits of its own; else the nearest number box
    within 0.8 of the row's height, unless such a name holds that number; where that leaves 1, the number that was read
    from the crop, if counts (ticket, text_row, text) has one. crop: cx, cy, half width, half height of
    where to read it, as turned as the ticket; null where it isn't wanted or there is no quantity column.
    menu: name, pos, names in normal form. ways: to how many tasks boxes are dealt by ticket already, if they are.
    """
    rows = filed(_placed(rows_of(read(boxes, layout), ["order_number", "count_at", "theta", "px", "py"], ways)))
    texts = written(rows.select("text").distinct().withColumn("_text", X.normalized(F.col("text"))))
    names = matching.best_name(texts.select(F.col("_text").alias("text")), menu, layout.prefixes)
    # What follows from a text and its name alone is found once for each distinct text.
    has_digits, leading = F.col("item").rlike("[1-9]"), X.leading_number(F.col("text"))
    names = texts.join(names.select(F.col("text").alias("_text"), F.col("name").alias("item")), "_text").select("text", "item", has_digits.alias("_digits"), F.when(~has_digits, leading).alias("_leading"))
    size = texts.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 100)).first()[0] or 0
    rows = rows.join(F.broadcast(names) if size <= FEW_TEXTS else names, "text")

    beside = F.when(~(F.col("_digits") & F.contains(F.col("item"), F.col("raw"))), F.col("number"))
    rows = rows.withColumns({"quantity": F.coalesce("_leading", beside, F.lit(1)), "_open": F.col("_leading").isNull() & (F.coalesce(beside, F.lit(1)) == 1)})
    rows = rows.withColumn("crop", F.when(F.col("_open"), F.col("crop")))
    if counts is not None:
        number = counts.groupBy("ticket", "text_row").agg(X.first_number(F.min("text")).alias("_read"))
        rows = rows.join(number, ["ticket", "text_row"], "left").withColumn("quantity", F.when(F.col("crop").isNotNull(), F.coalesce("_read", "quantity")).otherwise(F.col("quantity")))
    return rows.select("ticket", "text_row", "item", F.col("quantity").cast("int").alias("quantity"), F.coalesce("order_number", F.lit("000")).alias("order_number"), "crop")


def _placed(rows: DataFrame) -> DataFrame:
    """Of rows_of what is left to know until a row has its name, as whole numbers: ticket, text_row, text, order_number, number and raw (of the number box beside
    it, if one is near enough), crop (where to read its number; null without a quantity column; what lies beyond whole numbers is null)."""
    beside = F.col("near.away") < 0.8 * F.col("h")
    x, y = G.rotate(F.col("count_at"), F.col("longest.cy"), F.col("theta"), F.col("px"), F.col("py"))
    half = F.col("longest.h") / 2
    crop = {"cx": F.try_add(x.try_cast("int"), F.lit(10)), "cy": y.try_cast("int"), "half_width": half.try_cast("int"), "half_height": (half * 1.1).try_cast("int")}
    crop = F.when(F.col("count_at").isNotNull(), F.struct(*(v.alias(k) for k, v in crop.items())))
    return rows.select("ticket", "text_row", "text", "order_number", F.when(beside, F.col("near.number")).alias("number"), F.when(beside, F.col("near.raw")).alias("raw"), crop.alias("crop"))


def crop_sides(crop: Column, width: Column, height: Column) -> Column:
    """Struct left, top, right, bottom of a crop (see parsed) within the picture, in whole pixels; null where nothing of it is inside."""
    within = lambda v, most: F.least(F.greatest(v, F.lit(0)), most).cast("int")
    sides = {"left": within(crop["cx"] - crop["half_width"], width), "top": within(crop["cy"] - crop["half_height"], height), "right": within(crop["cx"] + crop["half_width"], width), "bottom": within(crop["cy"] + crop["half_height"], height)}
    return F.when((sides["right"] > sides["left"]) & (sides["bottom"] > sides["top"]), F.struct(*(v.alias(k) for k, v in sides.items())))


def _clockwise(quad: Column) -> Column:
    """clockwise of any array."""
    corner = lambda q, i: F.struct((F.get(q, 2 * i) + F.get(q, 2 * i + 1)).alias("sum"), i.alias("i"), F.get(q, 2 * i).alias("x"), F.get(q, 2 * i + 1).alias("y"))
    corners = G.bound(quad, lambda q: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: corner(q, i)))

    def ordered(p: Column) -> Column:
        last = F.aggregate(p, F.get(p, F.lit(0)), lambda best, v: F.when(v["sum"] > best["sum"], v).otherwise(best))
        return G.bound(F.struct(F.array_min(p).alias("a"), last.alias("c"), p.alias("p")), middle)

    def middle(v: Column) -> Column:
        others = F.filter(v["p"], lambda q: (q["i"] != v["a"]["i"]) & (q["i"] != v["c"]["i"]))
        rest = F.array_sort(F.transform(others, lambda q: F.struct((q["y"] - q["x"]).alias("d"), q["i"].alias("i"), q["x"].alias("x"), q["y"].alias("y"))))
        return G.bound(rest, lambda r: F.array(*(k[n] for k in (v["a"], F.get(r, F.lit(0)), v["c"], F.get(r, F.lit(1))) for n in ("x", "y"))))

    return G.bound(corners, ordered)


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _in_turn(quad: pa.Array) -> pa.Array:
    """clockwise of boxes of eight numbers, a batch at once; null for others."""
    given = pc.equal(pc.list_value_length(quad), 8).fill_null(False)
    q = quad.filter(given).flatten().to_numpy(zero_copy_only=False).reshape(-1, 4, 2)
    n = np.arange(len(q))
    total, d = q[..., 0] + q[..., 1], q[..., 1] - q[..., 0]
    order = [total.argmin(axis=1), None, total.argmax(axis=1), None]
    d[n, order[0]] = d[n, order[2]] = np.inf
    order[1] = d.argmin(axis=1)
    d[n, order[1]] = np.inf
    order[3] = d.argmin(axis=1)
    flat = q[n[:, None], np.stack(order, axis=1)].ravel() if len(q) else q.ravel()
    given = given.to_numpy(zero_copy_only=False)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(given * 8)]), pa.int32()), pa.array(flat, pa.float64()), mask=pa.array(~given))


def clockwise(quad: Column) -> Column:
    """Four corners from the upper left on: the least and the largest sum of coordinates are opposite; of the other two the one with the lesser y - x comes second.
    Boxes of finite numbers go in batches, as functions of an array's elements aren't compiled."""
    total = sum((F.get(quad, F.lit(k)) for k in range(1, 8)), F.get(quad, F.lit(0)))
    return F.when((F.size(quad) == 8) & (F.abs(total) < float("inf")), _in_turn(quad)).otherwise(_clockwise(quad))


def clipped(quad: Column, width: Column, height: Column) -> Column:
    """Corners within the picture, in whole pixels."""
    inside = lambda v, i: F.floor(F.least(F.greatest(v, F.lit(0.0)), F.when(i % 2 == 0, width).otherwise(height) - 1)).cast("double")
    return F.transform(quad, inside)


def sides(quad: Column) -> Column:
    """Struct width, height (means of opposite edges), short, long."""
    edge = lambda i, j: F.sqrt(F.pow(F.get(quad, F.lit(2 * i)) - F.get(quad, F.lit(2 * j)), 2) + F.pow(F.get(quad, F.lit(2 * i + 1)) - F.get(quad, F.lit(2 * j + 1)), 2))
    w, h = (edge(0, 1) + edge(3, 2)) / 2, (edge(0, 3) + edge(1, 2)) / 2
    return F.struct(w.alias("width"), h.alias("height"), F.least(w, h).alias("short"), F.greatest(w, h).alias("long"))


def large_enough(quad: Column, least: int = 10) -> Column:
    """Whether the upper and the left edge, in whole pixels, are longer than `least`."""
    edge = lambda j: F.floor(F.sqrt(F.pow(F.get(quad, F.lit(0)) - F.get(quad, F.lit(2 * j)), 2) + F.pow(F.get(quad, F.lit(1)) - F.get(quad, F.lit(2 * j + 1)), 2)))
    return (edge(1) > least) & (edge(3) > least)


def reading_order(boxes: DataFrame, near: float = 10.0) -> DataFrame:
    """With pos: the place of each box of a ticket, by its first corner from top to bottom, where a box goes before those
    that stand right of it and less than `near` lower or higher, one after another. A fold over the ticket's boxes."""
    x, y = F.get("quad", F.lit(0)), F.get("quad", F.lit(1))
    rows = boxes.select("*", F.struct(y.alias("y"), x.alias("x"), F.struct(*boxes.columns).alias("row")).alias("_b"))
    listed = rows.groupBy("ticket").agg(F.array_sort(F.collect_list("_b"), lambda a, b: F.when(F.struct(a["y"], a["x"]) < F.struct(b["y"], b["x"]), -1).when(F.struct(a["y"], a["x"]) > F.struct(b["y"], b["x"]), 1).otherwise(0)).alias("_l"))

    # A box only goes before some of the last ones, if it goes before the last one or none; what is `near` above any box is closed for it and all that follow.
    def insert(done, b):
        shut = ~F.coalesce(F.abs(b["y"] - done["y"]) < near, F.lit(False))
        closed, open_ = F.when(shut, F.concat(done["closed"], done["open"])).otherwise(done["closed"]), F.when(shut, empty).otherwise(done["open"])
        return F.struct(closed.alias("closed"), G.bound(open_, lambda o: placed(o, b)).alias("open"), b["y"].alias("y"))

    def placed(done, b):
        n = F.size(done)
        # How many of the last ones stand right of b and near its height, without a gap.
        back = F.aggregate(F.reverse(done), F.struct(F.lit(0).alias("k"), F.lit(True).alias("on")), lambda s, v: F.struct((s["k"] + F.when(s["on"] & (F.abs(b["y"] - v["y"]) < near) & (b["x"] < v["x"]), 1).otherwise(0)).alias("k"), (s["on"] & (F.abs(b["y"] - v["y"]) < near) & (b["x"] < v["x"])).alias("on")))["k"]
        return G.bound(back, lambda k: F.concat(F.slice(done, F.lit(1), n - k), F.array(b), F.slice(done, n - k + 1, k)))

    empty = F.slice("_l", 1, 0)
    start = F.struct(empty.alias("closed"), empty.alias("open"), F.lit(None).cast("double").alias("y"))
    ordered = listed.select(F.posexplode(F.aggregate("_l", start, insert, lambda s: F.concat(s["closed"], s["open"]))).alias("pos", "_b"))
    return ordered.select("_b.row.*", "pos")
