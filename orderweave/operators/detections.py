"""Detections of a frame: thresholds, ranking and suppression of boxes that say the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orderweave.functions import geometry as G


def confident(rows: DataFrame, threshold: float | dict[str, float], score: str = "score", cls: str = "cls") -> DataFrame:
    """Scores above a threshold, or above that of their class; classes without one go."""
    if not isinstance(threshold, dict):
        return rows.where(F.col(score) > threshold)
    marks = F.create_map(*(F.lit(x) for pair in threshold.items() for x in pair))
    return rows.where(F.col(score) > F.try_element_at(marks, F.col(cls)))


def routed(rows: DataFrame, routes: dict[str, str], cls: str = "cls") -> DataFrame:
    """With the route of each class; classes without one go."""
    table = F.create_map(*(F.lit(x) for pair in routes.items() for x in pair))
    return rows.withColumn("route", F.try_element_at(table, F.col(cls))).where("route is not null")


def best(rows: DataFrame, frame: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k of each frame, with their rank. Spark cuts each partition to k before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*frame).orderBy(*order))).where(F.col("rank") <= k)


def near_pairs(rows: DataFrame, frame: list[str], ident: str = "det", box: str = "box", carry: tuple[str, ...] = (), wide: float = 1.0, meets=G.in_reach) -> DataFrame:
    """Pairs of a frame's boxes that meet: frame, ident, box, carry and, of the one with the larger ident, other, other_box and other_ of carry.

    Boxes are sorted into cells as wide as `wide` times the frame's longest diagonal, beyond which nothing may meet; those that
    meet lie in the same cell or in neighbouring ones, of which each pair is looked for in one: a box looks right of, below and at its own.
    """
    reach = F.sqrt(F.col(box)["w"] * F.col(box)["w"] + F.col(box)["h"] * F.col(box)["h"])
    own = rows.select(*frame, ident, box, *carry, reach.alias("_reach"))
    cells = own.groupBy(*frame).agg(F.greatest(F.max("_reach") * wide, F.lit(1e-9)).alias("_cell"))
    own = own.join(cells, frame)
    own = own.withColumn("_x", F.floor(F.col(box)["cx"] / F.col("_cell"))).withColumn("_y", F.floor(F.col(box)["cy"] / F.col("_cell"))).drop("_reach", "_cell")
    ahead = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0, 0), (1, -1), (1, 0), (1, 1), (0, 1))))
    seek = own.withColumn("_d", F.explode(ahead)).withColumn("_x", F.col("_x") + F.col("_d.x")).withColumn("_y", F.col("_y") + F.col("_d.y"))
    other = own.select(*frame, "_x", "_y", F.col(ident).alias("other"), F.col(box).alias("other_box"), *(F.col(c).alias(f"other_{c}") for c in carry))
    pairs = seek.join(other, [*frame, "_x", "_y"]).where((F.col("other") != F.col(ident)) & ((F.col("other") > F.col(ident)) | (F.col("_d.x") != 0) | (F.col("_d.y") != 0)) & meets(F.col(box), F.col("other_box")))
    swap = F.col(ident) > F.col("other")
    turned = {ident: "other", box: "other_box"} | {c: f"other_{c}" for c in carry}
    first = [F.when(swap, F.col(o)).otherwise(F.col(c)).alias(c) for c, o in turned.items()]
    second = [F.when(swap, F.col(c)).otherwise(F.col(o)).alias(o) for c, o in turned.items()]
    return pairs.select(*frame, *first, *second)


def aligned(box: Column) -> tuple[Column, Column, Column, Column]:
    """Left, right, top and bottom of a box, its angle ignored."""
    return box["cx"] - box["w"] / 2, box["cx"] + box["w"] / 2, box["cy"] - box["h"] / 2, box["cy"] + box["h"] / 2


def turned(box: Column) -> tuple[Column, Column, Column, Column]:
    """Left, right, top and bottom of what a turned box covers."""
    c, s = F.abs(F.cos(box["r"])), F.abs(F.sin(box["r"]))
    x, y = (box["w"] * c + box["h"] * s) / 2, (box["w"] * s + box["h"] * c) / 2
    return box["cx"] - x, box["cx"] + x, box["cy"] - y, box["cy"] + y


def _celled(rows: DataFrame, extent, box: str, cell: float) -> DataFrame:
    """With _x0, _y0 (left, top) and a row for each cell (_x, _y) that the box covers."""
    x0, x1, y0, y1 = extent(F.col(box))
    columns, lines = (F.sequence(F.floor(a / cell), F.floor(b / cell)) for a, b in ((x0, x1), (y0, y1)))
    return rows.withColumns({"_x0": x0, "_y0": y0, "_x": F.explode(columns)}).withColumn("_y", F.explode(lines))


def _once(cell: float, *lefts: tuple[str, str]) -> Column:
    """Of the cells that two boxes share the one in which their intersection begins."""
    x, y = (F.floor(F.greatest(*c) / cell) for c in zip(*lefts, strict=True))
    return (F.col("_x") == x) & (F.col("_y") == y)


def overlapping(rows: DataFrame, frame: list[str], ident: str = "det", box: str = "box", carry: tuple[str, ...] = (), extent=aligned, cell: float = 256.0) -> DataFrame:
    """Pairs of a frame's boxes whose extents touch: frame, ident, box, carry, other, other_box and other_ of carry, other being the larger ident.

    A box meets those of the cells that it covers, over one exchange; cell: a side of about that of a large box.
    """
    own = _celled(rows.select(*frame, ident, box, *carry), extent, box, cell)
    names = {ident: "other", box: "other_box", "_x0": "_ox", "_y0": "_oy"} | {c: f"other_{c}" for c in carry}
    pairs = own.join(own.withColumnsRenamed(names), [*frame, "_x", "_y"]).where((F.col(ident) < F.col("other")) & _once(cell, ("_x0", "_y0"), ("_ox", "_oy")))
    return pairs.drop("_x", "_y", "_x0", "_y0", "_ox", "_oy")


def near_both(rows: DataFrame, frame: list[str], holder: Column, ident: str = "det", box: str = "box", inside: bool = True, extent=turned, cell: float = 256.0) -> DataFrame:
    """Pairs of a holder and something else of the frame: frame, holder, holder_box, ident, box. Those whose centre lies within the
    holder's extent (inside), or whose extents touch. Holders and the rest are parted first; only holders, which are few, go to
    several cells if centres are asked for.
    """
    held = F.coalesce(holder, F.lit(False))
    own = _celled(rows.where(held).select(*frame, F.col(ident).alias("holder"), F.col(box).alias("holder_box")), extent, "holder_box", cell)
    rest = rows.where(~held).select(*frame, ident, box)
    if inside:
        centre = {f"_{c}": F.floor(F.col(box)[f"c{c}"] / cell) for c in "xy"}
        return own.join(rest.withColumns(centre), [*frame, "_x", "_y"]).select(*frame, "holder", "holder_box", ident, box)
    rest = _celled(rest, extent, box, cell).withColumnsRenamed({"_x0": "_ox", "_y0": "_oy"})
    pairs = own.join(rest, [*frame, "_x", "_y"]).where(_once(cell, ("_x0", "_y0"), ("_ox", "_oy")))
    return pairs.select(*frame, "holder", "holder_box", ident, box)


def suppressed(rows: DataFrame, frame: list[str], threshold: float, group: Column, ident: str = "det", score: str = "score", box: str = "box") -> DataFrame:
    """Rows without those that a row of the same group with a higher score (ties: smaller ident) overlaps by the threshold or more.

    A suppressed row still suppresses others, so it is one anti join within frame and group.
    Boxes that are too far apart for any overlap are told apart by their cells: a box lies in
    the cell of its centre, and is compared with boxes of the cells around it. A cell is four
    times the longest diagonal of the frame's boxes; beyond that any overlap is below 1e-9.
    """
    own = rows.withColumn("_group", group).withColumn("_gauss", G.gaussian(F.col(box))).withColumn("_reach", F.sqrt(F.col(box)["w"] * F.col(box)["w"] + F.col(box)["h"] * F.col(box)["h"]))
    wide = own.groupBy(*frame).agg(F.max("_reach").alias("_cell"))
    own = own.join(wide, frame).withColumn("_cell", F.greatest(F.col("_cell") * 4, F.lit(1e-9)))
    own = own.withColumn("_x", F.floor(F.col(box)["cx"] / F.col("_cell"))).withColumn("_y", F.floor(F.col(box)["cy"] / F.col("_cell")))
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    other = own.select(*(F.col(c).alias(f"o_{c}") for c in frame), F.col("_group").alias("o_group"), F.col(ident).alias("o_ident"), F.col(score).alias("o_score"), F.col("_gauss").alias("o_gauss"), "_x", F.col("_y").alias("o_y"))
    other = other.withColumn("o_x", F.explode(F.transform(near, lambda d: F.col("_x") + d))).drop("_x")
    other = other.withColumn("o_y", F.explode(F.transform(near, lambda d: F.col("o_y") + d)))
    same = F.lit(True)
    for c in frame:
        same = same & (F.col(c) == F.col(f"o_{c}"))
    higher = (F.col("o_score") > F.col(score)) | ((F.col("o_score") == F.col(score)) & (F.col("o_ident") < F.col(ident)))
    hit = same & (F.col("_group") == F.col("o_group")) & (F.col("_x") == F.col("o_x")) & (F.col("_y") == F.col("o_y")) & higher & (G.gaussian_iou(F.col("o_gauss"), F.col("_gauss")) >= threshold)
    return own.join(other, hit, "left_anti").drop("_group", "_gauss", "_reach", "_cell", "_x", "_y")


def vote(rows: DataFrame, key: list[str], holds: Column, share: float, strict: bool) -> DataFrame:
    """For each key the share of rows for which something holds, and whether that reaches (strict: passes) the mark."""
    mean = F.avg(holds.cast("double"))
    return rows.groupBy(*key).agg(mean.alias("share"), (mean > share if strict else mean >= share).alias("yes"))


def tallest(rows: DataFrame, key: list[str], size: str, share: float = 0.75, few: int = 2) -> DataFrame:
    """Rows whose size is at least a share of the largest of their key; keys with few rows keep all."""
    w = W.partitionBy(*key)
    marked = rows.withColumn("_max", F.max(size).over(w)).withColumn("_n", F.count(F.lit(1)).over(w))
    return marked.where((F.col("_n") <= few) | (F.col(size) >= share * F.col("_max"))).drop("_max", "_n")


def nearest(rows: DataFrame, marks: DataFrame, key: str, at: str, mark_at: str, value: str, reach: Column) -> DataFrame:
    """Of each row the value of the mark of its key that is nearest, ties to the smaller place and value, if it is within reach.

    One sort of both: the last mark before a row and the first one after it are the only
    candidates, so no pairs are made.
    """
    none = F.lit(None)
    sides = rows.select("*", F.lit(None).cast(marks.schema[mark_at].dataType).alias("_mark"), none.cast(marks.schema[value].dataType).alias("_value"), F.col(at).cast("double").alias("_at"), F.lit(1).alias("_kind"))
    other = marks.select(*(F.col(c) if c == key else none.cast(rows.schema[c].dataType).alias(c) for c in rows.columns), F.col(mark_at).alias("_mark"), F.col(value).alias("_value"), F.col(mark_at).cast("double").alias("_at"), F.lit(0).alias("_kind"))
    both = sides.union(other)
    mark = F.when(F.col("_kind") == 0, F.struct(F.col("_mark").alias("mark"), F.col("_value").alias("value")))
    before = F.last(mark, True).over(W.partitionBy(key, "_at_group").orderBy("_at", "_kind", F.col("_value").desc_nulls_last()).rowsBetween(W.unboundedPreceding, 0))
    after = F.first(mark, True).over(W.partitionBy(key, "_at_group").orderBy("_at", F.col("_kind").desc(), "_value").rowsBetween(0, W.unboundedFollowing))
    both = both.withColumn("_at_group", F.lit(0)).withColumn("_b", before).withColumn("_a", after).where("_kind = 1")
    nearer = F.col("_a.mark").isNull() | (F.abs(F.col("_at") - F.col("_b.mark")) <= F.abs(F.col("_a.mark") - F.col("_at")))
    chosen = F.when(F.col("_b.mark").isNotNull() & nearer, F.col("_b")).otherwise(F.col("_a"))
    ok = F.abs(chosen["mark"] - F.col("_at")) < reach
    return both.withColumn("nearest_value", F.when(ok, chosen["value"])).drop("_mark", "_value", "_at", "_kind", "_at_group", "_b", "_a")
