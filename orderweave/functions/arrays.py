"""Arrays of numbers as columns: what goes into a detector and what comes out of its head, crops, and picture differences."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def at(values: Column, i) -> Column:
    return F.get(values, F.lit(i) if isinstance(i, int) else i)


def rows_of(values: Column, width: int) -> Column:
    """A flat array cut into rows of `width` values; what is left over at the end goes."""
    n = F.floor(F.size(values) / width).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(values, i * width + 1, width))).otherwise(F.slice(F.array(values), 1, 0))


def standardized(values: Column, mean: list[float], deviation: list[float]) -> Column:
    """Each value less the mean of its channel, over the channel's deviation; channels follow each other."""
    k = len(mean)
    of = lambda table, i: F.element_at(F.array(*map(F.lit, table)), (i % k + 1).cast("int"))
    return F.transform(values, lambda v, i: (v - of(mean, i)) / of(deviation, i))


def letterbox(width: Column, height: Column, to_width: int, to_height: int) -> Column:
    """Struct scale, width, height, dx, dy: how a picture is scaled and where it lies in the larger one."""
    across, down = to_width / width, to_height / height
    scale = F.least(across, down)
    w, h = F.floor(width * scale).cast("int"), F.floor(height * scale).cast("int")
    dx = F.when(across < down, 0).otherwise(F.floor((to_width - w) / 2)).cast("int")
    dy = F.when(across < down, F.floor((to_height - h) / 2)).otherwise(0).cast("int")
    return F.struct(scale.alias("scale"), w.alias("width"), h.alias("height"), dx.alias("dx"), dy.alias("dy"))


def box_from_distances(x: Column, y: Column, distances: Column, angle: Column) -> Column:
    """A box from an anchor's distances to its left, upper, right and lower side, along the box's own axes."""
    left, up, right, down = (at(distances, i) for i in range(4))
    ox, oy = (right - left) / 2, (down - up) / 2
    cx, cy = x + F.cos(angle) * ox - F.sin(angle) * oy, y + F.sin(angle) * ox + F.cos(angle) * oy
    return F.struct(*(c.cast("double").alias(n) for c, n in ((cx, "cx"), (cy, "cy"), (left + right, "w"), (up + down, "h"), (angle, "r"))))


def crop_matrix(box: Column) -> Column:
    """Array of the two rows of the affine map that turns a box upright and puts its upper left corner at the origin."""
    c, s = F.cos(box["r"]), F.sin(box["r"])
    return F.array(c, s, box["w"] / 2 - c * box["cx"] - s * box["cy"], -s, c, box["h"] / 2 + s * box["cx"] - c * box["cy"])


def inverse_map(m: Column) -> Column:
    """The affine map that undoes another one."""
    a, b, c, d, e, f = (at(m, i) for i in range(6))
    det = a * e - b * d
    return F.array(e / det, -b / det, (b * f - c * e) / det, -d / det, a / det, (c * d - a * f) / det)


def grown(area: Column, perimeter: Column, ratio: float = 1.5) -> Column:
    """By how much a text box is grown on each side."""
    return area * ratio / perimeter


def change_ratio(before: Column, after: Column, width: int, differs: float = 30.0, content: float = 200.0) -> Column:
    """Share of values of a picture (rows of `width`) that changed by more than `differs`, of those at or next to content: values
    below `content` in either picture. 1 where a picture is missing, 0 without content. Values that only one picture has didn't change."""

    def one(a: np.ndarray, b: np.ndarray) -> float:
        n = len(a)
        b = np.pad(b[:n], (0, max(0, n - len(b))), constant_values=np.nan)
        with np.errstate(invalid="ignore"):
            dark = (a < content) | (b < content)
            changed = np.abs(a - b) > differs
        rows = -(-n // width)
        room = np.zeros((rows + 2, width + 2), bool)
        room[1:-1, 1:-1] = np.pad(dark, (0, rows * width - n)).reshape(rows, width)
        near = np.zeros((rows, width), bool)
        for y in range(3):
            for x in range(3):
                near |= room[y : y + rows, x : x + width]
        near = near.ravel()[:n]
        return float((changed & near).sum() / near.sum()) if near.any() else 0.0

    @F.arrow_udf(T.DoubleType())
    def run(before: pa.Array, after: pa.Array) -> pa.Array:
        pictures = [(x.offsets.to_pylist(), x.values.to_numpy(zero_copy_only=False).astype(float), x.is_valid().to_pylist()) for x in (before, after)]
        out = []
        for k in range(len(before)):
            a, b = (values[ends[k] : ends[k + 1]] if valid[k] else None for ends, values, valid in pictures)
            out.append(1.0 if a is None or b is None else one(a, b))
        return pa.array(out, pa.float64())

    return run(before, after)
