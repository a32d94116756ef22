"""Boxes and polygons as columns. A polygon is an array x1, y1, x2, y2, ...; a box is a struct cx, cy, w, h, r (radians)."""

from __future__ import annotations

from math import atan2, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def box(cx, cy, w, h, r) -> Column:
    return F.struct(*(F.col(c).cast("double").alias(n) if isinstance(c, str) else c.cast("double").alias(n) for c, n in ((cx, "cx"), (cy, "cy"), (w, "w"), (h, "h"), (r, "r"))))


def corners(b: Column) -> Column:
    """The four corners of a box, against the turn of the angle, from the end of both half axes."""
    c, s = F.cos(b["r"]), F.sin(b["r"])
    ux, uy, vx, vy = b["w"] / 2 * c, b["w"] / 2 * s, -b["h"] / 2 * s, b["h"] / 2 * c
    x, y = b["cx"], b["cy"]
    return F.array(x + ux + vx, y + uy + vy, x + ux - vx, y + uy - vy, x - ux - vx, y - uy - vy, x - ux + vx, y - uy + vy)


def bound(value: Column, of) -> Column:
    """of(value), where value is computed once, however often it occurs."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def _edges(p: Column) -> Column:
    """Array of structs ax, ay, bx, by."""
    n = (F.size(p) / 2).cast("int")
    at = lambda i: F.get(p, i)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(at(2 * i).alias("ax"), at(2 * i + 1).alias("ay"), at(2 * ((i + 1) % n)).alias("bx"), at(2 * ((i + 1) % n) + 1).alias("by")))


def _total(edges: Column, of) -> Column:
    return F.aggregate(edges, F.lit(0.0), lambda t, e: t + of(e))


def _cross(e: Column) -> Column:
    return e["ax"] * e["by"] - e["bx"] * e["ay"]


def area(p: Column) -> Column:
    """By the shoelace formula; polygons don't cross themselves."""
    return F.abs(_total(_edges(p), _cross)) / 2


def centroid(p: Column) -> Column:
    """Struct x, y: of the area, not of the corners."""
    e = _edges(p)
    six = 3 * _total(e, _cross)
    return F.struct((_total(e, lambda k: (k["ax"] + k["bx"]) * _cross(k)) / six).alias("x"), (_total(e, lambda k: (k["ay"] + k["by"]) * _cross(k)) / six).alias("y"))


def within(box: Column, x: Column, y: Column, edge: float = 0.0) -> Column:
    """Whether a point lies within a turned box, at least so far from its sides; sides don't count. Measured along the box's own axes."""
    dx, dy, c, s = x - box["cx"], y - box["cy"], F.cos(box["r"]), F.sin(box["r"])
    return (F.abs(dx * c + dy * s) < box["w"] / 2 - edge) & (F.abs(dy * c - dx * s) < box["h"] / 2 - edge)


def contains(p: Column, x: Column, y: Column) -> Column:
    """Whether a convex polygon holds a point; its boundary doesn't count."""
    side = lambda e: (e["bx"] - e["ax"]) * (y - e["ay"]) - (e["by"] - e["ay"]) * (x - e["ax"])
    return F.forall(_edges(p), lambda e: side(e) > 0) | F.forall(_edges(p), lambda e: side(e) < 0)


def contains_centre(p: Column, q: Column) -> Column:
    """Whether a convex polygon holds the centroid of another one. That is bound, and so is the other one: written out, Spark would put what a corner
    is computed from in for each time that an edge asks for it, hundreds of times."""
    return bound(q, lambda v: bound(centroid(v), lambda c: contains(p, c["x"], c["y"])))


def shrink(p: Column, share: float) -> Column:
    """Each corner moved towards the corners' mean by a share of its distance."""
    n = F.size(p) / 2
    mean = lambda odd: F.aggregate(F.filter(p, lambda _, i: i % 2 == odd), F.lit(0.0), lambda t, v: t + v) / n
    return F.transform(p, lambda v, i: v + (F.when(i % 2 == 0, mean(0)).otherwise(mean(1)) - v) * share)


def aligned_iou(a: Column, b: Column) -> Column:
    """Overlap of boxes whose angle is ignored, over their union."""
    wide = F.greatest(F.least(a["cx"] + a["w"] / 2, b["cx"] + b["w"] / 2) - F.greatest(a["cx"] - a["w"] / 2, b["cx"] - b["w"] / 2), F.lit(0.0))
    high = F.greatest(F.least(a["cy"] + a["h"] / 2, b["cy"] + b["h"] / 2) - F.greatest(a["cy"] - a["h"] / 2, b["cy"] - b["h"] / 2), F.lit(0.0))
    both = wide * high
    return both / (a["w"] * a["h"] + b["w"] * b["h"] - both + F.lit(1e-9))


def in_reach(a: Column, b: Column) -> Column:
    """Whether the circles around two boxes meet; boxes whose circles don't share nothing, however they are turned."""
    reach = lambda k: F.sqrt(F.pow(k["w"], 2) + F.pow(k["h"], 2)) / 2
    return F.sqrt(F.pow(a["cx"] - b["cx"], 2) + F.pow(a["cy"] - b["cy"], 2)) < reach(a) + reach(b)


def covariance(b: Column) -> tuple[Column, Column, Column]:
    """Of the Gaussian that a box stands for: var x, var y, cov."""
    p, q = b["w"] * b["w"] / 12, b["h"] * b["h"] / 12
    c, s = F.cos(b["r"]), F.sin(b["r"])
    return p * c * c + q * s * s, p * s * s + q * c * c, (p - q) * c * s


def gaussian(b: Column) -> Column:
    """Struct cx, cy, a, b, c: centre and covariance of the Gaussian that a box stands for; computed once a box, where it meets many."""
    return F.struct(b["cx"].alias("cx"), b["cy"].alias("cy"), *(v.alias(n) for v, n in zip(covariance(b), "abc", strict=True)))


def prob_iou(one: Column, two: Column) -> Column:
    return gaussian_iou(gaussian(one), gaussian(two))


def gaussian_iou(one: Column, two: Column, eps: float = 1e-7) -> Column:
    """One less the Hellinger distance of the boxes' Gaussians, by their Bhattacharyya distance."""
    a, b, c, d, e, f = (g[n] for g in (one, two) for n in "abc")
    va, vb, vc = a + d, b + e, c + f
    det = va * vb - vc * vc
    dx, dy = one["cx"] - two["cx"], one["cy"] - two["cy"]
    far = (va * dy * dy + vb * dx * dx) / (det + eps) / 4 - vc * dx * dy / (det + eps) / 2
    own = F.sqrt(F.greatest(a * b - c * c, F.lit(0.0)) * F.greatest(d * e - f * f, F.lit(0.0)))
    distance = F.least(F.greatest(far + F.log(det / (4 * own + eps) + eps) / 2, F.lit(eps)), F.lit(100.0))
    return 1 - F.sqrt(1 - F.exp(-distance) + eps)


def rotate(x: Column, y: Column, theta: Column, px: Column, py: Column) -> tuple[Column, Column]:
    c, s = F.cos(theta), F.sin(theta)
    return px + (x - px) * c - (y - py) * s, py + (x - px) * s + (y - py) * c


def offset(p: Column, distance: Column, arc: float = 0.25) -> Column:
    """A convex polygon (x1, y1, ..., either way round) grown by a distance: its sum with a disc, whose arcs are cut into chords that lie at most
    `arc` inside of it. Corners in the polygon's order, as x1, y1, ...; a polygon that isn't grown stays as it is."""

    def one(flat: np.ndarray, d: float) -> np.ndarray:
        at = flat.reshape(-1, 2)
        edge = np.roll(at, -1, axis=0) - at
        way = -1.0 if (at[:, 0] * edge[:, 1] - at[:, 1] * edge[:, 0]).sum() < 0 else 1.0
        out = np.arctan2(-way * edge[:, 0], way * edge[:, 1])  # where the outer side of each edge looks
        first = np.roll(out, 1)
        turn = (way * (out - first)) % (2 * np.pi)
        parts = np.maximum(1, np.ceil(turn / (2 * np.arccos(max(0.0, 1 - arc / d))) - 1e-9)).astype(int)
        k = np.repeat(np.arange(len(at)), parts + 1)
        i = np.arange(len(k)) - np.repeat(np.cumsum(parts + 1) - (parts + 1), parts + 1)
        angle = first[k] + way * turn[k] * i / parts[k]
        return (at[k] + d * np.stack([np.cos(angle), np.sin(angle)], axis=1)).ravel()

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def run(p: pa.Array, distance: pa.Array) -> pa.Array:
        grown = [None if q is None or d is None else one(np.array(q), d) if d > 0 and len(q) else q for q, d in zip(p.to_pylist(), distance.to_pylist(), strict=True)]
        return pa.array(grown, pa.list_(pa.float64()))

    return run(p, distance.cast("double"))


#: Pairs up to which overlaps are computed one by one.
FEW = 12


def clipped_area(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Areas that pairs of convex quadrilaterals share; p, q: n x 8.

    The corners of the shared polygon are corners of one inside the other, and crossings of
    edges; sorted by angle about their mean they give its area.
    """
    a, b = (m.reshape(-1, 4, 2).astype(float) for m in (p, q))
    n = len(a)

    def turned(m):
        nxt = np.roll(m, -1, axis=1)
        flip = (m[..., 0] * nxt[..., 1] - nxt[..., 0] * m[..., 1]).sum(axis=1) < 0
        m[flip] = m[flip][:, ::-1]
        return m

    a, b = turned(a.copy()), turned(b.copy())

    def inside(points, m):
        d, rel = np.roll(m, -1, axis=1) - m, points[:, :, None] - m[:, None]
        return (d[:, None, :, 0] * rel[..., 1] - d[:, None, :, 1] * rel[..., 0] >= -1e-9).all(axis=2)

    da, db = np.roll(a, -1, axis=1) - a, np.roll(b, -1, axis=1) - b
    gap = b[:, None] - a[:, :, None]
    cross = da[:, :, None, 0] * db[:, None, :, 1] - da[:, :, None, 1] * db[:, None, :, 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (gap[..., 0] * db[:, None, :, 1] - gap[..., 1] * db[:, None, :, 0]) / cross
        u = (gap[..., 0] * da[:, :, None, 1] - gap[..., 1] * da[:, :, None, 0]) / cross
    met = (np.abs(cross) > 1e-12) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
    points = np.concatenate([a, b, (a[:, :, None] + np.nan_to_num(t, posinf=0, neginf=0)[..., None] * da[:, :, None]).reshape(n, 16, 2)], axis=1)
    valid = np.concatenate([inside(a, b), inside(b, a), met.reshape(n, 16)], axis=1)
    count = valid.sum(axis=1)
    middle = (points * valid[..., None]).sum(axis=1) / np.maximum(count, 1)[:, None]
    rel = points - middle[:, None]
    angle = np.where(valid, np.arctan2(rel[..., 1], rel[..., 0]), np.inf)
    order = np.argsort(angle, axis=1, kind="stable")
    ring = np.take_along_axis(np.where(valid[..., None], rel, 0), order[..., None], axis=1)
    last = np.maximum(count - 1, 0)
    following = np.roll(ring, -1, axis=1)
    following[np.arange(n), last] = ring[:, 0]
    twice = (ring[..., 0] * following[..., 1] - following[..., 0] * ring[..., 1]).sum(axis=1)
    return np.where(count >= 3, np.abs(twice) / 2, 0.0)


def _areas(p: np.ndarray) -> np.ndarray:
    m = p.reshape(-1, 4, 2)
    nxt = np.roll(m, -1, axis=1)
    return np.abs((m[..., 0] * nxt[..., 1] - nxt[..., 0] * m[..., 1]).sum(axis=1)) / 2


def _points(quad: list[float]) -> tuple[list[tuple[float, float]], float]:
    """Corners of a quadrilateral, in turn about it in one sense, and twice its area."""
    x0, y0, x1, y1, x2, y2, x3, y3 = quad
    twice = (x0 * y1 - x1 * y0) + (x1 * y2 - x2 * y1) + (x2 * y3 - x3 * y2) + (x3 * y0 - x0 * y3)
    p = [(x0, y0), (x1, y1), (x2, y2), (x3, y3)]
    return p[::-1] if twice < 0 else p, abs(twice)


def _edges_of(points: list[tuple[float, float]]) -> list[tuple[float, float, float, float]]:
    """Where each edge of a quadrilateral begins, and how far it goes."""
    (x0, y0), (x1, y1), (x2, y2), (x3, y3) = points
    return [(x0, y0, x1 - x0, y1 - y0), (x1, y1, x2 - x1, y2 - y1), (x2, y2, x3 - x2, y3 - y2), (x3, y3, x0 - x3, y0 - y3)]


def _inside(points: list[tuple[float, float]], edges: list[tuple[float, float, float, float]]) -> list[tuple[float, float]]:
    """Those of the points that lie on the inner side of all four edges. Written out, as this is where a fold over frames spends its time."""
    (x0, y0, u0, v0), (x1, y1, u1, v1), (x2, y2, u2, v2), (x3, y3, u3, v3) = edges
    return [
        (x, y) for x, y in points
        if u0 * (y - y0) - v0 * (x - x0) >= -1e-9 and u1 * (y - y1) - v1 * (x - x1) >= -1e-9 and u2 * (y - y2) - v2 * (x - x2) >= -1e-9 and u3 * (y - y3) - v3 * (x - x3) >= -1e-9
    ]


def _shared(a: list[tuple[float, float]], b: list[tuple[float, float]], edges_a: list[tuple], edges_b: list[tuple]) -> float:
    """clipped_area of one pair."""
    found = _inside(a, edges_b) + _inside(b, edges_a)
    for x, y, dx, dy in edges_a:
        for u, v, du, dv in edges_b:
            cross = dx * dv - dy * du
            if cross > 1e-12 or cross < -1e-12:
                gx, gy = u - x, v - y
                t = (gx * dv - gy * du) / cross
                if 0 <= t <= 1 and 0 <= (gx * dy - gy * dx) / cross <= 1:
                    found.append((x + t * dx, y + t * dy))
    n = len(found)
    if n < 3:
        return 0.0
    mx, my = sum([x for x, _ in found]) / n, sum([y for _, y in found]) / n
    rel = [(x - mx, y - my) for x, y in found]
    turn = [atan2(y, x) for x, y in rel]
    ring = [rel[k] for k in sorted(range(n), key=turn.__getitem__)]
    return abs(sum([x * v - u * y for (x, y), (u, v) in zip(ring, ring[1:] + ring[:1], strict=True)])) / 2


def _circle(quad: list[float]) -> tuple[float, float, float]:
    """About the mean of the corners, through the farthest."""
    x0, y0, x1, y1, x2, y2, x3, y3 = quad
    cx, cy = (x0 + x1 + x2 + x3) / 4, (y0 + y1 + y2 + y3) / 4
    return cx, cy, sqrt(max((x0 - cx) ** 2 + (y0 - cy) ** 2, (x1 - cx) ** 2 + (y1 - cy) ** 2, (x2 - cx) ** 2 + (y2 - cy) ** 2, (x3 - cx) ** 2 + (y3 - cy) ** 2))


class _Box:
    """What overlaps need of one box, found out once for all that it is held against; corners and edges only once a circle meets another."""

    __slots__ = ("area", "circle", "edges", "points", "quad")

    def __init__(self, quad: list[float]):
        self.quad, self.circle, self.points = quad, None if None in quad else _circle(quad), None

    def corners(self) -> None:
        self.points, twice = _points(self.quad)
        self.area, self.edges = twice / 2, _edges_of(self.points)


def _overlap(p: _Box, q: _Box) -> float:
    if p.circle is None or q.circle is None:
        return 0.0
    (ax, ay, ar), (bx, by, br) = p.circle, q.circle
    if not (ax - bx) ** 2 + (ay - by) ** 2 < (ar + br) ** 2:
        return 0.0
    for box in (p, q):
        if box.points is None:
            box.corners()
    both = _shared(p.points, q.points, p.edges, q.edges)
    return both / (p.area + q.area - both + 1e-9)


def quad_overlap(p: list[float], q: list[float]) -> float:
    """Overlap of two boxes over their union; 0 if their circles don't meet. For few pairs: an array's overhead costs more than the overlap itself."""
    return _overlap(_Box(p), _Box(q))


def quad_overlaps(p: list, q: list) -> np.ndarray:
    """Overlap of each of p with each of q, over their union; pairs whose circles don't meet aren't clipped."""
    if len(p) * len(q) <= FEW:
        one, two = [_Box(a) for a in p], [_Box(b) for b in q]
        return np.array([[_overlap(a, b) for b in two] for a in one], float).reshape(len(p), len(q))
    out = np.zeros((len(p), len(q)))
    a, b = np.asarray(p, float), np.asarray(q, float)
    ca, cb = (m.reshape(-1, 4, 2).mean(axis=1) for m in (a, b))
    ra, rb = (np.sqrt(((m.reshape(-1, 4, 2) - c[:, None]) ** 2).sum(axis=2)).max(axis=1) for m, c in ((a, ca), (b, cb)))
    i, j = np.nonzero(((ca[:, None] - cb[None]) ** 2).sum(axis=2) < (ra[:, None] + rb[None]) ** 2)
    both = clipped_area(a[i], b[j])
    out[i, j] = both / (_areas(a[i]) + _areas(b[j]) - both + 1e-9)
    return out


@F.pandas_udf(T.DoubleType())
def quad_iou(p: pd.Series, q: pd.Series) -> pd.Series:
    """Overlap of convex quadrilaterals over their union; null where one is null."""
    ok = p.notna() & q.notna()
    out = pd.Series(np.nan, index=p.index, dtype=object)
    if ok.any():
        a, b = (np.stack(s[ok].to_list()).astype(float) for s in (p, q))
        both = clipped_area(a, b)
        out[ok] = both / (_areas(a) + _areas(b) - both + 1e-9)
    return out.where(ok, None).astype("float64")
