from __future__ import annotations

import math
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orderweave.functions import decode, geometry, text


def turned(cx, cy, w, h, r):
    c, s = math.cos(r), math.sin(r)
    return [v for a, b in ((1, 1), (1, -1), (-1, -1), (-1, 1)) for v in (cx + a * w / 2 * c - b * h / 2 * s, cy + a * w / 2 * s + b * h / 2 * c)]


number = st.floats(0.5, 8)


@settings(max_examples=100, deadline=None)
@given(number, number, number, number, number, number, number, number)
def test_clipping_of_aligned_boxes(a, b, w, h, c, d, u, v):
    p, q = np.array([turned(a, b, w, h, 0)]), np.array([turned(c, d, u, v, math.pi)])
    wide, high = min(a + w / 2, c + u / 2) - max(a - w / 2, c - u / 2), min(b + h / 2, d + v / 2) - max(b - h / 2, d - v / 2)
    assert abs(geometry.clipped_area(p, q)[0] - max(wide, 0) * max(high, 0)) < 1e-6


def test_clipping_of_turned_boxes():
    rng, grid = np.random.RandomState(0), np.stack(np.meshgrid(np.linspace(-6, 6, 601), np.linspace(-6, 6, 601)), axis=-1).reshape(-1, 2)

    def inside(p):
        m = np.array(p).reshape(4, 2)
        d = np.roll(m, -1, axis=0) - m
        side = np.array([(d[k, 0] * (grid[:, 1] - m[k, 1]) - d[k, 1] * (grid[:, 0] - m[k, 0])) for k in range(4)])
        return (side >= 0).all(axis=0) | (side <= 0).all(axis=0)

    for _ in range(25):
        p, q = (turned(*rng.uniform(-1.5, 1.5, 2), *rng.uniform(0.5, 5, 2), rng.uniform(0, 7)) for _ in range(2))
        assert abs(geometry.clipped_area(np.array([p]), np.array([q]))[0] - (inside(p) & inside(q)).sum() * 0.02**2) < 0.15
        assert abs(geometry.clipped_area(np.array([p]), np.array([p]))[0] - geometry._areas(np.array([p]))[0]) < 1e-6


def test_geometry_columns(spark):
    rng = random.Random(2)
    boxes = [(rng.uniform(-9, 9), rng.uniform(-9, 9), rng.uniform(1, 9), rng.uniform(1, 9), rng.uniform(0, 6)) for _ in range(30)]
    df = spark.createDataFrame([(boxes[k], boxes[(k + 1) % 30]) for k in range(30)], "b struct<cx:double,cy:double,w:double,h:double,r:double>, o struct<cx:double,cy:double,w:double,h:double,r:double>")
    p = geometry.corners(F.col("b"))
    c = geometry.centroid(p)
    x, y = geometry.rotate(*geometry.rotate(F.col("b.cx"), F.col("b.cy"), F.lit(0.7), F.lit(1.0), F.lit(2.0)), F.lit(-0.7), F.lit(1.0), F.lit(2.0))
    rows = df.select("b", p.alias("p"), geometry.area(p).alias("area"), c.alias("c"), x.alias("x"), y.alias("y"), geometry.contains(p, F.col("b.cx"), F.col("b.cy")).alias("own"), geometry.contains(p, F.get(p, F.lit(0)), F.get(p, F.lit(1))).alias("edge"), geometry.area(geometry.shrink(p, 0.1)).alias("small"), geometry.prob_iou(F.col("b"), F.col("b")).alias("same"), geometry.prob_iou(F.col("b"), F.col("o")).alias("one"), geometry.prob_iou(F.col("o"), F.col("b")).alias("two"), geometry.quad_iou(p, p).alias("iou"), geometry.aligned_iou(F.col("b"), F.col("b")).alias("flat")).collect()
    for r in rows:
        assert np.allclose(r.p, turned(*r.b)) and abs(r.area - r.b.w * r.b.h) < 1e-9 and abs(r.small - 0.81 * r.area) < 1e-9
        assert abs(r.c.x - r.b.cx) < 1e-9 and abs(r.c.y - r.b.cy) < 1e-9 and abs(r.x - r.b.cx) < 1e-9 and abs(r.y - r.b.cy) < 1e-9
        assert r.own and not r.edge and r.same > 0.99 and abs(r.one - r.two) < 1e-9 and -1e-6 <= r.one <= 1 and abs(r.iou - 1) < 1e-6 and abs(r.flat - 1) < 1e-6
    assert spark.sql("select cast(null as array<double>) p").select(geometry.quad_iou("p", "p")).first()[0] is None


def naive(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.text("abcé", max_size=9), st.text("abcé", max_size=9)), min_size=1, max_size=6))
def test_common_length(pairs):
    assert text.common_length([a for a, _ in pairs], [b for _, b in pairs]).tolist() == [naive(a, b) for a, b in pairs]


def test_ratio(spark):
    rows = [("kitten", "sitting"), ("", ""), ("abc", ""), (None, "a"), ("kitten", "sitting"), ("数量", "数")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = [r.x for r in df.select(text.indel_ratio("a", "b").alias("x")).collect()]
    assert [None if x is None else round(x, 2) for x in got] == [61.54, 100.0, 0.0, None, 61.54, 66.67]


def test_common_length_of_long_texts():
    rng = random.Random(3)
    some = lambda: "".join(rng.choices("abc\U0001f600é", k=rng.choice([0, 1, 63, 64, 65, 130, 200])))
    pairs = [(some(), some()) for _ in range(40)]
    pairs += [(a, a) for a, _ in pairs[:5]]
    assert text.common_length([a for a, _ in pairs], [b for _, b in pairs]).tolist() == [naive(a, b) for a, b in pairs]
    assert text.common_length([], []).tolist() == []


def test_text(spark):
    rows = ["  Ａ　ｂ C ", "０１２３", "A１２３", "12 Cola", "007", " 42 ", "x5y", None, ""]
    r = spark.createDataFrame([(x,) for x in rows], "t string").select(*(f(F.col("t")).alias(n) for n, f in (("n", text.normalized), ("o", text.order_number), ("l", text.leading_number), ("d", text.only_digits), ("f", text.first_number)))).collect()
    assert [x.n for x in r] == ["abc", "0123", "a123", "12cola", "007", "42", "x5y", None, ""]
    assert [x.o for x in r] == [None, "123", "123", None, "007", None, None, None, None]
    assert [x.l for x in r] == [None, None, None, 12, None, 4, None, None, None]
    assert [x.d for x in r] == [False, False, False, False, False, True, False, None, False]
    assert [x.f for x in r] == [None, 123, 123, 12, 7, 42, 5, None, None]


def test_decode(spark):
    r = spark.sql("select array(0, 1, 1, 0, 1, 3, 3, 2) t, array(0.5d, 1, 1, 1, 0, 1, 1, 1) b")
    alphabet = F.array(*(F.lit(c) for c in ".abc"))
    remap = F.create_map(F.lit(3), F.lit(1))
    k = decode.collapsed(F.col("t"))
    loose, strict = decode.collapsed(F.col("t"), remap=remap, strict=False), decode.collapsed(F.col("t"), remap=remap)
    got = r.select(decode.decoded(k, alphabet), decode.confidence(k, F.col("b")), decode.decoded(loose, alphabet), decode.decoded(strict, alphabet), decode.argmax(F.array(F.lit(1), F.lit(3), F.lit(3))), decode.difference_bits(F.array(F.lit(1), F.lit(2), F.lit(2))), decode.hamming(F.lit(5), F.lit(6)), decode.confidence(decode.collapsed(F.array(F.lit(0))), F.col("b"))).first()
    assert list(got) == ["aacb", 0.75, "aaaab", "aaab", 1, "10", 2, 0.0]


def test_whole_hashes(spark):
    """Every neighbour counts, past 31 and past 64 bits too."""
    rng = random.Random(7)
    vectors = [[float(rng.randint(0, 3)) for _ in range(n)] for n in (0, 1, 2, 32, 33, 64, 65, 66, 130, 193)] + [None]
    flip = [None if v is None else [*v[:-1], v[-2] + (1 if v[-1] <= v[-2] else -1)] if len(v) > 1 else v for v in vectors]
    other = [None if v is None else [float(rng.randint(0, 3)) for _ in v] for v in vectors]
    rows = [(k, *r) for k, r in enumerate(zip(vectors, flip, other, strict=True))]
    w = [decode.difference_words(F.col(c)) for c in "vfo"]
    got = spark.createDataFrame(rows, "k int, v array<double>, f array<double>, o array<double>").select("k", decode.hamming_words(w[0], w[1]).alias("one"), decode.hamming_words(w[0], w[2]).alias("many")).collect()
    bits = lambda v: [b > a for a, b in zip(v, v[1:], strict=False)]
    for r in got:
        v, o = vectors[r.k], other[r.k]
        assert r.one == (None if v is None else int(len(v) > 1))
        assert r.many == (None if v is None else sum(a != b for a, b in zip(bits(v), bits(o), strict=True)))


def test_few_overlaps_are_those_of_arrays(monkeypatch):
    """One by one without an array's overhead, whatever the turn and the sense of the corners."""
    import numpy as np

    from orderweave.functions import geometry as G

    rng = np.random.default_rng(5)

    def rectangle(k):
        (w, h), t = rng.uniform(5, 60, 2) / 2, (0.0, 0.1, rng.uniform(0, 6))[k % 3]
        turn = np.array([[np.cos(t), -np.sin(t)], [np.sin(t), np.cos(t)]])
        p = np.array([[-w, -h], [w, -h], [w, h], [-w, h]]) @ turn.T + rng.integers(0, 7, 2) * 10
        return (p[::-1] if k % 4 == 0 else p).ravel().tolist()

    p, q = [rectangle(k) for k in range(60)], [rectangle(k) for k in range(59)]
    q += [p[0]]
    one_by_one = np.array([[G.quad_overlap(a, b) for b in q] for a in p])
    monkeypatch.setattr(G, "FEW", 0)
    assert np.abs(one_by_one - G.quad_overlaps(p, q)).max() < 1e-12
    monkeypatch.setattr(G, "clipped_area", None)
    monkeypatch.setattr(G, "FEW", 12)
    assert G.quad_overlaps(p[:3], q[:4]).tolist() == one_by_one[:3, :4].tolist()
    assert G.quad_overlaps(p[:0], q).shape == (0, 60)
    assert G.quad_overlap([None, *p[0][1:]], p[0]) == G.quad_overlap([float("nan"), *p[0][1:]], p[0]) == 0
