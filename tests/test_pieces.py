"""Grown polygons, exposure, picture differences and settings, against plain versions."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from orderweave.functions import arrays, geometry
from orderweave.operators import exposure
from orderweave.operators.exposure import Control, advance
from orderweave.sources import settings
from orderweave.streaming.runner import several_states


def area(p):
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1], strict=True))) / 2


def away(p, q):
    """How far a point lies from a polygon's edges."""
    out = math.inf
    for (ax, ay), (bx, by) in zip(p, p[1:] + p[:1], strict=True):
        dx, dy = bx - ax, by - ay
        t = min(1, max(0, ((q[0] - ax) * dx + (q[1] - ay) * dy) / (dx * dx + dy * dy)))
        out = min(out, math.hypot(q[0] - ax - t * dx, q[1] - ay - t * dy))
    return out


def test_grown_polygons(spark):
    dice, shapes = random.Random(1), []
    for n in (3, 4, 4, 4, 5, 7):
        for way in (1, -1):
            angles = sorted(dice.uniform(0, 2 * math.pi) for _ in range(n))
            if max(b - a for a, b in zip(angles, angles[1:] + [angles[0] + 2 * math.pi], strict=True)) > 3:
                continue
            shapes.append([(50 + 40 * math.cos(way * a), 60 + 25 * math.sin(way * a)) for a in angles])
    rows = [(k, [v for c in p for v in c], d) for k, p in enumerate(shapes) for d in (0.0, 1.5, 12.0, 80.0)]
    got = spark.createDataFrame(rows, "k int, p array<double>, d double").select("k", "d", geometry.offset(F.col("p"), F.col("d"), 0.05).alias("o")).collect()
    for r in got:
        p, o = shapes[r.k], list(zip(r.o[::2], r.o[1::2], strict=True))
        if r.d == 0:
            assert o == p
            continue
        edge = sum(math.dist(a, b) for a, b in zip(p, p[1:] + p[:1], strict=True))
        exact = area(p) + edge * r.d + math.pi * r.d * r.d
        assert exact - 2 * math.pi * r.d * 0.05 <= area(o) <= exact + 1e-6
        assert all(abs(away(p, q) - r.d) < 1e-9 for q in o)  # every corner lies on the true outline
        middles = [((a[0] + b[0]) / 2, (a[1] + b[1]) / 2) for a, b in zip(o, o[1:] + o[:1], strict=True)]
        assert all(r.d - 0.05 - 1e-9 <= away(p, q) <= r.d + 1e-9 for q in middles)


def test_change_ratio(spark):
    def plain(a, b, width):
        if a is None or b is None:
            return 1.0
        dark = [x < 200 or (k < len(b) and b[k] < 200) for k, x in enumerate(a)]
        near = [k for k in range(len(a)) if any(dark[j] for j in range(len(a)) if abs(j % width - k % width) < 2 and abs(j // width - k // width) < 2)]
        return sum(k < len(b) and abs(a[k] - b[k]) > 30 for k in near) / len(near) if near else 0.0

    dice = random.Random(2)
    some = lambda n: [float(dice.choice([10, 100, 250, 251, 255])) for _ in range(n)]
    rows = [(some(n), some(dice.choice([n, n - 1]))) for n in (1, 5, 12, 13, 20) for _ in range(6)] + [(None, [1.0]), ([1.0], None), ([255.0] * 9, [255.0] * 9), ([], [])]
    got = [r[0] for r in spark.createDataFrame(rows, "a array<double>, b array<double>").coalesce(1).select(arrays.change_ratio(F.col("a"), F.col("b"), 4)).collect()]
    assert got == pytest.approx([plain(a, b, 4) for a, b in rows])


C = Control(100.0, start=1000.0, most=3000.0, least=500.0, most_gain=10.0, most_bright=0.2, most_dark=0.3)


@pytest.mark.parametrize("before, seen, after", [
    ((1000.0, 0.0), (98.0, 0, 0), (1000.0, 0.0, "steady")),
    ((1000.0, 0.0), (None, 0, 0), (1000.0, 0.0, "steady")),
    ((1000.0, 0.0), (50.0, 0, 0), (2000.0, 0.0, "exposure")),
    ((1000.0, 0.0), (0.0, 0, 0), (2000.0, 0.0, "exposure")),  # by a factor of 2 at most
    ((2000.0, 0.0), (50.0, 0, 0), (3000.0, 0.0, "exposure")),
    ((3000.0, 0.0), (50.0, 0, 0), (3000.0, 20 * math.log10(2), "gain")),
    ((3000.0, 9.0), (50.0, 0, 0), (3000.0, 10.0, "gain")),
    ((3000.0, 9.0), (200.0, 0, 0), (1500.0, 9.0, "exposure")),  # darkened by exposure, whatever the gain
    ((600.0, 3.0), (400.0, 0, 0), (500.0, 3.0, "exposure")),
    ((1000.0, 0.0), (50.0, 0.25, 0), (1000.0, 0.0, "guarded")),
    ((1000.0, 0.0), (200.0, 0.25, 0.25), (500.0, 0.0, "exposure")),
    ((1000.0, 0.0), (200.0, 0, 0.35), (1000.0, 0.0, "guarded")),
])
def test_exposure_steps(before, seen, after):
    assert advance(C, *before, *seen) == pytest.approx(after)


def test_exposure_of_a_stream(spark, tmp_path):
    dice = random.Random(3)
    rows = [(c, f, dice.uniform(20, 130), dice.random() / 4, dice.random() / 2) for c in range(3) for f in range(30)]
    schema = "camera long, frame long, mean double, bright double, dark double"
    whole = sorted(map(tuple, exposure.steered(spark.createDataFrame(rows, schema), C).collect()))
    (tmp_path / "in").mkdir()
    for k, (lo, hi) in enumerate(((0, 9), (9, 10), (10, 30))):
        spark.createDataFrame([r for r in rows if lo <= r[1] < hi], schema).coalesce(1).write.parquet(str(tmp_path / f"p{k}"))
        next((tmp_path / f"p{k}").glob("*.parquet")).rename(tmp_path / "in" / f"{k}.parquet")
    out, stream = [], spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with several_states(spark):
        exposure.stream_steered(stream, C).writeStream.foreachBatch(lambda df, n: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, out)) == whole and {r[4] for r in whole} == {"steady", "guarded", "exposure", "gain"}


MAIN = """
includes: {classes: classes.yaml, menus_mapping: menus.yaml}
mode: MODE
mqtt: {host: localhost}
thresholds: {ai_conf: 0.5, ai_iou: "0.4"}
placement: {roi_strink: 0.1, iou_assign: 0.35, iou_candidate: 0.8, drift_iou_thresh: 0.95}
stability: {n_settle_frame: 7, k_container_fail: 3, k_container_new: 12, tray_missing_frame: 15, sticker_missing_frame: 16, ticket_leave_frame: 31}
birghtness_controller: {tolerance: 4, max_step_ratio: 1.5, overexposed_guard: null}
preset_roi: {ticket_roi: {points: [[0, 0], [10, 0], [10, 5], [0, 5]], color: [0, 1, 2]}}
"""


def folder(tmp_path, text):
    pytest.importorskip("yaml")
    (tmp_path / "classes.yaml").write_text("classes: [{id: 0, name: tray}, {id: '1', name: order_ticket}]")
    (tmp_path / "menus.yaml").write_text("mapping: [{name: set, sub_items: [tea, 7]}, {name: soup, sub_items: []}]")
    (tmp_path / "main.yaml").write_text(text)
    return tmp_path / "main.yaml"


def test_settings(spark, tmp_path):
    s = settings.load(folder(tmp_path, MAIN.replace("MODE", "Preset_ROI")))
    assert (s.service.tracking.mode, s.service.settled, s.service.tracking.tray, s.service.tracking.new_frames, s.service.tracking.ticket_leave) == ("preset_roi", 7, 0.35, 12, 31)
    assert s.service.area == (0.0, 0.0, 10.0, 0.0, 10.0, 5.0, 0.0, 5.0) and (s.score, s.overlap) == (0.5, 0.4) and s.classes == {0: "tray", 1: "order_ticket"}
    assert [tuple(r) for r in s.menu_table(spark).collect()] == [(0, "set", ["tea", "7"]), (1, "soup", [])] and not s.unknown
    assert (s.control(99.0).target, s.control(99.0).step, s.control(99.0).most_bright) == (99.0, 1.5, None)


def test_settings_that_are_wrong(tmp_path):
    with pytest.warns(UserWarning, match="no mode 'wrong'"):
        assert settings.load(folder(tmp_path, MAIN.replace("MODE", "wrong"))).service.tracking.mode == "tray"
    with pytest.warns(UserWarning, match="placement.iou_asign, extra|extra, placement.iou_asign"):
        s = settings.load(folder(tmp_path, MAIN.replace("MODE", "tray").replace("iou_assign: 0.35", "iou_assign: 0.35, iou_asign: 1") + "extra: 1\n"))
    assert set(s.unknown) == {"placement.iou_asign", "extra"}
    for old, new, said in (("n_settle_frame: 7, ", "", "stability.n_settle_frame is missing"), ("n_settle_frame: 7", "n_settle_frame: many", "stability.n_settle_frame is 'many'"), ("classes.yaml", "none.yaml", "none.yaml"), ("[10, 5], ", "", "four corners"), ("ticket_roi", "object_roi", "preset_roi.ticket_roi is missing")):
        with pytest.raises(ValueError, match=said):
            settings.load(folder(tmp_path, MAIN.replace("MODE", "tray").replace(old, new)))
