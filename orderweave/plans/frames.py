"""Detections: filters, routing, geometry, suppression and ordered state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orderweave.functions import geometry as G
from orderweave.operators import detections as D
from orderweave.operators import runs as R
from orderweave.plans.base import DETS, query
from orderweave.sources.tables import Tables

KEY, ORDER = ["tray"], ["ts", "det"]
ROUTES = {"view": "tray", "signup": "ticket", "click": "sticker", "purchase": "sticker"}
MARKS = {"view": 0.5, "click": 0.4, "purchase": 0.3, "signup": 0.6}


@query("conf_filter", f"WITH {DETS} SELECT det, tray, score FROM dets WHERE score > 0.5")
def conf_filter(t: Tables) -> DataFrame:
    return D.confident(t.detections, 0.5).select("det", "tray", "score")


@query("per_class_conf", f"WITH {DETS} SELECT det, cls, score FROM dets WHERE score > CASE cls " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in MARKS.items()) + " END")
def per_class_conf(t: Tables) -> DataFrame:
    return D.confident(t.detections, MARKS).select("det", "cls", "score")


@query("class_route", f"WITH {DETS} SELECT det, CASE cls " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ROUTES.items()) + " END AS route FROM dets WHERE cls IN (" + ", ".join(f"'{k}'" for k in ROUTES) + ")")
def class_route(t: Tables) -> DataFrame:
    return D.routed(t.detections, ROUTES).select("det", "route")


@query("ocr_score_filter", f"WITH {DETS} SELECT det, score FROM dets WHERE score >= CASE WHEN starts_with(cls, 'pur') THEN 0.3 ELSE 0.5 END")
def ocr_score_filter(t: Tables) -> DataFrame:
    return t.detections.where(F.col("score") >= F.when(F.col("cls").startswith("pur"), 0.3).otherwise(0.5)).select("det", "score")


@query("title_filter", f"WITH {DETS}, m AS (SELECT *, max(least(w, h)) OVER p AS mx, count(*) OVER p AS c FROM boxes WINDOW p AS (PARTITION BY tray, day)) SELECT det, tray FROM m WHERE c <= 2 OR least(w, h) >= 0.75 * mx")
def title_filter(t: Tables) -> DataFrame:
    rows = t.detections.withColumn("short", F.least(F.col("box.w"), F.col("box.h")))
    return D.tallest(rows, ["tray", "day"], "short").select("det", "tray")


@query("layout_vote", f"WITH {DETS} SELECT tray, round(avg(CASE WHEN h / w >= 1.4 THEN 1.0 ELSE 0.0 END), 6) AS share, avg(CASE WHEN h / w >= 1.4 THEN 1.0 ELSE 0.0 END) >= 0.2 AS yes FROM boxes GROUP BY 1")
def layout_vote(t: Tables) -> DataFrame:
    return D.vote(t.detections, KEY, F.col("box.h") / F.col("box.w") >= 1.4, 0.2, False).withColumn("share", F.round("share", 6))


@query("flip_vote", f"WITH {DETS} SELECT tray, round(avg(CASE WHEN cls = 'error' AND score > 0.1 THEN 1.0 ELSE 0.0 END), 6) AS share, avg(CASE WHEN cls = 'error' AND score > 0.1 THEN 1.0 ELSE 0.0 END) > 0.2 AS yes FROM dets GROUP BY 1")
def flip_vote(t: Tables) -> DataFrame:
    return D.vote(t.detections, KEY, (F.col("cls") == "error") & (F.col("score") > 0.1), 0.2, True).withColumn("share", F.round("share", 6))


@query("period_bucket", f"WITH {DETS} SELECT hour(ts) - 10 AS period, count(*) AS n FROM dets WHERE hour(ts) BETWEEN 11 AND 19 GROUP BY 1")
def period_bucket(t: Tables) -> DataFrame:
    hour = F.hour("ts")
    return t.detections.where(hour.between(11, 19)).groupBy((hour - 10).cast("long").alias("period")).agg(F.count(F.lit(1)).alias("n"))


@query("topk_per_frame", f"WITH {DETS} SELECT tray, det, rank FROM (SELECT tray, det, CAST(row_number() OVER (PARTITION BY tray, day ORDER BY score DESC, det) AS INTEGER) AS rank FROM dets) WHERE rank <= 3")
def topk_per_frame(t: Tables) -> DataFrame:
    return D.best(t.detections, ["tray", "day"], [F.col("score").desc(), F.col("det")], 3).select("tray", "det", "rank")


@query("admitted_task", f"WITH {DETS} SELECT tray, arg_min(det, (ts, det)) AS det FROM dets WHERE cls IN ('signup', 'click', 'purchase') AND score > 0.3 GROUP BY 1")
def admitted_task(t: Tables) -> DataFrame:
    """The first task of each tray that may go to recognition."""
    rows = t.detections.where(F.col("cls").isin("signup", "click", "purchase") & (F.col("score") > 0.3))
    return rows.groupBy("tray").agg(F.min_by("det", F.struct("ts", "det")).alias("det"))


# Geometry. Results of trigonometric functions are rounded on both sides.


@query("box_corners", f"WITH {DETS} SELECT det, round(cx + w / 2 * cos(r) - h / 2 * sin(r), 6) AS x1, round(cy + w / 2 * sin(r) + h / 2 * cos(r), 6) AS y1, round(cx - w / 2 * cos(r) + h / 2 * sin(r), 6) AS x3, round(cy - w / 2 * sin(r) - h / 2 * cos(r), 6) AS y3 FROM boxes")
def box_corners(t: Tables) -> DataFrame:
    p = t.detections.select("det", G.corners(F.col("box")).alias("p"))
    return p.select("det", *(F.round(F.get("p", F.lit(i)), 6).alias(n) for i, n in ((0, "x1"), (1, "y1"), (4, "x3"), (5, "y3"))))


@query("shoelace_area", f"WITH {DETS} SELECT det, round(w * h, 4) AS area, cx AS x, cy AS y FROM boxes")
def shoelace_area(t: Tables) -> DataFrame:
    """A turned box keeps its area, and its centroid is its centre."""
    p = t.detections.select("det", G.corners(F.col("box")).alias("p"))
    c = G.centroid(F.col("p"))
    return p.select("det", F.round(G.area(F.col("p")), 4).alias("area"), (F.round(c["x"], 4) + 0.0).alias("x"), (F.round(c["y"], 4) + 0.0).alias("y"))


_PAIR = "a.tray = b.tray AND a.day = b.day AND a.det < b.det"


@query("aabb_iou", f"""WITH {DETS}, p AS (SELECT a.det, b.det AS other, greatest(least(a.cx + a.w / 2, b.cx + b.w / 2) - greatest(a.cx - a.w / 2, b.cx - b.w / 2), 0) * greatest(least(a.cy + a.h / 2, b.cy + b.h / 2) - greatest(a.cy - a.h / 2, b.cy - b.h / 2), 0) AS i, a.w * a.h + b.w * b.h AS s FROM boxes a JOIN boxes b ON {_PAIR})
SELECT det, other, round(i / (s - i + 1e-9), 6) AS iou FROM p WHERE i > 0""")
def aabb_iou(t: Tables) -> DataFrame:
    rows = D.overlapping(t.detections, ["tray", "day"], cell=32.0).withColumn("iou", G.aligned_iou(F.col("box"), F.col("other_box")))
    return rows.where("iou > 0").select("det", "other", F.round("iou", 6).alias("iou"))


@query("rotated_iou")
def rotated_iou(t: Tables) -> DataFrame:
    """Overlap of turned boxes: SQL has no polygon clipping, so tests hold it against a sampled area."""
    d = t.detections.withColumn("quad", G.corners(F.col("box")))
    rows = D.overlapping(d, ["tray", "day"], carry=("quad",), extent=D.turned, cell=32.0).select("det", "other", G.quad_iou(F.col("quad"), F.col("other_quad")).alias("iou"))
    return rows.where("iou > 0").select("det", "other", F.round("iou", 6).alias("iou"))


def _prob_sql(a: str, b: str) -> str:
    cov = lambda k: (f"({k}.w*{k}.w/12*cos({k}.r)*cos({k}.r) + {k}.h*{k}.h/12*sin({k}.r)*sin({k}.r))", f"({k}.w*{k}.w/12*sin({k}.r)*sin({k}.r) + {k}.h*{k}.h/12*cos({k}.r)*cos({k}.r))", f"(({k}.w*{k}.w/12 - {k}.h*{k}.h/12)*cos({k}.r)*sin({k}.r))")
    (p, q, s), (u, v, z) = cov(a), cov(b)
    det = f"(({p}+{u})*({q}+{v}) - ({s}+{z})*({s}+{z}))"
    dx, dy = f"({a}.cx-{b}.cx)", f"({a}.cy-{b}.cy)"
    far = f"((({p}+{u})*{dy}*{dy} + ({q}+{v})*{dx}*{dx})/({det}+1e-7)/4 - ({s}+{z})*{dx}*{dy}/({det}+1e-7)/2)"
    own = f"sqrt(greatest({p}*{q}-{s}*{s}, 0)*greatest({u}*{v}-{z}*{z}, 0))"
    return f"(1 - sqrt(1 - exp(-least(greatest({far} + ln({det}/(4*{own}+1e-7)+1e-7)/2, 1e-7), 100)) + 1e-7))"


@query("probiou_pairs", f"WITH {DETS} SELECT det, other, iou FROM (SELECT a.det, b.det AS other, round({_prob_sql('a', 'b')}, 5) AS iou FROM boxes a JOIN boxes b ON {_PAIR}) WHERE iou > 0.01")
def probiou_pairs(t: Tables) -> DataFrame:
    """Pairs above 0.01: their centres are less than 1.7 longest diagonals apart, as a quarter of the squared distance in units
    of both covariances is below -ln(1 - 0.99 ** 2), and no variance is above a twelfth of the squared diagonal."""
    d = t.detections.withColumn("gauss", G.gaussian(F.col("box")))
    pairs = D.near_pairs(d, ["tray", "day"], carry=("gauss",), wide=1.7, meets=lambda a, b: F.lit(True))
    return pairs.select("det", "other", F.round(G.gaussian_iou(F.col("gauss"), F.col("other_gauss")), 5).alias("iou")).where("iou > 0.01")


_ROI = [15.0, 12.0, 72.0, 18.0, 66.0, 73.0, 11.0, 64.0]


def _roi_sql(x: str, y: str) -> str:
    p = list(zip(_ROI[::2], _ROI[1::2], strict=True))
    return " AND ".join(f"({bx - ax}) * ({y} - {ay}) - ({by - ay}) * ({x} - {ax}) > 0" for (ax, ay), (bx, by) in zip(p, p[1:] + p[:1], strict=True))


@query("point_in_roi", f"WITH {DETS} SELECT det, ({_roi_sql('cx', 'cy')}) AS inside FROM boxes")
def point_in_roi(t: Tables) -> DataFrame:
    roi = F.array(*(F.lit(v) for v in _ROI))
    return t.detections.select("det", G.contains(roi, F.col("box.cx"), F.col("box.cy")).alias("inside"))


@query("items_in_tray", f"""WITH {DETS} SELECT a.det AS holder, b.det FROM boxes a JOIN boxes b ON a.tray = b.tray AND a.day = b.day AND a.cls = 'view' AND b.cls <> 'view'
  AND abs((b.cx - a.cx) * cos(a.r) + (b.cy - a.cy) * sin(a.r)) < a.w / 2 - 1e-6 AND abs((b.cy - a.cy) * cos(a.r) - (b.cx - a.cx) * sin(a.r)) < a.h / 2 - 1e-6""")
def items_in_tray(t: Tables) -> DataFrame:
    """Which items have their centre within which tray of the frame; an item may lie in several."""
    pairs = D.near_both(t.detections, ["tray", "day"], F.col("cls") == "view", cell=32.0)
    return pairs.where(G.within(F.col("holder_box"), F.col("box.cx"), F.col("box.cy"), 1e-6)).select("holder", "det")


@query("new_trays", f"""WITH {DETS}, v AS (SELECT * FROM boxes WHERE cls = 'view'), o AS (SELECT * FROM boxes WHERE cls = 'signup'),
p AS (SELECT a.det, greatest(least(a.cx + a.w * 0.45, b.cx + b.w * 0.45) - greatest(a.cx - a.w * 0.45, b.cx - b.w * 0.45), 0) * greatest(least(a.cy + a.h * 0.45, b.cy + b.h * 0.45) - greatest(a.cy - a.h * 0.45, b.cy - b.h * 0.45), 0) AS i, 0.81 * (a.w * a.h + b.w * b.h) AS s FROM v a JOIN o b ON a.tray = b.tray AND a.day = b.day)
SELECT det FROM v WHERE det NOT IN (SELECT det FROM p WHERE i / (s - i + 1e-9) > 0.1)""")
def new_trays(t: Tables) -> DataFrame:
    """Detections that overlap no known tray of the frame, both shrunk by a tenth; the angle is ignored, as in the SQL (new_turned_trays takes it)."""
    small = F.struct(F.col("box.cx").alias("cx"), F.col("box.cy").alias("cy"), (F.col("box.w") * 0.9).alias("w"), (F.col("box.h") * 0.9).alias("h"), F.col("box.r").alias("r"))
    d = t.detections.withColumn("small", small)
    known = d.where("cls = 'signup'").select(F.col("tray").alias("k_tray"), F.col("day").alias("k_day"), F.col("small").alias("k_small"))
    over = (F.col("tray") == F.col("k_tray")) & (F.col("day") == F.col("k_day")) & (G.aligned_iou(F.col("small"), F.col("k_small")) > 0.1)
    return d.where("cls = 'view'").join(known, over, "left_anti").select("det")


@query("new_turned_trays")
def new_turned_trays(t: Tables) -> DataFrame:
    """As new_trays, which ignores the angle as its SQL does, by the overlap of the turned boxes; tests hold it against a plain version."""
    d = t.detections.select("tray", "day", "det", "cls", "box")
    known = d.where("cls = 'signup'").select("tray", "day", F.col("box").alias("known_box"))
    views = d.where("cls = 'view'")
    pairs = views.join(known, ["tray", "day"]).where(G.in_reach(F.col("box"), F.col("known_box")))
    over = pairs.select("det", G.quad_iou(*(G.shrink(G.corners(F.col(b)), 0.1) for b in ("box", "known_box"))).alias("iou")).where("iou > 0.1")
    return views.select("det").join(over, "det", "left_anti")


@query("shrink_box", f"WITH {DETS} SELECT det, round(cx + 0.9 * (w / 2 * cos(r) - h / 2 * sin(r)), 6) AS x1, round(cy + 0.9 * (w / 2 * sin(r) + h / 2 * cos(r)), 6) AS y1 FROM boxes")
def shrink_box(t: Tables) -> DataFrame:
    p = t.detections.select("det", G.shrink(G.corners(F.col("box")), 0.1).alias("p"))
    return p.select("det", F.round(F.get("p", F.lit(0)), 6).alias("x1"), F.round(F.get("p", F.lit(1)), 6).alias("y1"))


_SKEW = f"""s AS (SELECT tray, median(a) AS med, stddev_pop(a) AS sd, avg(cx) AS px, avg(cy) AS py FROM (SELECT *, degrees(r) / 10 AS a FROM boxes) GROUP BY tray),
k AS (SELECT tray, CASE WHEN sd > 15 OR abs(med) > 30 THEN 0 ELSE med END AS theta, px, py FROM s)"""


def _skew(t: Tables) -> DataFrame:
    d = t.detections.withColumn("a", F.degrees(F.col("box.r")) / 10)
    s = d.groupBy("tray").agg(F.median("a").alias("med"), F.stddev_pop("a").alias("sd"), F.avg("box.cx").alias("px"), F.avg("box.cy").alias("py"))
    return s.select("tray", F.when((F.col("sd") > 15) | (F.abs("med") > 30), 0.0).otherwise(F.col("med")).alias("theta"), "px", "py")


@query("skew_median", f"WITH {DETS}, {_SKEW} SELECT tray, round(theta, 6) AS theta, round(px, 6) AS px, round(py, 6) AS py FROM k")
def skew_median(t: Tables) -> DataFrame:
    return _skew(t).select("tray", *(F.round(c, 6).alias(c) for c in ("theta", "px", "py")))


@query("skew_corrected", f"WITH {DETS}, {_SKEW} SELECT det, round(px + (cx - px) * cos(-radians(theta)) - (cy - py) * sin(-radians(theta)), 5) AS x, round(py + (cx - px) * sin(-radians(theta)) + (cy - py) * cos(-radians(theta)), 5) AS y FROM boxes JOIN k USING (tray)")
def skew_corrected(t: Tables) -> DataFrame:
    d = t.detections.join(_skew(t), "tray")
    x, y = G.rotate(F.col("box.cx"), F.col("box.cy"), -F.radians("theta"), F.col("px"), F.col("py"))
    return d.select("det", F.round(x, 5).alias("x"), F.round(y, 5).alias("y"))


@query("angle_norm", f"WITH {DETS} SELECT det, round(CASE WHEN r * 3 - 2 < 0 THEN r * 3 - 2 + 2 * pi() ELSE r * 3 - 2 END % (pi() / 2), 6) AS angle FROM boxes")
def angle_norm(t: Tables) -> DataFrame:
    a = F.col("box.r") * 3 - 2
    return t.detections.select("det", F.round(F.when(a < 0, a + 2 * F.pi()).otherwise(a) % (F.pi() / 2), 6).alias("angle"))


@query("unletterbox", f"WITH {DETS} SELECT det, least(greatest((cx - 24) / 0.5, 0), 100) AS x, least(greatest((cy - 8) / 0.5, 0), 100) AS y, w / 0.5 AS w, h / 0.5 AS h FROM boxes")
def unletterbox(t: Tables) -> DataFrame:
    """Back from a padded, scaled picture: pad 24 and 8, scale one half, 100 x 100."""
    inside = lambda c, pad: F.least(F.greatest((c - pad) / 0.5, F.lit(0.0)), F.lit(100.0))
    return t.detections.select("det", inside(F.col("box.cx"), 24).alias("x"), inside(F.col("box.cy"), 8).alias("y"), (F.col("box.w") / 0.5).alias("w"), (F.col("box.h") / 0.5).alias("h"))


@query("anchor_grid", "SELECT CAST(s AS INTEGER) AS stride, CAST((x + 0.5) * s AS DOUBLE) AS cx, CAST((y + 0.5) * s AS DOUBLE) AS cy FROM (SELECT unnest([8, 16, 32]) AS s) t, range(56) a(x), range(56) b(y) WHERE x < 448 // s AND y < 448 // s")
def anchor_grid(t: Tables) -> DataFrame:
    strides = t.spark.createDataFrame([(8,), (16,), (32,)], "stride int")
    side = F.sequence(F.lit(0), (448 / F.col("stride")).cast("int") - 1)
    grid = strides.withColumn("x", F.explode(side)).withColumn("y", F.explode(side))
    return grid.select("stride", ((F.col("x") + F.lit(0.5).cast("double")) * F.col("stride")).alias("cx"), ((F.col("y") + F.lit(0.5).cast("double")) * F.col("stride")).alias("cy"))


_HIGHER = "(b.score > a.score OR (b.score = a.score AND b.det < a.det))"


def _nms_sql(group: str) -> str:
    g = lambda k: group.replace("cls", f"{k}.cls")
    return f"WITH {DETS} SELECT det FROM boxes a WHERE NOT EXISTS (SELECT 1 FROM boxes b WHERE a.tray = b.tray AND a.day = b.day AND {g('a')} = {g('b')} AND {_HIGHER} AND {_prob_sql('b', 'a')} >= 0.4)"


@query("nms_keep", _nms_sql("cls"))
def nms_keep(t: Tables) -> DataFrame:
    return D.suppressed(t.detections, ["tray", "day"], 0.4, F.col("cls")).select("det")


@query("nms_partial_agnostic", _nms_sql("CASE WHEN cls IN ('click', 'purchase') THEN 'sticker' ELSE cls END"))
def nms_partial_agnostic(t: Tables) -> DataFrame:
    """Classes that look alike are one group."""
    group = F.when(F.col("cls").isin("click", "purchase"), "sticker").otherwise(F.col("cls"))
    return D.suppressed(t.detections, ["tray", "day"], 0.4, group).select("det")


# Ordered state.

_ISLANDS = "n AS (SELECT *, CASE WHEN cls = lag(cls) OVER w THEN 0 ELSE 1 END AS fresh FROM dets WINDOW w AS (PARTITION BY tray ORDER BY ts, det)), i AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY tray ORDER BY ts, det) - 1 AS BIGINT) AS run FROM n)"


def _class_runs(t: Tables) -> DataFrame:
    d = t.detections.select("tray", "ts", "det", "cls", "score", "cell", "box", "value")
    return R.runs(d.withColumn("_before", R.prev("cls", KEY, ORDER)), KEY, ORDER, F.col("cls") == F.col("_before")).drop("_before")


@query("stable_runs", f"WITH {DETS}, {_ISLANDS} SELECT tray, run, any_value(cls) AS cls, count(*) - 1 AS stable_frames FROM i GROUP BY 1, 2")
def stable_runs(t: Tables) -> DataFrame:
    """Stability counts from 0, at the first sight."""
    return _class_runs(t).groupBy("tray", "run").agg(F.any_value("cls").alias("cls"), (F.count(F.lit(1)) - 1).alias("stable_frames"))


@query("promotion_k3", f"WITH {DETS}, {_ISLANDS}, p AS (SELECT *, row_number() OVER (PARTITION BY tray, run ORDER BY ts, det) AS k FROM i) SELECT tray, run, det FROM p WHERE k = 3")
def promotion_k3(t: Tables) -> DataFrame:
    return R.promoted(_class_runs(t), 3).select("tray", "run", "det")


@query("missing_runs", f"WITH {DETS}, g AS (SELECT tray, cls, n - coalesce(lag(n) OVER (PARTITION BY tray, cls ORDER BY n), n) AS step FROM (SELECT tray, cls, row_number() OVER (PARTITION BY tray ORDER BY ts, det) AS n FROM dets)) SELECT tray, cls, CAST(max(greatest(step - 1, 0)) AS BIGINT) AS longest_missing FROM g GROUP BY 1, 2")
def missing_runs(t: Tables) -> DataFrame:
    """For how many frames of its tray a class stays unseen at most."""
    n = t.detections.select("tray", "cls", F.row_number().over(W.partitionBy("tray").orderBy(*ORDER)).cast("long").alias("n"))
    step = F.col("n") - F.lag("n").over(W.partitionBy("tray", "cls").orderBy("n"))
    return n.withColumn("step", step).groupBy("tray", "cls").agg(F.max(F.greatest(F.coalesce("step", F.lit(0)) - 1, F.lit(0))).cast("long").alias("longest_missing"))


@query("freeze_runs", f"WITH {DETS}, n AS (SELECT *, CASE WHEN abs(score - lag(score) OVER w) <= 0.1 THEN 0 ELSE 1 END AS fresh FROM dets WINDOW w AS (PARTITION BY tray ORDER BY ts, det)), i AS (SELECT *, sum(fresh) OVER (PARTITION BY tray ORDER BY ts, det) AS run FROM n) SELECT tray, max(c) - 1 AS longest FROM (SELECT tray, run, count(*) AS c FROM i GROUP BY 1, 2) GROUP BY 1")
def freeze_runs(t: Tables) -> DataFrame:
    """The longest run in which each sighting stays close to the one before."""
    d = t.detections.withColumn("_before", R.prev("score", KEY, ORDER))
    r = R.runs(d, KEY, ORDER, F.abs(F.col("score") - F.col("_before")) <= 0.1)
    return r.groupBy("tray").agg(F.max("run_pos").cast("long").alias("longest"))


@query("mismatch_streak", f"WITH {DETS}, c AS (SELECT tray, ts, det, score, row_number() OVER (PARTITION BY tray ORDER BY ts, det) AS n FROM dets), k AS (SELECT *, sum(CASE WHEN score > 0.15 THEN 0 ELSE 1 END) OVER (PARTITION BY tray ORDER BY n) AS g FROM c WHERE n % 2 = 0) SELECT tray, det FROM (SELECT tray, det, score, row_number() OVER (PARTITION BY tray, g, score > 0.15 ORDER BY n) AS streak FROM k) WHERE score > 0.15 AND streak = 3")
def mismatch_streak(t: Tables) -> DataFrame:
    """Every second sighting is checked; the third mismatch in a row reopens."""
    n = t.detections.withColumn("n", F.row_number().over(W.partitionBy("tray").orderBy(*ORDER))).where("n % 2 = 0")
    off = F.col("score") > 0.15
    g = n.withColumn("g", F.sum(F.when(off, 0).otherwise(1)).over(W.partitionBy("tray").orderBy("n"))).where(off)
    return g.withColumn("streak", F.row_number().over(W.partitionBy("tray", "g").orderBy("n"))).where("streak = 3").select("tray", "det")


@query("session_departures", f"WITH {DETS}, g AS (SELECT tray, ts, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY tray ORDER BY ts)) <= 21600 THEN 0 ELSE 1 END AS fresh FROM dets), v AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY tray ORDER BY ts) - 1 AS BIGINT) AS visit FROM g) SELECT tray, visit, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS sightings FROM v GROUP BY 1, 2")
def session_departures(t: Tables) -> DataFrame:
    """Visits that end after six hours out of sight."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    gap = at - F.lag(at).over(W.partitionBy("tray").orderBy("ts"))
    return R.departures(t.detections.select("tray", "ts"), KEY, "ts", gap, F.lit(21600))


@query("period_changes", f"WITH {DETS}, p AS (SELECT tray, det, ts, hour(ts) // 6 AS period FROM dets) SELECT tray, det, period FROM (SELECT *, lag(period) OVER (PARTITION BY tray ORDER BY ts, det) AS old FROM p) WHERE old IS DISTINCT FROM period")
def period_changes(t: Tables) -> DataFrame:
    d = t.detections.select("tray", "det", "ts", F.floor(F.hour("ts") / 6).cast("long").alias("period"))
    return d.withColumn("old", R.prev("period", KEY, ORDER)).where(~F.col("old").eqNullSafe(F.col("period"))).select("tray", "det", "period")


_NUMBERED = f"{DETS}, o AS (SELECT tray, score, epoch(ts)::DOUBLE AS sec, row_number() OVER (PARTITION BY tray ORDER BY ts, det) AS n FROM dets)"


@query("heartbeat", f"WITH RECURSIVE {_NUMBERED}, f AS (SELECT tray, n, sec AS sent, true AS due FROM o WHERE n = 1 UNION ALL SELECT o.tray, o.n, CASE WHEN o.sec - f.sent >= 36000 THEN o.sec ELSE f.sent END, o.sec - f.sent >= 36000 FROM f JOIN o ON o.tray = f.tray AND o.n = f.n + 1) SELECT tray, count(*) FILTER (due) AS notices FROM f GROUP BY 1")
def heartbeat(t: Tables) -> DataFrame:
    """Notices at least ten hours apart, each counted from the last one sent."""
    d = t.detections.select("tray", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return R.throttled(d, KEY, "at", 36000.0).groupBy("tray").agg(F.count(F.lit(1)).alias("notices"))


@query("drift_snaps", f"WITH RECURSIVE {_NUMBERED}, f AS (SELECT tray, n, CASE WHEN score < 0.5 THEN 1 ELSE 0 END AS drift, 0 AS snaps FROM o WHERE n = 1 UNION ALL SELECT o.tray, o.n, CASE WHEN o.score >= 0.5 OR f.drift = 2 THEN 0 ELSE f.drift + 1 END, f.snaps + CASE WHEN o.score < 0.5 AND f.drift = 2 THEN 1 ELSE 0 END FROM f JOIN o ON o.tray = f.tray AND o.n = f.n + 1) SELECT tray, CAST(max(snaps) AS INTEGER) AS snaps FROM f GROUP BY 1")
def drift_snaps(t: Tables) -> DataFrame:
    """A place is taken over after three sightings off it in a row; then counting begins again: of a run of n, n / 3 times."""
    off = F.col("score") < 0.5
    d = t.detections.select("tray", "ts", "det", "score").withColumn("_before", R.prev("score", KEY, ORDER))
    islands = R.runs(d, KEY, ORDER, off == (F.col("_before") < 0.5)).groupBy("tray", "run").agg(F.any_value("score").alias("score"), F.count(F.lit(1)).alias("n"))
    return islands.groupBy("tray").agg(F.coalesce(F.sum(F.when(off, F.floor(F.col("n") / 3))), F.lit(0)).cast("int").alias("snaps"))


@query("greedy_assignment")
def greedy_assignment(t: Tables) -> DataFrame:
    """Trays of a frame take, one after another, the detection that overlaps them most and is still free: a fold over a frame's trays.

    Each tray brings the detections that it overlaps enough, best first, so the fold only keeps what is taken.
    """
    pairs = D.near_both(t.detections, ["tray", "day"], F.col("cls") == "view", inside=False, cell=32.0)
    pairs = pairs.withColumn("iou", G.quad_iou(G.corners(F.col("holder_box")), G.corners(F.col("box")))).where("iou >= 0.3")
    offers = pairs.groupBy("tray", "day", "holder").agg(F.array_sort(F.collect_list(F.struct((-F.col("iou")).alias("less"), "det"))).alias("offers"))
    start = F.array().cast("array<struct<holder:bigint,det:bigint>>")

    def step(taken, row):
        free = F.filter(row["offers"], lambda o: ~F.exists(taken, lambda x: x["det"] == o["det"]))
        first = F.get(free, F.lit(0))
        return F.when(first.isNull(), taken).otherwise(F.concat(taken, F.array(F.struct(row["holder"].alias("holder"), first["det"].alias("det")))))

    done = R.folded(offers, ["tray", "day"], ["holder"], ["offers"], start, step)
    return done.select(F.explode("state").alias("m")).select("m.holder", "m.det")


@query("row_cluster")
def row_cluster(t: Tables) -> DataFrame:
    """Boxes of a frame, in order, to rows of text; tests hold it against a plain version."""
    d = t.detections.select("tray", "day", "det", F.col("box.cy").alias("cy"), F.col("box.h").alias("h"))
    return R.row_clusters(d, ["tray", "day"], ["det"], "cy", "h").select("det", F.col("text_row").cast("long").alias("text_row"))


@query("topmost_box", f"WITH {DETS} SELECT tray, CAST(day AS VARCHAR) AS day, arg_min(det, (cy - h / 2, det)) AS det FROM boxes GROUP BY 1, 2")
def topmost_box(t: Tables) -> DataFrame:
    return t.detections.groupBy("tray", F.col("day").cast("string").alias("day")).agg(F.min_by("det", F.struct(F.col("box.cy") - F.col("box.h") / 2, F.col("det"))).alias("det"))


@query("row_text", f"WITH {DETS} SELECT tray, CAST(day AS VARCHAR) AS day, cy, string_agg(cls, '' ORDER BY cx, det) AS text, arg_max(cls, (length(cls), -det)) AS longest FROM boxes GROUP BY 1, 2, 3")
def row_text(t: Tables) -> DataFrame:
    rows = t.detections.groupBy("tray", "day", F.col("box.cy").alias("cy")).agg(F.array_sort(F.collect_list(F.struct(F.col("box.cx"), F.col("det"), F.col("cls")))).alias("r"), F.max_by("cls", F.struct(F.length("cls"), -F.col("det"))).alias("longest"))
    return rows.select("tray", F.col("day").cast("string").alias("day"), "cy", F.array_join("r.cls", "").alias("text"), "longest")


@query("nearest_digit", f"""WITH {DETS}, a AS (SELECT * FROM boxes WHERE cls <> 'error'), d AS (SELECT * FROM boxes WHERE cls = 'error')
SELECT a.det, (SELECT d.cell FROM d WHERE d.tray = a.tray AND abs(d.value - a.value) < 0.8 * a.h ORDER BY abs(d.value - a.value), d.value, d.cell LIMIT 1) AS nearest_value FROM a""")
def nearest_digit(t: Tables) -> DataFrame:
    """The number whose place is nearest to a row's, within 0.8 of the row's height."""
    d = t.detections.select("tray", "det", "cls", "value", "cell", F.col("box.h").alias("h"))
    rows, marks = d.where("cls <> 'error'").drop("cell"), d.where("cls = 'error'").select("tray", F.col("value").alias("place"), "cell")
    return D.nearest(rows, marks, "tray", "value", "place", "cell", 0.8 * F.col("h")).select("det", "nearest_value")


@query("frame_rate", f"WITH {DETS} SELECT date_trunc('hour', ts) AS hour, count(*) AS frames FROM dets GROUP BY 1")
def frame_rate(t: Tables) -> DataFrame:
    return t.detections.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count(F.lit(1)).alias("frames"))


@query("exposure_stats", f"WITH {DETS} SELECT tray, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS deviation, round(avg(CASE WHEN value >= 250 THEN 1.0 ELSE 0 END), 6) AS bright, round(avg(CASE WHEN value <= 5 THEN 1.0 ELSE 0 END), 6) AS dark, round(least(greatest(120 / avg(value), 0.5), 2), 6) AS gain FROM dets GROUP BY 1")
def exposure_stats(t: Tables) -> DataFrame:
    """Mean, deviation, shares of blown and black values, and the ratio to a target of 120 within a half and two."""
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    v = F.col("value")
    return t.detections.groupBy("tray").agg(F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_pop(v), 6).alias("deviation"), share(v >= 250).alias("bright"), share(v <= 5).alias("dark"), F.round(F.least(F.greatest(120 / F.avg(v), F.lit(0.5)), F.lit(2.0)), 6).alias("gain"))
