"""Smaller pieces: detector heads as arrays, crops, checks of parameters, file names, stamps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orderweave.functions import arrays as A
from orderweave.functions import decode as C
from orderweave.functions import geometry as G
from orderweave.operators import detections as D
from orderweave.operators import exposure as E
from orderweave.operators import runs as R
from orderweave.plans.base import DETS, EXPECTED, TOKENS, query
from orderweave.plans.frames import _prob_sql
from orderweave.sources.sinks import frame_stamps
from orderweave.sources.tables import Tables, next_file_name
from orderweave.streaming.runner import finished, scratch

_HEAD = f"""{TOKENS}, h AS (SELECT crop, g AS anchor, v[8 * g + 1 : 8 * g + 8] AS x, (g % 4) * 8 + 4 AS ax, (g // 4) * 8 + 4 AS ay FROM toks, range(8) t(g)),
b AS (SELECT crop, anchor, ax + cos(x[5]) * (abs(x[3]) - abs(x[1])) / 2 - sin(x[5]) * (abs(x[4]) - abs(x[2])) / 2 AS cx, ay + sin(x[5]) * (abs(x[3]) - abs(x[1])) / 2 + cos(x[5]) * (abs(x[4]) - abs(x[2])) / 2 AS cy,
  abs(x[1]) + abs(x[3]) AS w, abs(x[2]) + abs(x[4]) AS h, x[5] AS r, list_position(x[6:8], list_max(x[6:8])) - 1 AS cls, list_max(x[6:8]) AS score FROM h)"""


def _head(t: Tables) -> DataFrame:
    """Eight anchors of eight values for each vector: four distances, an angle, three scores."""
    rows = t.tokens.select("crop", F.posexplode(A.rows_of(F.col("v"), 8)).alias("anchor", "x"))
    scores = F.slice("x", 6, 3)
    box = A.box_from_distances((F.col("anchor") % 4) * 8 + 4, F.floor(F.col("anchor") / 4) * 8 + 4, F.transform(F.slice("x", 1, 4), F.abs), F.get("x", F.lit(4)))
    return rows.select("crop", F.col("anchor").cast("long").alias("anchor"), box.alias("box"), C.argmax(scores).cast("long").alias("cls"), F.array_max(scores).alias("score"))


@query("head_boxes", f"WITH {_HEAD} SELECT crop, anchor, cls, round(score, 6) AS score, round(cx, 6) AS cx, round(cy, 6) AS cy, round(w, 6) AS w, round(h, 6) AS h FROM b WHERE score > 0.1")
def head_boxes(t: Tables) -> DataFrame:
    """A detector's head to boxes with class and score."""
    rows = D.confident(_head(t), 0.1)
    return rows.select("crop", "anchor", "cls", F.round("score", 6).alias("score"), *(F.round(f"box.{c}", 6).alias(c) for c in ("cx", "cy", "w", "h")))


@query("head_kept", f"""WITH {_HEAD}, c AS (SELECT *, CASE WHEN cls < 2 THEN 0 ELSE cls END AS grp FROM b WHERE score > 0.1)
SELECT crop, anchor, cls, round(cx + w / 2 * cos(r) - h / 2 * sin(r), 5) AS x1, round(cy + w / 2 * sin(r) + h / 2 * cos(r), 5) AS y1 FROM c x
WHERE NOT EXISTS (SELECT 1 FROM c y WHERE y.crop = x.crop AND y.grp = x.grp AND (y.score > x.score OR (y.score = x.score AND y.anchor < x.anchor)) AND {_prob_sql("y", "x")} >= 0.3)""")
def head_kept(t: Tables) -> DataFrame:
    """The whole chain after a detector: its head to boxes, those that are sure, without those that say the same, and their corners.
    The first two classes count as one."""
    kept = D.suppressed(D.confident(_head(t), 0.1), ["crop"], 0.3, F.when(F.col("cls") < 2, 0).otherwise(F.col("cls")), ident="anchor")
    p = kept.select("crop", "anchor", "cls", G.corners(F.col("box")).alias("p"))
    return p.select("crop", "anchor", "cls", F.round(A.at(F.col("p"), 0), 5).alias("x1"), F.round(A.at(F.col("p"), 1), 5).alias("y1"))


@query("head_corners", f"""WITH {_HEAD}, s AS (SELECT crop, anchor, least(greatest((cx - 2) / 0.5, 0), 50) AS cx, least(greatest((cy - 1) / 0.5, 0), 50) AS cy, w / 0.5 AS w, h / 0.5 AS h, r FROM b WHERE score > 0.2)
SELECT crop, anchor, round(cx + w / 2 * cos(r) - h / 2 * sin(r), 5) AS x1, round(cy + w / 2 * sin(r) + h / 2 * cos(r), 5) AS y1 FROM s""")
def head_corners(t: Tables) -> DataFrame:
    """From a head to corners in the picture: boxes, back from the letterbox, clipped, turned."""
    inside = lambda c, pad: F.least(F.greatest((c - pad) / 0.5, F.lit(0.0)), F.lit(50.0))
    b = F.col("box")
    box = F.struct(inside(b["cx"], 2).alias("cx"), inside(b["cy"], 1).alias("cy"), (b["w"] / 0.5).alias("w"), (b["h"] / 0.5).alias("h"), b["r"].alias("r"))
    p = D.confident(_head(t), 0.2).select("crop", "anchor", G.corners(box).alias("p"))
    return p.select("crop", "anchor", F.round(A.at(F.col("p"), 0), 5).alias("x1"), F.round(A.at(F.col("p"), 1), 5).alias("y1"))


@query("flip_labels", f"WITH {TOKENS} SELECT crop, i, CASE WHEN v[2 * i + 1] >= v[2 * i + 2] THEN '0' ELSE '180' END AS label, round(greatest(v[2 * i + 1], v[2 * i + 2]), 6) AS score FROM toks, range(32) t(i)")
def flip_labels(t: Tables) -> DataFrame:
    """Which way up each crop is, by the larger of two scores."""
    rows = t.tokens.select("crop", F.posexplode(A.rows_of(F.col("v"), 2)).alias("i", "x"))
    return rows.select("crop", F.col("i").cast("long").alias("i"), A.at(F.array(F.lit("0"), F.lit("180")), C.argmax(F.col("x"))).alias("label"), F.round(F.array_max("x"), 6).alias("score"))


@query("standardized", f"WITH {TOKENS} SELECT crop, round(list_sum(list_transform(range(1, 65), lambda i: (v[i] - [0.1, 0.2, 0.3][(i - 1) % 3 + 1]) / [0.5, 0.25, 0.2][(i - 1) % 3 + 1])), 5) AS total FROM toks")
def standardized(t: Tables) -> DataFrame:
    x = A.standardized(F.col("v"), [0.1, 0.2, 0.3], [0.5, 0.25, 0.2])
    return t.tokens.select("crop", F.round(F.aggregate(x, F.lit(0.0), lambda s, v: s + v), 5).alias("total"))


@query("letterboxed", f"""WITH {DETS}, s AS (SELECT det, w * 7 AS w, h * 9 AS h FROM boxes), k AS (SELECT *, least(448 / w, 320 / h) AS scale FROM s), n AS (SELECT *, CAST(floor(w * scale) AS INTEGER) AS nw, CAST(floor(h * scale) AS INTEGER) AS nh FROM k)
SELECT det, nw AS width, nh AS height, CAST(CASE WHEN 448 / w < 320 / h THEN 0 ELSE floor((448 - nw) / 2) END AS INTEGER) AS dx, CAST(CASE WHEN 448 / w < 320 / h THEN floor((320 - nh) / 2) ELSE 0 END AS INTEGER) AS dy FROM n""")
def letterboxed(t: Tables) -> DataFrame:
    """How pictures of the boxes' sizes are scaled into 448 x 320."""
    return t.detections.select("det", A.letterbox(F.col("box.w") * 7, F.col("box.h") * 9, 448, 320).alias("l")).select("det", "l.width", "l.height", "l.dx", "l.dy")


@query("crop_maps", f"""WITH {DETS} SELECT det, round(w / 2 - cos(r) * cx - sin(r) * cy, 5) AS x0, round(h / 2 + sin(r) * cx - cos(r) * cy, 5) AS y0,
  round(cx - cos(r) * w / 2 + sin(r) * h / 2, 5) AS back_x, round(cy - sin(r) * w / 2 - cos(r) * h / 2, 5) AS back_y FROM boxes""")
def crop_maps(t: Tables) -> DataFrame:
    """Where the maps of crops put the picture's origin, and where their inverses put the crop's: at its upper left corner."""
    m = t.detections.select("det", A.crop_matrix(F.col("box")).alias("m")).withColumn("i", A.inverse_map(F.col("m")))
    return m.select("det", *(F.round(A.at(F.col(c), k), 5).alias(n) for c, k, n in (("m", 2, "x0"), ("m", 5, "y0"), ("i", 2, "back_x"), ("i", 5, "back_y"))))


@query("grown_boxes", f"WITH {DETS}, g AS (SELECT det, score, w, h, w * h * 1.5 / (2 * (w + h)) AS d FROM boxes) SELECT det, round(d, 5) AS distance FROM g WHERE score >= 0.6 AND least(w, h) >= 3 AND least(w, h) + 2 * d >= 5")
def grown_boxes(t: Tables) -> DataFrame:
    """Text boxes that are sure and large enough before and after they are grown, with the distance."""
    b = F.col("box")
    d = t.detections.withColumn("distance", A.grown(G.area(G.corners(b)), 2 * (b["w"] + b["h"])))
    short = F.least(b["w"], b["h"])
    return d.where((F.col("score") >= 0.6) & (short >= 3) & (short + 2 * F.col("distance") >= 5)).select("det", F.round("distance", 5).alias("distance"))


_ARC = "2 * acos(greatest(0, 1 - 0.25 / d))"


@query("grown_polygons", f"""WITH {DETS}, g AS (SELECT det, w, h, w * h * 1.5 / (2 * (w + h)) AS d FROM boxes), n AS (SELECT *, greatest(1, ceil(pi() / 2 / ({_ARC}) - 1e-9)) AS parts FROM g)
SELECT det, CAST(4 * (parts + 1) AS BIGINT) AS corners, round(w * h + 2 * (w + h) * d + 2 * parts * d * d * sin(pi() / 2 / parts) + 1e-7, 3) AS area FROM n""")
def grown_polygons(t: Tables) -> DataFrame:
    """Text boxes grown with round corners: how many corners they have then, and their area."""
    b = F.col("box")
    d = t.detections.withColumn("p", G.corners(b)).withColumn("distance", A.grown(G.area(F.col("p")), 2 * (b["w"] + b["h"])))
    d = d.withColumn("p", G.offset(F.col("p"), F.col("distance")))
    return d.select("det", (F.size("p") / 2).cast("long").alias("corners"), F.round(G.area(F.col("p")) + 1e-7, 3).alias("area"))


_STEER = E.Control(target=120.0, tolerance=40.0, most=20_000.0, most_gain=9.0, most_bright=0.5)


def _lit(frames: DataFrame) -> DataFrame:
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    return frames.select(F.col("user_id").alias("camera"), F.row_number().over(order).cast("long").alias("frame"), F.col("value").alias("mean"), (F.col("event_id") % 4 / 5).alias("bright"), F.lit(0.0).alias("dark"))


_STEERED = """WITH RECURSIVE l AS (SELECT user_id AS camera, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frame, value AS mean, event_id % 4 / 5 AS bright FROM events),
s AS (SELECT camera, 0::BIGINT AS frame, 10000::DOUBLE AS exposure, 0::DOUBLE AS gain, '' AS change FROM (SELECT DISTINCT camera FROM l)
UNION ALL SELECT camera, frame, CASE WHEN change = 'exposure' THEN longer ELSE exposure END, CASE WHEN change = 'gain' THEN least(greatest(gain + 20 * log10(ratio), 0), 9) ELSE gain END, change FROM (
  SELECT *, CASE WHEN abs(120 - mean) <= 40 THEN 'steady' WHEN mean < 120 AND bright > 0.5 THEN 'guarded' WHEN ratio > 1 AND (exposure >= 20000 OR longer = exposure) THEN 'gain' ELSE 'exposure' END AS change FROM (
    SELECT s.camera, l.frame, s.exposure, s.gain, l.mean, l.bright, least(greatest(120 / greatest(l.mean, 1e-3), 0.5), 2) AS ratio, least(greatest(s.exposure * least(greatest(120 / greatest(l.mean, 1e-3), 0.5), 2), 100), 20000) AS longer FROM s JOIN l ON l.camera = s.camera AND l.frame = s.frame + 1)))
SELECT camera, frame, round(exposure, 3) AS exposure, round(gain, 6) AS gain, change FROM s WHERE frame > 0"""


@query("exposure_steps", _STEERED)
def exposure_steps(t: Tables) -> DataFrame:
    """Exposure and gain of each camera after each frame."""
    return E.steered(_lit(t.events), _STEER).withColumns({"exposure": F.round("exposure", 3), "gain": F.round("gain", 6)})


@query("stream_exposure_steps", _STEERED)
def stream_exposure_steps(t: Tables) -> DataFrame:
    """The same as a stream that keeps two numbers a camera."""
    folder = scratch(t.spark)
    _lit(t.events).write.parquet(f"{folder}/frames")
    stream = t.spark.readStream.schema("camera long, frame long, mean double, bright double, dark double").parquet(f"{folder}/frames")
    return finished(E.stream_steered(stream, _STEER)).withColumns({"exposure": F.round("exposure", 3), "gain": F.round("gain", 6)})


@query("large_crops", f"WITH {DETS} SELECT det FROM boxes WHERE floor(w) >= 10 AND floor(h) >= 10")
def large_crops(t: Tables) -> DataFrame:
    return t.detections.where((F.floor("box.w") >= 10) & (F.floor("box.h") >= 10)).select("det")


@query("outside_roi", f"WITH {DETS} SELECT det FROM boxes WHERE NOT (cx > 20 AND cx < 60 AND cy > 10 AND cy < 70)")
def outside_roi(t: Tables) -> DataFrame:
    roi = F.array(*(F.lit(v) for v in (20.0, 10.0, 60.0, 10.0, 60.0, 70.0, 20.0, 70.0)))
    return t.detections.where(~G.contains(roi, F.col("box.cx"), F.col("box.cy"))).select("det")


@query("checked_parameters", f"WITH {DETS} SELECT det, CASE cls WHEN 'view' THEN value BETWEEN 50 AND 300 WHEN 'click' THEN CAST(cell AS VARCHAR) IN ('1', '2', '3', '5', '8') END AS ok FROM dets WHERE cls IN ('view', 'click')")
def checked_parameters(t: Tables) -> DataFrame:
    """Values against rules: within a range, or one of those allowed; names without a rule go. The rules are a small table."""
    rules = t.spark.createDataFrame([("view", "float", 50.0, 300.0, None), ("click", "string", None, None, ["1", "2", "3", "5", "8"])], "cls string, type string, low double, high double, allowed array<string>")
    d = t.detections.select("det", "cls", F.when(F.col("cls") == "view", F.col("value").cast("string")).otherwise(F.concat(F.lit(" "), F.col("cell").cast("string"))).alias("given"))
    ok = F.when(F.col("type") == "float", F.col("given").try_cast("double").between(F.col("low"), F.col("high"))).otherwise(F.array_contains("allowed", F.trim("given")))
    return d.join(F.broadcast(rules), "cls").select("det", ok.alias("ok"))


@query("parameter_names", r"""SELECT DISTINCT regexp_extract(l, '^"?([A-Za-z_][A-Za-z0-9_]*)"?[ \t]', 1) AS name FROM (SELECT trim(unnest(string_split(text, chr(10)))) || ' ' AS l FROM conversations) WHERE NOT starts_with(l, '#') AND regexp_extract(l, '^"?([A-Za-z_][A-Za-z0-9_]*)"?[ \t]', 1) <> ''""")
def parameter_names(t: Tables) -> DataFrame:
    """Names that begin the lines of a dump."""
    line = t.conversations.select(F.explode(F.split("text", "\n")).alias("l")).select(F.concat(F.trim("l"), F.lit(" ")).alias("l")).where(~F.col("l").startswith("#"))
    return line.select(F.regexp_extract("l", r'^"?([A-Za-z_][A-Za-z0-9_]*)"?[ \t]', 1).alias("name")).where("name <> ''").distinct()


@query("next_names", r"""SELECT DISTINCT p_type || '_' || p_size || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '_p' || (p_partkey % 3 + 1) END AS name, p_type || '_' || p_size || CASE WHEN p_partkey % 3 = 0 THEN '_p2' ELSE '_p' || (p_partkey % 3 + 2) END AS following FROM part""")
def next_names(t: Tables) -> DataFrame:
    """The file name that follows one that is taken."""
    k = F.col("p_partkey") % 3
    name = F.concat_ws("_", "p_type", F.col("p_size").cast("string"), F.when(k > 0, F.concat(F.lit("p"), (k + 1).cast("string"))))
    return t.part.select(name.alias("name")).distinct().withColumn("following", next_file_name(F.col("name")))


_PICTURES = f"{TOKENS}, g AS (SELECT crop, list_transform(v, lambda x: least(abs(x) * 500, 255)) AS a, list_transform(list_reverse(v), lambda x: least(abs(x) * 500, 255)) AS b FROM toks)"


@query("change_ratio", f"""WITH {_PICTURES}, px AS (SELECT crop, i % 8 AS x, i // 8 AS y, a[i + 1] < 200 OR b[i + 1] < 200 AS dark, abs(a[i + 1] - b[i + 1]) > 30 AS changed FROM g, range(64) t(i)),
m AS (SELECT p.crop, p.x, p.y, any_value(p.changed) AS changed FROM px p JOIN px q ON p.crop = q.crop AND q.dark AND abs(p.x - q.x) <= 1 AND abs(p.y - q.y) <= 1 GROUP BY ALL)
SELECT g.crop, round(coalesce(avg(CASE WHEN changed THEN 1.0 WHEN NOT changed THEN 0.0 END), 0), 6) AS ratio FROM g LEFT JOIN m USING (crop) GROUP BY 1""")
def change_ratio(t: Tables) -> DataFrame:
    """How much of a picture of 8 x 8 values changed, at and next to its content."""
    picture = lambda v: F.transform(v, lambda x: F.least(F.abs(x) * 500, F.lit(255.0)))
    return t.tokens.select("crop", F.round(A.change_ratio(picture(F.col("v")), picture(F.reverse("v")), 8), 6).alias("ratio"))


@query("repeated_items", f"WITH {EXPECTED} SELECT tray, string_agg(repeat(item || ' ', CAST(n AS INTEGER)), '' ORDER BY item) AS items FROM expected GROUP BY 1")
def repeated_items(t: Tables) -> DataFrame:
    """Each order's counted items as one list in which an item stands as often as it is ordered."""
    bag = t.expected.groupBy("tray").agg(F.array_sort(F.collect_list(F.struct("item", "n"))).alias("b"))
    single = F.flatten(F.transform("b", lambda x: F.array_repeat(x["item"].cast("string"), x["n"].cast("int"))))
    return bag.select("tray", F.concat(F.array_join(single, " "), F.lit(" ")).alias("items"))


@query("last_order", "SELECT o_orderkey AS tray, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS last_order FROM orders")
def last_order(t: Tables) -> DataFrame:
    """The order before, at the same place."""
    before = F.lag("o_orderkey").over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return t.orders.select(F.col("o_orderkey").alias("tray"), before.alias("last_order"))


@query("flipped_pairs", f"WITH {TOKENS} SELECT crop, i AS place, list_reverse(tokens)[i + 1] AS token, round(list_reverse(best)[i + 1], 6) AS score FROM toks, range(64) t(i)")
def flipped_pairs(t: Tables) -> DataFrame:
    """Of a crop that is upside down both lists are reversed; they belong together by position."""
    pairs = F.zip_with(F.reverse("tokens"), F.reverse("best"), lambda token, score: F.struct(token.alias("token"), score.alias("score")))
    rows = t.tokens.select("crop", F.posexplode(pairs).alias("place", "p"))
    return rows.select("crop", F.col("place").cast("long").alias("place"), "p.token", F.round("p.score", 6).alias("score"))


@query("frame_stamps", f"WITH {DETS} SELECT strftime(ts, '%Y%m%d') AS dt, hour(ts) - 10 AS period, strftime(ts, '%H:%M:%S') AS stamp, det FROM dets WHERE hour(ts) BETWEEN 11 AND 19")
def stamps(t: Tables) -> DataFrame:
    """A row for each frame within working hours, by day and period."""
    return frame_stamps(t.detections, F.col("ts")).select("dt", "period", "stamp", "det")


@query("frozen_boxes", f"""WITH {DETS}, p AS (SELECT *, lag(cx) OVER w AS px, lag(cy) OVER w AS py, lag(w) OVER w AS pw, lag(h) OVER w AS ph FROM boxes WINDOW w AS (PARTITION BY tray, cls ORDER BY ts, det)),
i AS (SELECT *, greatest(least(cx + w / 2, px + pw / 2) - greatest(cx - w / 2, px - pw / 2), 0) * greatest(least(cy + h / 2, py + ph / 2) - greatest(cy - h / 2, py - ph / 2), 0) AS inter FROM p),
n AS (SELECT *, CASE WHEN inter / (w * h + pw * ph - inter + 1e-9) >= 0.1 THEN 0 ELSE 1 END AS fresh FROM i), r AS (SELECT *, sum(fresh) OVER (PARTITION BY tray, cls ORDER BY ts, det) AS run FROM n)
SELECT tray, cls, max(c) - 1 AS longest FROM (SELECT tray, cls, run, count(*) AS c FROM r GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def frozen_boxes(t: Tables) -> DataFrame:
    """For how many sightings in a row the boxes of a class overlap the one before by a tenth."""
    key, order = ["tray", "cls"], ["ts", "det"]
    d = t.detections.withColumn("_before", R.prev("box", key, order))
    r = R.runs(d, key, order, G.aligned_iou(F.col("box"), F.col("_before")) >= 0.1)
    return r.groupBy(*key).agg(F.max("run_pos").cast("long").alias("longest"))


@query("first_contours", f"WITH {DETS} SELECT tray, det FROM (SELECT tray, det, row_number() OVER (PARTITION BY tray, day ORDER BY det) AS k FROM dets) WHERE k <= 2")
def first_contours(t: Tables) -> DataFrame:
    """Of a frame's contours the first ones only, as the detector takes them."""
    return D.best(t.detections.select("tray", "day", "det"), ["tray", "day"], [F.col("det")], 2).select("tray", "det")


@query("latest_per_tray", f"WITH {DETS} SELECT tray, arg_max(det, (ts, det)) AS det FROM dets GROUP BY 1")
def latest_per_tray(t: Tables) -> DataFrame:
    """The newest frame of each tray alone, as a consumer that is slow sees it."""
    return t.detections.groupBy("tray").agg(F.max_by("det", F.struct("ts", "det")).alias("det"))


@query("one_task_a_frame", f"WITH {DETS} SELECT CAST(day AS VARCHAR) AS day, arg_min(det, (tray, cls, det)) AS det FROM dets WHERE score > 0.3 AND cls IN ('signup', 'click') GROUP BY 1")
def one_task_a_frame(t: Tables) -> DataFrame:
    """The first thing of a frame that may be read, by tray and kind."""
    rows = t.detections.where((F.col("score") > 0.3) & F.col("cls").isin("signup", "click"))
    return rows.groupBy(F.col("day").cast("string").alias("day")).agg(F.min_by("det", F.struct("tray", "cls", "det")).alias("det"))
