"""Tickets read from text boxes, by hand-made tickets and plain versions."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from orderweave.operators import matching, tickets

SCHEMA = "ticket string, pos int, quad array<double>, text string, score double"
MENU = [("redwidget", 0), ("bluebolt", 1), ("18cut", 2), ("ねぎ玉丼", 3), ("ねぎ塩丼", 4), ("ねぎ", 5)]


def box(x0, y0, x1, y1, angle=0.0):
    c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
    return [v for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1)) for v in (x * c - y * s, x * s + y * c)]


def ticket(spark, boxes, angle=0.0, **more):
    heads = [((100, 50, 200, 70), "No 123", 0.9), ((100, 100, 280, 120), "ティクアウト", 0.9), ((300, 100, 320, 120), "枚", 0.9)]
    rows = [("t", k, box(*b, angle), text, score) for k, (b, text, score) in enumerate(heads + boxes)]
    got = tickets.parsed(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(MENU, "name string, pos int"), **more).collect()
    return sorted((r["item"], r["quantity"], r["order_number"], r["crop"] is not None) for r in got)


def test_three_ways_to_a_quantity(spark):
    lines = [((100, 140, 200, 160), "3 red widget", 0.9), ((100, 180, 200, 200), "blue bol", 0.9), ((300, 182, 310, 202), "12", 0.9), ((100, 220, 200, 240), "red widge", 0.9)]
    assert ticket(spark, lines) == [("bluebolt", 12, "123", False), ("redwidget", 1, "123", True), ("redwidget", 3, "123", False)]
    for angle in (8, -8):  # turned as a whole, rows stay rows
        assert len(ticket(spark, lines, angle)) == 3
    counts = spark.createDataFrame([("t", 3, "x4")], "ticket string, text_row int, text string")
    assert ("redwidget", 4, "123", True) in ticket(spark, lines, counts=counts)


def test_numbers_within_names(spark):
    # A number box that is part of the name is no quantity, another one is; a leading number belongs to the name.
    assert ticket(spark, [((100, 140, 200, 160), "18 cut", 0.9), ((205, 141, 215, 161), "8", 0.9)]) == [("18cut", 1, "123", True)]
    assert ticket(spark, [((100, 140, 200, 160), "18 cut", 0.9), ((300, 141, 310, 161), "5", 0.9)]) == [("18cut", 5, "123", False)]


def test_area_scores_and_numbers(spark):
    outside = [((100, 20, 200, 40), "blue bolt", 0.9), ((500, 140, 600, 160), "blue bolt", 0.9)]
    faint = [((100, 180, 200, 200), "blue bolt", 0.4), ((100, 220, 200, 240), "ねぎ玉丼", 0.4)]
    assert ticket(spark, outside + faint) == [("ねぎ玉丼", 1, "123", True)]
    rows = [("t", 0, box(0, 0, 50, 20), "blue bolt", 0.9)]
    got = tickets.parsed(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(MENU, "name string, pos int")).collect()
    assert [(r["item"], r["order_number"], r["crop"]) for r in got] == [("bluebolt", "000", None)]
    assert tickets.parsed(spark.createDataFrame([], SCHEMA), spark.createDataFrame(MENU, "name string, pos int")).count() == 0


def test_alike_prefixes(spark):
    texts = spark.createDataFrame([("ねぎ玉井",), ("ねぎ",), ("ねぎねぎねぎねぎ",), ("redwidgit",), ("zzz",), ("",)], "text string")
    got = {r.text: (r["name"], round(r.score, 1)) for r in matching.best_name(texts, spark.createDataFrame(MENU, "name string, pos int"), ["ねぎ"]).collect()}
    assert got == {"ねぎ玉井": ("ねぎ玉丼", 75.0), "ねぎ": ("ねぎ", 100.0), "redwidgit": ("redwidget", 88.9)}


def ratio(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(row[k + 1], new[k]))
        row = new
    return 200 * row[-1] / (len(a) + len(b)) if a or b else 100.0


def test_no_similar_name_is_lost(spark):
    rng = random.Random(2)
    words = ["".join(rng.choices("abcde", k=rng.randint(1, 12))) for _ in range(120)]
    menu, texts = [(w, k) for k, w in enumerate(words[:40])], words[40:]
    for least in (40.0, 70.0):
        got = {r.text: (r["name"], r.score) for r in matching.most_similar(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame(menu, "name string, pos int"), least).collect()}
        want = {}
        for t in texts:
            score, k = max((ratio(t, w), -k) for w, k in menu)
            if score > least:
                want[t] = (words[-k], score)
        assert got == want


def test_few_pairs_are_scored_among_many_names(spark):
    rng = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyzäöüéè"
    names = ["".join(rng.choices(letters, k=rng.randint(6, 14))) for _ in range(10_000)]
    texts = []
    for name in rng.sample(names, 200):
        k = rng.randrange(len(name))
        texts.append(rng.choice([name, name[:k] + rng.choice(letters) + name[k + 1 :], name[:k] + name[k + 1 :]]))
    menu = spark.createDataFrame([(w, k) for k, w in enumerate(names)], "name string, pos int")
    words = spark.createDataFrame([(t,) for t in texts], "text string")
    often = menu.select(F.explode(matching._numbered(F.col("name"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("often"))
    pairs = matching.candidates(matching._ranked(words.distinct(), "text", often), matching._ranked(menu.select("name").distinct(), "name", often), 80.0)
    assert pairs.count() < len(texts) * len(names) / 10
    got = {r.text: r["name"] for r in matching.most_similar(words, menu).collect()}
    assert got == {t: max(((ratio(t, w), -k, w) for k, w in enumerate(names) if abs(len(w) - len(t)) < 3))[2] for t in texts}


def test_stickers_against_what_remains(spark):
    menu = [("cola", 0), ("green tea", 1), ("soup", 2)]
    box = lambda y: [0.0, y, 50.0, y + 2, 50.0, y + 10, 0.0, y + 9]
    rows = [
        (1, 1, 0, box(30.0), "soup", 0.9), (1, 1, 1, box(10.0), "Ｃola ", 0.9),  # the upper box alone counts
        (2, 1, 0, box(10.0), "soup", 0.9), (3, 1, 0, box(10.0), "coal!!", 0.4), (4, 1, 0, box(10.0), "xyz", 0.9),
        (5, 2, 0, box(10.0), "cola", 0.9), (6, 3, 0, box(10.0), "cola", 0.9), (7, 1, 0, box(10.0), None, 0.9),
        (8, 1, 1, box(10.0), "greentea", 0.9), (8, 1, 0, box(10.0), "soups", 0.9),  # equally high: the first one
    ]
    boxes = spark.createDataFrame(rows, "sticker int, order int, pos int, quad array<double>, text string, score double")
    remaining = spark.createDataFrame([(1, "cola", 2), (1, "greentea", 1), (1, "soup", 0), (2, "soup", 1)], "order int, item string, n int")
    names = spark.createDataFrame([(n.replace(" ", ""), k) for n, k in menu], "name string, pos int")
    got = {r.sticker: (r.item, r.status) for r in matching.sticker_matches(boxes, remaining, names).collect()}
    assert got == {1: ("cola", "MATCHED"), 2: ("soup", "WRONG_ITEM"), 3: (None, "UNRECOGNIZED"), 4: (None, "UNRECOGNIZED"), 5: ("cola", "WRONG_ITEM"), 6: (None, "UNRECOGNIZED"), 7: (None, "UNRECOGNIZED"), 8: ("soup", "WRONG_ITEM")}


def test_corners_and_sizes(spark):
    df = spark.createDataFrame([([20.0, 10.0, 0.0, 0.0, 20.0, 0.0, 0.0, 10.0],), ([0.0, 0.0, 5.0, 0.0, 5.0, 30.0, 0.0, 30.0],)], "quad array<double>")
    rows = df.select(tickets.clockwise(F.col("quad")).alias("p")).select("p", tickets.sides(F.col("p")).alias("s"), tickets.large_enough(F.col("p")).alias("ok"), tickets.clipped(F.col("p"), F.lit(15), F.lit(8)).alias("c")).collect()
    assert rows[0].p == [0, 0, 20, 0, 20, 10, 0, 10] and rows[0].c == [0, 0, 14, 0, 14, 7, 0, 7] and not rows[0].ok
    assert tuple(rows[1].s) == (5, 30, 5, 30) and not rows[1].ok


def test_reading_order(spark):
    rng = random.Random(4)
    rows = [(t, k, [float(rng.randint(0, 60)), float(rng.randint(0, 60)), 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for t in range(20) for k in range(rng.randint(1, 12))]
    got = {(r.ticket, r.box): r.pos for r in tickets.reading_order(spark.createDataFrame(rows, "ticket int, box int, quad array<double>")).collect()}
    for t in range(20):
        done = []
        for b in sorted((r for r in rows if r[0] == t), key=lambda r: (r[2][1], r[2][0], r[1])):
            at = len(done)
            while at and abs(b[2][1] - done[at - 1][2][1]) < 10 and b[2][0] < done[at - 1][2][0]:
                at -= 1
            done.insert(at, b)
        assert [got[t, b[1]] for b in done] == list(range(len(done)))


def test_a_ticket_on_its_head(spark):
    """A ticket turned by half a circle, whose boxes are named from the upper left as they stand, in reverse order."""
    heads = [((100, 50, 200, 70), "No 123", 0.9), ((100, 100, 280, 120), "ティクアウト", 0.9), ((300, 100, 320, 120), "枚", 0.9)]
    lines = [((100, 140, 150, 160), "red", 0.9), ((160, 140, 200, 160), "widget", 0.9), ((300, 142, 310, 162), "3", 0.9), ((100, 180, 200, 200), "blue bolt", 0.9), ((100, 20, 200, 40), "blue bolt", 0.9), ((500, 140, 600, 160), "blue bolt", 0.9)]
    whole = heads + lines
    turned = [(box(600 - b[2], 400 - b[3], 600 - b[0], 400 - b[1]), text, score) for b, text, score in whole]
    upright = [("t", k, box(*b), text, score, False, 600.0) for k, (b, text, score) in enumerate(whole)]
    n = len(whole)
    flipped = [("f", n - 1 - k, q, text, score, True, 600.0) for k, (q, text, score) in enumerate(turned)]
    without = [("g", n - 1 - k, q, text, score, True, 600.0) for k, (q, text, score) in enumerate(turned) if "ティ" not in text]  # the number alone is the anchor
    df = spark.createDataFrame(upright + flipped + without, f"{SCHEMA}, flipped boolean, width double")
    got = tickets.parsed(df, spark.createDataFrame(MENU, "name string, pos int")).collect()
    found = {t: sorted((r["item"], r["quantity"], r["order_number"]) for r in got if r["ticket"] == t) for t in "tfg"}
    assert found["t"] == found["f"] == [("bluebolt", 1, "123"), ("redwidget", 3, "123")]
    assert found["g"] == [("bluebolt", 1, "123")]  # its area begins 100 beyond the number


def test_ratio_to_one_text(spark):
    from orderweave.functions import text as X

    texts = ["数", "数量", "枚数 ", "", "ティクアウト", "テイクアウト", "ティ", None, "アイウ数"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for header in ("数", "ティクアウト"):
        assert [r[0] for r in df.select(X.ratio_to(F.col("t"), header)).collect()] == [None if t is None else ratio(t, header) for t in texts]


def test_crops_stay_within_the_picture(spark):
    rows = [((50, 40, 10, 11),), ((5, 95, 10, 11),), ((200, 40, 10, 11),), (None,)]
    df = spark.createDataFrame(rows, "crop struct<cx:int,cy:int,half_width:int,half_height:int>")
    got = [r[0] and tuple(r[0]) for r in df.select(tickets.crop_sides(F.col("crop"), F.lit(120), F.lit(100))).collect()]
    assert got == [(40, 29, 60, 51), (0, 84, 15, 100), None, None]


def test_corners_in_batches_are_those_of_one_expression(spark):
    """Also of boxes with equal sums or differences, without numbers, with what isn't one, or with fewer corners."""
    r, odd = random.Random(4), [0.0, 1.0, 2.0, None, float("nan"), float("inf")]
    quads = [[r.choice(odd[:3]) for _ in range(8)] for _ in range(300)] + [[r.choice(odd) for _ in range(8)] for _ in range(300)] + [[r.uniform(0, 99) for _ in range(8)] for _ in range(100)] + [None, [1.0] * 6, []]
    rows = spark.createDataFrame([(q,) for q in quads], "quad array<double>")
    found = rows.select(tickets.clockwise(F.col("quad")).alias("p"), tickets._clockwise(F.col("quad")).alias("q")).collect()
    assert [repr(x.p) for x in found] == [repr(x.q) for x in found]


def test_reading_order_closes_what_is_near_nothing(spark):
    """Over many lines of chance boxes the fold gives the same as a pass over the whole ticket."""
    r, rows, want = random.Random(6), [], set()
    for t in range(40):
        own = [(t, k, [float(r.randrange(60)), r.choice((1.0, 3.0, 10.0)) * r.randrange(12) + r.random() / 2] * 4) for k in range(r.randrange(1, 25))]
        rows += own
        done = []
        for b in sorted(own, key=lambda b: (b[2][1], b[2][0])):
            k = len(done)
            while k and abs(b[2][1] - done[k - 1][2][1]) < 10 and b[2][0] < done[k - 1][2][0]:
                k -= 1
            done.insert(k, b)
        want |= {(t, b[1], n) for n, b in enumerate(done)}
    got = tickets.reading_order(spark.createDataFrame(rows, "ticket long, box long, quad array<double>"))
    assert {(x.ticket, x.box, x.pos) for x in got.collect()} == want
