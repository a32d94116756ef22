"""Input tables and the views of the order verification domain that they stand for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orderweave.functions import geometry as G
from orderweave.operators.interim import tasks, tasks_of

#: Lines that a task gets of tickets; it makes some four boxes of each, and sorts them.
LINES = 100_000


class Tables:
    """Tables of a folder, each a Parquet file or folder; only what is used is read."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def only(self, tickets: DataFrame) -> Tables:
        """The same tables with the lines of these tickets (ticket) alone, so that windows, sorts and joins meet no others."""
        some = Tables(self.spark, self.folder)
        lines = self.lineitem.join(tickets.select(F.col("ticket").alias("l_orderkey")), "l_orderkey", "left_semi")
        some.lineitem = lines.repartition(tasks(self.spark), "l_orderkey")
        return some

    @property
    def expected(self) -> DataFrame:
        """Items of each order: tray, item, n."""
        return self.lineitem.groupBy(F.col("l_orderkey").alias("tray"), F.col("l_partkey").alias("item")).agg(F.sum(F.col("l_quantity").cast("long")).alias("n"))

    @property
    def checked(self) -> DataFrame:
        rows = self.lineitem.where("l_linestatus = 'F'")
        return rows.groupBy(F.col("l_orderkey").alias("tray"), F.col("l_partkey").alias("item")).agg(F.sum(F.col("l_quantity").cast("long")).alias("n"))

    @property
    def wrong(self) -> DataFrame:
        rows = self.lineitem.where("l_linestatus = 'F' and l_returnflag = 'R'")
        return rows.groupBy(F.col("l_orderkey").alias("tray"), F.col("l_partkey").alias("item")).agg(F.count(F.lit(1)).alias("n"))

    @property
    def menu(self) -> DataFrame:
        """Menu: pos, name, sub_items."""
        return self.part.select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("name"), F.array("p_type", "p_brand").alias("sub_items"))

    @property
    def detections(self) -> DataFrame:
        """Observations: det, ts, tray, day, cls, score, cell, box."""
        k = F.get_json_object("props", "$.k").cast("int")
        e = self.events.select(F.col("event_id").alias("det"), "ts", F.col("user_id").alias("tray"), F.to_date("ts").alias("day"), F.col("event_type").alias("cls"), (F.col("value") / 500).alias("score"), k.alias("cell"), "value")
        boxed = G.box(F.col("cell") % 10 * 10, F.floor(F.col("cell") / 10) * 10, F.col("value") % 20 + 5, F.col("det") % 15 + 5, F.col("det") % 8 * (F.lit(3.141592653589793) / 16))
        return e.withColumn("box", boxed)

    @property
    def frame_detections(self) -> DataFrame:
        """Detections of a table under a camera, four events a frame: session, frame, det, cls, quad. Things stay about where they are, and shake a little."""
        return self._frames(1, 4).drop("place")

    def _frames(self, users: int, each: int) -> DataFrame:
        """As frame_detections, of cameras for so many users and so many events a frame, with the place (0 or 1) where a thing lies."""
        e = self.events.select("event_id", F.floor(F.col("user_id") / users).alias("user_id"), "ts", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))
        n = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
        kind = F.create_map(*(F.lit(v) for p in {"view": "tray", "signup": "order_ticket", "click": "order_sticker", "purchase": "sesame_front", "error": "sesame_back"}.items() for v in p))
        e = e.withColumn("frame", F.floor(n / each)).withColumn("cls", kind[F.col("event_type")])
        shake, place = F.col("value") % 8, F.col("k") % 2
        cx = F.when(F.col("cls") == "tray", 100 + place * 200).when(F.col("cls") == "order_ticket", 60 + place * 200).otherwise(140 + place * 200) + shake
        w = F.when(F.col("cls") == "tray", 160.0).otherwise(40.0)
        box = G.box(cx, 100 + shake / 2, w, F.when(F.col("cls") == "tray", 120.0).otherwise(30.0), F.lit(0.1))
        return e.select(F.col("user_id").alias("session"), "frame", F.col("event_id").alias("det"), "cls", G.corners(box).alias("quad"), place.alias("place"))

    @property
    def camera_frames(self) -> DataFrame:
        """Detections of cameras that ten users pass, eight events a frame, with what lies there: session, frame, det, cls, quad, ticket, text.
        ticket: whose boxes (ticket_boxes) a ticket's crop shows. text: what is read of a sticker, the name of a line of the ticket at
        its place without its last letter; every seventh one is a line of another ticket, every eleventh one can't be read."""
        seen = self._frames(10, 8)
        ticket = F.col("session") * 2 + F.col("place")
        label = F.col("cls") == "order_sticker"
        whose = F.when(label & (F.col("det") % 7 == 0), ticket + 1).otherwise(ticket)
        seen = seen.withColumns({"ticket": F.when(F.col("cls") == "order_ticket", ticket), "_of": F.when(label & (F.col("det") % 11 > 0), whose)})
        shown = seen.where("_of is not null").select(F.col("_of").alias("ticket")).distinct()
        lines = self.only(shown).ticket_lines.groupBy(F.col("ticket").alias("_of")).agg(F.array_sort(F.collect_list("name")).alias("_names"))
        name = F.get("_names", F.col("det") % F.size("_names"))
        return seen.join(lines, "_of", "left").withColumn("text", F.substring(name, F.lit(1), F.length(name) - 1)).drop("_of", "_names", "place")

    @property
    def camera_commands(self) -> DataFrame:
        """Commands, one a nation, to a single camera or (session is null) to all: session, frame, what, cls, order."""
        kind = F.element_at(F.array(*map(F.lit, ("a", "b", "all"))), F.col("n_nationkey").cast("int") % 3 + 1)
        mode = F.col("n_nationkey") % 4 == 3
        return self.nation.select(
            F.when(F.col("n_regionkey") > 0, F.col("n_nationkey").cast("long")).alias("session"), (F.col("n_nationkey") * 3 + 4).cast("long").alias("frame"),
            F.when(mode, "mode").otherwise("reset").alias("what"), F.when(mode, F.when(F.col("n_nationkey") % 8 == 3, "tray").otherwise("single")).otherwise(kind).alias("cls"), F.lit(1).cast("long").alias("order"),
        )

    @property
    def observations(self) -> DataFrame:
        """What is read of orders, a second a frame: order, frame, seq, at, kind, ref, number, items. Odd lines stand on a first
        ticket, even ones on a second, which in every fourth order has another number; every line of a ticket that counts is a
        sticker, every seventh one of a wrong item that is taken away two frames later; two thirds of the orders leave at the end."""
        lines = self.ticket_lines.select("ticket", "line", "name")
        one, several = lambda k: F.lit(k).cast("long"), lambda v: F.array(v).cast("array<string>")
        number = F.lpad((F.col("ticket") % 1000).cast("string"), 3, "0")
        none, nothing = F.lit(None).cast("string"), F.array().cast("array<string>")

        def row(frame, seq, kind, ref, num=none, items=nothing):
            return F.struct(frame.cast("long").alias("frame"), one(seq).alias("seq"), F.lit(kind).alias("kind"), ref.cast("long").alias("ref"), num.alias("number"), items.alias("items"))

        frame = (F.col("line") + 2) * 4
        odd = (F.col("ticket") * 3 + F.col("line")) % 7 == 0
        stickers = lines.where("ticket % 4 > 0 or line % 2 = 0").select("ticket", F.explode(F.when(odd, F.array(row(frame, 0, "sticker", F.col("line") + 100, items=several(F.lit("other"))), row(frame + 2, 0, "sticker_gone", F.col("line") + 100), row(frame + 3, 0, "sticker", F.col("line"), items=several(F.col("name"))))).otherwise(F.array(row(frame, 0, "sticker", F.col("line"), items=several(F.col("name")))))).alias("r"))
        bags = lines.groupBy("ticket").agg(*(F.array_sort(F.collect_list(F.when(F.col("line") % 2 == k, F.col("name")))).alias(n) for k, n in ((0, "a"), (1, "b"))), F.max("line").alias("last"))
        other = F.when(F.col("ticket") % 4 == 0, F.lit("999")).otherwise(number)
        end = (F.col("last") + 3) * 4
        heads = F.array(row(F.lit(0), 0, "seen", F.lit(0)), row(F.lit(1), 0, "ticket", F.lit(1), number, F.col("a")), row(F.lit(9), 0, "ticket", F.lit(2), other, F.col("b")), row(end, 0, "tick", F.lit(0)))
        ends = F.when(F.col("ticket") % 3 > 0, F.array(row(end + 1, 0, "gone", F.lit(0)))).otherwise(F.slice(heads, 1, 0))
        rows = stickers.union(bags.select("ticket", F.explode(F.concat(heads, ends)).alias("r")))
        return rows.select(F.col("ticket").alias("order"), "r.*", F.col("r.frame").cast("double").alias("at"))

    @property
    def ticket_lines(self) -> DataFrame:
        """Lines of tickets, numbered from 0: ticket, line, name, quantity, kind (0: the number leads, 1: it stands beside, 2: it is left out, 3: too faint to be read)."""
        return self._lines()

    def _lines(self, ways: int | None = None) -> DataFrame:
        """As ticket_lines; ways: dealt by ticket to so many tasks. Lines that are alike in these four columns are so in all that is made of them, whatever their order."""
        order = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
        rows = self.lineitem.select("l_orderkey", *order)
        rows = rows.repartition(ways, "l_orderkey") if ways else rows
        lines = rows.withColumn("line", F.row_number().over(W.partitionBy("l_orderkey").orderBy(*order)) - 1).select("l_orderkey", "line", "l_partkey", F.col("l_quantity").cast("int").alias("quantity"))
        kind = F.when((F.col("l_orderkey") + F.col("line")) % 11 == 0, 3).otherwise((F.col("l_orderkey") + F.col("line")) % 3)
        lines = lines.join(self.part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "line", F.col("p_name").alias("name"), "quantity")
        lines = lines.repartition(ways, "l_orderkey") if ways else lines
        return lines.select(F.col("l_orderkey").alias("ticket"), "line", "name", "quantity", kind.cast("int").alias("kind"))

    @property
    def ticket_boxes(self) -> DataFrame:
        """Text boxes of tickets as they would be recognised: ticket, pos, quad, text, score. Every ticket is turned by -4 to 4 degrees;
        beside the lines stand a number, headers and, outside the item area, something else."""
        return self._boxes()

    def dealt_boxes(self) -> tuple[DataFrame, int]:
        """ticket_boxes, and to how many tasks they are dealt by ticket: as lines, which are less than the boxes that are made of them."""
        ways = tasks_of(self.spark, self.lineitem.count(), LINES)
        return self._boxes(ways), ways

    def _boxes(self, ways: int | None = None) -> DataFrame:
        def at(x0, x1, y, text, score, pos):
            return F.struct(*(v.cast("double").alias(n) for v, n in ((F.lit(x0), "x0"), (F.lit(x1), "x1"), (y, "y"), (score, "score"))), F.lit(pos).alias("k"), text.alias("text"))

        y = 200 + F.col("line") * 40
        word, rest = F.substring_index("name", " ", 1), F.substring_index("name", " ", -1)
        number, sure = F.col("quantity").cast("string"), F.when(F.col("kind") == 3, 0.4).otherwise(0.9)
        lead = F.when(F.col("kind") == 0, F.concat(number, word)).otherwise(word)
        boxes = F.array(at(100, 170, y, lead, sure, 0), at(180, 260, y + 1, rest, sure, 1), at(500, 560, y, word, F.lit(0.9), 2))
        beside = F.when(F.col("kind") == 1, F.array(at(300, 320, y + 2, number, F.lit(0.9), 3))).otherwise(F.slice(boxes, 1, 0))
        lines = self._lines(ways).select("ticket", ((F.col("line") + 1) * 4).alias("base"), F.explode(F.concat(boxes, beside)).alias("b"))
        code = F.lpad((F.col("l_orderkey") % 1000).cast("string"), 3, "0")
        heads = F.array(at(100, 200, F.lit(60), F.concat(F.lit("No "), code), F.lit(0.9), 0), at(100, 280, F.lit(150), F.lit("ティクアウト"), F.lit(0.9), 1), at(300, 320, F.lit(150), F.lit("数"), F.lit(0.9), 2))
        orders = self.lineitem.select("l_orderkey")
        orders = (orders.repartition(ways, "l_orderkey") if ways else orders).distinct()
        heads = orders.select(F.col("l_orderkey").alias("ticket"), F.lit(0).alias("base"), F.explode(heads).alias("b"))
        rows = heads.union(lines).select("ticket", (F.col("base") + F.col("b.k")).alias("pos"), F.radians((F.col("ticket") % 5 - 2) * 2).alias("r"), "b.*")
        corners = ((F.col("x0"), F.col("y")), (F.col("x1"), F.col("y")), (F.col("x1"), F.col("y") + 20), (F.col("x0"), F.col("y") + 20))
        quad = F.array(*(v for x, y in corners for v in G.rotate(x, y, F.col("r"), F.lit(0.0), F.lit(0.0))))
        return rows.select("ticket", "pos", quad.alias("quad"), "text", "score")

    @property
    def sticker_boxes(self) -> DataFrame:
        """Text boxes of stickers, one for each line of a ticket: sticker, order, pos, quad, text, score. The upper one has the line's
        name and a mark, if it isn't too faint."""
        high = lambda y: F.array(*(F.lit(float(v)) for v in (0, y, 80, y, 80, y + 10, 0, y + 10)))
        faint = (F.col("ticket") + F.col("line")) % 11 == 0
        upper = F.struct(F.lit(1).alias("pos"), high(5).alias("quad"), F.concat("name", F.lit("!")).alias("text"), F.when(faint, 0.4).otherwise(0.9).alias("score"))
        lower = F.struct(F.lit(0).alias("pos"), high(25).alias("quad"), F.lit("hot").alias("text"), F.lit(0.9).alias("score"))
        rows = self.ticket_lines.select((F.col("ticket") * 8 + F.col("line")).alias("sticker"), F.col("ticket").alias("order"), F.explode(F.array(upper, lower)).alias("b"))
        return rows.select("sticker", "order", "b.*")

    @property
    def tokens(self) -> DataFrame:
        """Token sequences: crop, tokens (0 is blank), best (scores)."""
        e = self.embeddings.select(F.col("vec_id").alias("crop"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
        return e.select("crop", F.transform("v", lambda x: (F.floor(F.abs(x) * 10) % 5).cast("int")).alias("tokens"), F.transform("v", lambda x: F.abs(x)).alias("best"), "v")


def natural_key(name: Column) -> Column:
    """Sorts runs of digits by their number: each is padded to 20 digits; letters by their lower case."""
    padded = F.regexp_replace(F.lower(name), r"(\d+)", "00000000000000000000$1")
    return F.regexp_replace(padded, r"0*(\d{20})(?!\d)", "$1")


def next_file_name(stem: Column) -> Column:
    """The name after a taken one: `_p2`, or the next number if it has one."""
    number = F.regexp_extract(stem, r"_p(\d+)$", 1)
    return F.when(number == "", F.concat(stem, F.lit("_p2"))).otherwise(F.concat(F.regexp_replace(stem, r"\d+$", ""), (number.try_cast("int") + 1).cast("string")))


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Characters of a recogniser: token, ch. A file with one for each line; 0 is the blank, the last one a space."""
    whole = spark.read.text(path, wholetext=True)
    lines = F.split(F.regexp_replace(F.regexp_replace("value", "\r", ""), "\n$", ""), "\n")
    return whole.select(F.posexplode(F.concat(F.array(F.lit("")), lines, F.array(F.lit(" ")))).alias("token", "ch"))


def menu_file(spark: SparkSession, path: str) -> DataFrame:
    """A menu: pos, name, sub_items, from a JSON array of names with their parts."""
    schema = "array<struct<name:string,sub_items:array<string>>>"
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.from_json("value", schema)).alias("pos", "m")).select("pos", "m.name", "m.sub_items")


def commands(feed: DataFrame, root: str) -> DataFrame:
    """A feed of topic, payload (JSON) under `root`: cmd, and the fields that are understood; other topics and broken JSON go."""
    cmd = F.lower(F.substring_index("topic", "/", -1))
    body = F.from_json("payload", "tray_id string, type string, enable string", {"mode": "PERMISSIVE"})
    valid = F.try_parse_json("payload").isNotNull()
    return feed.where(F.col("topic").startswith(f"{root}/cmd/") & valid).select("ts", cmd.alias("cmd"), body["tray_id"].alias("tray_id"), body["type"].alias("type"), (F.lower(body["enable"]) == "true").alias("enable"))


def replay(spark: SparkSession, folder: str, schema: str, files_at_once: int = 1) -> DataFrame:
    """A stream of the JSON files of a folder, oldest first, so many at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).json(folder)
