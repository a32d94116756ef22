"""Tickets read from text boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderweave.functions import text as X
from orderweave.operators import matching
from orderweave.operators import tickets as K
from orderweave.plans.base import query
from orderweave.sources.tables import Tables

#: The lines that the boxes were written from: reading a ticket gives them back.
LINES = """l AS (SELECT l_orderkey AS ticket, l_partkey, CAST(l_quantity AS INTEGER) AS quantity,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) - 1 AS INTEGER) AS line FROM lineitem),
k AS (SELECT ticket, line, quantity, p_name AS name, replace(p_name, ' ', '') AS item, CASE WHEN (ticket + line) % 11 = 0 THEN 3 ELSE (ticket + line) % 3 END AS kind FROM l JOIN part ON l_partkey = p_partkey)"""


@query("ticket_parse", f"""WITH {LINES} SELECT ticket, CAST(row_number() OVER (PARTITION BY ticket ORDER BY line) AS INTEGER) AS text_row, item,
  CASE WHEN kind = 2 THEN 1 ELSE quantity END AS quantity, lpad(CAST(ticket % 1000 AS VARCHAR), 3, '0') AS order_number, kind = 2 OR (kind = 1 AND quantity = 1) AS wants_crop FROM k WHERE kind < 3""")
def ticket_parse(t: Tables) -> DataFrame:
    """Items and quantities of each ticket, from its turned boxes; the SQL has the lines that they were written from."""
    menu = t.part.groupBy(X.normalized(F.col("p_name"), compatible=False).alias("name")).agg(F.min("p_partkey").cast("long").alias("pos"))
    boxes, ways = t.dealt_boxes()
    rows = K.parsed(boxes, menu, ways=ways)
    return rows.select("ticket", "text_row", "item", "quantity", "order_number", F.col("crop").isNotNull().alias("wants_crop"))


@query("sticker_match", f"""WITH {LINES}, r AS (SELECT DISTINCT ticket, item FROM k WHERE line % 3 > 0 AND ticket % 5 > 0),
s AS (SELECT ticket * 8 + line AS sticker, ticket, item, (ticket + line) % 11 > 0 AND ticket IN (SELECT ticket FROM r) AS known, (ticket, item) IN (SELECT (ticket, item) FROM r) AS there FROM k)
SELECT sticker, CASE WHEN known THEN item END AS item, CASE WHEN NOT known THEN 'UNRECOGNIZED' WHEN there THEN 'MATCHED' ELSE 'WRONG_ITEM' END AS status FROM s""")
def sticker_match(t: Tables) -> DataFrame:
    """Each sticker's item, by its upper text box, and whether it is among what remains of its order."""
    menu = t.part.groupBy(X.normalized(F.col("p_name"), compatible=False).alias("name")).agg(F.min("p_partkey").cast("long").alias("pos"))
    left = t.ticket_lines.where("line % 3 > 0 and ticket % 5 > 0").groupBy(F.col("ticket").alias("order"), X.normalized(F.col("name"), compatible=False).alias("item")).agg(F.count(F.lit(1)).alias("n"))
    return matching.sticker_matches(t.sticker_boxes, left, menu).select("sticker", "item", "status")


@query("ticket_skew", """SELECT DISTINCT l_orderkey AS ticket, CAST((l_orderkey % 5 - 2) * 2 AS DOUBLE) AS degrees FROM lineitem""")
def ticket_skew(t: Tables) -> DataFrame:
    """How far each ticket is turned, from its boxes alone."""
    return K.skew(t.ticket_boxes).groupBy("ticket").agg((F.round(F.degrees(F.first("theta")), 6) + 0.0).alias("degrees"))


@query("text_box_sizes", """SELECT CAST(x1 - x0 AS DOUBLE) AS width, count(*) AS n FROM (SELECT unnest([100, 180, 500]) AS x0, unnest([170, 260, 560]) AS x1 FROM lineitem UNION ALL SELECT 300, 320 FROM l1
  UNION ALL SELECT unnest([100, 100, 300]), unnest([200, 280, 320]) FROM (SELECT DISTINCT l_orderkey FROM lineitem)) GROUP BY 1""".replace("l1", f"(WITH {LINES} SELECT * FROM k WHERE kind = 1)"))
def text_box_sizes(t: Tables) -> DataFrame:
    """How many boxes of each width there are, of those that are large enough, corners put in order first."""
    p = t.ticket_boxes.select(K.clockwise(F.col("quad")).alias("p"))
    width = F.when(K.large_enough(F.col("p")), F.round(K.sides(F.col("p"))["width"], 4))
    return p.groupBy(width.alias("width")).agg(F.count(F.lit(1)).alias("n")).where("width is not null")


@query("reading_order")
def reading_order(t: Tables) -> DataFrame:
    """Boxes of each ticket from top to bottom and from left to right; a pass that depends on order, which tests hold against a plain version."""
    out = K.reading_order(t.ticket_boxes.select("ticket", F.col("pos").alias("box"), "quad"))
    return out.select("ticket", "box", F.col("pos").cast("int").alias("place"))
