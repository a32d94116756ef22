"""Orders: expected, checked, remaining and wrong items, and what follows for each order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderweave.operators import bags
from orderweave.operators.interim import tasks
from orderweave.plans.base import CHECKED, EXPECTED, MENU, WRONG, query
from orderweave.sources.sinks import order_records
from orderweave.sources.tables import Tables

_VERIFIED = f"""WITH {EXPECTED}, {CHECKED}, {WRONG},
b AS (SELECT tray, item, coalesce(e.n, 0) AS e, coalesce(c.n, 0) AS c, coalesce(w.n, 0) AS w FROM expected e FULL JOIN checked c USING (tray, item) FULL JOIN wrong w USING (tray, item)),
t AS (SELECT tray, CAST(sum(e) AS BIGINT) AS expected, count(*) FILTER (e > 0) AS expected_items, CAST(sum(c) AS BIGINT) AS checked, CAST(sum(greatest(e - c, 0)) AS BIGINT) AS remaining,
  CAST(sum(greatest(c - e, 0)) AS BIGINT) AS surplus, CAST(sum(w) AS BIGINT) AS wrong FROM b GROUP BY tray)
SELECT *, CASE WHEN expected = 0 THEN 'WAITING_TICKET' WHEN remaining = 0 AND surplus = 0 AND wrong = 0 THEN 'COMPLETED' WHEN remaining = 0 AND surplus = 0 THEN 'BLOCKED' ELSE 'WAITING_STICKERS' END AS status FROM t"""


@query("order_verification", _VERIFIED)
def order_verification(t: Tables) -> DataFrame:
    return bags.verified(t.expected, t.checked, t.wrong, ["tray"])


@query("remaining_items", f"WITH {EXPECTED}, {CHECKED} SELECT tray, item, e.n - coalesce(c.n, 0) AS n FROM expected e LEFT JOIN checked c USING (tray, item) WHERE e.n > coalesce(c.n, 0)")
def remaining_items(t: Tables) -> DataFrame:
    return bags.minus(t.expected, t.checked, ["tray"])


@query("bag_union", f"WITH {CHECKED}, {WRONG} SELECT tray, item, CAST(sum(n) AS BIGINT) AS n FROM (SELECT * FROM checked UNION ALL SELECT * FROM wrong) GROUP BY 1, 2")
def bag_union(t: Tables) -> DataFrame:
    return bags.plus(t.checked, t.wrong, ["tray"])


@query("bag_retract", "SELECT l_orderkey AS tray, l_partkey AS item FROM lineitem EXCEPT ALL SELECT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag = 'R'")
def bag_retract(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_orderkey").alias("tray"), F.col("l_partkey").alias("item"))
    gone = t.lineitem.where("l_returnflag = 'R'").select("l_orderkey", "l_partkey")
    return bags.retracted(rows, gone)


@query("wrong_items", f"WITH {WRONG} SELECT tray, item, n FROM wrong")
def wrong_items(t: Tables) -> DataFrame:
    return t.wrong


@query("distinct_expected_count", "SELECT l_orderkey AS tray, count(DISTINCT l_partkey) AS expected_item_count FROM lineitem GROUP BY 1")
def distinct_expected_count(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.col("l_orderkey").alias("tray")).agg(F.count_distinct("l_partkey").alias("expected_item_count"))


_EXPAND = f"""WITH {MENU}, m AS (SELECT name, arg_max(sub_items, pos) AS subs FROM menu GROUP BY name),
names AS (SELECT l_orderkey AS tray, CASE WHEN l_linenumber % 2 = 0 THEN p_name ELSE p_name || ' *' END AS item, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)
SELECT tray, item, CAST(sum(n) AS BIGINT) AS n FROM (SELECT tray, unnest(coalesce(subs, [item])) AS item, n FROM names LEFT JOIN m ON item = name) GROUP BY 1, 2"""


@query("menu_expand", _EXPAND)
def menu_expand(t: Tables) -> DataFrame:
    """Every second line names a menu, the others something that the menu doesn't list. Lines are dealt by order once, to a number of tasks that isn't
    lowered: both groupings keep that dealing, and the memory of one doesn't follow from how many partitions were joined."""
    name = F.when(F.col("l_linenumber") % 2 == 0, F.col("p_name")).otherwise(F.concat("p_name", F.lit(" *")))
    lines = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("tray"), name.alias("item"), F.col("l_quantity").cast("long").alias("n"))
    items = lines.repartition(tasks(t.spark), "tray").groupBy("tray", "item").agg(F.sum("n").alias("n"))
    return bags.counted(bags.expanded(items, t.menu), ["tray"], n=F.col("n"))


@query("sub_item_set", f"WITH {MENU}, u AS (SELECT pos, unnest(sub_items) AS item FROM menu) SELECT item, min(pos) AS first_pos FROM u GROUP BY 1")
def sub_item_set(t: Tables) -> DataFrame:
    return t.menu.select("pos", F.explode("sub_items").alias("item")).groupBy("item").agg(F.min("pos").alias("first_pos"))


@query("digit_name_set", "SELECT DISTINCT p_brand AS name FROM part WHERE regexp_matches(p_brand, '[1-9]') UNION SELECT DISTINCT p_name FROM part WHERE regexp_matches(p_name, '[1-9]')")
def digit_name_set(t: Tables) -> DataFrame:
    names = t.part.select(F.col("p_brand").alias("name")).union(t.part.select("p_name"))
    return names.where(F.col("name").rlike("[1-9]")).distinct()


@query("item_counts", "SELECT tray, CAST(to_json(list(json_object(item, n) ORDER BY first_line, item)) AS VARCHAR) AS items FROM (SELECT l_orderkey AS tray, CAST(l_partkey AS VARCHAR) AS item, count(*) AS n, min(l_linenumber) AS first_line FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def item_counts(t: Tables) -> DataFrame:
    """Counts of each order's items as a list of one-key maps, in order of first sight."""
    n = t.lineitem.groupBy(F.col("l_orderkey").alias("tray"), F.col("l_partkey").cast("string").alias("item")).agg(F.count(F.lit(1)).alias("n"), F.min("l_linenumber").alias("first_line"))
    rows = n.groupBy("tray").agg(F.array_sort(F.collect_list(F.struct("first_line", "item", "n"))).alias("r"))
    return rows.select("tray", F.to_json(F.transform("r", lambda x: F.create_map(x["item"], x["n"]))).alias("items"))


@query("sticker_status", f"""WITH {EXPECTED}, s AS (SELECT l_orderkey AS tray, l_partkey AS item, l_linestatus AS line, CAST(l_quantity AS BIGINT) AS q, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_shipdate, l_quantity, l_extendedprice, l_linestatus, l_linenumber, l_discount, l_tax) AS seq FROM lineitem),
c AS (SELECT *, CAST(sum(CASE WHEN line = 'F' THEN q ELSE 2 * q END) OVER (PARTITION BY tray, item ORDER BY seq) AS BIGINT) AS seen FROM s)
SELECT tray, item, seq, CASE WHEN seen <= n THEN 'MATCHED' ELSE 'WRONG_ITEM' END AS status FROM c JOIN expected USING (tray, item)""")
def sticker_status(t: Tables) -> DataFrame:
    """Stickers in order against what their item has left: all in one pass over the item's rows. Open lines count twice, so that some are too many."""
    from pyspark.sql import Window as W

    w = W.partitionBy("tray", "item").orderBy("l_shipdate", "l_quantity", "l_extendedprice", "l_linestatus", "l_linenumber", "l_discount", "l_tax")
    q = F.col("l_quantity").cast("long")
    rows = t.lineitem.withColumnsRenamed({"l_orderkey": "tray", "l_partkey": "item"}).withColumn("seq", F.row_number().over(w).cast("long"))
    rows = rows.withColumn("seen", F.sum(F.when(F.col("l_linestatus") == "F", q).otherwise(2 * q)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("n", F.sum(q).over(W.partitionBy("tray", "item")))
    return rows.select("tray", "item", "seq", F.when(F.col("seen") <= F.col("n"), "MATCHED").otherwise("WRONG_ITEM").alias("status"))


_RECORD = _VERIFIED.replace("SELECT *, CASE", "SELECT CAST(tray AS VARCHAR) AS tray_id, right('00' || (tray % 1000), 3) AS order_number, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS start_time, '' AS end_time, CAST(expected AS VARCHAR) AS expected_item, CAST(expected_items AS VARCHAR) AS expected_item_count, CAST(checked AS VARCHAR) AS checked_item, CASE").replace("AS status FROM t", "AS ignored FROM t JOIN orders ON o_orderkey = tray")


@query("order_record", f"SELECT tray_id, order_number, start_time, end_time, expected_item, expected_item_count, checked_item FROM ({_RECORD})")
def order_record(t: Tables) -> DataFrame:
    v = bags.verified(t.expected, t.checked, t.wrong, ["tray"]).join(t.orders.select(F.col("o_orderkey").alias("tray"), "o_orderdate"), "tray")
    rows = v.select(F.col("tray").alias("tray_id"), F.right(F.concat(F.lit("00"), (F.col("tray") % 1000).cast("string")), F.lit(3)).alias("order_number"), F.col("o_orderdate").alias("start_time"), F.col("expected").alias("expected_item"), F.col("expected_items").alias("expected_item_count"), F.col("checked").alias("checked_item"))
    return order_records(rows)


@query("departed_orders", "SELECT o_orderkey AS tray FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def departed_orders(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("tray")).join(t.lineitem.select(F.col("l_orderkey").alias("tray")), "tray", "left_anti")
