"""The whole course of orders. What an observation leads to depends on all before it, so tests hold these against scenes made by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderweave.operators import course as C
from orderweave.plans.base import query
from orderweave.plans.tickets import LINES
from orderweave.sources.tables import Tables


@query("machine_events")
def machine_events(t: Tables) -> DataFrame:
    """Every event of every order."""
    return C.order_events(t.observations).withColumns({"items": F.to_json("items"), "checked": F.to_json("checked")})


@query("machine_final_state", """SELECT DISTINCT l_orderkey AS "order", CASE WHEN l_orderkey % 3 > 0 THEN 'TRAY_REMOVED' ELSE 'TRAY_COMPLETED' END AS status FROM lineitem""")
def machine_final_state(t: Tables) -> DataFrame:
    """How each order stands at the end: it left, or is completed, as every line of its tickets was a sticker."""
    return C.final_states(C.order_events(t.observations)).select("order", "status")


@query("machine_records", f"""WITH {LINES} SELECT ticket AS "order", name AS item, count(*) AS expected, count(*) AS checked FROM k WHERE ticket % 3 > 0 AND (ticket % 4 > 0 OR line % 2 = 0) GROUP BY 1, 2""")
def machine_records(t: Tables) -> DataFrame:
    """The records of the orders that left, a row for each item; the SQL has the lines of the tickets that count."""
    rows = C.record_lines(C.order_events(t.observations))
    side = lambda c, there: F.transform(c, lambda i: F.struct(i["item"].alias("item"), *((i["n"] if there == k else F.lit(0).cast("long")).alias(k) for k in ("expected", "checked"))))
    both = rows.select("order", F.explode(F.concat(side("expected", "expected"), side("checked", "checked"))).alias("i")).select("order", "i.*")
    return both.groupBy("order", "item").agg(F.sum("expected").alias("expected"), F.sum("checked").alias("checked"))
