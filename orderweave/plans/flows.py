"""The course of orders, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orderweave.operators import verification
from orderweave.plans.base import query
from orderweave.sources.tables import Tables
from orderweave.streaming import order_state, runner

# Each line is a ticket entry; closed lines show a sticker, returned ones a wrong one, which leaves again on even lines.
_SEEN = """s AS (SELECT l_orderkey AS o, l_partkey AS p, l_linestatus AS st, l_returnflag AS rf, l_linenumber AS ln, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_quantity, l_extendedprice, l_linenumber, l_suppkey, l_discount, l_tax) AS k FROM lineitem),
seen AS (SELECT o AS "order", CAST(k AS BIGINT) AS frame, 'ticket' AS kind, CAST(p AS VARCHAR) AS item FROM s UNION ALL SELECT o, 1000 + 4 * k, 'sticker', CAST(p AS VARCHAR) FROM s WHERE st = 'F' OR ln % 3 > 0
  UNION ALL SELECT o, 1001 + 4 * k, 'sticker', 'x' || p FROM s WHERE rf = 'R' UNION ALL SELECT o, 1002 + 4 * k, 'gone', 'x' || p FROM s WHERE rf = 'R' AND ln % 2 = 0)"""

#: Rows of a group of orders in stream_status_events, about.
ROWS = 2000


def _observed(rows: DataFrame) -> DataFrame:
    kinds = F.array_compact(F.array(
        F.struct(F.col("k").alias("frame"), F.lit("ticket").alias("kind"), F.col("p").alias("item")),
        F.when((F.col("st") == "F") | (F.col("ln") % 3 > 0), F.struct((1000 + 4 * F.col("k")).alias("frame"), F.lit("sticker").alias("kind"), F.col("p").alias("item"))),
        F.when(F.col("rf") == "R", F.struct((1001 + 4 * F.col("k")).alias("frame"), F.lit("sticker").alias("kind"), F.concat(F.lit("x"), F.col("p")).alias("item"))),
        F.when((F.col("rf") == "R") & (F.col("ln") % 2 == 0), F.struct((1002 + 4 * F.col("k")).alias("frame"), F.lit("gone").alias("kind"), F.concat(F.lit("x"), F.col("p")).alias("item"))),
    ))
    return rows.select(F.col("o").alias("order"), F.explode(kinds).alias("e")).select("order", "e.frame", "e.kind", "e.item")


def _numbered(t: Tables) -> DataFrame:
    w = W.partitionBy("l_orderkey").orderBy("l_shipdate", "l_partkey", "l_quantity", "l_extendedprice", "l_linenumber", "l_suppkey", "l_discount", "l_tax")
    return t.lineitem.select(F.col("l_orderkey").alias("o"), F.col("l_partkey").cast("string").alias("p"), F.col("l_linestatus").alias("st"), F.col("l_returnflag").alias("rf"), F.col("l_linenumber").alias("ln"), F.row_number().over(w).cast("long").alias("k"))


_EVENTS = f"""WITH {_SEEN},
a AS (SELECT *, sum(CAST(kind = 'ticket' AS INT)) OVER (PARTITION BY "order", item) AS need, sum(CAST(kind = 'sticker' AS INT)) OVER i AS nth, sum(CAST(kind = 'gone' AS INT)) OVER i AS lft FROM seen WINDOW i AS (PARTITION BY "order", item ORDER BY frame)),
b AS (SELECT *, kind = 'sticker' AND nth <= need AS mat, kind = 'sticker' AND nth > need AS wro, kind = 'gone' AND lft <= nth - need AS settles FROM a),
c AS (SELECT *, sum(CAST(mat AS INT)) OVER f AS matched, sum(CAST(wro AS INT) - CAST(settles AS INT)) OVER f AS open, sum(CAST(kind = 'ticket' AS INT)) OVER (PARTITION BY "order") AS total, sum(CAST(kind = 'ticket' AS INT)) OVER f AS tickets FROM b WINDOW f AS (PARTITION BY "order" ORDER BY frame)),
d AS (SELECT *, min(CASE WHEN tickets = total AND matched = total AND open = 0 THEN frame END) OVER (PARTITION BY "order") AS fin, min(CASE WHEN kind = 'ticket' THEN frame END) OVER (PARTITION BY "order") AS beg FROM c),
e AS (SELECT * FROM d WHERE fin IS NULL OR frame <= fin)
SELECT "order", frame, 'TICKET_READY' AS status, CAST(NULL AS VARCHAR) AS item FROM e WHERE frame = beg UNION ALL SELECT "order", frame, 'ITEM_CHECKED', item FROM e WHERE mat
UNION ALL SELECT "order", frame, 'WRONG_ITEM_DETECTED', item FROM e WHERE wro UNION ALL SELECT "order", frame, 'TRAY_COMPLETED', NULL FROM e WHERE frame = fin"""


@query("status_events", _EVENTS)
def status_events(t: Tables) -> DataFrame:
    return verification.status_events(_observed(_numbered(t)))


@query("final_status", f"SELECT \"order\", arg_max(status, (frame, CASE status WHEN 'TRAY_COMPLETED' THEN 1 ELSE 0 END)) AS status, count(*) AS events FROM ({_EVENTS}) GROUP BY 1")
def final_status(t: Tables) -> DataFrame:
    e = verification.status_events(_observed(_numbered(t)))
    return e.groupBy("order").agg(F.max_by("status", F.struct("frame", (F.col("status") == "TRAY_COMPLETED").cast("int"))).alias("status"), F.count(F.lit(1)).alias("events"))


@query("stream_status_events", _EVENTS)
def stream_status_events(t: Tables) -> DataFrame:
    """The same events from a stream of observations: they are replayed from files, in one go here, in any number of batches in tests."""
    folder = runner.scratch(t.spark) + "/seen"
    _observed(_numbered(t)).write.parquet(folder)
    stream = t.spark.readStream.schema("order long, frame long, kind string, item string").parquet(folder)
    groups = max(1, t.spark.read.parquet(folder).count() // ROWS)
    return runner.finished(order_state.status_events(stream, groups))


def _events(t: Tables) -> DataFrame:
    """Event time must be a timestamp with a zone; the tables have none, so UTC is taken."""
    e = runner.source(t.spark, t.folder, "events")
    return e.withColumn("at", F.to_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone())).withWatermark("at", "1 hour")


@query("stream_tumbling", "SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1")
def stream_tumbling(t: Tables) -> DataFrame:
    n = _events(t).groupBy(F.window("at", "1 hour")).agg(F.count(F.lit(1)).alias("n"))
    out = runner.finished(n.select("window.start", "n"), "complete")
    return out.select(F.from_utc_timestamp("start", F.current_timezone()).cast("timestamp_ntz").alias("hour"), "n")


@query("stream_session", "WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id AS tray, min(ts) AS first_seen, count(*) AS sightings FROM s GROUP BY user_id, k")
def stream_session(t: Tables) -> DataFrame:
    s = _events(t).groupBy("user_id", F.session_window("at", "6 hours")).agg(F.count(F.lit(1)).alias("sightings"))
    out = runner.finished(s.select(F.col("user_id").alias("tray"), "session_window.start", "sightings"), "complete")
    return out.select("tray", F.from_utc_timestamp("start", F.current_timezone()).cast("timestamp_ntz").alias("first_seen"), "sightings")


@query("stream_dedup", "SELECT DISTINCT user_id AS tray, event_type AS cls FROM events")
def stream_dedup(t: Tables) -> DataFrame:
    return runner.finished(_events(t).select(F.col("user_id").alias("tray"), F.col("event_type").alias("cls")).dropDuplicates(["tray", "cls"]))
