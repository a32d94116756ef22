"""One run from camera frames and text boxes to events, tasks and records. The fold depends on all that came before, which SQL doesn't express;
tests hold it against scenes made by hand and a plain version, and the stream against the batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderweave.functions import text as X
from orderweave.operators import matching
from orderweave.operators import service as S
from orderweave.operators import tickets as K
from orderweave.operators.tracking import Rules
from orderweave.plans.base import query
from orderweave.sources.tables import Tables
from orderweave.streaming.runner import finished, scratch

RULES = Rules(mode="single", new_frames=2, confirm_frames=2, tray_missing=4, sticker_missing=3, ticket_leave=5)
SERVICE = S.Service(RULES, settled=1, margin=2, delay=1, silence=30.0)


def feed(t: Tables) -> DataFrame:
    """The columns service.FEED. Tickets are parsed from their boxes, a piece of each item; stickers take the name that their text is
    most like, if it is above 60; a frame lasts a second."""
    seen = t.camera_frames
    menu = t.part.groupBy(X.normalized(F.col("p_name"), compatible=False).alias("name")).agg(F.min("p_partkey").cast("long").alias("pos"))
    shown = seen.where("ticket is not null").select("ticket").distinct()
    rows = K.parsed(t.only(shown).ticket_boxes, menu)
    orders = rows.groupBy("ticket").agg(F.min("order_number").alias("_number"), F.array_sort(F.collect_list(F.struct("text_row", "item")))["item"].alias("_items"))
    words = seen.where("text is not null").select("text").distinct().withColumn("_clean", X.normalized(F.col("text")))
    names = matching.best_name(words.select(F.col("_clean").alias("text")), menu, ()).where("score > 60").select(F.col("text").alias("_clean"), F.col("name").alias("_name"))
    words = words.join(names, "_clean").select("text", "_name")
    read = seen.join(orders, "ticket", "left").join(words, "text", "left")
    items = F.coalesce("_items", F.when(F.col("_name").isNotNull(), F.array("_name")))
    dets = read.select("session", "frame", F.lit("det").alias("kind"), F.col("det").alias("seq"), "cls", "quad", F.col("_number").alias("number"), items.alias("items"), F.lit(None).cast("long").alias("order"), F.lit(None).cast("string").alias("what"))
    told = S.fanned(t.camera_commands, seen.select("session").distinct())
    commands = told.select("session", "frame", F.lit("command").alias("kind"), F.xxhash64("what", "cls").alias("seq"), "cls", F.lit(None).cast("array<double>").alias("quad"), F.lit(None).cast("string").alias("number"), F.lit(None).cast("array<string>").alias("items"), "order", "what")
    return dets.union(commands).withColumn("at", 1.0 + F.col("frame"))


def _plain(out: DataFrame) -> DataFrame:
    return out.withColumns({"items": F.to_json("items"), "checked": F.to_json("checked")})


@query("service_events")
def service_events(t: Tables) -> DataFrame:
    """Every event, task and record of every camera."""
    return _plain(S.events(feed(t), SERVICE))


@query("service_records")
def service_records(t: Tables) -> DataFrame:
    """The records of the orders that left, or whose camera saw nothing any more."""
    out = S.records(S.events(feed(t), SERVICE, until=1e12))
    return out.withColumns({"expected": F.to_json("expected"), "checked": F.to_json("checked")})


@query("recognition_tasks")
def recognition_tasks(t: Tables) -> DataFrame:
    """What is read, one thing at a time, of trays and what lies in them."""
    empty = {"kind": F.lit("det"), "number": F.lit(None).cast("string"), "items": F.lit(None).cast("array<string>"), "order": F.lit(None).cast("long"), "what": F.lit(None).cast("string"), "at": 1.0 + F.col("frame")}
    rules = Rules(new_frames=2, tray_missing=5, sticker_missing=3)
    out = S.events(t.camera_frames.withColumnRenamed("det", "seq").withColumns(empty), S.Service(rules, settled=1, delay=2))
    return out.where("status = 'TASK'").select("session", "frame", "order", "what")


@query("stream_service_events")
def stream_service_events(t: Tables) -> DataFrame:
    """The same as service_events, as a stream with a session's trays and things as typed states, and with timers."""
    folder = scratch(t.spark)
    feed(t).repartition("session").write.parquet(f"{folder}/feed")
    stream = t.spark.readStream.schema(S.FEED).parquet(f"{folder}/feed")
    return _plain(finished(S.stream_events(stream, SERVICE)))
