"""Things followed from frame to frame. The folds depend on order, which SQL doesn't express; tests hold them against scenes made by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderweave.operators import tracking as K
from orderweave.plans.base import query
from orderweave.sources.tables import Tables

RULES = K.Rules(new_frames=2, tray_missing=3, sticker_missing=2)
SINGLE = K.Rules(mode="single", ticket_leave=3, sticker_missing=2)


@query("tracked_things")
def tracked_things(t: Tables) -> DataFrame:
    """Trays with what lies in them, over all frames."""
    return K.tracked(t.frame_detections, RULES)


@query("tracked_single")
def tracked_single(t: Tables) -> DataFrame:
    """One order at a time: tickets, extra tickets and stickers, whatever the place."""
    return K.tracked(t.frame_detections, SINGLE)


@query("tracked_in_area")
def tracked_in_area(t: Tables) -> DataFrame:
    """One order at a time, whose tickets lie within a preset area."""
    return K.tracked(K.tickets_by_place(t.frame_detections, [0.0, 0.0, 200.0, 0.0, 200.0, 300.0, 0.0, 300.0], True), SINGLE)


@query("tray_lives")
def tray_lives(t: Tables) -> DataFrame:
    """When each tray came and left, how often its place was taken over anew, and how many tickets and stickers it held."""
    rows = K.tracked(t.frame_detections, RULES)
    own = rows.withColumn("tray", F.when(F.col("kind") == "tray", F.col("track")).otherwise(F.col("holder"))).where("tray is not null")
    on = lambda c: F.count(F.when(c, 1))
    return own.groupBy("session", "tray").agg(
        F.min("frame").alias("first_frame"),
        F.max(F.when((F.col("kind") == "tray") & (F.col("status") == "lost"), F.col("frame"))).alias("left_frame"),
        on(F.col("status") == "snapped").alias("snaps"),
        on((F.col("kind") == "ticket") & F.col("status").isin("new", "replaced")).alias("tickets"),
        on((F.col("kind") == "sticker") & F.col("status").isin("new", "promoted")).alias("stickers"),
    )
