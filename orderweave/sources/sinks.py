"""Order records and events as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderweave.sources.record_files import RecordFiles

RECORD = ("tray_id", "order_number", "start_time", "end_time", "expected_item", "expected_item_count", "checked_item")
#: With the captures, base64 of pictures that others take.
FULL_RECORD = (*RECORD, "ticket_capture", "final_tray_capture")


def record_field(column: Column, kind: T.DataType) -> Column:
    """As it stands in a record: null is empty, nested values are JSON, fractions have two digits."""
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.to_json(column), F.lit(""))
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.coalesce(F.round(column, 2).cast("string"), F.lit(""))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.coalesce(F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(""))
    return F.coalesce(column.cast("string"), F.lit(""))


def order_records(orders: DataFrame, columns: tuple[str, ...] = RECORD) -> DataFrame:
    """The known columns, in their order, as text; a column that is missing is empty, others go."""
    kinds = {f.name: f.dataType for f in orders.schema}
    return orders.select(*((record_field(F.col(c), kinds[c]) if c in kinds else F.lit("")).alias(c) for c in columns))


def write_records(orders: DataFrame, folder: str, day: Column, batch: str, columns: tuple[str, ...] = RECORD, host: str | None = None) -> None:
    """Appends records as files for each day and host (record_files.py). batch: an id by which a write that is tried again is known."""
    kinds = {f.name: f.dataType for f in orders.schema}
    rows = orders.select(F.date_format(day, "yyyyMMdd").alias("dt"), *((record_field(F.col(c), kinds[c]) if c in kinds else F.lit("")).alias(c) for c in columns))
    orders.sparkSession.dataSource.register(RecordFiles)
    out = rows.repartition("dt").write.format("record_files").mode("append").option("path", folder).option("batch", batch)
    (out.option("host", host) if host else out).save()


def frame_stamps(frames: DataFrame, ts: Column, first_hour: int = 11, last_hour: int = 19) -> DataFrame:
    """With dt, period (1 for the first working hour) and stamp; frames out of working hours go."""
    rows = frames.withColumns({"dt": F.date_format(ts, "yyyyMMdd"), "period": (F.hour(ts) - (first_hour - 1)).cast("long"), "stamp": F.date_format(ts, "HH:mm:ss")})
    return rows.where(F.hour(ts).between(first_hour, last_hour))


def write_stamps(frames: DataFrame, folder: str, ts: Column) -> None:
    """Appends stamps in a folder for each day and period."""
    frame_stamps(frames, ts).select("dt", "period", "stamp").write.mode("append").partitionBy("dt", "period").csv(folder)


def event_messages(events: DataFrame, root: str, topic: str) -> DataFrame:
    """topic, value (JSON of all columns): as message queues take them."""
    return events.select(F.lit(f"{root}/{topic}").alias("topic"), F.to_json(F.struct(*events.columns)).alias("value"))
