"""Runs a stream to the end of its present input and gives what it wrote as a table."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A new folder in the one that all executors share; without one, a local one if driver and executors are one process, as in tests."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{shared}/stream-{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix="orderweave-stream-")


@contextmanager
def several_states(spark: SparkSession) -> Iterator[None]:
    """Streams that are started meanwhile use a state store that can hold several states; the session's setting comes back afterwards."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def source(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A table as a stream of its files. The pattern lets a table be a single file, which a plain path may not be."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{table}.[p]arquet")


def finished(stream: DataFrame, mode: str = "append") -> DataFrame:
    """mode append: all rows written; complete: the rows of the last batch."""
    folder = scratch(stream.sparkSession)

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/orderweave_batch={number}")

    with several_states(stream.sparkSession):
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start()
        query.awaitTermination()
    rows = stream.sparkSession.read.option("basePath", f"{folder}/out").parquet(f"{folder}/out").drop("orderweave_batch")
    if mode == "complete":
        rows = rows.join(rows.agg(F.max("_batch").alias("_batch")), "_batch")
    return rows.drop("_batch")
