"""Places in the order of all rows, without a single task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orderweave.streaming.runner import scratch


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """With the row's place, from 1, in the given order of all rows.

    Rows are dealt by ranges of the order; each part numbers its own rows, and the parts' sizes, one row each, say how many
    come before. The parts are written to the shared folder first, as ranges are drawn anew when they are computed again.
    """
    spark = df.sparkSession
    folder = f"{scratch(spark)}/parts"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()).write.parquet(folder)
    rows = spark.read.parquet(folder)
    own = rows.withColumn("_own", F.row_number().over(W.partitionBy("_part").orderBy(*order)))
    sizes = rows.groupBy("_part").count()
    before = F.coalesce(F.sum("count").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_part", before.alias("_before"))
    return own.join(F.broadcast(sizes), "_part").withColumn(name, F.col("_own") + F.col("_before")).drop("_part", "_own", "_before")
