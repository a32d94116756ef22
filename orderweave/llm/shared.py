"""Where intermediate results are kept, and how work is cut into bounded pieces."""

from __future__ import annotations

import math
import re
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def kept(df: DataFrame) -> DataFrame:
    """The rows of df written to the folder that the cluster names in spark.checkpoint.dir, so that lost executors don't lose them.

    Where that setting is missing, a folder of our own is set: in the warehouse, which executors share, or a temporary
    one if driver and executors are one process, as in tests.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        one = re.match(r"local(\[|$)", spark.sparkContext.master)
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="orderweave-") if one else f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints")
    return df.checkpoint(eager=True)


#: Rows of an Arrow batch of texts, at most.
BATCH = 1000


def modest_batches(spark: SparkSession) -> None:
    """Texts may be long, and the JVM and Python both hold a batch of them, so batches are kept short for this session."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH:
        spark.conf.set(key, BATCH)


def sparing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """run over batches, after which Arrow gives back the memory that it holds free: workers live on from stage to stage."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return mapped


def block_of(ident: Column, text: Column, blocks: int) -> Column:
    """The block of a row, by a hash of its id, its text and its input partition, so that rows that are equal don't all meet in one."""
    return F.pmod(F.xxhash64(ident, text, F.spark_partition_id()), F.lit(blocks))


def text_bytes(docs: DataFrame, text_col: str) -> tuple[int, int]:
    """Number of rows and of UTF-8 bytes of the texts."""
    n, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.col(text_col))), F.lit(0))).first()
    return n, size


def pieces(total: int, each: int) -> int:
    return max(1, math.ceil(total / each))


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sampled(texts: DataFrame, ids: DataFrame, order: Column, most: int, most_bytes: int) -> DataFrame:
    """ids (column _id and others), the first `most` in the given order whose texts together don't go beyond `most_bytes`; the text
    that does so is the last one. No text is left out for its length. texts: _id, text. `most` bounds what the driver sees.
    """
    some = ids.orderBy(order, "_id").limit(most)
    sizes = texts.join(F.broadcast(some), "_id").groupBy("_id").agg(F.max(F.octet_length("text")).alias("size"))
    total, chosen = 0, []
    for row in sizes.select("_id", F.coalesce("size", F.lit(0)).alias("size"), order.alias("_order")).toArrow().sort_by([("_order", "ascending"), ("_id", "ascending")]).to_pylist():
        if total >= most_bytes:
            break
        total += row["size"]
        chosen.append((row["_id"],))
    keep = ids.sparkSession.createDataFrame(chosen, ids.select("_id").schema)
    return some.join(F.broadcast(keep), "_id")


def one_text(rows: DataFrame) -> DataFrame:
    """Of the rows of an _id one, that with the smallest hash of the text; combined before the shuffle."""
    others = [c for c in rows.columns if c not in ("_id", "text")]
    return rows.groupBy("_id", *others).agg(F.min_by("text", F.struct(F.xxhash64("text"), F.col("text"))).alias("text"))
