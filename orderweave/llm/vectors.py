"""Vectors for search: which take part, shards of bounded size, and blocks of queries.

A shard holds about `shard` vectors of one dimension, dealt by a hash, a block about `together`
queries; both are up to 16 times as large once there are enough rows for TASKS of them, as every
shard is sent once for each block. So they follow from the number of rows alone, not from a session's settings. Each task searches one block in one shard; the stated query
set is held against all rows in such blocks. Rows that are equal in every part count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderweave.llm.shared import pieces

SHARD = 2048
QUERIES = 1024
#: Tasks for which there is one shard each before shards become larger.
TASKS = 64


def finite(embedding: Column) -> Column:
    return F.coalesce(F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def vectors(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Columns vec_id, v (doubles), dim, of the rows whose id isn't null and whose components are all there and finite."""
    v = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    return v.where(finite(F.col("v"))).distinct().withColumn("dim", F.size("v"))


def dealt(v: DataFrame, every: int, shard: int = SHARD, together: int = QUERIES) -> tuple[DataFrame, DataFrame, int, int]:
    """All with their shard, the queries (ids divisible by every) with a block and the shard that has them, the number of shards and of blocks."""
    n, q = v.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("vec_id") % every == 0).cast("long")), F.lit(0))).first()
    shards, blocks = (pieces(total, min(16 * least, max(least, total // TASKS))) for total, least in ((n, shard), (q, together)))
    rows = v.withColumn("shard", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(shards)))
    queries = rows.where(F.col("vec_id") % every == 0)
    queries = queries.select(F.col("vec_id").alias("q_id"), F.col("v").alias("q"), F.col("dim").alias("q_dim"), F.col("shard").alias("q_shard"), F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(blocks)).alias("q_block"))
    return rows, queries, shards, blocks


def each(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
