"""Mixing sources to target weights by Sainte-Lague apportionment, with DataFrame functions only.

Targets share all words by weight; a target stops at `most` times its source's size and
the excess is shared anew until none is above. A source's documents are dealt by a hash
into shards of about `SHARD` words, in which they lie in a seeded order. Blocks of equal
size are apportioned by highest quotients, first to sources by their targets, then to
each source's shards by their sizes, which gives an integer quota for each shard. A
shard of n blocks and quota q takes block j floor((j + 1 + s) q / n) - floor((j + s) q / n)
times, where s is drawn from the seed: q blocks in all, each floor(q / n) times or once
more. Which words of a document are taken follows from its place in the shard, so blocks
never become rows.

Ranks over all sources or shards come from a range-partitioned sort: each part numbers
its rows, and the parts' sizes give the offsets. Nothing is collected but a few sums.

Cases: null or empty texts have size 0 and are never taken; null is a source of its own,
the last; rows may repeat, and each has a place of its own; documents with equal hashes lie in
the order of their ids and texts; a very long text is one row, of which only the number of words
counts, however many shards' worth it has; without words every target is 0; an empty table gives
none; other columns of the input aren't read, so their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from orderweave.llm.shared import kept, width

WORD = r"[^\x20\x09-\x0D]+"
SHARD = 65_536
#: Words of a block, fewer where the smallest target needs it.
BLOCK = 64


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """With column name: the row's place, from 1, in the given order of all rows."""
    parts = kept(df.repartitionByRange(width(df.sparkSession), *order).withColumn("_part", F.spark_partition_id()))
    own = parts.withColumn("_own", F.row_number().over(W.partitionBy("_part").orderBy(*order)))
    before = parts.groupBy("_part").count().withColumn("_before", F.coalesce(F.sum("count").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    return own.join(F.broadcast(before), "_part").withColumn(name, F.col("_own") + F.col("_before")).drop("_part", "_own", "_before")


def targets(sources: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """sources: source, source_size. Adds weight and target."""
    held = kept(numbered(sources, [F.col("source").asc_nulls_last()], "_nth").withColumn("weight", F.element_at(F.array(*(F.lit(w) for w in weights)), (F.pmod(F.col("_nth") - 1, F.lit(len(weights))) + 1).cast("int"))).drop("_nth"))
    total = held.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level = None
    while True:  # the level rises; sources at their limit stay there
        over = F.lit(False) if level is None else F.col("weight") * F.lit(level) > F.col("source_size") * most
        full, free = held.agg(F.coalesce(F.sum(F.when(over, F.col("source_size") * most)), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0))).first()
        if not free:
            break
        after = (total - full) / free
        if level is not None and after <= level:
            break
        level = after
    limit = F.col("source_size") * most
    return held.withColumn("target", F.least(limit.cast("double"), F.col("weight") * F.lit(float(level or 0))))


def apportioned(cells: DataFrame, group: str, key: list[str], claim: str, seats: str, name: str) -> DataFrame:
    """Sainte-Lague within each group: column name has each cell's share of the group's seats.

    A claim's rounded share is within half the group's cells, times its part of all claims,
    of its final one. So only the quotients claim / (2 k + 1) about the rounded share are
    ranked, a few for each cell; ties go to the smaller key.
    """
    cells = cells.withColumn("_id", F.struct(*key))
    sums = cells.groupBy(group).agg(F.sum(claim).alias("_sum"), F.count(F.lit(1)).alias("_n"))
    c = cells.withColumnRenamed(group, "_g").join(sums.withColumnRenamed(group, "_h"), F.col("_g").eqNullSafe(F.col("_h"))).drop("_h")
    share = F.when(F.col("_sum") > 0, F.col(claim) / F.col("_sum")).otherwise(F.lit(0.0))
    c = c.withColumn("_at", F.floor(F.col(seats) * share + 0.5)).withColumn("_by", F.ceil(F.col("_n") * share / 2) + 2)
    c = kept(c.withColumn("_sure", F.greatest(F.col("_at") - F.col("_by"), F.lit(0))))
    left = c.groupBy("_g").agg((F.max(seats) - F.sum("_sure")).alias("_left"))
    q = c.where(F.col(claim) > 0).select("_g", "_id", claim, F.explode(F.sequence(F.col("_sure"), F.col("_at") + F.col("_by"))).alias("_seat"))
    q = q.select("_g", "_id", (F.col(claim) / (2 * F.col("_seat") + 1)).alias("_q"))
    q = kept(numbered(q, [F.col("_g").asc_nulls_last(), F.col("_q").desc(), F.col("_id")], "_rank"))
    start = q.groupBy("_g").agg(F.min("_rank").alias("_start"))
    begun = start.join(left.withColumnRenamed("_g", "_h"), F.col("_g").eqNullSafe(F.col("_h"))).select("_h", "_start", "_left")
    won = q.join(begun, F.col("_g").eqNullSafe(F.col("_h"))).where(F.col("_rank") - F.col("_start") < F.col("_left")).groupBy("_g", "_id").agg(F.count(F.lit(1)).alias("_won"))
    won = won.select(F.col("_g").alias("_h"), F.col("_id").alias("_k"), "_won")
    c = c.join(won, F.col("_g").eqNullSafe(F.col("_h")) & (F.col("_id") == F.col("_k")), "left").withColumn(name, (F.col("_sure") + F.coalesce("_won", F.lit(0))).cast("long"))
    return c.withColumnRenamed("_g", group).drop("_sum", "_n", "_at", "_by", "_sure", "_h", "_k", "_won", "_id")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 7) -> DataFrame:
    """A row for each row of docs: id_col, size, source_size, target, taken, and where in its shard it lies.

    Further columns: begin (its first word's place in the shard), n_blocks, quota, shift, block: see `taken_before`.
    """
    text = F.col(text_col).cast("string")
    rows = kept(docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long")).alias("size")))
    sources = kept(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most))
    total, least = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.min(F.when(F.col("target") > 0, F.col("target")))).first()
    block = max(1, min(BLOCK, int((least or 0) / 1000)))

    src = sources.select(F.col("source").alias("s"), "source_size", "target", F.greatest(F.ceil(F.col("source_size") / SHARD), F.lit(1)).alias("n_shards"))
    dealt = rows.join(src, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    dealt = dealt.withColumn("key", F.xxhash64(F.lit(seed), "id")).withColumn("shard", F.pmod("key", "n_shards"))
    place = W.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "id"), "id", "size")
    laid = kept(dealt.withColumn("begin", F.sum("size").over(place.rowsBetween(W.unboundedPreceding, 0)) - F.col("size")).drop("key", "n_shards"))

    quotas = apportioned(sources.withColumn("all", F.lit(1)).withColumn("seats", F.lit(round(total / block))), "all", ["source"], "target", "seats", "source_quota").select(F.col("source").alias("s"), "source_quota")
    cells = laid.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"))
    cells = cells.join(quotas, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    cells = apportioned(cells, "source", ["shard"], "shard_size", "source_quota", "quota").select(F.col("source").alias("s"), F.col("shard").alias("h"), "quota", F.ceil(F.col("shard_size") / block).cast("long").alias("n_blocks"))
    cells = cells.withColumn("quota", F.least("quota", F.col("n_blocks") * most)).withColumn("shift", F.when(F.col("n_blocks") > 0, F.pmod(F.xxhash64(F.lit(seed + 2), "s", "h"), "n_blocks")).otherwise(F.lit(0)))
    out = laid.join(cells, F.col("source").eqNullSafe(F.col("s")) & (F.col("shard") == F.col("h"))).withColumn("block", F.lit(block).cast("long"))
    out = out.withColumn("taken", F.when(F.col("size") > 0, taken_before(F.col("begin") + F.col("size")) - taken_before(F.col("begin"))).otherwise(F.lit(0)).cast("long"))
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", "taken", "begin", "n_blocks", "quota", "shift", "block")


def times(j: Column) -> Column:
    """How often the shard's blocks before block j are taken, all together."""
    q, n, s = F.col("quota"), F.col("n_blocks"), F.col("shift")
    return F.call_function("div", (j + s) * q, n) - F.call_function("div", s * q, n)


def taken_before(x: Column) -> Column:
    """How many words the mix takes of a shard's first x words, repeats counted."""
    b = F.col("block")
    j = F.call_function("div", x, b)
    return b * times(j) + (x % b) * (times(j + 1) - times(j))


def op7(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")
