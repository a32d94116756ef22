"""What is computed once and used several times."""

from __future__ import annotations

import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _folder(session: SparkSession) -> str:
    """Where rows are kept: the folder that spark.checkpoint.dir names. Without that setting a local one is taken if driver and executors are one process, as in tests."""
    context = session.sparkContext
    if not session.conf.get("spark.checkpoint.dir", None) and not context.getCheckpointDir():
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="orderweave-"))
    return context.getCheckpointDir() or session.conf.get("spark.checkpoint.dir")


def written(df: DataFrame) -> DataFrame:
    """The rows of df, computed now and kept in a shared folder, so that lost executors don't lose them."""
    _folder(df.sparkSession)
    return df.checkpoint(eager=True)


def filed(df: DataFrame) -> DataFrame:
    """As written, for many rows: by columns, whose like values take a fraction of what whole rows do."""
    path = f"{_folder(df.sparkSession)}/filed-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks(session: SparkSession) -> int:
    """Into how many tasks work goes that takes time by its rows. Given as a number, adaptive execution leaves it alone; else it joins partitions by their
    bytes, and a few tasks are long while other cores wait."""
    return max(int(session.conf.get("spark.sql.shuffle.partitions")), 4 * session.sparkContext.defaultParallelism)


def tasks_of(session: SparkSession, rows: int, each: int) -> int:
    """As tasks, but for large tables so many that each gets about so many rows: what it sorts then stays in its memory, however large the table is."""
    return max(tasks(session), -(-rows // each))


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt by key for a walk in Python. By the key's hash: rows that are dealt by the key itself already, in joined partitions, would be left as they are."""
    return rows.repartition(tasks(rows.sparkSession), F.xxhash64(key))


def values(column: pa.Array) -> list:
    """to_pylist, without a scalar object for each value where numpy has a shorter way."""
    if pa.types.is_string(column.type) or not column.null_count and (pa.types.is_integer(column.type) or pa.types.is_floating(column.type)):
        return column.to_numpy(zero_copy_only=False).tolist()
    if pa.types.is_list(column.type):
        at, flat = column.offsets.to_numpy().tolist(), values(column.values)
        if not column.null_count:
            return [flat[lo:hi] for lo, hi in zip(at, at[1:], strict=False)]
        return [flat[lo:hi] if there else None for lo, hi, there in zip(at, at[1:], column.is_valid().to_numpy(zero_copy_only=False).tolist(), strict=False)]
    return column.to_pylist()
