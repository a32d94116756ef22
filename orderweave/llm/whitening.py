"""Embedding whitening by upper-triangle column aggregates.

Entries c become whole numbers x = floor(64 c) + 1000000. A first aggregation has each dimension's exact sum, a second one
the sum of centred products for every pair of dimensions i <= j, as generated SQL expressions of one statement; the driver
sees those sums alone, assembles the covariance and decomposes it (LAPACK). Rows are then projected where they lie, and a
third aggregation, of the same form over the whitened columns, measures how far their covariance is from the identity.

Centring is exact up to one rounding: x less the whole number nearest to the mean, then less the rest of the mean.
Sums of products are combined in each task, then over at most `BUCKETS` buckets of tasks, whose rows of sums the driver adds. The generated statement grows with the square of the
dimension: 2,080 sums for 64 dimensions; it is meant for some hundred dimensions.

Cases: vectors null or with null or non-finite entries take no part; an x beyond 2**62 counts as the nearest such number; a
deviation beyond a long is given as the largest long; vectors of different dimension are lists of their own, whitened
apart (one pass for each dimension that occurs), and an empty vector has no components; components without variance (at
most 1e-12 of the largest eigenvalue) can't be whitened and are left out, so a list of equal rows has none; repeated rows
count and are returned as often as they occur; a null id is kept; an empty table gives none; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderweave.llm.shared import width
from orderweave.llm.vectors import finite

SCALE, SHIFT = 64, 1_000_000
_MOST = 1 << 62
_LONG = (1 << 63) - 1
#: Share of the largest eigenvalue up to which a component counts as without variance.
FLAT = 1e-12
#: Rows of sums that the driver sees, at most.
BUCKETS = 256


@dataclass(frozen=True)
class Whitening:
    """Of a list of n vectors: sums of x by dimension, eigenvalues that aren't 0 (falling), their unit eigenvectors as columns, and the trace."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    axes: np.ndarray
    trace: float

    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        """The whole numbers nearest to the means, and what the means have beside them."""
        near = [round(Fraction(s, self.n)) for s in self.sums]
        return np.array(near, np.int64), np.array([float(Fraction(s, self.n) - c) for s, c in zip(self.sums, near, strict=True)])

    def apply(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whitened components and deviations of rows of x."""
        near, rest = self.centre()
        away = x - near
        z = (away.astype(float) - rest) @ (self.axes / np.sqrt(self.values))
        left = [s - self.n * int(c) for s, c in zip(self.sums, near, strict=True)]  # n x - S = n (x - near) - left
        most = self.n * int(np.abs(away).max(initial=0)) + max(map(abs, left), default=0)
        if most * most * max(1, len(left)) <= _LONG:
            return z, ((self.n * away - np.array(left, np.int64)) ** 2).sum(axis=1)
        whole = (away.astype(object) * self.n - np.array(left, object)) ** 2
        return z, np.array([min(int(v), _LONG) for v in whole.sum(axis=1)], np.int64)


def whole_entries(embedding: Column) -> Column:
    """x of each entry."""
    return F.transform(embedding, lambda c: F.floor(F.greatest(F.lit(-float(_MOST)), F.least(F.lit(float(_MOST)), c.cast("double") * SCALE))) + SHIFT)


def _triangle(columns: DataFrame, d: int) -> np.ndarray:
    """The symmetric matrix of sums of products of the columns y0, y1, ... of `columns`, which also have their task's bucket."""
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = columns.sparkSession.sql(f"SELECT {', '.join(f'sum(y{i} * y{j}) AS p{i}_{j}' for i, j in pairs)} FROM {{t}} GROUP BY bucket", t=columns).toArrow()
    out = np.zeros((d, d))
    for k, (i, j) in enumerate(pairs):
        out[i, j] = out[j, i] = sums.column(k).to_numpy().sum()
    return out


def _bucket(df: DataFrame) -> Column:
    return F.pmod(F.spark_partition_id(), F.lit(min(BUCKETS, width(df.sparkSession)))).alias("bucket")


def fit(rows: DataFrame, d: int, n: int) -> Whitening:
    """rows: x, arrays of d whole numbers, n of them."""
    sums = rows.select(*(F.col("x")[i].alias(f"x{i}") for i in range(d))).agg(*(F.sum(F.col(f"x{i}").cast("decimal(20,0)")).alias(f"s{i}") for i in range(d))).first()
    w = Whitening(n, tuple(int(s) for s in sums), np.zeros(0), np.zeros((d, 0)), 0.0)
    near, rest = w.centre()
    y = rows.select(_bucket(rows), *(((F.col("x")[i] - F.lit(int(near[i]))).cast("double") - F.lit(float(rest[i]))).alias(f"y{i}") for i in range(d)))
    values, axes = np.linalg.eigh(_triangle(y, d) / n)
    values, axes = values[::-1], axes[:, ::-1]
    there = values > FLAT * max(values[0], 0.0)
    sign = np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(d)])  # so that a rerun gives the same sign
    return Whitening(n, w.sums, values[there], (axes * sign)[:, there], float(values.sum()))


def _applied(w: Whitening, d: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, d)
            z, deviation = w.apply(x)
            z = np.ascontiguousarray(z[:, :most])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * z.shape[1], pa.int32()), pa.array(z.ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(deviation, pa.int64()), lists], ["id", "deviation", "z"])

    return run


def whiten(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", most: int = 32) -> DataFrame:
    """Columns id_col, component, n, deviation, whitened, explained, identity_error: a row for each vector and each of its first `most` components."""
    x = rows.where(F.col(vec_col).isNotNull() & finite(F.col(vec_col))).select(F.col(id_col).cast("long").alias("id"), whole_entries(F.col(vec_col)).alias("x"))
    out = None
    for d, n in sorted(map(tuple, x.groupBy(F.size("x")).count().collect())):
        if d == 0:
            continue
        own = x.where(F.size("x") == d)
        w = fit(own, d, n)
        k = min(most, len(w.values))
        if not k:
            continue
        z = own.mapInArrow(_applied(w, d, most), "id long, deviation long, z array<double>")
        spread = _triangle(z.select(_bucket(z), *(F.col("z")[i].alias(f"y{i}") for i in range(k))), k) / n
        share = F.array(*(F.lit(float(v / w.trace)) for v in w.values[:k]))
        part = z.select("id", "deviation", F.posexplode("z").alias("place", "whitened")).select(
            F.col("id").alias(id_col), (F.col("place") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
            share[F.col("place")].alias("explained"), F.lit(float(np.abs(spread - np.eye(k)).max())).alias("identity_error"),
        )
        out = part if out is None else out.union(part)
    empty = rows.sparkSession.createDataFrame([], f"`{id_col}` long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return empty if out is None else out


def op12(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
