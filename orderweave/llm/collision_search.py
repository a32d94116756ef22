"""Approximate nearest neighbours by collision-counting hashing.

Each shard projects its vectors on `PROJECTIONS` random lines and sorts each line's values.
A query opens a window about its own value on every line; a vector in the window of a
line collides once. Virtual rehashing widens all windows by the same factor, and only
what they newly hold is counted. A vector whose collisions exceed the threshold is
verified: its distance is computed on the original vectors. A query ends when the k-th
verified distance is within its radius, or when all of the shard has been verified.

A vector at the radius collides on a line with chance p(1), one at `RATIO` times the radius
with p(RATIO); the threshold lies between them, nearer the second, so that a true
neighbour is missed in a few cases of a hundred. Every vector is indexed. The
projections are seeded, so reruns agree; measured recall is in the README.

Cases: see vectors.py; zero vectors take no part; ids that rows share are not told apart;
only vectors of the query's dimension are candidates; a distance beyond the largest double is
given as infinite and counts as such; equal distances go to smaller ids; an empty table gives none; other columns of the input aren't read, so their names can't clash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from orderweave.llm import vectors as V
from orderweave.llm.exact_search import _matrix

PROJECTIONS = 64
#: Vectors of a shard: in a larger one the k-th neighbour is nearer, so that windows stay smaller; and queries of a block.
SHARD, QUERIES = 8192, 256
WIDEN = 1.2
RATIO = 1.3
#: Queries that are counted together; their counts take this many rows of a shard.
TOGETHER = 64


def chance(ratio: float) -> float:
    """That a vector at ratio times the radius lies in a window of one radius to each side."""
    return math.erf(1 / ratio / math.sqrt(2))


THRESHOLD = math.ceil(PROJECTIONS * (0.45 * chance(1) + 0.55 * chance(RATIO)))


class Lines:
    """The sorted arrays of a shard."""

    def __init__(self, x: np.ndarray, seed: int = 10):
        self.x = x
        self.lines = np.random.RandomState(seed).standard_normal((x.shape[1], PROJECTIONS))
        values = x @ self.lines
        self.order = np.argsort(values, axis=0, kind="stable")
        self.values = np.take_along_axis(values, self.order, 0)
        self.spread = float(np.sqrt(((x - x.mean(axis=0)) ** 2).sum(axis=1).mean())) or 1.0

    def search(self, q: np.ndarray, own: np.ndarray, k: int):
        """For each query which rows were verified (or are the query itself), and their distances; own: row that is the query itself, or -1."""
        n, m = self.x.shape[0], PROJECTIONS
        at = q @ self.lines
        lo = np.stack([np.searchsorted(self.values[:, j], at[:, j]) for j in range(m)], axis=1)
        hi = lo.copy()
        counts = np.zeros((len(q), n), np.int32)
        far = np.full((len(q), n), np.inf)
        done = np.zeros((len(q), n), bool)
        done[np.flatnonzero(own >= 0), own[own >= 0]] = True
        active, radius = np.arange(len(q)), self.spread / 16
        while len(active):
            new_lo = np.stack([np.searchsorted(self.values[:, j], at[active, j] - radius, "left") for j in range(m)], axis=1)
            new_hi = np.stack([np.searchsorted(self.values[:, j], at[active, j] + radius, "right") for j in range(m)], axis=1)
            for a, b in ((new_lo, lo[active]), (hi[active], new_hi)):
                size = np.maximum(b - a, 0).ravel()
                begin = np.repeat(a.ravel() - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                line = np.repeat(np.tile(np.arange(m), len(active)), size)
                row = np.repeat(np.arange(len(active)), size.reshape(len(active), m).sum(axis=1))
                counts[active] += np.bincount(row * n + self.order[begin, line], minlength=len(active) * n).reshape(len(active), n).astype(np.int32)
            lo[active], hi[active] = np.minimum(new_lo, lo[active]), np.maximum(new_hi, hi[active])
            who, which = np.nonzero((counts[active] >= THRESHOLD) & ~done[active])
            who = active[who]
            done[who, which] = True
            with np.errstate(over="ignore"):
                far[who, which] = np.sqrt(((q[who] - self.x[which]) ** 2).sum(axis=1))
            near = np.partition(far[active], min(k, n) - 1, axis=1)[:, min(k, n) - 1]
            active = active[~((near <= radius) | done[active].all(axis=1))]
            radius *= WIDEN
        return done, far


def _found(k: int):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table, queries: pa.Table) -> pa.Table:
        out = ([], [], [])
        if rows.num_rows and queries.num_rows and key[0].as_py():
            dim = key[0].as_py()
            ids, q_ids = rows["vec_id"].to_numpy(), queries["q_id"].to_numpy()
            q, lines = _matrix(queries["q"], dim), Lines(_matrix(rows["v"], dim))
            for lo in range(0, len(q), TOGETHER):
                part = q_ids[lo : lo + TOGETHER]
                same = ids[None, :] == part[:, None]
                there, far = lines.search(q[lo : lo + TOGETHER], np.where(same.any(axis=1), same.argmax(axis=1), -1), k)
                there &= ~same
                order = np.lexsort((np.broadcast_to(ids, far.shape), far, ~there), axis=1)[:, :k]
                best, there = (np.take_along_axis(m, order, 1) for m in (far, there))
                out[0].append(np.repeat(part, there.sum(axis=1)))
                out[1].append(ids[order[there]])
                out[2].append(best[there])
        columns = [np.concatenate(c) if len(c) else [] for c in out]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    return run


def nearest(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10, every: int = 100) -> DataFrame:
    """Columns query_id, rank, vec_id, score (Euclidean distance): the k nearest found of each query."""
    v = V.vectors(rows, id_col, vec_col).where(F.exists("v", lambda x: x != 0))
    rows, queries, shards, blocks = V.dealt(v, every, SHARD, QUERIES)
    queries = queries.drop("q_shard").withColumn("q_shard", V.each(shards))
    rows = rows.withColumn("block", V.each(blocks))
    found = rows.groupBy("dim", "shard", "block").cogroup(queries.groupBy("q_dim", "q_shard", "q_block")).applyInArrow(_found(k), "query_id long, vec_id long, score double")
    best = W.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
