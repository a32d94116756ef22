"""Exact top-k by inner product: ball-tree branch and bound in each shard.

A node's bound for a query q is q.c + |q| r, of the centre c and radius r of its ball. Each
query visits the child with the higher bound first and skips nodes whose bound is below
its k-th score so far. That score is shared: every query is first searched in its own
shard, and the k-th score found there goes with it to all shards. Shards return at most
k rows a query, of which the best k are ranked.

Components are floor(256 x), so scores are exact integers: they are computed in doubles
where no sum can pass 2**53, else in 64-bit integers, else in Python's; a score beyond 64 bits
is given as the nearest value of 64 bits. Bounds have room for rounding.

Cases: see vectors.py; ids that rows share are not told apart, so neither is the other's
candidate; only vectors of the query's dimension are candidates; ties go to smaller ids; an
empty table gives none; other columns of the input aren't read, so their names can't clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from orderweave.llm import vectors as V

LEAF = 64
_LEAST = np.iinfo(np.int64).min


class Ball:
    """A ball over rows of x; leaves have rows, others two children."""

    def __init__(self, x: np.ndarray, rows: np.ndarray):
        own = x[rows]
        self.centre = own.mean(axis=0)
        away = own - self.centre
        self.radius = float(np.sqrt((away**2).sum(axis=1).max()))
        self.rows, self.parts = rows, []
        if len(rows) > LEAF and self.radius > 0:
            a = own[np.argmax((away**2).sum(axis=1))]
            b = own[np.argmax(((own - a) ** 2).sum(axis=1))]
            order = np.argsort(own @ (a - b), kind="stable")
            half = len(order) // 2
            self.parts = [Ball(x, rows[order[:half]]), Ball(x, rows[order[half:]])]

    def bound(self, q: np.ndarray, norms: np.ndarray) -> np.ndarray:
        b = q @ self.centre + norms * self.radius
        return b + 1e-9 * np.abs(b) + 1e-6 * (norms + 1)


class Search:
    """The best k rows so far of each query; `least` is the k-th score, or a shared one that is higher."""

    def __init__(self, x, ids, q, q_ids, k, least):
        self.x, self.ids, self.q, self.q_ids, self.k = x, ids, q, q_ids, k
        self.least = least.copy()
        self.norms = np.sqrt((q**2).sum(axis=1))
        self.score = np.full((len(q), k), _LEAST)
        self.found = np.full((len(q), k), np.iinfo(np.int64).max)
        top = max(np.abs(x).max(initial=0), np.abs(q).max(initial=0))
        most = float(top) * float(top) * max(1, x.shape[1])
        self.whole, self.fits = most < 2**53, most < 2**62

    def visit(self, node: Ball, who: np.ndarray) -> None:
        who = who[node.bound(self.q[who], self.norms[who]) >= self.least[who]]
        if not len(who):
            return
        if not node.parts:
            self.leaf(node.rows, who)
            return
        left, right = node.parts
        first = left.bound(self.q[who], self.norms[who]) >= right.bound(self.q[who], self.norms[who])
        for a, b, own in ((left, right, who[first]), (right, left, who[~first])):
            self.visit(a, own)
            self.visit(b, own)

    def leaf(self, rows: np.ndarray, who: np.ndarray) -> None:
        if not len(who):
            return
        if self.whole:
            s = (self.q[who] @ self.x[rows].T).astype(np.int64)
        elif self.fits:
            s = self.q[who].astype(np.int64) @ self.x[rows].astype(np.int64).T
        else:
            a, b = (np.vectorize(int, otypes=[object])(m) for m in (self.q[who], self.x[rows]))
            s = np.clip(a @ b.T, _LEAST + 1, np.iinfo(np.int64).max).astype(np.int64)
        ids = np.broadcast_to(self.ids[rows], s.shape)
        own = ids == self.q_ids[who][:, None]
        s = np.concatenate([self.score[who], np.where(own, _LEAST, s)], axis=1)
        ids = np.concatenate([self.found[who], np.where(own, np.iinfo(np.int64).max, ids)], axis=1)
        order = np.lexsort((ids, ~s), axis=1)[:, : self.k]
        self.score[who] = np.take_along_axis(s, order, 1)
        self.found[who] = np.take_along_axis(ids, order, 1)
        self.least[who] = np.maximum(self.least[who], self.score[who][:, -1].astype(float))


def _matrix(column, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), dim).astype(float)


def _searched(k: int):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table, queries: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if rows.num_rows and queries.num_rows:
            dim = key[0].as_py()
            x, q = np.floor(256 * _matrix(rows["v"], dim)), np.floor(256 * _matrix(queries["q"], dim))
            least = queries["least"].fill_null(_LEAST).to_numpy().astype(float)
            s = Search(x, rows["vec_id"].to_numpy(), q, queries["q_id"].to_numpy(), k, least)
            s.visit(Ball(x, np.arange(len(x))), np.arange(len(q)))
            there = s.found != np.iinfo(np.int64).max
            out = {"query_id": np.repeat(s.q_ids, k)[there.ravel()], "vec_id": s.found[there], "score": s.score[there]}
        return pa.table({c: pa.array(a, pa.int64()) for c, a in out.items()})

    return run


def top_k(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, every: int = 50) -> DataFrame:
    """Columns query_id, rank, vec_id, score: the k best candidates of each query."""
    rows, queries, shards, blocks = V.dealt(V.vectors(rows, id_col, vec_col), every)
    schema = "query_id long, vec_id long, score long"
    first = rows.groupBy("dim", "shard").cogroup(queries.withColumn("least", F.lit(None).cast("long")).groupBy("q_dim", "q_shard")).applyInArrow(_searched(k), schema)
    kth = first.groupBy("query_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select("query_id", "least")
    queries = queries.drop("q_shard").join(kth, F.col("q_id") == F.col("query_id"), "left").drop("query_id").withColumn("q_shard", V.each(shards))
    rows = rows.withColumn("block", V.each(blocks))
    found = rows.groupBy("dim", "shard", "block").cogroup(queries.groupBy("q_dim", "q_shard", "q_block")).applyInArrow(_searched(k), schema)
    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH v AS (SELECT vec_id, embedding FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS (SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM v),
c AS (SELECT vec_id, i, CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM e),
s AS (SELECT q.vec_id AS query_id, r.vec_id, CAST(sum(q.x * r.x) AS BIGINT) AS score FROM c q JOIN c r ON q.i = r.i AND q.vec_id % 50 = 0 AND r.vec_id <> q.vec_id GROUP BY 1, 2),
k AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 5
"""
