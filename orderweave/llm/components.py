"""Connected components by alternating large-star and small-star.

Each round rewrites the links: large-star points every larger neighbour of a node at the
smallest of its neighbourhood, small-star every smaller one. The rounds end when all links
are stars, after some log(n) of them; then every node points at its component's smallest.
Both are a grouped minimum, which combines before the shuffle, and a join, whose hot
keys Spark splits; no neighbourhood is gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderweave.llm.shared import kept


def _both(links: DataFrame) -> DataFrame:
    """Each link in both directions."""
    ends = F.array(F.struct(F.col("u").alias("u"), F.col("v").alias("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    return links.select(F.explode(ends).alias("e")).select("e.u", "e.v")


def _large_star(links: DataFrame) -> DataFrame:
    """links: u > v. Returns such links, some of them several times."""
    both = _both(links)
    near = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(near, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """links: u > v. Returns such links, each once."""
    near = links.groupBy("u").agg(F.min("v").alias("m"))
    ends = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))
    return links.join(near, "u").select(F.explode(ends).alias("e")).select("e.u", "e.v").where("u > v").distinct()


def _are_stars(links: DataFrame) -> bool:
    """Whether every node is either a centre or has a single link to one."""
    ends = F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("out")), F.struct(F.col("v").alias("node"), F.lit(0).alias("out")))
    nodes = links.select(F.explode(ends).alias("e")).groupBy("e.node").agg(F.sum("e.out").alias("out"), F.min("e.out").alias("least"))
    return not nodes.where("out > 1 or (out = 1 and least = 0)").limit(1).count()


def near_labels(links: DataFrame) -> DataFrame:
    """node, component, as `components`, but only over two steps: nodes with one label are connected, connected nodes may have several labels."""
    both = _both(links.where("u <> v"))
    first = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m"))
    return kept(both.join(first, "v").groupBy("u").agg(F.min("m").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("component")))


def components(links: DataFrame) -> DataFrame:
    """links: columns u, v, in any direction. Returns node, component (its smallest node) for every node with a link to another."""
    links = kept(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _are_stars(links):
        links = kept(_small_star(_large_star(links)))
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(links.select("v", "v").distinct())
