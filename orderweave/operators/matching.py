"""Texts against a menu of names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orderweave.functions import text as X
from orderweave.operators.interim import written


def by_prefix(texts: DataFrame, names: DataFrame, n: int = 2) -> DataFrame:
    """text, matched (if a single name has its length and first n characters), candidates. Names are grouped first, so a text meets one row."""
    k = names.groupBy(F.length("name").alias("_len"), F.substring("name", 1, n).alias("_pre")).agg(F.count_distinct("name").alias("c"), F.min("name").alias("only"))
    joined = texts.join(k, (F.length("text") == F.col("_len")) & (F.substring("text", 1, n) == F.col("_pre")), "left")
    return joined.select("text", F.when(F.col("c") == 1, F.col("only")).alias("matched"), F.coalesce("c", F.lit(0)).alias("candidates"))


def _numbered(text: Column) -> Column:
    """Its characters, numbered where they repeat: texts have as many of these in common as characters, whatever their order."""
    sorted_ = F.array_sort(F.filter(F.split(text, ""), lambda c: c != ""))
    return F.transform(sorted_, lambda c, i: F.concat(c, (i - F.array_position(sorted_, c) + 1).cast("string")))


def _shared(n: Column, m: Column, least: float) -> Column:
    """How many characters texts of n and m characters share at least if they are more alike than `least`."""
    return F.floor((n + m) * (least / 200)) + 1


def _ranked(rows: DataFrame, column: str, often: DataFrame) -> DataFrame:
    """column, token, n (how many tokens), i (the place of a token in its text, rare ones first): a row for each token."""
    tokens = rows.select(column, F.explode(_numbered(F.col(column))).alias("token")).join(often, "token", "left")
    own = W.partitionBy(column)
    return tokens.select(column, "token", F.count(F.lit(1)).over(own).alias("n"), (F.row_number().over(own.orderBy(F.coalesce("often", F.lit(0)), "token")) - 1).alias("i"))


def candidates(texts: DataFrame, names: DataFrame, least: float) -> DataFrame:
    """text, name of pairs that may be more alike than `least`, of what _ranked gives for both; none that is goes missing.

    Above `least` two texts of n and m characters share more than s (n + m) of them, s = least / 200, so each is at most 1 / s - 1
    times as long as the other, and a text of n shares more than n s / (1 - s), with whatever text. Of its tokens, rare ones first,
    the first that is shared then lies within the first n less so many; and from that token on, enough must follow in both.
    """
    part = least / 200 / (1 - least / 200)
    first = [rows.where(F.col("i") < F.col("n") - F.floor(F.col("n") * part)) for rows in (texts, names)]
    pairs = first[0].join(first[1].withColumnsRenamed({"n": "m", "i": "j"}), "token")
    pairs = pairs.where(F.least("n", "m") >= _shared(F.col("n"), F.col("m"), least))
    met = pairs.groupBy("text", "name", "n", "m").agg(F.min("i").alias("i"), F.min("j").alias("j"))
    return met.where(F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) >= _shared(F.col("n"), F.col("m"), least)).select("text", "name")


def most_similar(texts: DataFrame, menu: DataFrame, least: float = 40.0, steps: Sequence[float] = (80.0, 60.0)) -> DataFrame:
    """text, name, score of each distinct text's most similar name above `least`; ties go to the name that the menu lists first. menu: name, pos.

    Texts that have a name above the first of `steps` are done with it, as all such names are found; the others are looked
    up below. So what has a good match, as most texts do, meets few names, however low `least` is.
    """
    least = max(least, 1e-9)
    names = menu.where("name is not null").groupBy("name").agg(F.min("pos").alias("pos"))
    often = names.select(F.explode(_numbered(F.col("name"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("often"))
    known, rest = written(_ranked(names, "name", often)), written(_ranked(texts.where("text is not null").select("text").distinct(), "text", often))
    out = None
    for mark in (*(s for s in steps if s > least), least):
        scored = candidates(rest, known, mark).withColumn("score", X.indel_ratio(F.col("text"), F.col("name"))).where(F.col("score") > mark)
        best = scored.join(names, "name").groupBy("text").agg(F.max_by(F.struct("name", "score"), F.struct(F.col("score"), -F.col("pos"))).alias("b")).select("text", "b.name", "b.score")
        best = written(best) if mark > least else best
        out = best if out is None else out.union(best)
        rest = rest.join(best.select("text"), "text", "left_anti")
    return out


def sticker_matches(boxes: DataFrame, remaining: DataFrame, menu: DataFrame, prefixes: Sequence[str] = (), least: float = 60.0, least_score: float = 0.5) -> DataFrame:
    """sticker, order, item, score, status of each sticker, by its topmost text box alone (the first in order of equal ones).

    MATCHED: the name of the menu that its text is most like, above `least`, is among what remains of the order; WRONG_ITEM: it
    isn't; UNRECOGNIZED: there is no such name, the box is too faint, or nothing remains of the order.
    boxes: sticker, order, pos, quad, text, score. remaining: order, item, n. menu: name, pos, in normal form.
    """
    top = F.array_min(F.filter("quad", lambda _, i: i % 2 == 1))
    read = boxes.groupBy("sticker", "order").agg(F.min_by(F.struct("text", "score"), F.struct(top, F.col("pos"))).alias("t"))
    read = read.select("sticker", "order", F.when(F.col("t.score") >= least_score, X.normalized(F.col("t.text"))).alias("text"))
    found = best_name(read.where("text is not null").select("text"), menu, prefixes).where(F.col("score") > least).withColumnRenamed("name", "item")
    left = remaining.where("n > 0").groupBy("order").agg(F.collect_set("item").alias("_left"))
    rows = read.join(found, "text", "left").join(left, "order", "left")
    status = F.when(F.col("item").isNull() | F.col("_left").isNull(), "UNRECOGNIZED").when(F.array_contains("_left", F.col("item")), "MATCHED").otherwise("WRONG_ITEM")
    rows = rows.withColumn("status", status)
    known = F.col("status") != "UNRECOGNIZED"
    return rows.select("sticker", "order", F.when(known, F.col("item")).alias("item"), F.when(known, F.col("score")).alias("score"), "status")


def best_name(texts: DataFrame, menu: DataFrame, prefixes: Sequence[str], n: int = 2, least_special: float = 35.0, least: float = 40.0) -> DataFrame:
    """text, name, score of each distinct text. Texts that begin with one of prefixes look alike: of names of their length and with
    their first n characters the only one scores 100, of several the most similar counts above least_special. What that
    leaves open, and all other texts, take the most similar name above least. Texts and names are normalised already.
    """
    distinct = texts.select("text").distinct()
    special = F.lit(False)
    for p in prefixes:
        special = special | F.col("text").startswith(p)
    names = menu.groupBy("name").agg(F.min("pos").alias("pos"))
    like = distinct.where(special).withColumn("_len", F.length("text")).withColumn("_pre", F.substring("text", 1, n))
    pairs = like.join(names.withColumn("_len", F.length("name")).withColumn("_pre", F.substring("name", 1, n)), ["_len", "_pre"])
    pairs = pairs.withColumn("score", X.indel_ratio(F.col("text"), F.col("name")))
    best = pairs.groupBy("text").agg(F.count(F.lit(1)).alias("c"), F.max_by(F.struct("name", "score"), F.struct(F.col("score"), -F.col("pos"))).alias("b"))
    found = best.select("text", "b.name", F.when(F.col("c") == 1, 100.0).otherwise(F.col("b.score")).alias("score"), "c").where((F.col("c") == 1) | (F.col("score") > least_special)).drop("c")
    return found.union(most_similar(distinct.join(found.select("text"), "text", "left_anti"), menu, least))
