"""From raw documents to token ids: five stages, each over all that the one before kept.

Columns other than doc_id, text, source and n_chars are passed through as they are, whatever their names.

Cases, in every stage: a null text counts as empty. `quality` keeps a text without lines if the share of label 1 among
the labels is at least the mark; `near_duplicates` keeps all rows without words or id, and of rows that share an id all or none;
`substrings` leaves short texts as they are, a null id counts as the largest, so its row loses what others have; `mixture`
drops rows without words, as nothing is taken of them; `tokens` gives null and empty texts no ids. Ties go to the smaller id.
Repeated rows are judged alike. Very long texts are read as a whole. An empty table leads to an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderweave.llm.byte_bpe import encode
from orderweave.llm.line_quality import fit, score
from orderweave.llm.mixing import WORD, mix_sources, times
from orderweave.llm.near_dedup import near_dedup
from orderweave.llm.substring_dedup import dedup_substrings


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier doesn't reject."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = docs.select("text", F.struct(*docs.drop("text").columns).alias("row"))
    kept = score(rows, model, carry=("row",), original=True).where("predicted = 1")
    return kept.select("row.*", F.col("original_text").alias("text")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near copies; all without words or id."""
    found = near_dedup(docs).groupBy("doc_id").agg(F.max("kept").alias("kept")).where("not kept").select("doc_id")
    return docs.join(found.hint("shuffle_hash"), "doc_id", "left_anti").select(docs.columns)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the runs of 13 words that a document with a smaller id has too; a text that loses none stays as it was."""
    rest = docs.drop("text")
    rows = docs.select("doc_id", "text", F.struct(*rest.columns).alias("row"))
    done = dedup_substrings(rows, carry=("row",), original=True)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("original_text"))
    return _with_text(done.select("row.*", text.alias("text")), docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document: whole copies, and one more row with the words of the blocks taken once more.

    Rows that share an id are taken alike; a document with nothing taken goes.
    """
    keyed = docs.withColumn("_key", F.coalesce("doc_id", F.xxhash64("text", "source")))
    mix = mix_sources(keyed, id_col="_key").groupBy("_key").agg(F.min(F.struct("begin", "size", "n_blocks", "quota", "shift", "block")).alias("_plan"))
    plan = mix.select("_key", "_plan.*").where("size > 0 and quota > 0")
    names = [c for c in docs.columns if c != "text"]
    rows = keyed.select("_key", "text", F.struct(*names).alias("_row")).join(plan.hint("shuffle_hash"), "_key")
    whole = F.expr("cast(quota div n_blocks as int)")
    last = F.expr("(begin + size - 1) div block")
    some = times(last + 1) - times(F.expr("begin div block")) > whole * (last + 1 - F.expr("begin div block"))

    def more(word, i):
        j = F.call_function("div", F.col("begin") + i, F.col("block"))
        return times(j + 1) - times(j) > whole

    extra = F.when(some, F.array_join(F.filter(F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)), more), " "))
    texts = F.array_compact(F.concat(F.array_repeat("text", whole), F.array(extra)))
    return _with_text(rows.select("_row", F.explode(texts).alias("text")).select("_row.*", "text").where("text <> ''"), docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, as little-endian unsigned 32-bit integers, and digests of them and of the bytes that they decode to."""
    both = encode(docs, decoded=True)
    return both.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def _with_text(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, in their order; n_chars, where there is one, counts the new text."""
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(docs.columns)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("substrings", substrings), ("mixture", mixture), ("tokens", tokens)]

#: Stages hold trained models and hashes, which SQL can't express; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
