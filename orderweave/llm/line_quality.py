"""Quality classifier: a conditional random field labels lines, and their marginals make up a document's score.

It is fitted on the driver from at most `SAMPLE` labelled documents, taken by a hash of their
ids until they hold `SAMPLE_BYTES` together; whatever a text's length, it may be among them. Of
those only the line features are collected, one text for each id. Scoring is a map over the
documents with the fitted weights and shuffles nothing.

Cases: a null or empty text, or one of white space alone, has no lines and scores the share
of label 1 in the sample; a null label counts as none; an id with several labels takes the
smallest; without labels of both kinds all scores are that share; rows may repeat and ids
may be null; a very long text is scored as a whole, alone; an empty table gives none; other
columns of the input aren't read unless they are carried, so their names can't clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderweave.llm import crf, textnp
from orderweave.llm import line_features as lf
from orderweave.llm.shared import modest_batches, one_text, sampled, sparing

SAMPLE = 4000
SAMPLE_BYTES = 1 << 24
#: Bytes of text looked at together.
PIECE = 1 << 19
GOOD = 0.3


def remainder(id_col: str, mod: int) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % mod


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """Columns _id, text, label of a sample of labelled ids, a text for each."""
    ids = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).cast("int").alias("label"))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    some = sampled(texts, ids, F.xxhash64("_id"), most, most_bytes)
    return one_text(texts.join(F.broadcast(some), "_id")).select("_id", "text", "label")


def _featured(batches):
    for batch in batches:
        data, offsets = textnp.column(batch["text"])
        rows = []
        for lo, hi in textnp.slices(offsets, PIECE):
            part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            starts, ends, first = lf.lines(part, at)
            x, size = lf.raw(part, starts, ends, first), (ends - starts).astype(np.float32)
            rows += [np.column_stack([x[a:b], size[a:b]]).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch["_id"].cast(pa.string()), batch["label"], pa.array(rows, pa.binary())], ["id", "label", "lines"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = SAMPLE) -> crf.Model:
    """labels: id_col and label_col, 0 or 1. Only the labels given are learnt from."""
    modest_batches(docs.sparkSession)
    got = labelled_sample(docs, labels, id_col, text_col, label_col, most).mapInArrow(sparing(_featured), "id string, label int, lines binary").toArrow()
    rows = sorted(zip(*(got[c].to_pylist() for c in ("id", "label", "lines")), strict=True))
    x = [np.frombuffer(r[2], np.float32).reshape(-1, lf.RAW + 1) for r in rows]
    first = np.concatenate([[0], np.cumsum([len(a) for a in x])]).astype(np.int64)
    x = np.concatenate(x) if x else np.zeros((0, lf.RAW + 1), np.float32)
    return crf.fit(lf.design(x[:, :-1], first), x[:, -1].astype(float), first, np.array([r[1] for r in rows], int))


def score(docs: DataFrame, model: crf.Model, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), good: float = GOOD, original: bool = False) -> DataFrame:
    """The columns of carry, score, predicted, and the lines: start and length in bytes, chance of good; original: with the text, as original_text. A row for each row of docs."""

    modest_batches(docs.sparkSession)
    names = ["_other", "score", "predicted", "lines", *(["original_text"] if original else [])]

    def run(batches):
        for batch in batches:
            data, offsets = textnp.column(batch["_text"])
            for lo, hi in textnp.slices(offsets, PIECE):
                part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                starts, ends, first = lf.lines(part, at)
                size = (ends - starts).astype(float)
                s, p = crf.scores(model, lf.design(lf.raw(part, starts, ends, first), first), size, first)
                begin = starts - np.repeat(at[:-1], np.diff(first))
                found = pa.StructArray.from_arrays([pa.array(begin, pa.int64()), pa.array(ends - starts, pa.int64()), pa.array(p, pa.float64())], ["start", "bytes", "good"])
                spans = pa.ListArray.from_arrays(pa.array(first, pa.int32()), found)
                own = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([own["_other"], pa.array(s, pa.float64()), pa.array((s >= good).astype(np.int32)), spans, *([own["_text"]] if original else [])], names)

    rows = docs.select(F.col(text_col).cast("string").alias("_text"), F.struct(F.lit(0).alias("_"), *(F.col(c) for c in carry)).alias("_other"))
    line = T.StructType([T.StructField("start", T.LongType()), T.StructField("bytes", T.LongType()), T.StructField("good", T.DoubleType())])
    out = T.StructType([rows.schema["_other"], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("lines", T.ArrayType(line)), *([T.StructField("original_text", T.StringType())] if original else [])])
    scored = rows.mapInArrow(sparing(run), out)
    return scored.select(*(F.col("_other")[c].alias(c) for c in carry), "score", "predicted", "lines", *(["original_text"] if original else []))


def op2(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit(docs.select("doc_id", "text"), labels.where(remainder("doc_id", 5) != 0))
    held = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted", F.size("lines").alias("n_lines"))
