"""Substring dedup: runs of words that a document with a smaller id also has are removed.

Count-min prefilter: a first pass over the texts sketches all windows (sketch.py), the
merged sketches overestimate each window's count, and the second pass groups exactly
only those windows whose estimate is two or more. A third pass removes words.

Windows are grouped by 128 bits over 128 bits of each word, under a key that is drawn anew in each run (textnp.word_keys), so
two different windows are taken for one with a chance of about 2**-128, whatever their texts. The texts are
dealt once, into blocks of about `BLOCK` bytes by a hash of id and text, salted so that
repeated rows spread; all three passes read that one exchange. What is sent between
passes holds each distinct window of a block once, so a passage that a third of all
documents share costs one entry a block.

Cases: a null text has no words; a null id counts as larger than any other, so such a
row loses what others have and takes nothing from them; rows with one id never take
from each other, and repeated rows are all returned; texts with fewer words than a
window stay as they are; a very long text is a block of its own; an empty table gives
none; other columns are passed through only if they are carried, so their names can't clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderweave.llm import sketch, textnp
from orderweave.llm.shared import block_of, modest_batches, pieces, text_bytes

BLOCK = 2_000_000
_LAST = np.iinfo(np.int64).max


def _windows(table: pa.Table, window: int, key: bytes):
    """Of a block: bytes, word starts, ends, first words; both halves of window hashes, first windows, ids."""
    data, offsets = textnp.column(table["text"])
    starts, ends, first = textnp.spans(data, offsets)
    h, g, at = textnp.long_runs(textnp.word_keys(data, starts, ends, key), first, window)
    ids = table["id"].fill_null(_LAST).to_numpy() if table["id"].null_count else table["id"].to_numpy()
    return data, offsets, starts, ends, first, h, g, at, np.repeat(ids, np.diff(at))


def removed_words(first: np.ndarray, at: np.ndarray, hit: np.ndarray, window: int) -> np.ndarray:
    """Which words lie in a window that is hit."""
    where = textnp.run_starts(first, np.diff(at))[hit]
    n = int(first[-1])
    change = np.zeros(n + 1, np.int8)
    change[where] += 1
    change[where + window] -= 1
    return np.cumsum(change[:n], dtype=np.int32) > 0


def kept_texts(data, offsets, starts, ends, first, gone) -> list[bytes]:
    """Each text's words that stay, joined by one space."""
    n = len(data)
    text = np.where(textnp.WHITE[data], np.uint8(32), data)
    last = np.zeros(n + 1, bool)
    last[offsets] = True
    stay = ~gone
    a, b = starts[stay], ends[stay]
    b = b + ~(last[b] | (b >= n))  # with the white space after the word, unless the text ends there
    change = np.zeros(n + 1, np.int8)
    change[a] += 1
    change[b] -= 1
    mask = np.cumsum(change[:n], dtype=np.int8) > 0
    return [text[lo:hi][mask[lo:hi]].tobytes().rstrip(b" ") for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, carry: tuple[str, ...] = (), original: bool = False) -> DataFrame:
    """Columns id_col, n_words, n_removed, kept_text and those of carry, a row for each row of docs. original: with the text as it was, as original_text."""
    modest_batches(docs.sparkSession)
    _, size = text_bytes(docs, text_col)
    blocks, slices = pieces(size, BLOCK), sketch.n_slices(size // 5 + 1)
    rows = docs.select(
        block_of(F.col(id_col), F.col(text_col), blocks).alias("block"),
        F.col(id_col).cast("long").alias("id"),
        F.col(text_col).cast("string").alias("text"),
        F.struct(F.lit(0).alias("_"), *(F.col(c) for c in carry)).alias("other"),
    )
    carried, secret = rows.schema["other"].dataType, textnp.secret()

    def sketched(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return sketch.sketch(key[0].as_py(), _windows(table, window, secret)[5], slices)

    def offered(key: tuple[pa.Scalar, ...], table: pa.Table, replies: pa.Table) -> pa.Table:
        *_, h, g, _, ids = _windows(table, window, secret)
        maybe = sketch.repeated(h, replies, slices)
        return sketch.offers(key[0].as_py(), h[maybe], g[maybe], ids[maybe], slices)

    def removed(key: tuple[pa.Scalar, ...], table: pa.Table, replies: pa.Table) -> pa.Table:
        data, offsets, starts, ends, first, h, g, at, ids = _windows(table, window, secret)
        gone = removed_words(first, at, sketch.least_of(h, g, ids, replies) < ids, window)
        sums = np.concatenate([[0], np.cumsum(gone)])
        return pa.table({
            "id": table["id"], "n_words": pa.array(np.diff(first), pa.int64()), "n_removed": pa.array(np.diff(sums[first]), pa.int64()),
            "kept_text": pa.array(kept_texts(data, offsets, starts, ends, first, gone), pa.binary()).cast(pa.string()), "other": table["other"],
        } | ({"original_text": table["text"]} if original else {}))

    out = T.StructType([T.StructField("id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType()), T.StructField("other", carried), *([T.StructField("original_text", T.StringType())] if original else [])])
    dealt = rows.groupBy("block")
    replies = dealt.applyInArrow(sketched, sketch.CELL_SCHEMA).groupBy("part").applyInArrow(sketch.merged, sketch.REPLY_SCHEMA)
    offers = dealt.cogroup(replies.groupBy("block")).applyInArrow(offered, sketch.OWNER_SCHEMA)
    owners = offers.groupBy("part").applyInArrow(sketch.least, sketch.LEAST_SCHEMA)
    done = dealt.cogroup(owners.groupBy("block")).applyInArrow(removed, out)
    return done.select(F.col("id").alias(id_col), "n_words", "n_removed", "kept_text", *(["original_text"] if original else []), *(F.col("other")[c].alias(c) for c in carry))


def op4(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(text, '[^\x20\x09-\x0D]+') END AS w FROM documents),
win AS (SELECT rid, doc_id, i, array_to_string(w[i : i + 12], ' ') AS k FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
least AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + 13)) AS p FROM win JOIN least USING (k) WHERE m < doc_id),
words AS (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (rid, p) GROUP BY rid),
cut AS (SELECT rid, count(*) AS n FROM gone GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(cut.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (rid) LEFT JOIN cut USING (rid)
"""
