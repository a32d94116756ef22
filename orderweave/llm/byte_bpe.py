"""Byte-level BPE encoding and decoding over whole texts.

Every text is cut into overlapping chunks of `CHUNK` characters, each of which is pre-tokenised
from its own start, without regard to the others. The chunks are stitched where pre-token
boundaries resynchronise: at the first boundary in an overlap that both chunks have, from which
on the later one is right. Where an overlap has none, as within a word that is longer than a
chunk, the text from the last certain boundary on is pre-tokenised again, over twice the length
each time, until it meets a chunk's boundary. The pieces (pre-tokens) are encoded one by one;
those that were seen before come from a table. Decoding concatenates the tokens' bytes.

Texts of over `SPREAD` characters are first cut into overlapping sections in the same way, which
are dealt to tasks, pre-tokenised and encoded there, and then stitched by the same function; so
a very long text doesn't hold one task.

Cases: null and empty texts have no tokens and decode to nothing; a text without white space may
be one piece; rows may repeat, and ids may be null or repeated: a row for each row; an empty table
gives none; other columns of the input aren't read, so their names can't clash. The pattern must
cover every text, look at most `MARGIN` characters ahead and not behind, as the published ones do.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderweave.llm.shared import modest_batches, sparing, width

#: Characters of a chunk, of the overlap after it, and before a chunk's end where boundaries aren't trusted.
CHUNK, OVERLAP, MARGIN = 2048, 128, 8
#: Characters of a section: texts that have more are dealt to several tasks.
SPREAD = 1 << 20
#: Pieces whose tokens are remembered, of up to so many characters.
REMEMBERED, SHORT = 100_000, 32
#: Rows that are worked on together.
ROWS = 200
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


class Part(NamedTuple):
    """A stretch of a text that was pre-tokenised on its own: where it ends, and its pieces' starts with the last one's end."""

    end: int
    bounds: list[int]


class Pieces(dict):
    """The ids of pieces, as bytes; what isn't known yet is encoded."""

    def __init__(self, encoder: tiktoken.Encoding):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.encoder.encode_ordinary(piece), "<u4").tobytes()
        if len(piece) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = ids
        return ids


@lru_cache(2)
def vocabulary(path: str, pattern: str):
    """The tokens of pieces, the pre-token pattern, and each token's bytes as one buffer with offsets."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    by_rank = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        by_rank[rank] = token
    encoder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return Pieces(encoder), regex.compile(pattern), np.frombuffer(b"".join(by_rank), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in by_rank])])


def cuts(n: int, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """Where the chunks of n characters begin, and where they end after the overlap."""
    return [(a, min(n, a + chunk + overlap)) for a in range(0, max(1, n - overlap), chunk)]


def _part(start: int, end: int, pieces: list[str]) -> Part:
    return Part(end, list(accumulate(map(len, pieces), initial=start)))


def seams(text: str, parts: list[Part], pattern, margin: int = MARGIN) -> Iterator[tuple[int, list[str], int, int]]:
    """What a text's pieces are, in order: pieces i to j of part k, or (k = -1) of the given list."""
    n = len(text)
    k, again, i, now, at = 0, [], 0, parts[0], 1
    while now.end < n:
        while parts[at].end <= now.end:
            at += 1
        other = parts[at]
        last = max(i, bisect_right(now.bounds, now.end - margin) - 1)
        low = bisect_left(now.bounds, other.bounds[0], i, last + 1)
        trusted = {p: j for j, p in enumerate(now.bounds[low : last + 1], low)}
        most = bisect_right(other.bounds, now.bounds[last])
        shared = next((j for j in range(min(most, len(other.bounds) - 1)) if other.bounds[j] in trusted), None)
        if shared is not None:
            yield k, again, i, trusted[other.bounds[shared]]
            k, again, i, now = at, [], shared, other
        else:
            yield k, again, i, last
            base = now.bounds[last]
            end = min(n, base + 2 * (other.end - base))
            again = pattern.findall(text[base:end])
            k, i, now = -1, 0, _part(base, end, again)
    yield k, again, i, len(now.bounds) - 1


def pre_tokens(text: str, pattern, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """A text's pieces: its chunks' pre-tokens, stitched."""
    spans = cuts(len(text), chunk, overlap)
    if len(spans) == 1:
        return pattern.findall(text)
    own = [pattern.findall(text[a:b]) for a, b in spans]
    out: list[str] = []
    for k, again, i, j in seams(text, [_part(a, b, p) for (a, b), p in zip(spans, own, strict=True)], pattern):
        out += (own[k] if k >= 0 else again)[i:j]
    return out


def _assembled(texts: list[str], starts: list[int], lengths: list[np.ndarray], counts: list[np.ndarray], ids: list[bytes], pieces: Pieces, pattern) -> bytes:
    """The ids of a text from its sections, in order: their texts, piece lengths, ids for each piece, ids."""
    text = "".join(t[: b - a] for t, a, b in zip(texts, starts, [*starts[1:], starts[-1] + len(texts[-1])], strict=True))
    parts = [Part(a + len(t), [a, *(a + np.cumsum(x)).tolist()]) for t, a, x in zip(texts, starts, lengths, strict=True)]
    at = [np.concatenate([[0], np.cumsum(c)]) * 4 for c in counts]
    out = [ids[k][at[k][i] : at[k][j]] if k >= 0 else b"".join(map(pieces.__getitem__, again[i:j])) for k, again, i, j in seams(text, parts, pattern)]
    return b"".join(out)


def decode_ids(ids: np.ndarray, tokens: np.ndarray, offsets: np.ndarray) -> bytes:
    """The tokens' bytes one after another."""
    starts, sizes = offsets[ids], offsets[ids.astype(np.int64) + 1] - offsets[ids]
    at = np.cumsum(sizes) - sizes
    return tokens[np.repeat(starts - at, sizes) + np.arange(int(sizes.sum()))].tobytes()


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS, pattern: str = PATTERN, chunk: int = CHUNK, overlap: int = OVERLAP, spread: int = SPREAD, decoded: bool = False) -> DataFrame:
    """Columns id_col, n_tokens, ids (binary: ids as little-endian unsigned 32-bit integers), a row for each row of docs.

    decoded: with the bytes that the ids stand for, in the same pass.
    """
    names = ["id", "ids", *(["decoded"] if decoded else [])]
    kinds = "id long, ids binary" + (", decoded binary" if decoded else "")

    def batch_of(own, ids: list[bytes]) -> pa.RecordBatch:
        *_, tokens, offsets = vocabulary(ranks, pattern)
        back = [pa.array([decode_ids(np.frombuffer(x, "<u4"), tokens, offsets) for x in ids], pa.binary())] if decoded else []
        return pa.RecordBatch.from_arrays([own, pa.array(ids, pa.binary()), *back], names)

    def whole(batches):
        pieces, compiled, *_ = vocabulary(ranks, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                yield batch_of(part["id"], [b"".join(map(pieces.__getitem__, pre_tokens(t.as_py() or "", compiled, chunk, overlap))) for t in part["text"]])

    def cut(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                own, digest, text, copies = (batch[c][i].as_py() for c in ("id", "digest", "text", "copies"))
                for a, b in cuts(len(text), spread, overlap):
                    yield pa.RecordBatch.from_pylist([{"id": own, "digest": digest, "copies": copies, "start": a, "text": text[a:b]}], schema=sections)

    def section(batches):
        pieces, compiled, *_ = vocabulary(ranks, pattern)
        for batch in batches:
            for i in range(batch.num_rows):
                own = pre_tokens(batch["text"][i].as_py(), compiled, chunk, overlap)
                ids = [pieces[p] for p in own]
                found = [np.array([len(p) for p in own], "<i4"), np.array([len(x) // 4 for x in ids], "<i4")]
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns, *(pa.array([x], pa.binary()) for x in (found[0].tobytes(), found[1].tobytes(), b"".join(ids)))], [*sections.names, "lengths", "counts", "ids"])

    def assembled(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        pieces, compiled, *_ = vocabulary(ranks, pattern)
        rows = rows.sort_by("start")
        texts, starts, ids = (rows[c].to_pylist() for c in ("text", "start", "ids"))
        lengths, counts = ([np.frombuffer(x, "<i4").astype(np.int64) for x in rows[c].to_pylist()] for c in ("lengths", "counts"))
        one = batch_of(rows["id"].combine_chunks().slice(0, 1), [_assembled(texts, starts, lengths, counts, ids, pieces, compiled)])
        return pa.Table.from_batches([one] * key[2].as_py())

    modest_batches(docs.sparkSession)
    sections = pa.schema([("id", pa.int64()), ("digest", pa.string()), ("copies", pa.int64()), ("start", pa.int64()), ("text", pa.string())])
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    many = F.coalesce(F.length("text"), F.lit(0)) > spread + overlap
    one = rows.where(~many).mapInArrow(sparing(whole), kinds)
    texts = rows.where(many).groupBy("id", F.sha2("text", 256).alias("digest")).agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    dealt = texts.mapInArrow(cut, "id long, digest string, copies long, start long, text string").repartition(width(docs.sparkSession), "id", "digest", "start")
    dealt = dealt.mapInArrow(sparing(section), "id long, digest string, copies long, start long, text string, lengths binary, counts binary, ids binary")
    out = one.union(dealt.groupBy("id", "digest", "copies").applyInArrow(assembled, kinds))
    return out.select(F.col("id").alias(id_col), F.expr("octet_length(ids) div 4").alias("n_tokens"), *names[1:])


def decode(encoded: DataFrame, ids_col: str = "ids", ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """encoded with a column decoded: the bytes that its ids stand for; null ids stand for none."""
    modest_batches(encoded.sparkSession)
    names = encoded.columns

    def run(batches):
        *_, tokens, offsets = vocabulary(ranks, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                out = [decode_ids(np.frombuffer(x or b"", "<u4"), tokens, offsets) for x in part[ids_col].to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], [*names, "decoded"])

    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())])
    return encoded.mapInArrow(sparing(run), schema)


def op5(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    both = encode(docs, decoded=True)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
