"""Suffix-array dedup: bytes covered by a long string that also starts in a document with a smaller id are removed.

Every string of `length` bytes (a window) is found through an anchor: the least hash among
its grams. Neighbouring windows with one anchor form a run, a stretch of text some 60 bytes
long; equal windows have equal anchors, so all that can match lies in runs of one anchor.

1. Blocks of texts sketch their anchors (sketch.py); runs whose anchor can't repeat drop out.
   An anchor that many blocks have, or that has many different runs in one, is hot.
2. Blocks sketch the windows of hot anchors. Those that can't repeat drop out too, so that
   what each document has beside a passage that many share isn't sent.
3. The rest is sent as stretches of bytes, compressed, to the anchor's task, each distinct one once a block.
4. There, stretches that are equal byte for byte become one, with the smallest id. Windows
   whose hash no other has drop out. What is left of each anchor is one text, whose suffix array is built by linear grouping
   (lyndon.py). Neighbouring suffixes that agree in `length` bytes are one string; which
   windows have a smaller id elsewhere goes back to the blocks, which remove bytes in a last pass.

Hashes choose what meets; what is removed is decided by the bytes alone. The texts are dealt
once, by a hash of id and text, salted so that repeated rows spread; all passes read that
exchange, each block in one order, so that places in it mean the same in all of them.

Cases: a null text is empty; texts shorter than `length` stay as they are; a null id counts
as larger than any other; rows with one id never take from each other; rows may repeat and
are all returned; a very long text is a block of its own; an empty table gives none; other
columns are passed through only if they are carried, so their names can't clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderweave.llm import sketch, textnp
from orderweave.llm.lyndon import suffix_arrays
from orderweave.llm.shared import block_of, modest_batches, pieces, text_bytes

BLOCK = 2_000_000
#: Bytes of an anchor's gram.
GRAM = 24
#: Bytes looked at together; a longer text is cut into overlapping pieces.
PIECE = 1 << 20
#: Bytes whose suffixes are sorted together.
SORTED = 1 << 20
#: Windows of a stretch, at most: in a text that repeats itself a run may be long.
MOST = 64
#: An anchor is hot from so many blocks, or distinct runs in a block, on.
HOT_BLOCKS, HOT_RUNS = 32, 8
_LAST = np.iinfo(np.int64).max
_STEP = textnp._STEP[40:44]

CELL_SCHEMA = "part long, block long, cells binary, hot binary"
ANSWER_SCHEMA = "block long, part long, cells binary, hot binary"
STRETCH_SCHEMA = "part long, block long, anchors binary, sizes binary, data binary, counts binary, places binary, ids binary"
SPAN_SCHEMA = "block long, spans binary"

#: Hashes of byte spans that choose which stretches are compared.
hashed = textnp.span_hashes


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    at = np.cumsum(sizes) - sizes
    return np.repeat(starts - at, sizes) + np.arange(int(sizes.sum()))


def _binary(parts: list) -> pa.Array:
    return pa.array([x.tobytes() for x in parts], pa.binary())


def _valid(n: int, cuts: np.ndarray, length: int) -> np.ndarray:
    """Which of the n windows lie within one text."""
    change = np.zeros(n + 1, np.int64)
    inner = cuts[(cuts > 0) & (cuts < n + length - 1)]
    np.add.at(change, np.maximum(inner - length + 1, 0), 1)
    np.add.at(change, np.minimum(inner, n), -1)
    return np.cumsum(change)[:n] == 0


def _piece(data: np.ndarray, cuts: np.ndarray, length: int, gram: int):
    n = len(data) - length + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64)
    eight = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,)).copy()
    width = len(data) - gram + 1
    m = np.zeros(width, np.uint64)
    for k, at in enumerate(sorted({*range(0, gram - 7, 8), gram - 8})):
        m += eight[at : at + width] * _STEP[k % 4]
    m = textnp.mix(m)
    width, span = length - gram + 1, 1
    while 2 * span <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    if span < width:
        m = np.minimum(m[: span - width], m[width - span :])
    valid = _valid(n, cuts, length)
    first = valid.copy()
    first[1:] &= ~valid[:-1] | (m[1:] != m[:-1])
    last = valid.copy()
    last[:-1] &= ~valid[1:] | (m[1:] != m[:-1])
    a, b = np.flatnonzero(first), np.flatnonzero(last)
    return a, b - a + 1, m[a]


def runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int = GRAM, most: int = PIECE):
    """Of all texts: the runs' starts, numbers of windows, anchors."""
    found = []
    for lo, hi in textnp.slices(offsets, most):
        a, b = int(offsets[lo]), int(offsets[hi])
        if hi - lo == 1 and b - a > 2 * most:
            parts = [(c, min(b, c + most + length - 1), np.zeros(0, np.int64)) for c in range(a, b - length + 1, most)]
        else:
            parts = [(a, b, offsets[lo:hi] - a)]
        for x, y, cuts in parts:
            start, *rest = _piece(data[x:y], cuts, length, gram)
            found.append((start + x, *rest))
    if not found:
        found = [_piece(data[:0], offsets[:0], length, gram)]
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _ordered(table: pa.Table) -> pa.Table:
    """The rows of a block in an order that depends on nothing but the rows."""
    return table.sort_by([("id", "ascending"), ("text", "ascending")])


def _block(table: pa.Table, length: int):
    data, offsets = textnp.column(table["text"])
    return data, offsets, *runs(data, offsets, length)


def _ids(table: pa.Table, offsets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    ids = table["id"].fill_null(_LAST).to_numpy() if table["id"].null_count else table["id"].to_numpy()
    return ids[np.searchsorted(offsets, starts, "right") - 1]


def _slice_of(anchors: np.ndarray, slices: int) -> np.ndarray:
    return sketch.cells_of(anchors, slices) >> sketch.SLICE_BITS


def _busy(data: np.ndarray, start: np.ndarray, count: np.ndarray, anchor: np.ndarray, length: int) -> np.ndarray:
    """Anchors with HOT_RUNS distinct runs in the block."""
    distinct, which, number = np.unique(anchor, return_inverse=True, return_counts=True)
    own = np.flatnonzero(number[which] >= HOT_RUNS)
    which, h = which[own], hashed(data, start[own], start[own] + count[own] + length - 1)
    order = np.lexsort((h, which))
    which, h = which[order], h[order]
    new = np.ones(len(own), bool)
    new[1:] = (which[1:] != which[:-1]) | (h[1:] != h[:-1])
    return distinct[np.bincount(which[new], minlength=len(distinct)) >= HOT_RUNS]


def _anchored(block: int, data, start, count, anchor, slices: int, length: int) -> pa.Table:
    """The block's sketch of anchors, with the cells of busy ones."""
    cells = sketch.sketch(block, anchor, slices)
    busy = np.unique(sketch.cells_of(_busy(data, start, count, anchor, length), slices))
    hot = {p: sketch.encode(busy[a:b] & ((1 << sketch.SLICE_BITS) - 1)) for p, a, b in sketch.ranges(busy >> sketch.SLICE_BITS)}
    return cells.append_column("hot", pa.array([hot.get(p) for p in cells["part"].to_pylist()], pa.binary()))


def _judged(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """Adds the sketches of a slice; answers each block with those of its cells that repeat, and with the hot ones among them."""
    own = [np.unique(sketch.decode(x)) for x in rows["cells"].to_pylist()]
    answers = sketch.merged(key, rows.select(["part", "block", "cells"]))
    cells, blocks = np.unique(np.concatenate(own), return_counts=True)
    busy = [sketch.decode(x) for x in rows["hot"].to_pylist() if x]
    hot = np.union1d(cells[blocks >= HOT_BLOCKS], np.concatenate(busy) if busy else cells[:0])
    found = [np.intersect1d(sketch.decode(x), hot, assume_unique=True) for x in answers["cells"].to_pylist()]
    return answers.append_column("hot", pa.array([sketch.encode(x) if len(x) else None for x in found], pa.binary()))


def _among(h: np.ndarray, replies: pa.Table, column: str, slices: int) -> np.ndarray:
    """Which hashes lie in cells that a column of the replies names."""
    said = replies.filter(replies[column].is_valid())
    return sketch.repeated(h, pa.table({"part": said["part"], "cells": said[column]}), slices)


def _hot_windows(data, start, count, anchor, replies: pa.Table, slices: int, length: int):
    """Which runs may repeat, which of them are hot; starts and hashes of the windows of hot runs, and their runs."""
    maybe = np.flatnonzero(_among(anchor, replies, "cells", slices))
    hot = maybe[_among(anchor[maybe], replies, "hot", slices)]
    at = _ranges(start[hot], count[hot])
    return maybe, hot, at, hashed(data, at, at + length), np.repeat(hot, count[hot])


def classes(data: np.ndarray, start: np.ndarray, size: np.ndarray, anchor: np.ndarray, together: int = 1 << 15) -> np.ndarray:
    """For each stretch the first one that has its anchor and the same bytes; hashes choose what is compared."""
    order, new = sketch.by_key(hashed(data, start, start + size), anchor)
    out = np.arange(len(start))
    first = order[new][np.cumsum(new) - 1] if len(order) else order
    other = first != order
    a, b = order[other], first[other]
    fits = size[a] == size[b]
    a, b = a[fits], b[fits]
    for lo in range(0, len(a), together):
        x, y = a[lo : lo + together], b[lo : lo + together]
        differs = data[_ranges(start[x], size[x])] != data[_ranges(start[y], size[y])]
        same = ~np.logical_or.reduceat(differs, np.cumsum(size[x]) - size[x])
        out[x[same]] = y[same]
    return out


def _stretches(block: int, table: pa.Table, data, offsets, start, count, anchor, replies: pa.Table, slices: int, length: int) -> pa.Table:
    """The runs, or windows joined to stretches, that may repeat, by the anchor's slice: each distinct one with its places and ids."""
    maybe, hot, at, h, of = _hot_windows(data, start, count, anchor, replies, slices, length)
    whole = np.setdiff1d(maybe, hot, assume_unique=True)
    again = _among(h, replies, "windows", slices)
    at, of = at[again], of[again]
    new = np.ones(len(at), bool)
    new[1:] = (of[1:] != of[:-1]) | (at[1:] != at[:-1] + 1)
    begin = np.flatnonzero(new)
    a = np.concatenate([start[whole], at[begin]])
    windows = np.concatenate([count[whole], np.diff(np.append(begin, len(at)))])
    own = np.concatenate([anchor[whole], anchor[of[begin]]])
    # No stretch has more than MOST windows.
    cuts = -(-windows // MOST)
    a, own, left = np.repeat(a, cuts), np.repeat(own, cuts), np.repeat(windows, cuts)
    k = np.arange(len(a)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    a, windows = a + k * MOST, np.minimum(left - k * MOST, MOST)

    size = windows + length - 1
    rep = classes(data, a, size, own)
    order = np.lexsort((rep, _slice_of(own, slices)))
    rep = rep[order]
    new = np.ones(len(order), bool)
    new[1:] = rep[1:] != rep[:-1]
    begin = np.flatnonzero(new)
    number = np.diff(np.append(begin, len(order)))
    one, ids = rep[begin], _ids(table, offsets, a[order]) if len(order) else order
    part, places, out = _slice_of(own[one], slices), a[order], []
    for p, lo, hi in sketch.ranges(part):
        r = one[lo:hi]
        x, y = begin[lo], begin[hi - 1] + number[hi - 1]
        out.append((p, block, own[r].tobytes(), size[r].astype("<i4").tobytes(), pa.compress(data[_ranges(a[r], size[r])].tobytes(), "zstd", asbytes=True), number[lo:hi].astype("<i4").tobytes(), places[x:y].astype(np.int64).tobytes(), ids[x:y].tobytes()))
    kinds = {"part": pa.int64(), "block": pa.int64()}
    names = ("part", "block", "anchors", "sizes", "data", "counts", "places", "ids")
    return pa.table({c: pa.array([r[k] for r in out], kinds.get(c, pa.binary())) for k, c in enumerate(names)})


def least_ids(anchor: np.ndarray, data: np.ndarray, at: np.ndarray, ids: np.ndarray, length: int) -> list[np.ndarray]:
    """For each stretch the smallest id of each of its windows, among the stretches with its anchor, by suffix arrays."""
    sizes = np.diff(at)
    order = np.argsort(anchor, kind="stable")
    found: list = [None] * len(order)
    lo = 0
    while lo < len(order):
        # Whole anchors, up to SORTED bytes or one anchor.
        total = np.cumsum(sizes[order[lo:]] + 2)
        hi = lo + max(1, int(np.searchsorted(total, SORTED, "right")))
        while hi < len(order) and anchor[order[hi]] == anchor[order[hi - 1]]:
            hi += 1
        part = order[lo:hi]
        s = sizes[part]
        new = np.ones(len(part), bool)
        new[1:] = anchor[part][1:] != anchor[part][:-1]
        closing = np.concatenate([new[1:], [True]]).astype(np.int64)
        begin = np.cumsum(s + 1 + closing) - (s + 1 + closing)
        n = int((s + 1 + closing).sum())
        symbols = np.ones(n, np.int64)  # 1 ends a stretch, 0 all those of an anchor
        inside = _ranges(begin, s)
        symbols[inside] = data[_ranges(at[part], s)].astype(np.int64) + 2
        symbols[(begin + s + 1)[closing == 1]] = 0
        sa = suffix_arrays(symbols, begin[new])
        # Suffixes that begin with a window, in order; those that agree in a window are neighbours.
        stretch = np.full(n, -1, np.int64)
        windows = s - length + 1
        starts = _ranges(begin, windows)
        stretch[starts] = np.repeat(np.arange(len(part)), windows)
        sa = sa[stretch[sa] >= 0]
        view = np.lib.stride_tricks.sliding_window_view(symbols.astype(np.int16), length)
        fresh = np.ones(len(sa), bool)
        for c in range(1, len(sa), 1 << 16):
            d = min(len(sa), c + (1 << 16))
            fresh[c:d] = (view[sa[c:d]] != view[sa[c - 1 : d - 1]]).any(axis=1)
        fresh[1:] |= anchor[part][stretch[sa[1:]]] != anchor[part][stretch[sa[:-1]]]
        least = np.minimum.reduceat(ids[part][stretch[sa]], np.flatnonzero(fresh))[np.cumsum(fresh) - 1]
        at_place = np.empty(n, np.int64)
        at_place[sa] = least
        for k, b, w in zip(part, begin, windows, strict=True):
            found[k] = at_place[b : b + w]
        lo = hi
    return found


def _shared(data: np.ndarray, start: np.ndarray, windows: np.ndarray, length: int, together: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What of the stretches has windows whose hash occurs again, window by window without a gap: the stretch, the number of windows,
    the first one's place. Equal windows have equal hashes, so none that occurs twice is left out."""
    at = _ranges(start, windows)
    h = np.concatenate([hashed(data, at[lo : lo + together], at[lo : lo + together] + length) for lo in range(0, len(at), together)])
    order = np.sort(h)
    again = np.unique(order[1:][order[1:] == order[:-1]])
    seen = np.flatnonzero(again[np.minimum(np.searchsorted(again, h), len(again) - 1)] == h) if len(again) else np.zeros(0, np.int64)
    own = np.repeat(np.arange(len(start)), windows)[seen]
    new = np.ones(len(seen), bool)
    new[1:] = (seen[1:] != seen[:-1] + 1) | (own[1:] != own[:-1])
    begin = np.flatnonzero(new)
    return own[begin], np.diff(np.append(begin, len(seen))), at[seen[begin]] - start[own[begin]]


def _covered(length: int):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        """Tells each block which windows of its stretches have a smaller id elsewhere: place of the first, number."""
        anchor, size = sketch.joined(rows, "anchors", np.uint64), sketch.joined(rows, "sizes", "<i4").astype(np.int64)
        data = np.concatenate([np.frombuffer(pa.decompress(x, int(np.frombuffer(n, "<i4").sum()), "zstd"), np.uint8) for x, n in zip(rows["data"].to_pylist(), rows["sizes"].to_pylist(), strict=True)])
        number, place, ids = sketch.joined(rows, "counts", "<i4").astype(np.int64), sketch.joined(rows, "places", np.int64), sketch.joined(rows, "ids", np.int64)
        n_places = [sum(np.frombuffer(x, "<i4").tolist()) for x in rows["counts"].to_pylist()]
        start = np.cumsum(size) - size
        one, which = np.unique(classes(data, start, size, anchor), return_inverse=True)
        of = np.repeat(which, number)  # the class of each place
        best = np.full(len(one), _LAST)
        np.minimum.at(best, of, ids)
        _, back, several = np.unique(anchor[one], return_inverse=True, return_counts=True)
        # For each class the smallest ids of its windows: those of the class, if no other has its anchor or none of them.
        windows = size[one] - length + 1
        at = np.cumsum(windows) - windows
        least = np.repeat(best, windows)
        sorted_ = np.flatnonzero(several[back] > 1)
        if len(sorted_):
            k, w, places = _shared(data, start[one[sorted_]], windows[sorted_], length)
            c, long = sorted_[k], w + length - 1
            first = start[one[c]] + places
            alike, which = np.unique(classes(data, first, long, anchor[one[c]]), return_inverse=True)
            ids_of = np.full(len(alike), _LAST)
            np.minimum.at(ids_of, which, best[c])
            a, long, first = anchor[one[c[alike]]], long[alike], first[alike]
            found = least_ids(a, data[_ranges(first, long)], np.concatenate([[0], np.cumsum(long)]), ids_of, length)
            if found:
                mine = w[alike]
                least[_ranges(at[c] + places, w)] = np.concatenate(found)[_ranges((np.cumsum(mine) - mine)[which], w)]
        out, lo = [], 0
        for block, m in zip(rows["block"].to_pylist(), n_places, strict=True):
            c = of[lo : lo + m]
            w = windows[c]
            gone = least[_ranges(at[c], w)] < np.repeat(ids[lo : lo + m], w)
            edge = np.cumsum(w)
            begin, end = gone.copy(), gone.copy()
            begin[1:] &= ~gone[:-1]
            end[:-1] &= ~gone[1:]
            begin[edge[:-1]] = gone[edge[:-1]]
            end[edge - 1] = gone[edge - 1]
            where = (_ranges(place[lo : lo + m], w))[begin]
            spans = np.stack([where, np.flatnonzero(end) - np.flatnonzero(begin) + 1], axis=1)
            if len(spans):
                out.append((block, spans.astype(np.int64)))
            lo += m
        return pa.table({"block": pa.array([b for b, _ in out], pa.int64()), "spans": _binary([x for _, x in out])})

    return run


def _gone(data: np.ndarray, replies: pa.Table, length: int) -> np.ndarray:
    """Which bytes of a block are removed."""
    change = np.zeros(len(data) + 1, np.int32)
    spans = sketch.joined(replies, "spans", np.int64).reshape(-1, 2)
    np.add.at(change, spans[:, 0], 1)
    np.add.at(change, spans[:, 0] + spans[:, 1] + length - 1, -1)
    return np.cumsum(change[:-1], dtype=np.int32) > 0


def dedup_suffixes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, carry: tuple[str, ...] = ()) -> DataFrame:
    """Columns id_col, n_bytes, n_removed, n_spans, kept (binary) and those of carry, a row for each row of docs. length: at least GRAM."""
    modest_batches(docs.sparkSession)
    _, size = text_bytes(docs, text_col)
    blocks, slices = pieces(size, BLOCK), sketch.n_slices(size // 12 + 1)
    rows = docs.select(
        block_of(F.col(id_col), F.col(text_col), blocks).alias("block"),
        F.col(id_col).cast("long").alias("id"),
        F.col(text_col).cast("string").alias("text"),
        F.struct(F.lit(0).alias("_"), *(F.col(c) for c in carry)).alias("other"),
    )

    def anchored(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        data, _, start, count, anchor = _block(table, length)
        return _anchored(key[0].as_py(), data, start, count, anchor, slices, length)

    def windowed(key: tuple[pa.Scalar, ...], table: pa.Table, replies: pa.Table) -> pa.Table:
        data, _, start, count, anchor = _block(table, length)
        return sketch.sketch(key[0].as_py(), _hot_windows(data, start, count, anchor, replies, slices, length)[3], slices)

    def stretched(key: tuple[pa.Scalar, ...], table: pa.Table, replies: pa.Table) -> pa.Table:
        table = _ordered(table)
        return _stretches(key[0].as_py(), table, *_block(table, length), replies, slices, length)

    def removed(key: tuple[pa.Scalar, ...], table: pa.Table, replies: pa.Table) -> pa.Table:
        table = _ordered(table)
        data, offsets = textnp.column(table["text"])
        gone = _gone(data, replies, length)
        sums = np.concatenate([[0], np.cumsum(gone)])[offsets]
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        cut = offsets[:-1][offsets[:-1] < len(data)]
        begins[cut] = gone[cut]
        spans = np.concatenate([[0], np.cumsum(begins)])[offsets]
        stay = data[~gone]
        at = offsets - sums
        kept = [stay[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        return pa.table({"id": table["id"], "n_bytes": pa.array(np.diff(offsets), pa.int64()), "n_removed": pa.array(np.diff(sums), pa.int64()), "n_spans": pa.array(np.diff(spans), pa.int64()), "kept": pa.array(kept, pa.binary()), "other": table["other"]})

    out = T.StructType([T.StructField("id", T.LongType()), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept", T.BinaryType()), T.StructField("other", rows.schema["other"].dataType)])
    none = F.lit(None).cast("binary")
    dealt = rows.groupBy("block")
    cells = dealt.applyInArrow(anchored, CELL_SCHEMA).groupBy("part").applyInArrow(_judged, ANSWER_SCHEMA)
    windows = dealt.cogroup(cells.groupBy("block")).applyInArrow(windowed, sketch.CELL_SCHEMA).groupBy("part").applyInArrow(sketch.merged, sketch.REPLY_SCHEMA)
    both = cells.select("block", "part", "cells", "hot", none.alias("windows")).union(windows.select("block", "part", none, none, F.col("cells")))
    sent = dealt.cogroup(both.groupBy("block")).applyInArrow(stretched, STRETCH_SCHEMA)
    spans = sent.groupBy("part").applyInArrow(_covered(length), SPAN_SCHEMA)
    done = dealt.cogroup(spans.groupBy("block")).applyInArrow(removed, out)
    return done.select(F.col("id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept", *(F.col("other")[c].alias(c) for c in carry))


def op9(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_suffixes(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


SQL = """
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT *, CAST(length(h) // 2 AS BIGINT) AS n FROM d),
win AS (SELECT rid, doc_id, p, substr(h, 2 * p + 1, 100) AS k FROM (SELECT rid, doc_id, h, unnest(range(0, n - 49)) AS p FROM s)),
least AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k HAVING count(DISTINCT doc_id) > 1),
hit AS (SELECT rid, p, CASE WHEN p <= lag(p) OVER (PARTITION BY rid ORDER BY p) + 50 THEN 0 ELSE 1 END AS fresh FROM win JOIN least USING (k) WHERE m < doc_id),
spans AS (SELECT rid, min(p) AS a, max(p) + 50 AS e FROM (SELECT rid, p, sum(fresh) OVER (PARTITION BY rid ORDER BY p) AS g FROM hit) GROUP BY rid, g),
cut AS (SELECT rid, sum(e - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY rid),
stay AS (SELECT rid, coalesce(lag(e) OVER (PARTITION BY rid ORDER BY a), 0) AS a, a AS e FROM spans UNION ALL SELECT s.rid, coalesce(max(e), 0), max(n) FROM s LEFT JOIN spans ON s.rid = spans.rid GROUP BY s.rid),
kept AS (SELECT rid, string_agg(substr(h, 2 * a + 1, 2 * (e - a)), '' ORDER BY a, e) AS t FROM stay JOIN s USING (rid) GROUP BY rid)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(t)) AS kept_sha256 FROM s JOIN kept USING (rid) LEFT JOIN cut USING (rid)
"""
