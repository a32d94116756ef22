"""Counting by partition sketches: which hashes occur more than once in a corpus.

Texts lie in blocks of bounded size. Each block sketches the hashes of its windows
as a count-min row: a hash adds one to its cell, of which there are `CELLS` for each
window of the corpus, so the row grows with the input and keeps its error. A block
touches few cells, so it sends only those, cut into slices of the row and coded as
gaps of two bytes, or of four once a block's cells lie far apart; counts stop at two. Merging the sketches of a slice adds counts:
a cell's sum is at least the count of each hash in it. The answer to a block is
which of its cells reached two. No window that occurs twice is ever lost, and a
window that occurs once passes with a chance of about 1 / CELLS.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Cells for each window, and cells in a slice of the row.
CELLS = 16
SLICE_BITS = 24
_ESCAPE = 0xFFFF

CELL_SCHEMA = "part long, block long, cells binary"
REPLY_SCHEMA = "block long, part long, cells binary"


def n_slices(windows: int) -> int:
    return max(1, -(-windows * CELLS >> SLICE_BITS))


def encode(cells: np.ndarray) -> bytes:
    """Sorted cells of a slice as gaps, in four bytes each where they lie far apart, else in two, of which a gap of 65535 or more takes several; the first byte says which."""
    gaps = np.diff(cells, prepend=0)
    if len(gaps) and gaps.mean() > _ESCAPE / 2:
        return b"\4" + gaps.astype("<u4").tobytes()
    over, rest = gaps // _ESCAPE, gaps % _ESCAPE
    if not over.any():
        return b"\2" + rest.astype("<u2").tobytes()
    out = np.full(int(over.sum()) + len(cells), _ESCAPE, "<u2")
    out[np.cumsum(over + 1) - 1] = rest
    return b"\2" + out.tobytes()


def decode(raw: bytes) -> np.ndarray:
    if raw[0] == 4:
        return np.cumsum(np.frombuffer(raw, "<u4", offset=1), dtype=np.int64)
    gaps = np.frombuffer(raw, "<u2", offset=1)
    return np.cumsum(gaps, dtype=np.int64)[gaps != _ESCAPE]


def cells_of(hashes: np.ndarray, slices: int) -> np.ndarray:
    return ((hashes >> np.uint64(8)) % np.uint64(slices << SLICE_BITS)).astype(np.int64)


def ranges(part: np.ndarray) -> list[tuple[int, int, int]]:
    """part is sorted: each part with its range."""
    at = np.flatnonzero(np.diff(part, prepend=-1))
    return [(int(part[a]), int(a), int(b)) for a, b in zip(at, np.append(at[1:], len(part)), strict=False)]


def _cut(cells: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Sorted cells by slice."""
    return [(p, cells[a:b] & ((1 << SLICE_BITS) - 1)) for p, a, b in ranges(cells >> SLICE_BITS)]


def sketch(block: int, hashes: np.ndarray, slices: int) -> pa.Table:
    """A block's sketch: its cells by slice, a cell twice if its count is two or more."""
    cells = np.sort(cells_of(hashes, slices))
    if len(cells) > 2:
        cells = cells[np.concatenate([[True, True], cells[2:] != cells[:-2]])]
    rows = _cut(cells)
    return pa.table({"part": pa.array([p for p, _ in rows], pa.int64()), "block": pa.array([block] * len(rows), pa.int64()), "cells": pa.array([encode(c) for _, c in rows], pa.binary())})


def merged(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """Adds the sketches of a slice; answers each block with those of its cells that reached two."""
    own = [decode(x) for x in rows["cells"].to_pylist()]
    cells = np.sort(np.concatenate(own))
    again = np.unique(cells[1:][cells[1:] == cells[:-1]])
    out = []
    for block, mine in zip(rows["block"].to_pylist(), own, strict=True):
        mine = np.unique(mine)
        at = np.minimum(np.searchsorted(again, mine), max(len(again) - 1, 0))
        mine = mine[again[at] == mine] if len(again) else mine[:0]
        if len(mine):
            out.append((block, encode(mine)))
    return pa.table({"block": pa.array([b for b, _ in out], pa.int64()), "part": pa.array([key[0].as_py()] * len(out), pa.int64()), "cells": pa.array([c for _, c in out], pa.binary())})


def repeated(hashes: np.ndarray, replies: pa.Table, slices: int) -> np.ndarray:
    """Which hashes lie in cells that reached two."""
    if not replies.num_rows:
        return np.zeros(len(hashes), bool)
    yes = np.sort(np.concatenate([decode(c) + (p << SLICE_BITS) for p, c in zip(replies["part"].to_pylist(), replies["cells"].to_pylist(), strict=True)]))
    cells = cells_of(hashes, slices)
    return yes[np.minimum(np.searchsorted(yes, cells), len(yes) - 1)] == cells


OWNER_SCHEMA = "part long, block long, hashes binary, others binary, ids binary"
LEAST_SCHEMA = "block long, hashes binary, others binary, ids binary"


def by_key(h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal pairs (h, g) are neighbours, and which places of it begin a new pair."""
    order = np.argsort(h, kind="stable")
    new = np.ones(len(h), bool)
    if len(h) > 1:
        a, b = h[order], g[order]
        same = a[1:] == a[:-1]
        if (same & (b[1:] != b[:-1])).any():  # equal first halves with several second halves
            order = np.lexsort((g, h))
            a, b = h[order], g[order]
            same = a[1:] == a[:-1]
        new[1:] = ~same | (b[1:] != b[:-1])
    return order, new


def least_ids(h: np.ndarray, g: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each place the smallest id of the places with its pair."""
    if not len(h):
        return ids
    order, new = by_key(h, g)
    out = np.empty_like(ids)
    out[order] = np.minimum.reduceat(ids[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    return out


def _binary(parts: list) -> pa.Array:
    return pa.array([x.tobytes() for x in parts], pa.binary())


def offers(block: int, h: np.ndarray, g: np.ndarray, ids: np.ndarray, slices: int) -> pa.Table:
    """A block's distinct 128-bit hashes with their smallest ids, by slice: what is grouped exactly."""
    order, new = by_key(h, g)
    least = least_ids(h, g, ids)
    own = order[new]
    part = cells_of(h[own], slices) >> SLICE_BITS
    by_part = np.argsort(part, kind="stable")
    own, rows = own[by_part], ranges(part[by_part])
    columns = {c: _binary([v[own[a:b]] for _, a, b in rows]) for c, v in (("hashes", h), ("others", g), ("ids", least))}
    return pa.table({"part": pa.array([p for p, _, _ in rows], pa.int64()), "block": pa.array([block] * len(rows), pa.int64())} | columns)


def joined(rows: pa.Table, column: str, kind) -> np.ndarray:
    found = [np.frombuffer(x, kind) for x in rows[column].to_pylist() if x]
    return np.concatenate(found) if found else np.zeros(0, kind)


def least(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """Groups the hashes of a slice exactly, by all 128 bits; answers each block with the smaller ids that it hasn't got.

    An answer has 96 bits of a hash, as it only has to say which of the block's own windows it is for.
    """
    h, g, ids = joined(rows, "hashes", np.uint64), joined(rows, "others", np.uint64), joined(rows, "ids", np.int64)
    best = least_ids(h, g, ids)
    less = best < ids
    ends = np.cumsum([len(x) // 8 for x in rows["ids"].to_pylist()]).astype(int)
    out = [(block, *(v[a:b][less[a:b]] for v in (h, g.astype(np.uint32), best))) for block, a, b in zip(rows["block"].to_pylist(), [0, *ends[:-1]], ends, strict=True) if less[a:b].any()]
    return pa.table({"block": pa.array([x[0] for x in out], pa.int64())} | {c: _binary([x[k] for x in out]) for k, c in ((1, "hashes"), (2, "others"), (3, "ids"))})


def least_of(h: np.ndarray, g: np.ndarray, ids: np.ndarray, replies: pa.Table) -> np.ndarray:
    """For each hash the smallest id in the corpus: the block's own, or what a reply says."""
    told = (joined(replies, "hashes", np.uint64), joined(replies, "others", np.uint32), joined(replies, "ids", np.int64))
    return least_ids(*(np.concatenate([own, other]) for own, other in zip((h, g.astype(np.uint32), ids), told, strict=True)))[: len(h)]
