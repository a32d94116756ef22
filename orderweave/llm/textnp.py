"""Vectorised words, hashes and shingles over Arrow text columns.

A column's texts lie in one byte buffer; every function works on that buffer and
the texts' offsets, so that no Python object is made for a word. Words are runs
of bytes other than 0x20 and 0x09-0x0D. Null texts count as empty.
"""

from __future__ import annotations

import functools
import hashlib
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of texts looked at together; the arrays about a piece take some 40 times as much.
PIECE = 1 << 21
#: Spans of more bytes than this are hashed one by one.
LONG = 1024

WHITE = np.zeros(256, bool)
WHITE[[0x20, 9, 10, 11, 12, 13]] = True

_RNG = np.random.RandomState(20240229)
_STEP, _OTHER_STEP = (_RNG.randint(1, 2**63 - 1, 64, dtype=np.int64).astype(np.uint64) | np.uint64(1) for _ in range(2))
_LENGTH = np.uint64(0xD6E8FEB86659FD93)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: The first n of eight bytes.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values after which all bits depend on all bits."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def column(values) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and its len + 1 offsets; null is empty."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.ChunkedArray):
        values = pa.concat_arrays(values.chunks) if values.num_chunks else pa.array([], values.type)
    values = values.cast(pa.large_string() if not pa.types.is_binary(values.type) else pa.large_binary())
    if values.null_count:
        values = pc.fill_null(values, "" if pa.types.is_large_string(values.type) else b"")
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int64)
    data = values.buffers()[2] if len(values) else None
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = PIECE):
    """Ranges of whole texts of about `most` bytes together; a longer text is alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the first word's index of each text (len + 1)."""
    n = len(data)
    inside = ~WHITE[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    cut[n] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | cut[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | cut[1:n]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """64-bit hashes of the given byte spans; fold: A-Z as a-z.

    Eight bytes at a time go into a state that is mixed in between, so no structure of the bytes cancels out.
    """
    size = (ends - starts).astype(np.int64)
    out = mix(size.astype(np.uint64) * _LENGTH + np.uint64(1))
    if not len(starts):
        return out
    if fold:
        data = _FOLD[data]
    for i in np.flatnonzero(size > LONG):
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest()
        out[i] = np.frombuffer(digest, "<u8")[0]
    eight = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    live = np.flatnonzero((size > 0) & (size <= LONG))
    at, left, h = starts[live], size[live], out[live]
    while len(live):
        h = mix(h ^ (eight[at] & _FIRST[np.minimum(left, 8)]))
        out[live] = h
        more = left > 8
        live, at, left, h = live[more], at[more] + 8, left[more] - 8, h[more]
    return out


def secret() -> bytes:
    """A key for one run of an operator, drawn by the driver; tasks get it with their code, so a task that runs again has the same."""
    return os.urandom(32)


@functools.lru_cache(4)
def _factors(key: bytes) -> np.ndarray:
    """Four rows of secret factors: one for a word's length, one for each four bytes up to LONG, and what is added."""
    return np.frombuffer(hashlib.shake_256(key).digest(4 * 8 * (LONG // 4 + 2)), "<u8").reshape(4, -1)


def word_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: bytes, fold: bool = False, halves: int = 2) -> list[np.ndarray]:
    """128 bits of each of the given byte spans, as two arrays of 64 (or the first of them); fold: A-Z as a-z.

    Each quarter is the upper half of a sum of secret factors times the length and every four bytes, which any two
    different spans share with a chance of 2**-32 over the key, whatever they are: so all 128 bits with 2**-128. As the key
    is secret and new in each run, no text can be made for it.
    """
    size = (ends - starts).astype(np.int64)
    factors = _factors(key)[: 2 * halves]
    if fold:
        data = _FOLD[data]
    sums = [f[0] + size.astype(np.uint64) * f[1] for f in factors]
    four = np.ndarray((len(data) + 1,), "<u4", np.concatenate([data, np.zeros(4, np.uint8)]), strides=(1,))
    live = np.flatnonzero((size > 0) & (size <= LONG))
    at, left, k = starts[live], size[live], 2
    while len(live):
        part = four[at].astype(np.uint64) & _FIRST[np.minimum(left, 4)]
        for total, f in zip(sums, factors, strict=True):
            total[live] += part * f[k]
        more = left > 4
        live, at, left, k = live[more], at[more] + 4, left[more] - 4, k + 1
    top = np.uint64(0xFFFFFFFF00000000)
    out = [mix((a >> np.uint64(32)) | (b & top)) for a, b in zip(sums[::2], sums[1::2], strict=True)]
    for i in np.flatnonzero(size > LONG):
        digest = np.frombuffer(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=16, key=key).digest(), "<u8")
        for half, v in zip(out, digest, strict=False):
            half[i] = v
    return out


def runs(words: np.ndarray, first: np.ndarray, k: int, step: np.ndarray = _STEP) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of k words and the first run's index of each text; texts with fewer words have none."""
    n = len(words) - k + 1
    counts = np.maximum(np.diff(first) - k + 1, 0)
    at = np.concatenate([[0], np.cumsum(counts)])
    if n <= 0 or not counts.any():
        return np.zeros(0, np.uint64), at
    h = words[:n] * step[0]
    for j in range(1, k):
        h += (words[j : j + n] * step[j % 64]) ^ np.uint64(j // 64)
    return mix(h[run_starts(first, counts)]), at


def long_runs(words: list[np.ndarray], first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As `runs`, of words of 128 bits, with hashes of 128 bits: their two halves."""
    h, at = runs(words[0], first, k)
    return h, runs(words[1], first, k, _OTHER_STEP)[0], at


def run_starts(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Index of the first word of each run, for counts runs a text."""
    at = np.cumsum(counts) - counts
    return np.repeat(first[:-1] - at, counts) + np.arange(int(counts.sum()))


def owners(at: np.ndarray) -> np.ndarray:
    """For each element the text to which it belongs; at: first index of each text."""
    return np.repeat(np.arange(len(at) - 1), np.diff(at))


def shingle_sets(values, k: int, key: bytes, fold: bool = True):
    """For each text its sorted distinct k-word shingle hashes (under a secret key): all words as one shingle if there are fewer, none without words."""
    data, offsets = column(values)
    for lo, hi in slices(offsets):
        part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        starts, ends, first = spans(part, at)
        (words,) = word_keys(part, starts, ends, key, fold, 1)
        h, of = runs(words, first, k)
        for i in range(hi - lo):
            n = int(first[i + 1] - first[i])
            if n == 0:
                yield np.zeros(0, np.uint64)
            elif n < k:
                w = words[first[i] : first[i + 1]]
                yield mix(np.array([np.sum(w * _STEP[:n]) + np.uint64(n)], np.uint64))
            else:
                yield np.unique(h[of[i] : of[i + 1]])
