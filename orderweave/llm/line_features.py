"""What a line looks like: shares of byte classes, word statistics and repetition, for many texts at a time."""

from __future__ import annotations

import numpy as np

from orderweave.llm import textnp

#: Byte classes: upper, lower, digit, white, beyond ASCII, sentence punctuation, exclamation, other symbols.
CLASSES = np.full(256, 7, np.uint8)
for _class, _members in enumerate((range(65, 91), range(97, 123), range(48, 58), (32, *range(9, 14)), range(128, 256), b".,;:?'\"()-", b"!")):
    CLASSES[list(_members)] = _class
N_CLASSES = 8
#: Shares that are described by whether they pass these marks too.
MARKS = (0.02, 0.1, 0.3, 0.6)
#: Class shares without white space; neighbouring equal words, repeated words, upper-case starts; the line again in its text.
SHARES = N_CLASSES + 3
#: Log length, words, mean word length, end punctuation.
SIZES = 4
RAW = SHARES + SIZES
WIDTH = RAW + SHARES * len(MARKS) + 2 * RAW + 2


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the lines with a word, and each text's first line (len + 1)."""
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    cut[len(data)] = True
    cut[1:] |= data == 10
    at = np.flatnonzero(cut)
    starts, ends = at[:-1], at[1:]
    solid = np.concatenate([[0], np.cumsum(~textnp.WHITE[data])])
    full = solid[ends] > solid[starts]
    starts, ends = starts[full], ends[full]
    return starts, ends, np.searchsorted(starts, offsets)


def raw(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
    """RAW columns for each line."""
    out = np.zeros((len(starts), RAW), np.float32)
    if not len(starts):
        return out
    size = (ends - starts).astype(np.float64)
    kinds = CLASSES[data]
    counts = np.empty((len(starts), N_CLASSES))
    for c in range(N_CLASSES):
        total = np.concatenate([[0], np.cumsum(kinds == c)])
        counts[:, c] = total[ends] - total[starts]
    solid = np.maximum(size - counts[:, 3], 1)
    out[:, :N_CLASSES] = counts / solid[:, None]
    out[:, 3] = 0

    w_start, w_end, w_first = textnp.spans(data, np.concatenate([starts, ends[-1:]]))
    words = np.diff(w_first)
    h = textnp.span_hashes(data, w_start, w_end, fold=True)
    line = np.repeat(np.arange(len(starts)), words)
    same = np.zeros(len(h), bool)
    if len(h) > 1:
        same[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    key = textnp.mix(h ^ (line.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(key)
    again = np.zeros(len(h), bool)  # a word that its line has elsewhere too, but for one place
    again[order[1:]] = key[order[1:]] == key[order[:-1]]
    per = np.maximum(words, 1)
    out[:, N_CLASSES] = np.bincount(line, same, len(starts)) / per
    out[:, N_CLASSES + 1] = np.bincount(line, again, len(starts)) / per

    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    line_hash = np.bincount(line, minlength=len(starts)).astype(np.uint64)
    sums = np.zeros(len(starts), np.uint64)
    np.add.at(sums, line, textnp.mix(h + (np.arange(len(h)) - w_first[line]).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    key = textnp.mix(sums ^ line_hash ^ textnp.mix(owner.astype(np.uint64) + np.uint64(1)))
    _, back, count = np.unique(key, return_inverse=True, return_counts=True)
    out[:, N_CLASSES + 2] = count[back] > 1

    out[:, SHARES] = np.log1p(size) / 8
    out[:, SHARES + 1] = np.log1p(words) / 6
    out[:, SHARES + 2] = np.minimum(solid / per, 40) / 20
    tail = data[w_end[w_first[1:] - 1] - 1]
    out[:, SHARES + 3] = (tail == 46) | (tail == 63) | (tail == 33)
    return out


def design(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The features of each line: its own, marks of its shares, those of the lines before and after it in its text."""
    n = len(x)
    out = np.zeros((n, WIDTH), np.float32)
    out[:, :RAW] = x
    at = RAW
    for mark in MARKS:
        out[:, at : at + SHARES] = x[:, :SHARES] > mark
        at += SHARES
    is_first, is_last = np.zeros(n, bool), np.zeros(n, bool)
    filled = np.flatnonzero(np.diff(first))
    is_first[first[filled]] = True
    is_last[first[filled + 1] - 1] = True
    if n > 1:
        out[1:, at : at + RAW] = x[:-1]
        out[:-1, at + RAW : at + 2 * RAW] = x[1:]
    out[is_first, at : at + RAW] = 0
    out[is_last, at + RAW : at + 2 * RAW] = 0
    out[:, -2], out[:, -1] = is_first, is_last
    return out
