"""Text of tickets and stickers: normal form, similarity and numbers."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WIDE_DIGITS, DIGITS = "０１２３４５６７８９", "0123456789"
#: What Unicode says is white space.
WHITE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def stripped(text: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.btrim(text, F.lit(WHITE))


def normalized(text: Column, compatible: bool = True) -> Column:
    """NFKC, stripped, lower case, without ASCII spaces; compatible=False: the text has its NFKC form already, which keeps the work in the JVM."""
    return F.replace(F.lower(stripped(nfkc(text) if compatible else text)), F.lit(" "), F.lit(""))


def digits(text: Column) -> Column:
    return F.translate(text, WIDE_DIGITS, DIGITS)


def first_number(text: Column) -> Column:
    """The first run of digits that doesn't begin with 0, as a number; null without one."""
    return F.nullif(F.regexp_extract(digits(text), r"[1-9][0-9]*", 0), F.lit("")).try_cast("int")


def leading_number(text: Column) -> Column:
    """A number that something follows, at the start of the stripped text."""
    return F.nullif(F.regexp_extract(digits(stripped(text)), r"^([1-9][0-9]*).+", 1), F.lit("")).try_cast("int")


def order_number(text: Column) -> Column:
    """The three digits that a text ends with."""
    return F.nullif(F.regexp_extract(digits(stripped(text)), r"[0-9]{3}$", 0), F.lit(""))


def ends_with_digit(text: Column) -> Column:
    """Whether a stripped text may be, or end with, a number; much less work than to look for one."""
    return F.substring(text, -1, 1).isin(*DIGITS, *WIDE_DIGITS)


def only_digits(text: Column) -> Column:
    return digits(stripped(text)).rlike(r"^[1-9][0-9]*$")


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of all texts one after another, the text that each belongs to, and its place there."""
    size = np.array([len(t) for t in texts], np.int64)
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return chars, np.repeat(np.arange(len(texts)), size), np.arange(len(chars)) - np.repeat(np.cumsum(size) - size, size)


def common_length(a: list[str], b: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequences of pairs.

    Bit-parallel: a bit of a word stands for a place of the first text, 64 places a word, and is unset once it takes part; a
    step takes one character of all second texts at a time.
    """
    n, m = max(map(len, a), default=0), max(map(len, b), default=0)
    texts, of = np.unique(np.array(a, object), return_inverse=True) if len(a) else (np.array([], object), np.zeros(0, int))
    chars, owner, place = _codes(texts.tolist())
    others, row, at = _codes(b)
    known = np.unique(chars)
    words = max(1, -(-n // 64))
    masks = np.zeros((words, len(texts), len(known) + 1), np.uint64)  # the last column is of all other characters
    np.bitwise_or.at(masks, (place // 64, owner, np.searchsorted(known, chars)), np.uint64(1) << (place % 64).astype(np.uint64))
    second = np.full((len(b), m), len(known))
    if len(known):
        found = np.minimum(np.searchsorted(known, others), len(known) - 1)
        second[row, at] = np.where(known[found] == others, found, len(known))
    left = np.full((words, len(a)), ~np.uint64(0))
    for j in range(m):
        carry = np.zeros(len(a), np.uint64)
        for w in range(words):
            v = left[w]
            u = v & masks[w, of, second[:, j]]
            total = v + u
            more = total + carry
            carry = ((total < v) | (more < total)).astype(np.uint64)
            left[w] = more | (v & ~u)
    size = np.array([len(t) for t in a], np.int64)
    out = np.zeros(len(a), np.int64)
    for w in range(words):
        bits = np.clip(size - 64 * w, 0, 64)
        within = np.where(bits == 64, ~np.uint64(0), (np.uint64(1) << np.minimum(bits, 63).astype(np.uint64)) - np.uint64(1))
        out += np.bitwise_count(~left[w] & within)
    return out


@F.pandas_udf(T.DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """200 * common subsequence / both lengths; 100 for two empty texts, null where one is null. Pairs are computed once each, by similar length."""
    pairs = pd.DataFrame({"a": a, "b": b})
    some = pairs.dropna().drop_duplicates()
    some = some.assign(n=some.a.str.len() + some.b.str.len()).sort_values("n")
    parts = []
    for lo in range(0, len(some), 1024):
        part = some.iloc[lo : lo + 1024]
        lcs = common_length(part.a.to_list(), part.b.to_list())
        parts.append(pd.Series(np.where(part.n > 0, 200.0 * lcs / np.maximum(part.n, 1), 100.0), index=pd.MultiIndex.from_frame(part[["a", "b"]])))
    if not parts:
        return pd.Series([None] * len(pairs), index=pairs.index, dtype="float64")
    known = pd.concat(parts).to_dict()
    return pd.Series([known.get(p) for p in zip(pairs.a, pairs.b, strict=True)], index=pairs.index, dtype="float64")


def ratio_to(text: Column, other: str) -> Column:
    """indel_ratio to one text of at most 62 characters, within the JVM: the bits of a number stand for its places (see common_length)."""
    n = len(other)
    if not 0 < n <= 62:
        raise ValueError("a text of 1 to 62 characters")
    places: dict[str, int] = {}
    for k, c in enumerate(other):
        places[c] = places.get(c, 0) | 1 << k
    whole = (1 << n) - 1
    masks = F.create_map(*(F.lit(v) for c, mask in places.items() for v in (c, F.lit(mask).cast("long"))))

    def step(left: Column, c: Column) -> Column:
        mask = F.coalesce(F.try_element_at(masks, c), F.lit(0).cast("long"))
        u = left.bitwiseAND(mask)
        return (left + u).bitwiseOR(left.bitwiseAND(F.bitwise_not(mask))).bitwiseAND(F.lit(whole).cast("long"))

    left = F.aggregate(F.split(text, ""), F.lit(whole).cast("long"), step)
    return 200.0 * (n - F.bit_count(left)) / (n + F.length(text))
