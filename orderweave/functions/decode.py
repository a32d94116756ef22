"""Sequences of class scores to labels and text, on arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def argmax(scores: Column) -> Column:
    """Index from 0 of the first largest element."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def collapsed(tokens: Column, blank: int = 0, remap: Column | None = None, strict: bool = True) -> Column:
    """Struct token, pos of the steps that a sequence's text is made of: no blanks, and of equal neighbours the first.

    remap: map from tokens to others that look alike. strict=False compares a step with the
    remapped token before it, as some recognizers do; then repeats of a remapped token stay.
    """
    other = (lambda t: F.coalesce(F.try_element_at(remap, t), t)) if remap is not None else (lambda t: t)

    def stays(t, i):
        before = F.get(tokens, i - 1)
        same = (i > 0) & (before == t) if strict else (i > 0) & (other(before) == t)
        return (t != blank) & ~same

    indexed = F.transform(tokens, lambda t, i: F.struct(other(t).alias("token"), i.alias("pos"), stays(t, i).alias("stays")))
    return F.transform(F.filter(indexed, lambda x: x["stays"]), lambda x: F.struct(x["token"].alias("token"), x["pos"].alias("pos")))


def decoded(kept: Column, alphabet: Column) -> Column:
    return F.array_join(F.transform(kept, lambda x: F.get(alphabet, x["token"])), "")


def confidence(kept: Column, best: Column) -> Column:
    """Mean best score of the steps that stay; 0 without any."""
    total = F.aggregate(kept, F.lit(0.0), lambda t, x: t + F.get(best, x["pos"]))
    return F.when(F.size(kept) > 0, total / F.size(kept)).otherwise(F.lit(0.0))


def difference_bits(values: Column) -> Column:
    """A character for each pair of neighbours: 1 where the second is larger."""
    return F.array_join(F.transform(F.sequence(F.lit(1), F.size(values) - 1), lambda i: F.when(F.get(values, i) > F.get(values, i - 1), "1").otherwise("0")), "")


def difference_words(values: Column) -> Column:
    """The same bits, one for each pair of neighbours, as an array of longs of 64 bits; the last may hold fewer."""
    last = F.size(values) - 1
    bit = lambda i: F.when(F.get(values, i) > F.get(values, i - 1), F.call_function("shiftleft", F.lit(1).cast("long"), ((i - 1) % 64).cast("int"))).otherwise(F.lit(0).cast("long"))
    word = lambda w: F.aggregate(F.sequence(64 * w + 1, F.least(64 * w + 64, last)), F.lit(0).cast("long"), lambda s, i: s.bitwiseOR(bit(i)))
    words = F.transform(F.sequence(F.lit(0), ((last - 1) / 64).cast("int")), word)
    return F.when(last > 0, words).when(values.isNotNull(), F.array().cast("array<bigint>"))


def hamming_words(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of longs; what the shorter one lacks counts as 0."""
    none = F.lit(0).cast("long")
    return F.aggregate(F.zip_with(a, b, lambda x, y: hamming(F.coalesce(x, none), F.coalesce(y, none))), F.lit(0), lambda s, n: s + n)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
