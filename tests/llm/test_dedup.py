"""Substring, suffix and near dedup against plain versions, on texts made to be awkward."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from orderweave.llm import near_dedup as near
from orderweave.llm import sketch, textnp
from orderweave.llm.components import components, near_labels
from orderweave.llm.near_dedup import near_dedup
from orderweave.llm.substring_dedup import dedup_substrings
from orderweave.llm.suffix_dedup import dedup_suffixes
from tests.llm import brute

SCHEMA = "doc_id long, text string, kept_text string, n_removed string, node long, block string"


def corpus(seed: int = 0, n: int = 60):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 7))) for _ in range(300)]
    passage = " ".join(rng.choices(words, k=60))
    docs = []
    for i in range(n):
        text = " ".join(rng.choices(words, k=rng.randint(0, 120)))
        kind = i % 6
        if kind == 1:
            text = text[: len(text) // 2] + passage[rng.randint(0, 40) :] + text[len(text) // 2 :]
        elif kind == 2 and docs:
            text = docs[rng.randrange(len(docs))][1] or ""
        elif kind == 3 and docs:
            w = (docs[rng.randrange(len(docs))][1] or "x").split(" ")
            w[rng.randrange(len(w))] = "Changed"
            text = " ".join(w)
        elif kind == 4:
            text = (rng.choice(["ab ", "x", "\n\t ", "word word "]) * rng.randint(1, 90))
        docs.append((i * 7 % 101, text))
    return docs + [(200, None), (201, ""), (202, " \n"), (203, "a"), (204, passage.upper()), (205, "A " * 30000)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    return rows, spark.createDataFrame([(i, t, "clash", "clash", 1, "clash") for i, t in rows], SCHEMA)


def test_substrings(docs):
    rows, df = docs
    got = dedup_substrings(df).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256)).collect()
    assert sorted(map(tuple, got)) == sorted(brute.substring_dedup(rows))


def test_suffixes(docs):
    rows, df = docs
    got = dedup_suffixes(df).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got)) == sorted(brute.byte_dedup(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_suffixes_over_many_blocks(spark, monkeypatch, seed):
    from orderweave.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "BLOCK", 3000)
    rows = corpus(seed, 90)
    got = dedup_suffixes(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got)) == sorted(brute.byte_dedup(rows))


def test_suffixes_with_few_hashes(spark, monkeypatch):
    """Hashes only choose what is compared: with three bits of them the rows are the same."""
    from orderweave.llm import suffix_dedup

    def few(*a, **k):
        return textnp.span_hashes(*a, **k) & np.uint64(7)

    rows = corpus(4, 40)
    got = []
    for h, hot in ((textnp.span_hashes, 2), (textnp.span_hashes, 4), (few, 2)):
        monkeypatch.setattr(suffix_dedup, "hashed", h)
        monkeypatch.setattr(suffix_dedup, "HOT_RUNS", hot)
        tables = {}
        for b in range(3):
            own = pa.table({"id": pa.array([i for i, _ in rows[b::3]], pa.int64()), "text": pa.array([t for _, t in rows[b::3]])})
            tables[b] = suffix_dedup._ordered(own)
        slices = 2
        found = {b: suffix_dedup._block(t, 50) for b, t in tables.items()}
        sent = pa.concat_tables([suffix_dedup._anchored(b, f[0], *f[2:], slices, 50) for b, f in found.items()])
        by_part = lambda t, f: [f((pa.scalar(p),), t.filter(pc.equal(t["part"], p))) for p in sorted(set(t["part"].to_pylist()))]
        cells = pa.concat_tables(by_part(sent, suffix_dedup._judged))
        own = lambda t, b: t.filter(pc.equal(t["block"], b))
        windows = pa.concat_tables([sketch.sketch(b, suffix_dedup._hot_windows(f[0], *f[2:], own(cells, b), slices, 50)[3], slices) for b, f in found.items()])
        windows = pa.concat_tables(by_part(windows, sketch.merged)).rename_columns(["block", "part", "windows"])
        both = pa.concat_tables([cells, windows], promote_options="default")
        stretches = pa.concat_tables([suffix_dedup._stretches(b, tables[b], *f, own(both, b), slices, 50) for b, f in found.items()])
        spans = pa.concat_tables(by_part(stretches, suffix_dedup._covered(50)))
        got.append({i: int(g.sum()) for b, f in found.items() for i, g in zip(tables[b]["id"].to_pylist(), np.split(suffix_dedup._gone(f[0], own(spans, b), 50), f[1][1:-1]), strict=True)})
    assert got[0] == got[1] == got[2] == {i: n for i, _, n, *_ in brute.byte_dedup(rows)}


@pytest.mark.parametrize("shingle, percent", [(3, 85), (5, 80)])
def test_near(docs, shingle, percent):
    rows, df = docs
    got = near_dedup(df, shingle=shingle, percent=percent).collect()
    assert sorted(map(tuple, got)) == sorted(brute.near_dedup(rows, shingle, percent))


def test_near_in_small_blocks(spark, monkeypatch):
    """A group of near copies that spans several blocks keeps all its links."""
    monkeypatch.setattr(near, "BLOCK", 4)
    rng = random.Random(5)
    base = [f"w{k}" for k in range(80)]
    rows = []
    for i in range(40):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(80)] = f"v{rng.randrange(99)}"
        rows.append((i, " ".join(w)))
    got = near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, percent=85).collect()
    assert sorted(map(tuple, got)) == sorted(brute.near_dedup(rows, 3, 85))


def test_empty_tables_and_null_ids(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert dedup_substrings(none).count() == dedup_suffixes(none).count() == near_dedup(none).count() == 0
    long = " ".join(f"word{k}" for k in range(40))
    rows = spark.createDataFrame([(None, long), (None, long), (3, long), (3, long)], "doc_id long, text string")
    removed = {(r.doc_id, r.n_removed) for r in dedup_substrings(rows).collect()}
    assert removed == {(None, 40), (3, 0)}
    removed = {(r.doc_id, r.n_removed) for r in dedup_suffixes(rows).collect()}
    assert removed == {(None, len(long)), (3, 0)}
    assert {tuple(r) for r in near_dedup(rows).select("doc_id", "component_id", "kept").collect()} == {(None, None, True), (3, 3, True)}


def test_sketch_loses_nothing():
    h = np.random.RandomState(0).randint(0, 2**63, 5000).astype(np.uint64)
    blocks = [np.concatenate([h[:300], h[1000:2000]]), np.concatenate([h[200:400], h[3000:4000]])]
    slices = 3
    tables = [sketch.sketch(b, x, slices) for b, x in enumerate(blocks)]
    rows = pa.concat_tables(tables)
    replies = pa.concat_tables([sketch.merged((pa.scalar(p),), rows.filter(pa.compute.equal(rows["part"], p))) for p in set(rows["part"].to_pylist())])
    for b, x in enumerate(blocks):
        yes = sketch.repeated(x, replies.filter(pa.compute.equal(replies["block"], b)), slices)
        assert yes[np.isin(x, h[200:300])].all() and yes.mean() < 0.5


def turned(n: int) -> tuple[str, str]:
    """Two words of 2**n letters that hashes by powers of an odd base, modulo a power of two, can't tell apart."""
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_words_that_polynomials_confuse(spark):
    a, b = turned(10)
    six = " ".join(f"w{k}" for k in range(6))
    rows = [(1, f"{six} {a} {six} q"), (2, f"{six} {b} {six} q"), (3, f"{six} {a} {six} q"), (4, f"{a} x y"), (5, f"{b} x y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in dedup_substrings(df).collect()} == {1: 0, 2: 0, 3: 14, 4: 0, 5: 0}
    got = {r.doc_id: r.component_id for r in near_dedup(df, shingle=3, percent=85).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}
    found = dedup_suffixes(df).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, found)) == sorted(brute.byte_dedup(rows))


def test_words_made_to_share_a_public_hash(spark):
    """Each of these pairs has one hash if eight bytes at a time go through public constants."""
    (a, b), (c, d) = ("%.;{._b3{(]h4p8!", "_71>[w*e&mm)l|oj"), ("4&,^&]cP^6@kQwWZ", "LIQRsd~xzD{7wUT>")
    rows = [(1, " ".join([a] * 13)), (2, " ".join([b] * 13)), (3, " ".join([c] * 13)), (4, " ".join([d] * 13)), (5, " ".join([c] * 14))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in dedup_substrings(df).collect()} == {1: 0, 2: 0, 3: 0, 4: 0, 5: 14}
    assert {r.doc_id: r.component_id for r in near_dedup(df, shingle=3, percent=85).collect()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 3}


def test_classes_under_few_bits_are_told_apart(docs):
    rows, df = docs
    got = near_dedup(df, shingle=3, percent=85, bits=2).collect()
    assert sorted(map(tuple, got)) == sorted(brute.near_dedup(rows, 3, 85))


def test_word_keys_are_of_the_bytes_alone():
    words = [b"", b"a", b"a\0", b"ab", b"abcd", b"abcde", b"x" * 1024, b"x" * 1025, b"x" * 1026, "é".encode(), b"AB", b"a"]
    data, ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words])
    starts = ends - [len(w) for w in words]
    for key in (b"1" * 32, b"2" * 32):
        lo, hi = textnp.word_keys(data, starts, ends, key)
        both = list(zip(lo.tolist(), hi.tolist(), strict=True))
        assert len(set(both)) == len(words) - 1 and both[1] == both[-1]
        (folded,) = textnp.word_keys(data, starts, ends, key, True, 1)
        assert folded[3] == folded[10] == lo[3]
    assert textnp.word_keys(data, starts, ends, b"1" * 32)[0][3] != lo[3]


def test_cells_are_coded_without_loss():
    for cells in ([0], [5, 6, 7], [1, 70000, 200000], [65535, 131070], [1 << 23, (1 << 24) - 1], [], list(range(0, 1 << 24, 100_000))):
        assert sketch.decode(sketch.encode(np.array(cells, np.int64))).tolist() == cells


def test_equal_first_halves_stay_apart():
    h, g, ids = np.array([5, 5, 5, 9], np.uint64), np.array([1, 2, 1, 1], np.uint64), np.array([7, 3, 4, 1])
    assert sketch.least_ids(h, g, ids).tolist() == [4, 3, 4, 1]


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 3), (10, 11), (20, 20)] + [(k, k + 1) for k in range(100, 140)]
    df = spark.createDataFrame(links, "u long, v long")
    got = {r.node: r.component for r in components(df).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 10: 10, 11: 10} | {k: 100 for k in range(100, 141)}
    assert all(got[r.node] == got[r.component] for r in near_labels(df).collect())
