"""Byte-level BPE against the tokenizer library over whole texts."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orderweave.llm import byte_bpe
from orderweave.llm.byte_bpe import PATTERN, RANKS, decode, encode, pre_tokens, vocabulary
from tests.llm import brute

TEXTS = [None, "", "hello  world", "tail space ", "é日本語 ✓ x y", "a" * 3000, " \n\n\t " * 400, "don't I'LL we've" * 50, "line one\r\nline two\n\n" * 200, "  lead", "123 456,789", "​﻿", "😀" * 500 + " end", "<|endoftext|> x", "it's  they're\n\n  x", "été 中文 ١٢ 3   y", "a" * 3000, " " * 500, "abc123" * 300, "don't " * 400, "x\n" * 700, "!?" * 300 + "'ll", "🙂👍" * 200]
SCHEMA = "doc_id long, text string, ids string, text2 string, n_tokens string, start int"


@pytest.mark.parametrize("chunk, overlap, spread", [(7, 9, 40), (64, 16, 300), (2048, 128, 1 << 20), (65536, 128, 1000)])
def test_as_the_library(spark, chunk, overlap, spread):
    rows = [(k, t, "clash", "clash", "clash", 3) for k, t in enumerate(TEXTS)] + [(2, "hello  world", "", "", "", 1), (5, "b" * 2500, "", "", "", 1), (5, "a" * 3000, "", "", "", 1), (None, "null id " * 40, "", "", "", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    _, ids = brute.encoded("", RANKS, PATTERN)
    got = decode(encode(df, chunk=chunk, overlap=overlap, spread=spread)).collect()
    both = encode(df, chunk=chunk, overlap=overlap, spread=spread, decoded=True).collect()
    want = sorted((-1 if i is None else i, ids(t), (t or "").encode()) for i, t, *_ in rows)
    for found in (got, both):
        assert sorted((-1 if r.doc_id is None else r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), bytes(r.decoded)) for r in found) == want
        assert all(r.n_tokens == len(r.ids) // 4 for r in found)


def test_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert encode(none).count() == encode(none, decoded=True).count() == decode(encode(none)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "'", "r", "e", "'re", " ", "  ", "\n", "1", "23", "!", "é", "中", " ", "'s", "ll", " "]), max_size=160), st.sampled_from([(7, 9), (16, 16), (33, 12), (64, 40)]))
def test_chunks_resynchronise(letters, sizes):
    text, pattern = "".join(letters), vocabulary(RANKS, PATTERN)[1]
    assert pre_tokens(text, pattern, *sizes) == pattern.findall(text)


def test_long_words_are_read_a_few_times_only(monkeypatch):
    pattern = vocabulary(RANKS, PATTERN)[1]
    read = []

    class Counting:
        def findall(self, text):
            read.append(len(text))
            return pattern.findall(text)

    text = "".join(random.Random(0).choices("abcdefgh", k=5_000_000))
    began = time.perf_counter()
    assert pre_tokens(text + " end", Counting()) == [text, " end"]
    assert sum(read) < 6 * len(text) and time.perf_counter() - began < 30


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    _, ids = brute.encoded("", RANKS, PATTERN)
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.op5(spark, "/root/testdata/sf0.001").collect()}
    plain = spark.createDataFrame([(r.doc_id, np.array(ids(r.text), "<u4").tobytes(), (r.text or "").encode()) for r in docs.collect()], "doc_id long, ids binary, bytes binary")
    assert got == {r.doc_id: (len(r.ids) // 4, r.a, r.b) for r in plain.select("doc_id", "ids", F.sha2("ids", 256).alias("a"), F.sha2("bytes", 256).alias("b")).collect()}
