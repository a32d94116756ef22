from __future__ import annotations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from orderweave.llm.lyndon import suffix_arrays
from orderweave.llm.suffix_dedup import least_ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), max_size=25), min_size=1, max_size=6))
def test_suffix_arrays(texts):
    ended = [[*t, 0] for t in texts]
    lo = np.concatenate([[0], np.cumsum([len(t) for t in ended])[:-1]])
    got = suffix_arrays(np.concatenate(ended), lo)
    expected = [b + i for b, t in zip(lo, ended, strict=True) for i in sorted(range(len(t)), key=lambda i: t[i:])]
    assert got.tolist() == [int(x) for x in expected]


def test_empty():
    assert len(suffix_arrays(np.zeros(0, np.int64), np.zeros(0, np.int64))) == 0
    assert suffix_arrays(np.array([0]), np.array([0])).tolist() == [0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.text("ab", min_size=5, max_size=14), st.integers(0, 9)), min_size=1, max_size=12))
def test_least_ids(rows):
    rows.sort()
    data = np.frombuffer("".join(t for _, t, _ in rows).encode(), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t) for _, t, _ in rows])])
    got = least_ids(np.array([a for a, _, _ in rows], np.uint64), data, at, np.array([i for _, _, i in rows]), 5)
    for (a, t, _), least in zip(rows, got, strict=True):
        assert least.tolist() == [min(i for b, u, i in rows if b == a and t[k : k + 5] in u) for k in range(len(t) - 4)]


def test_only_windows_that_may_repeat_are_sorted(monkeypatch):
    """Stretches of one anchor share a passage, or nothing: of the first only the passage is sorted, of the others nothing."""
    import pyarrow as pa

    from orderweave.llm import suffix_dedup

    rng = np.random.default_rng(3)
    text = lambda n: rng.integers(97, 123, n).astype(np.uint8).tobytes()
    passage, other = text(60), text(55)
    stretches = [text(6) + passage, text(4) + passage, passage[3:] + text(8), text(70), text(70), text(2) + other, other]
    anchors = np.array([7, 7, 7, 7, 7, 9, 9], np.uint64)
    sizes = np.array([len(s) for s in stretches], "<i4")
    ids, places = np.arange(len(stretches)), np.cumsum(sizes) - sizes
    row = {"part": 0, "block": 0, "anchors": anchors.tobytes(), "sizes": sizes.tobytes(), "data": pa.compress(b"".join(stretches), "zstd", asbytes=True), "counts": np.ones(len(ids), "<i4").tobytes(), "places": places.astype(np.int64).tobytes(), "ids": ids.astype(np.int64).tobytes()}
    sorted_ = []
    monkeypatch.setattr(suffix_dedup, "suffix_arrays", lambda symbols, lo: sorted_.append(len(symbols)) or suffix_arrays(symbols, lo))
    spans = suffix_dedup._covered(50)((pa.scalar(0),), pa.Table.from_pylist([row]))
    got = {tuple(x) for raw in spans["spans"].to_pylist() for x in np.frombuffer(raw, np.int64).reshape(-1, 2).tolist()}
    assert got == {(int(places[1]) + 4, 11), (int(places[2]), 8), (int(places[6]), 6)}
    assert sum(sorted_) <= 60 + 57 + 55 + 6
