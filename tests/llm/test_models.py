"""The two classifiers, on invented text; and the CRF's messages against sums over all labellings."""

from __future__ import annotations

import itertools
import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from orderweave.llm import crf, line_features, line_quality, textnp, toxicity

SCHEMA = "doc_id long, text string, score string, lines string, _other string"


def test_marginals_are_exact():
    rng = np.random.RandomState(0)
    first = np.array([0, 3, 3, 7, 8])
    odds, steps = rng.randn(8) * 2, rng.randn(2, 2)
    good, pairs = crf.marginals(odds, steps, first)
    for a, b in zip(first[:-1], first[1:], strict=True):
        total, ones, joint = 0.0, np.zeros(b - a), np.zeros((b - a, 2, 2))
        for y in itertools.product((0, 1), repeat=b - a):
            w = np.exp(sum((v - 0.5) * o for v, o in zip(y, odds[a:b], strict=True)) + sum(steps[p, q] for p, q in zip(y, y[1:], strict=False)))
            total += w
            ones += w * np.array(y)
            for k in range(1, b - a):
                joint[k, y[k - 1], y[k]] += w
        if b > a:
            assert np.allclose(good[a:b], ones / total)
            assert np.allclose(pairs[a:b], joint / total)


def test_marginals_of_long_texts_stay_finite():
    good, _ = crf.marginals(np.tile([30.0, -30.0], 5000), np.array([[5.0, -5], [-5, 5]]), np.array([0, 10000]))
    assert np.isfinite(good).all()


def documents(spark, n=240):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(200)]
    rows, labels = [], []
    for i in range(n):
        lines = [" ".join(rng.choices(words, k=rng.randint(5, 15))).capitalize() + "." for _ in range(rng.randint(1, 6))]
        bad, toxic = i % 5 == 0, i % 4 == 1
        if bad:
            lines = [x.upper().replace(" ", "!! ") for x in lines]
        if toxic:
            lines[rng.randrange(len(lines))] += " " + rng.choice(["vileword", "nastyone", "hatething"])
        rows.append((i, "\n".join(lines), "clash", "clash", "clash"))
        labels.append((i, int(not bad), int(toxic)))
    rows += [(900, None, None, None, None), (901, "", "", "", ""), (902, " \n ", "", "", ""), (None, "Some text.", "", "", ""), (903, "x " * 20000, "", "", "")]
    labels += [(5000, 1, 1), (900, None, None), (None, 0, 1)]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_on_held_out(spark):
    docs, labels = documents(spark)
    train = labels.where(line_quality.remainder("doc_id", 5) != 0)
    got = line_quality.score(docs, line_quality.fit(docs, train), carry=("doc_id", "score"), original=True)
    rows = got.toDF("doc_id", "clash", "score", "predicted", "lines", "original_text").collect()
    assert len(rows) == 245
    by = {r.doc_id: r for r in rows}
    held = [r for r in labels.where((line_quality.remainder("doc_id", 5) == 0) & F.col("quality").isNotNull()).collect() if r.doc_id in by]
    assert len(held) > 20 and np.mean([by[r.doc_id].predicted == r.quality for r in held]) >= 0.95
    assert by[900].score == by[901].score == by[902].score and by[900].lines == [] and 0 < by[900].score < 1
    assert all(0 <= r.score <= 1 for r in rows)


def test_line_labels_use_neighbours(spark):
    """A line within a text of bad ones is less likely good than the same line within good ones."""
    docs, labels = documents(spark)
    model = line_quality.fit(docs, labels)
    good, bad = "Abc defg hij abdc.", "ABC!! DEFG!! HIJ!! ABDC!! ABBA!!"
    rows = spark.createDataFrame([(1, "\n".join([bad, bad, good, bad, bad])), (2, "\n".join([good] * 5))], "doc_id long, text string")
    lines = {r.doc_id: r.lines for r in line_quality.score(rows, model).collect()}
    assert lines[1][2].good < lines[2][2].good
    assert lines[1][1].start == len(bad) + 1


def test_toxicity_on_held_out(spark):
    docs, labels = documents(spark, 600)
    held = line_quality.remainder("doc_id", 3) == 1
    model = toxicity.fit(docs.where(~F.coalesce(held, F.lit(False))), labels.where(~held))
    rows = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    out = [r for r in labels.where(held & F.col("toxic").isNotNull()).collect() if r.doc_id in rows]
    assert len(out) > 100 and np.mean([rows[r.doc_id].predicted == r.toxic for r in out]) >= 0.97
    assert rows[900].n_marks == 0 and rows[900].predicted == 0


def test_risk_is_not_negative():
    """Positives that a classifier could learn by heart don't turn all else negative without bound."""
    rng = np.random.RandomState(0)
    p, u = (rng.rand(30, 200) < 0.1).astype(np.float32), (rng.rand(300, 200) < 0.1).astype(np.float32)
    w, b = toxicity.train(p, u, 0.1)
    assert np.isfinite(w).all() and (w >= 0).all() and np.isfinite(b)


def test_copies_are_no_evidence():
    one = np.arange(1, 400, 2, dtype=np.uint32)
    other = np.arange(1001, 1400, 2, dtype=np.uint32)
    assert len(toxicity.without_copies([one, one, one[:-3], other])) == 2


def test_without_labels(spark):
    docs, labels = documents(spark, 12)
    none = labels.where("false")
    assert {r.score for r in line_quality.score(docs, line_quality.fit(docs, none)).collect()} == {0.5}
    assert {r.predicted for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()} == {0}
    empty = docs.where("false")
    assert line_quality.score(empty, line_quality.fit(empty, labels)).count() == toxicity.score(empty, toxicity.fit(empty, labels)).count() == 0


def test_samples_of_repeated_ids(spark, monkeypatch):
    """Repeats of an id and null ids take no places of the samples, and an id brings one text."""
    rows = [(1, f"repeat {k}") for k in range(300)] + [(None, f"null {k}") for k in range(50)] + [(k, f"text {k}") for k in range(2, 22)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(1, 11)], "doc_id long, quality int, toxic int")
    got = line_quality.labelled_sample(docs, labels, "doc_id", "text", "quality", 100).collect()
    assert sorted(r._id for r in got) == list(range(1, 11)) and all(r.label == r._id % 2 for r in got)
    taken = []
    monkeypatch.setattr(toxicity, "_collected", lambda texts: taken.append([tuple(r) for r in texts.collect()]) or [np.arange(3, dtype=np.uint32)] * 3)
    toxicity.fit(docs, labels, unlabelled=21)
    assert [sorted(int(i) for i, _ in part) for part in taken] == [[1, 3, 5, 7, 9], list(range(1, 22))]


def test_samples_take_long_texts(spark):
    """Texts are taken until they hold enough together; a long one isn't passed over."""
    docs = spark.createDataFrame([(k, "x " * (50000 if k % 3 else 10)) for k in range(30)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1) for k in range(30)], "doc_id long, quality int")
    got = line_quality.labelled_sample(docs, labels, "doc_id", "text", "quality", 100, 500_000).collect()
    sizes = [len(r.text) for r in got]
    assert 5 <= sum(s > 1000 for s in sizes) <= 6 and sum(sizes) - 100_000 < 500_000
    assert len(line_quality.labelled_sample(docs, labels, "doc_id", "text", "quality", 7).collect()) == 7


def plain_score(model, text):
    """A text's score with a line's features from that text alone, and messages one after another."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    starts, ends, first = line_features.lines(data, np.array([0, len(data)]))
    if not len(starts):
        return model.prior
    x = line_features.design(line_features.raw(data, starts, ends, first), first)
    odds = [float(np.dot(row.astype(float), model.weights[:-1].astype(float)) + float(model.weights[-1])) for row in x]
    own = [np.array([math.exp(-max(-40, min(40, o)) / 2), math.exp(max(-40, min(40, o)) / 2)]) for o in odds]
    t = np.exp(model.steps)
    forward = [own[0] / own[0].sum()]
    for o in own[1:]:
        a = (forward[-1] @ t) * o
        forward.append(a / a.sum())
    backward = [np.ones(2)]
    for o in own[:0:-1]:
        b = t @ (o * backward[-1])
        backward.append(b / b.sum())
    good = [(f * b)[1] / (f * b).sum() for f, b in zip(forward, backward[::-1], strict=True)]
    size = ends - starts
    mean = min(max(float((np.array(good) * size).sum() / size.sum()), 1e-3), 1 - 1e-3)
    return 1 / (1 + math.exp(-(model.slope * math.log(mean / (1 - mean)) + model.shift)))


def test_scores_as_a_plain_version(spark):
    docs, labels = documents(spark)
    model = line_quality.fit(docs, labels)
    got = line_quality.score(docs.select("doc_id", "text"), model, carry=("doc_id", "text")).collect()
    assert len(got) == 245 and max(abs(r.score - plain_score(model, r.text)) for r in got) < 1e-4


def test_toxicity_as_a_plain_version(spark):
    docs, labels = documents(spark, 400)
    model = toxicity.fit(docs, labels)
    weight = dict(zip(model.keys.tolist(), model.weights.tolist(), strict=True))

    def key(piece: str, k: int) -> int:
        raw = np.frombuffer(piece.lower().encode(), np.uint8)
        h = textnp.span_hashes(raw, np.array([0]), np.array([len(raw)]))
        return int((textnp.mix(h + np.uint64(k)) >> np.uint64(32)).astype(np.uint32)[0]) & 0xFFFFFFFE | (k == 0)

    got = toxicity.score(docs, model, carry=("doc_id", "text")).collect()
    for r in got[:: len(got) // 60]:
        words = re.findall(r"[A-Za-z0-9]+", r.text or "")
        found = {key(w, 0) for w in words} | {key(w[:k], k) for w in words for k in toxicity.BEGINNINGS if len(w) > k}
        z = model.shift + sum(weight.get(k, 0.0) for k in found)
        assert abs(r.score - 1 / (1 + math.exp(-z))) < 1e-9 and r.n_marks == sum(k in weight for k in found)


def test_risk_and_its_slope():
    """The risk is the mean of single losses, and its slope that of small steps."""
    rng = np.random.RandomState(1)
    p, u, theta, prior = rng.rand(7, 3).astype(np.float32), rng.rand(11, 3).astype(np.float32), rng.randn(4), 0.2
    z = lambda x: [float(v) for v in x @ theta[:-1] + theta[-1]]
    as_toxic = prior * np.mean([math.log1p(math.exp(-v)) for v in z(p)])
    rest = np.mean([math.log1p(math.exp(v)) for v in z(u)]) - prior * np.mean([math.log1p(math.exp(v)) for v in z(p)])
    a, b, ga, gb = toxicity.risk(theta, p, u, prior)
    assert abs(a - as_toxic) < 1e-6 and abs(b - rest) < 1e-6
    for k in range(4):
        step = np.eye(4)[k] * 1e-3
        up, down = toxicity.risk(theta + step, p, u, prior), toxicity.risk(theta - step, p, u, prior)
        assert abs((up[0] - down[0]) / 2e-3 - ga[k]) < 1e-3 and abs((up[1] - down[1]) / 2e-3 - gb[k]) < 1e-3
    # Where the rest is negative, a step is taken against it: training ends with a risk that isn't far below zero.
    w, shift = toxicity.train(p, u[:0], prior)
    assert np.isfinite(w).all() and np.isfinite(shift)
