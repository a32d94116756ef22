"""Toxicity by non-negative positive-unlabelled learning.

Positives are confirmed toxic documents, unlabelled is any other text; what is labelled as
clean counts as unlabelled. A document's features are which words and word beginnings it
has, hashed. Those that mostly toxic texts have, as far as the two samples tell, are chosen, and linear numpy classifiers are trained on them by the risk
    prior * R(positives as toxic) + max(0, R(unlabelled as clean) - prior * R(positives as clean)),
where prior is the share of toxic among all labels, taken as at least `LEAST_PRIOR` and at most `MOST_PRIOR`. When the second term falls below zero,
which shows overfitting, a step is taken against it instead. Several classifiers, each on its
own part of the unlabelled sample, are averaged.

They are trained on the driver from at most `POSITIVES` and `UNLABELLED` documents, taken by a
hash of their ids until they hold `SAMPLE_BYTES` together, one text for each id; whatever a
text's length, it may be among them. Scoring is a map and shuffles nothing.

Cases: null and empty texts have no features and score what the intercepts give; without
positives all scores are the prior, or 0 without labels; an id with several labels is toxic
if one says so; null labels count as none; rows may repeat; ids may be null; a very long text is
scored as a whole, alone; an empty table gives none; other columns of the input aren't read
unless they are carried, so their names can't clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderweave.llm import textnp
from orderweave.llm.line_quality import remainder
from orderweave.llm.shared import modest_batches, one_text, sampled, sparing

POSITIVES = 2000
UNLABELLED = 5000
SAMPLE_BYTES = 1 << 25
#: A share of toxic texts beyond these is taken as one of them: without it the risk has no slope, or no clean side.
LEAST_PRIOR, MOST_PRIOR = 0.01, 0.5
CHOSEN = 1024
#: Bytes of a word's beginning that count as features, besides the whole word.
BEGINNINGS = (4, 5, 6, 7)
BAGS = 3
PURE = 0.35
TOXIC = 0.7


_EVEN = np.uint32(0xFFFFFFFE)
_A = np.random.RandomState(6).randint(1, 2**31, 120, dtype=np.int64).astype(np.uint64) * np.uint64(2**32 + 2) + np.uint64(1)


@dataclass(frozen=True)
class Model:
    keys: np.ndarray  # chosen features' hashes, in order
    weights: np.ndarray  # of them, averaged over the classifiers
    shift: float


def features(data: np.ndarray, offsets: np.ndarray):
    """For each kind of feature: hashes of 32 bits, odd ones for whole words, and the texts they belong to; bytes other than letters, digits and those beyond ASCII part words."""
    kinds = np.ones(256, bool)
    kinds[:128] = [chr(c).isalnum() for c in range(128)]
    solid = np.where(kinds[data], data, np.uint8(32))
    starts, ends, first = textnp.spans(solid, offsets)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    for k in (*BEGINNINGS, 0):
        own = np.ones(len(starts), bool) if not k else ends - starts > k
        stop = ends if not k else np.minimum(ends, starts + k)
        h = textnp.span_hashes(solid, starts[own], stop[own], fold=True)
        yield (textnp.mix(h + np.uint64(k)) >> np.uint64(32)).astype(np.uint32) & _EVEN | np.uint32(k == 0), text[own]


def _distinct(batches):
    for batch in batches:
        data, offsets = textnp.column(batch["text"])
        rows = []
        for lo, hi in textnp.slices(offsets):
            found = list(features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]))
            key = np.unique((np.concatenate([t for _, t in found]).astype(np.uint64) << np.uint64(32)) | np.concatenate([h for h, _ in found]))
            cut = np.searchsorted(key >> np.uint64(32), np.arange(hi - lo + 1).astype(np.uint64))
            low = key.astype(np.uint32)
            rows += [low[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch["id"], pa.array(rows, pa.binary())], ["id", "features"])


def _collected(texts: DataFrame) -> list[np.ndarray]:
    got = texts.mapInArrow(sparing(_distinct), "id string, features binary").toArrow()
    rows = sorted(zip(*(got[c].to_pylist() for c in ("id", "features")), strict=True), key=lambda r: (r[0] or "", r[1]))
    return without_copies([np.frombuffer(r[1], np.uint32) for r in rows])


def without_copies(rows: list[np.ndarray], bands: int = 12) -> list[np.ndarray]:
    """Of texts that share a band of minima of their whole words only the first, so that copies of one text don't pass for evidence."""
    seen: set = set()
    out = []
    for r in rows:
        words = r[r & np.uint32(1) == 1].astype(np.uint64)
        if len(words):
            least = (words[:, None] * _A).min(axis=0).reshape(bands, -1)
            keys = [(i, b.tobytes()) for i, b in enumerate(least)]
            if not seen.isdisjoint(keys):
                continue
            seen.update(keys)
        out.append(r)
    return out


def _presence(rows: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    out = np.zeros((len(rows), len(keys)), np.float32)
    for i, r in enumerate(rows):
        at = np.minimum(np.searchsorted(keys, r), len(keys) - 1)
        out[i, at[keys[at] == r]] = 1
    return out


def chosen(positives: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, most: int = CHOSEN) -> np.ndarray:
    """The features of which, by cautious counts, a share of at least `PURE` of the texts that have them is toxic: prior * p / q,
    where p and q are their shares of positives and of unlabelled text. Of those the `most` with the largest p * log(p / q)."""
    keys, n = np.unique(np.concatenate(positives), return_counts=True)
    other, m = np.unique(np.concatenate([*unlabelled, np.zeros(0, np.uint32)]), return_counts=True)
    if not len(keys) or not len(other):
        return keys[:0]
    at = np.minimum(np.searchsorted(other, keys), len(other) - 1)
    m = np.where(other[at] == keys, m[at], 0) + 1
    pure = prior * (n - np.sqrt(n)) / len(positives) * len(unlabelled) / (m + np.sqrt(m)) >= PURE
    chance = m * len(positives) / (len(unlabelled) + 1)  # count among positives if they were like the rest; its Poisson tail must be rare among all keys
    pure &= n * np.log(n / chance) - (n - chance) >= 0.8 * np.log(len(keys))
    keys, p, q = keys[pure], n[pure] / len(positives), m[pure] / (len(unlabelled) + 1)
    best = np.lexsort((keys, -p * np.log(p / q)))[:most]
    return np.sort(keys[best])


def risk(theta: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """With logistic loss: the positives' part prior * R(p as toxic), the rest R(u as clean) - prior * R(p as clean), and their slopes."""

    def part(x, as_toxic: bool):
        z = np.clip(x @ theta[:-1].astype(np.float32) + theta[-1], -30, 30)
        loss, slope = (np.logaddexp(0, -z), 1 / (1 + np.exp(-z)) - 1) if as_toxic else (np.logaddexp(0, z), 1 / (1 + np.exp(-z)))
        n = max(1, len(x))
        return loss.sum() / n, np.concatenate([slope.astype(np.float32) @ x, [slope.sum()]]) / n

    (toxic, g_toxic), (clean_p, g_clean_p), (clean_u, g_clean_u) = part(p, True), part(p, False), part(u, False)
    return prior * toxic, clean_u - prior * clean_p, prior * g_toxic, g_clean_u - prior * g_clean_p


def train(p: np.ndarray, u: np.ndarray, prior: float, rounds: int = 300, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and intercept by Adam over the non-negative risk."""
    theta = np.zeros(p.shape[1] + 1)
    theta[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        _, rest, g_toxic, g_rest = risk(theta, p, u, prior)
        g = g_toxic + g_rest if rest >= 0 or not len(u) else -g_rest
        g[:-1] += decay * theta[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta -= 0.1 * (0.5 + 0.5 * np.cos(np.pi * t / rounds)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        theta[:-1] = np.maximum(theta[:-1], 0)  # a chosen feature speaks for toxic or not at all
    return theta[:-1], float(theta[-1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """docs: what may be trained on. labels: id_col and label_col, 1 for toxic; their share is the prior."""
    modest_batches(docs.sparkSession)
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("label"))
    share = known.agg(F.avg((F.col("label") == 1).cast("double"))).first()[0]
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    toxic = sampled(texts, known.where("label = 1").select("_id"), F.xxhash64("_id"), positives, SAMPLE_BYTES)
    p = _collected(one_text(texts.join(F.broadcast(toxic), "_id")).select(F.col("_id").cast("string").alias("id"), "text"))
    none = Model(np.zeros(0, np.uint32), np.zeros(0), float(np.log(max(share or 0, 1e-6) / (1 - min(share or 0, 1 - 1e-6)))))
    if not p:
        return none
    some = sampled(texts, texts.where("_id is not null").select("_id").distinct(), F.xxhash64(F.lit(6), "_id"), unlabelled, SAMPLE_BYTES)
    u = _collected(one_text(texts.join(F.broadcast(some), "_id")).select(F.col("_id").cast("string").alias("id"), "text"))
    prior = float(np.clip(share, LEAST_PRIOR, MOST_PRIOR))
    keys = chosen(p, u, prior)
    if not len(keys):
        return none
    xp, xu = _presence(p, keys), _presence(u, keys)
    bags = [train(xp, xu[np.arange(len(xu)) % BAGS != b] if len(xu) > BAGS else xu, prior) for b in range(BAGS)]
    return Model(keys, np.mean([w for w, _ in bags], axis=0), float(np.mean([s for _, s in bags])))


def score(docs: DataFrame, model: Model, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), toxic: float = TOXIC) -> DataFrame:
    """The columns of carry, score, predicted and n_marks (how many chosen features a text has). A row for each row of docs."""
    modest_batches(docs.sparkSession)
    maybe = np.zeros(1 << 16, bool)
    maybe[model.keys & np.uint32(0xFFFF)] = True

    def run(batches):
        for batch in batches:
            data, offsets = textnp.column(batch["_text"])
            s, n = np.full(batch.num_rows, model.shift), np.zeros(batch.num_rows, np.int64)
            for lo, hi in textnp.slices(offsets) if len(model.keys) else ():
                found = []
                for h, text in features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]):
                    some = maybe[h & np.uint32(0xFFFF)]
                    h, text = h[some], text[some]
                    at = np.minimum(np.searchsorted(model.keys, h), len(model.keys) - 1)
                    hit = model.keys[at] == h
                    found.append(text[hit] * len(model.keys) + at[hit])
                found = np.unique(np.concatenate(found))
                text, at = found // len(model.keys), found % len(model.keys)
                s[lo:hi] += np.bincount(text, model.weights[at], hi - lo)
                n[lo:hi] = np.bincount(text, minlength=hi - lo)
            s = 1 / (1 + np.exp(-np.clip(s, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch["_other"], pa.array(s, pa.float64()), pa.array((s >= toxic).astype(np.int32)), pa.array(n)], ["_other", "score", "predicted", "n_marks"])

    rows = docs.select(F.col(text_col).cast("string").alias("_text"), F.struct(F.lit(0).alias("_"), *(F.col(c) for c in carry)).alias("_other"))
    out = T.StructType([rows.schema["_other"], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("n_marks", T.LongType())])
    return rows.mapInArrow(sparing(run), out).select(*(F.col("_other")[c].alias(c) for c in carry), "score", "predicted", "n_marks")


def op6(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    apart = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    model = fit(docs.select("doc_id", "text").where(~apart), labels.where(remainder("doc_id", 3) != 1))
    return score(docs, model).select("doc_id", apart.alias("held_out"), "score", "predicted", "n_marks")
