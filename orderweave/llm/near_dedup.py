"""MinHash near-dedup: documents linked by the similarity of their shingle sets.

Texts with equal sets form a class, which its smallest id stands for. Many universal hash
minima are cut into bands; classes that share a band meet in a bucket. The number of
bands follows from the threshold: a pair at it shares no band with a chance below 1e-6.

Pairs of a bucket are not listed. Each bucket names a hub, the member with the most
company over all its bands, and members are held against hubs: first by their
signatures, then by the full sets. That links most of a group of copies. What is left
open are pairs of members of one hub which still lie in different components. Those are
held against each other in square blocks of bounded size by a product of their incidence
matrices, so no pair becomes a row; a block returns the few links that join components.
Components are alternating large-star and small-star.

Cases: a text without words is empty and linked with nothing; null texts are empty; a null
id is linked with nothing and keeps a null component; where rows share an id, each row's
component is that of its own text; repeated rows are one class, and each is returned; other columns aren't read, so their
names can't clash; an empty table gives none; a very long text is hashed alone, and takes some 40 times its size meanwhile.

Shingles are 64 bits under a key that is drawn anew in each run (textnp.word_keys), so no texts can be made to share them.
Classes are told apart by 128 bits of a digest (BLAKE2b) of the set: the first half is the key by which they are grouped, and
where sets of one key differ in the second half, which is looked for, the key is split.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderweave.llm import textnp
from orderweave.llm.components import components, near_labels
from orderweave.llm.shared import kept, modest_batches

ROWS = 6
#: Members of one side of a block, and of a hub that are held against it in one task.
BLOCK = 512
#: Texts whose sets are held together.
SETS = 500
_A = np.random.RandomState(8).randint(1, 2**62, 1024, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_B = np.random.RandomState(9).randint(1, 2**62, 1024, dtype=np.int64).astype(np.uint64)


def bands_for(percent: int) -> int:
    return math.ceil(math.log(1e-6) / math.log(1 - (percent / 100) ** ROWS))


def minima(sets: list[np.ndarray], count: int) -> np.ndarray:
    """For each nonempty set the minima of `count` universal hashes, 32 bits each."""
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    out = np.empty((len(sets), count), np.uint32)
    lo = 0
    while lo < len(sets):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + 32768, "right")) - 1)
        x, cuts = np.concatenate(sets[lo:hi]), at[lo:hi] - at[lo]
        h = np.empty_like(x)
        for i in range(count):
            np.multiply(x, _A[i], out=h)
            h += _B[i]
            out[lo:hi, i] = np.minimum.reduceat(h, cuts) >> np.uint64(32)
        lo = hi
    return out


def _digest(s: np.ndarray, bits: int) -> tuple[int, int]:
    """Of a sorted set: both halves of 128 bits, the first cut to so many."""
    a, b = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), "<i8").tolist()
    return a >> (64 - bits), b


def _signatures(shingle: int, bands: int, secret: bytes, bits: int):
    def run(batches):
        for batch in (b.slice(lo, SETS) for b in batches for lo in range(0, b.num_rows, SETS)):
            sets = list(textnp.shingle_sets(batch["text"], shingle, secret))
            full = [i for i, s in enumerate(sets) if len(s)]
            nodes: list = [(None, None)] * len(sets)
            keys: list = [None] * len(sets)
            sigs: list = [None] * len(sets)
            if full:
                m = minima([sets[i] for i in full], bands * ROWS)
                h = np.zeros((len(full), bands), np.uint64)
                for j in range(ROWS):
                    h = (h ^ m[:, j::ROWS]) * textnp._STEP[j]
                h = textnp.mix(h + np.arange(bands, dtype=np.uint64) * textnp._STEP[60]).view(np.int64)
                low = m.astype(np.uint8)
                for r, i in enumerate(full):
                    nodes[i], keys[i], sigs[i] = _digest(sets[i], bits), h[r], low[r].tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch["id"], pa.array([len(s) for s in sets], pa.int64()), *(pa.array([v[k] for v in nodes], pa.int64()) for k in (0, 1)), pa.array(keys, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
                ["id", "n", "node", "other", "bands", "sig"],
            )

    return run


def _sets(shingle: int, secret: bytes, bits: int):
    def run(batches):
        for batch in (b.slice(lo, SETS) for b in batches for lo in range(0, b.num_rows, SETS)):
            sets = list(textnp.shingle_sets(batch["text"], shingle, secret))
            nodes = [_digest(s, bits) if len(s) else (None, None) for s in sets]
            yield pa.RecordBatch.from_arrays([*(pa.array([v[k] for v in nodes], pa.int64()) for k in (0, 1)), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "other", "members"])

    return run


def _alike(least: float):
    """Signature check: the share of equal minima, of which each pair has 1/256 by chance."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sig", "hub_sig"))
            share = ((a == b).mean(axis=1) - 1 / 256) / (1 - 1 / 256)
            yield pa.RecordBatch.from_arrays([batch["hub"], batch["node"], pa.array(share, pa.float64()), pa.array(share >= least)], ["hub", "node", "share", "close"])

    return run


def _against_hub(percent: int):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        nodes, sets = rows["node"].to_numpy(), [np.frombuffer(x, np.uint64) for x in rows["members"].to_pylist()]
        hub = key[0].as_py()
        h = next(s for x, s in zip(nodes, sets, strict=True) if x == hub)
        out = []
        for x, s in zip(nodes.tolist(), sets, strict=True):
            if x != hub:
                both = int(np.sum(h[np.minimum(np.searchsorted(h, s), len(h) - 1)] == s))
                out.append((x, 100 * both >= percent * (len(h) + len(s) - both)))
        return pa.table({"hub": pa.array([hub] * len(out), pa.int64()), "node": pa.array([x for x, _ in out], pa.int64()), "linked": pa.array([x for _, x in out], pa.bool_())})

    return run


def linked_pairs(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Matrix of which sets are linked, by counting common elements over those that several sets have."""
    size = np.array([len(s) for s in sets], np.int64)
    tokens, who = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(tokens, kind="stable")
    tokens, who = tokens[order], who[order]
    new = np.concatenate([[True], tokens[1:] != tokens[:-1]])
    group = np.cumsum(new) - 1
    several = np.bincount(group)[group] > 1
    group, who = group[several], who[several]
    both = np.zeros((len(sets), len(sets)), np.float32)
    if len(group):
        group = np.cumsum(np.concatenate([[True], group[1:] != group[:-1]])) - 1
        for lo in range(0, int(group[-1]) + 1, 4096):
            a, b = np.searchsorted(group, [lo, lo + 4096])
            m = np.zeros((len(sets), int(group[b - 1]) - lo + 1), np.float32)
            m[who[a:b], group[a:b] - lo] = 1
            both += m @ m.T
    both = both.astype(np.int64)
    return 100 * both >= percent * (size[:, None] + size[None, :] - both)


def _open_pairs(percent: int):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        nodes = rows["node"].to_numpy()
        parent = {c: c for c in set(rows["component"].to_pylist())}

        def root(c):
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        comp = rows["component"].to_numpy()
        link = linked_pairs([np.frombuffer(x, np.uint64) for x in rows["members"].to_pylist()], percent)
        link &= comp[:, None] != comp[None, :]
        found = []
        for a, b in zip(*np.nonzero(np.triu(link, 1)), strict=True):
            ra, rb = root(int(comp[a])), root(int(comp[b]))
            if ra != rb:
                parent[ra] = rb
                found.append((int(nodes[a]), int(nodes[b])))
        return pa.table({"u": pa.array([a for a, _ in found], pa.int64()), "v": pa.array([b for _, b in found], pa.int64())})

    return run


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, bits: int = 64) -> DataFrame:
    """Columns id_col, n_shingles, component_id, kept: a row for each row of docs.

    Two documents are linked if 100 * common shingles >= percent * shingles of either. bits: of the key by which classes
    are grouped before they are split; it changes no row.
    """
    modest_batches(docs.sparkSession)
    bands = bands_for(percent)
    t = percent / 100
    doubt = t - 5 * math.sqrt(t * (1 - t) / (bands * ROWS)) - 0.01
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    secret = textnp.secret()
    rows = kept(texts.mapInArrow(_signatures(shingle, bands, secret, bits), "id long, n long, node long, other long, bands array<long>, sig binary"))
    mixed: list[int] = []

    def told_apart(sets: DataFrame) -> DataFrame:
        return sets.withColumn("node", F.when(F.col("node").isin(mixed), F.xxhash64("node", "other")).otherwise(F.col("node"))) if mixed else sets

    linkable = rows.where("node is not null and id is not null")
    classes = kept(linkable.groupBy("node").agg(F.min("id").alias("first_id"), (F.min("other") < F.max("other")).alias("mixed")))
    mixed += [r["node"] for r in classes.where("mixed").collect()]  # of 10 billion sets some three
    if mixed:
        rows = told_apart(rows)
        linkable = rows.where("node is not null and id is not null")
        classes = kept(linkable.groupBy("node").agg(F.min("id").alias("first_id")))
    classes = classes.select("node", "first_id")
    reps = kept(linkable.select("node", "bands", "sig").dropDuplicates(["node"]))

    member = reps.select("node", F.explode("bands").alias("bucket"))
    crowd = member.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    member = kept(member.join(crowd, "bucket"))
    company = member.groupBy("node").agg(F.sum("size").alias("company"))
    hubs = member.join(company, "node").groupBy("bucket").agg(F.max(F.struct("company", (-F.col("node")).alias("node"))).alias("h")).select("bucket", (-F.col("h.node")).alias("hub"))
    stars = member.join(hubs, "bucket").where("hub <> node").select("hub", "node").distinct()
    sigs = reps.select("node", "sig")
    stars = stars.join(sigs, "node").join(sigs.select(F.col("node").alias("hub"), F.col("sig").alias("hub_sig")), "hub")
    stars = kept(stars.mapInArrow(_alike(doubt), "hub long, node long, share double, close boolean"))

    # The full sets of all that may be linked; texts are hashed against the smaller side, not sorted.
    near = kept(stars.select("node").union(stars.select("hub")).distinct().join(classes, "node"))
    texts = texts.join(near.select("first_id").distinct().hint("shuffle_hash"), F.col("id") == F.col("first_id"), "left_semi")
    full = kept(told_apart(texts.select("text").mapInArrow(_sets(shingle, secret, bits), "node long, other long, members binary")).drop("other").join(near.select("node"), "node", "left_semi").dropDuplicates(["node"]))

    best = stars.where("close").groupBy("node").agg(F.max(F.struct("share", "hub")).alias("b")).select("node", F.col("b.hub").alias("hub"))
    links = kept(_confirmed(best, full, percent))
    found = near_labels(links)
    # The other hubs of a node matter only where they may join components.
    rest = _labelled(_labelled(stars.where("close").select("hub", "node").join(best, ["hub", "node"], "left_anti"), found, "node", "a"), found, "hub", "b").where("a <> b").select("node", "hub")
    links = kept(links.union(_confirmed(rest, full, percent)))
    found = near_labels(links)

    # What is open: members of one hub that may lie in different components.
    star = _labelled(stars.select("hub", "node").union(stars.select("hub", F.col("hub")).distinct()), found, "node", "component")
    open_hubs = star.groupBy("hub").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo < hi and size > 2").select("hub", F.ceil(F.col("size") / BLOCK).alias("sides"))
    placed = star.join(open_hubs, "hub").withColumn("side", F.pmod(F.xxhash64("node"), F.col("sides")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("sides") - 1))
    placed = placed.withColumn("other", other).select("hub", "node", "component", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"))
    more = placed.join(full, "node").groupBy("hub", "i", "j").applyInArrow(_open_pairs(percent), "u long, v long")
    found = components(links.select("u", "v").union(more))

    labels = _labelled(classes, found, "node", "component")
    first = labels.groupBy("component").agg(F.min("first_id").alias("component_id"))
    labels = labels.join(first, "component").select("node", "component_id")
    out = rows.select("id", "n", F.when(F.col("id").isNotNull(), F.col("node")).alias("node")).join(labels, "node", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id")).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def _labelled(pairs: DataFrame, found: DataFrame, key: str, name: str) -> DataFrame:
    """With the component of column key; a node without links is its own."""
    return pairs.join(found.select(F.col("node").alias(key), F.col("component").alias(name)), key, "left").withColumn(name, F.coalesce(name, key))


def _confirmed(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Links u, v among pairs (node, hub), by the full sets; a hub with many nodes is dealt to several tasks with its set."""
    groups = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    dealt = pairs.join(groups, "hub").select("hub", "node", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part"))
    own = groups.select("hub", F.col("hub").alias("node"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    return dealt.union(own).join(full, "node").groupBy("hub", "part").applyInArrow(_against_hub(percent), "hub long, node long, linked boolean").where("linked").select(F.col("hub").alias("u"), F.col("node").alias("v"))


def op8(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_dedup(docs, shingle=3, percent=85)


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') END AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' ')) END) AS s FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT u, v FROM pairs JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 85 * (x.n + y.n - c)),
sides AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT reach.doc_id, sides.v FROM reach JOIN sides ON sides.u = reach.other)
SELECT doc_id, coalesce(n, 0) AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id, n
"""
