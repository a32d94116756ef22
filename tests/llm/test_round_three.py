"""Conversation repair, whitening and the URL filter against plain versions and odd rows."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderweave.llm import conversations as C
from orderweave.llm import url_filter as U
from orderweave.llm import whitening as Wh

PATTERN = re.compile(r"(s?(ua)+)?\Z")


def repaired_by_hand(turns: list[tuple[str, str]]):
    """Faults, cost, audit and repaired turns by trying every list of edits."""
    seen, faults = set(), []
    for role, text in turns:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))

    def tries(i: int, roles: str, room: int):
        if room >= 0 and len(roles) <= 2 * len(turns) + 2:
            if i == len(turns):
                if PATTERN.match(roles):
                    yield 0, "", []
            else:
                (role, text), fault = turns[i], faults[i]
                more = 3 * (fault == "truncated")
                options = [("D", 4, None)]
                if fault not in ("blank", "duplicate"):
                    options += [("R", 3 + more, ("user", text)), ("R", 3 + more, ("assistant", text))]
                    if role[:1] in ("s", "u", "a"):
                        options.append(("K", more, (role, text)))
                for edit, cost, new in options:
                    for c, a, rest in tries(i + 1, roles + (new[0][0] if new else ""), room - cost):
                        yield c + cost, edit + a, ([new] if new else []) + rest
            for new in ("user", "assistant"):
                if re.match(r"s?(ua)*u?\Z", roles + new[0]):
                    for c, a, rest in tries(i, roles + new[0], room - 3):
                        yield c + 3, "I" + a, [(new, ""), *rest]

    cost, audit, new = min(tries(0, "", 4 * len(turns)), key=lambda t: (t[0], t[1]))
    return faults, cost, audit, new


def row_of(turns: list[tuple]) -> tuple:
    """The row of one conversation; turns: number, role, text, in order."""
    faults, cost, audit, new = repaired_by_hand([t[1:] for t in turns])
    numbers = {t[0] for t in turns} - {None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    initials = [t[1][:1] for t in turns]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in new).encode()).hexdigest()
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, sha


def test_edits_are_the_cheapest_with_the_least_audit():
    dice = random.Random(4)
    for n in [0, 1, 2, 3, 4, 5] * 12:
        turns = [(dice.choice(["user", "assistant", "system", "tool", ""]), dice.choice(["a.", "b", " ", "c!", "d?\n"])) for _ in range(n)]
        faults, cost, audit, _ = repaired_by_hand(turns)
        codes = bytes("_sua".index(r[0]) if r[:1] in ("s", "u", "a") else 0 for r, _ in turns)
        codes = bytes(c | (C._GOES if f in ("blank", "duplicate") else C._CUT if f else 0) for c, f in zip(codes, faults, strict=True))
        assert C.best_edits(codes) == (cost, audit)


def test_pieces_give_what_the_whole_gives():
    dice = random.Random(5)
    for n in (1, 5, 40, 90):
        codes = bytes(dice.choice([0, 1, 2, 3, 2, 3, 6, 7, 10, 11]) for _ in range(n))
        whole = C.best_edits(codes, 1000)
        assert all(C.best_edits(codes, piece) == whole for piece in (1, 2, 7, 33))


def test_conversations_against_every_list_of_edits(spark):
    dice, rows = random.Random(6), []
    for conv in range(120):
        for turn in range(dice.choice([1, 2, 3, 4])):
            rows.append((conv, turn + dice.choice([0, 0, 2]), dice.choice(["user", "assistant", "system", None]), dice.choice(["one.", "two", "three!\n", "", None, "four?  "])))
    rows += [(None, 1, "user", "x."), (None, None, "assistant", "y."), (500, 3, "tool", "z."), (500, 3, "tool", "z."), (501, 0, "", "z.")]
    by_conv: dict = defaultdict(list)
    for conv, turn, role, text in rows:
        by_conv[conv].append((turn, " " if role is None else role, " " if text is None else text))
    digest = lambda r, t: hashlib.sha256(f"{len(r)}:{r}{t}".encode()).digest()[:16]
    order = lambda t: (t[0] is not None, t[0] or 0, t[1], digest(*t[1:]))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"digest": F.lit(1), "conv": F.lit("x")})
    found = {r[0]: tuple(r[1:]) for r in C.reports(df).collect()}
    assert found == {conv: row_of(sorted(turns, key=order)) for conv, turns in by_conv.items()}
    turns = defaultdict(list)
    for r in C.repaired(df).orderBy("place").collect():
        turns[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    assert all(hashlib.sha256("\n".join(turns[conv]).encode()).hexdigest() == v[-1] for conv, v in found.items())


def test_op11_on_the_tables(spark):
    folder = "/root/testdata/sf0.001"
    by_conv: dict = defaultdict(list)
    for r in spark.read.parquet(f"{folder}/conversations.parquet").orderBy("conv_id", "turn").collect():
        kind, text = zlib.crc32(f"{r['conv_id']}:{r['turn']}".encode()) % 20, r["text"]
        own = by_conv[r["conv_id"]]
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(r["turn"], "user" if kind == 4 else r["role"], text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    found = {r[0]: tuple(r[1:]) for r in C.op11(spark, folder).collect()}
    short = {conv for conv, turns in by_conv.items() if len(turns) < 7}
    assert found.keys() == by_conv.keys() and short
    assert all(found[conv] == row_of(by_conv[conv]) for conv in short)


def test_nothing_left_and_no_rows(spark):
    rows = spark.createDataFrame([(c, t, "user", "x.") for c in range(200) for t in (1,)], "conv_id long, turn long, role string, text string")
    dropped = {c for c in range(200) if zlib.crc32(f"{c}:1".encode()) % 20 == 0}
    found = {r["conv_id"]: tuple(r)[1:] for r in C.reports(C.damaged(rows), there=F.col("there")).collect()}
    assert dropped and len(found) == 200
    assert all(found[c] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in dropped)
    assert C.reports(rows.limit(0)).count() == 0 and C.repaired(rows.limit(0)).count() == 0


def test_a_long_conversation_and_a_long_text(spark):
    long = "word " * 200_000 + "."
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"turn {t}.") for t in range(3000)] + [(2, 0, "user", long), (2, 1, "assistant", "yes.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r["conv_id"]: r for r in C.reports(df).collect()}
    assert (found[1]["cost"], found[1]["audit"]) == (0, "K" * 3000)
    assert found[2]["repaired_sha256"] == hashlib.sha256(f"user:{long}\nassistant:yes.".encode()).hexdigest()


# Whitening


def plain_whitening(vectors: dict[int, list[float]]):
    ids = sorted(vectors)
    x = [[math.floor(64 * float(np.float64(c))) + 1_000_000 for c in vectors[i]] for i in ids]
    n, d = len(x), len(x[0])
    sums = [sum(r[k] for r in x) for k in range(d)]
    y = np.array([[float(Fraction(n * r[k] - sums[k], n)) for k in range(d)] for r in x])
    return ids, n, [sum((n * r[k] - sums[k]) ** 2 for k in range(d)) for r in x], y, y.T @ y / n


def test_whitening_on_the_tables(spark):
    folder = "/root/testdata/sf0.001"
    vectors = {r[0]: r[1] for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()}
    ids, n, deviations, y, v = plain_whitening(vectors)
    rows = Wh.op12(spark, folder).toPandas()
    assert len(rows) == 32 * n and set(rows["n"]) == {n}
    assert rows.groupby("vec_id")["deviation"].first().to_dict() == dict(zip(ids, deviations, strict=True))
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    z = rows.pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    own = y @ axes[:, :32] / np.sqrt(values[:32])
    assert np.abs(np.abs(z) - np.abs(own)).max() < 1e-8
    assert np.abs(z.T @ z / n - np.eye(32)).max() < 1e-9
    shares = rows.groupby("component")["explained"].first().to_numpy()
    assert np.allclose(shares, values[:32] / values.sum(), rtol=1e-9)
    assert rows["identity_error"].nunique() == 1 and rows["identity_error"].iloc[0] < 1e-9


def test_odd_vectors(spark):
    rows = [(1, [1.0, 2.0]), (2, [2.0, 1.0]), (3, [0.5, 0.25]), (3, [0.5, 0.25]), (None, [3.0, 0.0]), (4, None), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [1.0]), (9, []), (10, [5.0, 5.0, 5.0]), (11, [5.0, 5.0, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"x": F.lit(1), "component": F.lit("c")})
    found = Wh.whiten(df).collect()
    assert sorted((r["vec_id"] or 0, r["component"]) for r in found) == sorted((i, c) for i in (0, 1, 2, 3, 3) for c in (1, 2))
    _, n, deviations, _, v = plain_whitening({0: [3.0, 0.0], 1: [1.0, 2.0], 2: [2.0, 1.0], 3: [0.5, 0.25], 4: [0.5, 0.25]})
    assert {(r["vec_id"] or 0, r["deviation"]) for r in found} == set(zip((0, 1, 2, 3, 3), deviations, strict=True)) and {r["n"] for r in found} == {n}
    assert Wh.whiten(df.limit(0)).count() == 0


def test_large_entries_and_flat_dimensions(spark):
    rows = [(i, [float(i), 7.0, 1e300 if i == 3 else 0.0]) for i in range(6)]
    found = Wh.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r["component"] for r in found} == {1} and all(r["identity_error"] < 1e-4 for r in found)
    assert max(r["deviation"] for r in found) == 2**63 - 1


# URLs


def plain_parts(url: str | None):
    if url is None or "://" not in url:
        return "", "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    return lower, re.match(r"[^?#]*", rest[len(host) :])[0], lower + rest[len(host) :]


def plain_rule(host: str, path: str):
    own = [(len(t), t, v) for v, t in U.RULES for name, rest in [t.split("/", 1)] if (host == name or host.endswith("." + name)) and path.startswith("/" + rest)]
    return max(own)[1:] if own else (None, None)


class Model:
    """A variable-order model, asked one character at a time."""

    def __init__(self, texts: list[str], order: int):
        self.order, self.after = order, defaultdict(lambda: defaultdict(int))
        for t in texts:
            t = "\x02" * order + t + "\x03"
            for i in range(order, len(t)):
                for j in range(order + 1):
                    self.after[t[i - j : i]][t[i]] += 1

    def p(self, context: str, c: str) -> float:
        low = self.p(context[1:], c) if context else 1 / 0x110000
        seen = self.after.get(context)
        return low if not seen else (seen.get(c, 0) + len(seen) * low) / (sum(seen.values()) + len(seen))


def plain_filter(urls: list[str | None], order: int = U.ORDER):
    rows = [(*plain_parts(u), *plain_rule(*plain_parts(u)[:2])) for u in urls]
    texts = {text: says for _, _, text, _, says in rows}
    held = {t for t in texts if hashlib.md5(t.encode()).hexdigest()[0] in "012"}
    models = [Model([t for t, says in texts.items() if says == side and t not in held], order) for side in ("allow", "block")]

    def score(t: str) -> float:
        padded, total = "\x02" * order + t + "\x03", 0
        for i in range(order, len(padded)):
            a, b = (m.p(padded[i - order : i], padded[i]) for m in models)
            total += math.floor((math.log(a) - math.log(b)) * 1e6 + 0.5)
        return total / (len(t) + 1) / 1e6

    step = {t: max(-2048, min(2047, math.floor(score(t) * 64))) for t in texts if texts[t] is None or t in held}
    known = [(step[t], texts[t]) for t in held if texts[t]]
    n = [sum(says == side for _, says in known) for side in ("allow", "block")]
    mark = 0
    if all(n):
        right = lambda m: sum(s >= m for s, says in known if says == "allow") * n[1] + sum(s < m for s, says in known if says == "block") * n[0]
        mark = min({0, *(s for s, _ in known)}, key=lambda m: (-right(m), abs(m), m))
    return [(host, path, rule, says or ("allow" if step[text] >= mark else "block")) for host, path, text, rule, says in rows]


def test_urls_of_the_tables(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url").collect()
    found = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in U.op13(spark, "/root/testdata/sf0.01").collect()}
    assert found == dict(zip([p["page_id"] for p in pages], plain_filter([p["url"] for p in pages]), strict=True))
    assert {v for *_, rule, v in found.values() if rule is None} == {"allow", "block"}


ODD = [
    None, "", "no scheme.net/", "http://", "http://net/", "http://NET/x", "http://x.net", "http://x.net?/", "http://xnet/", "http://a.b.net/en/", "https://EXAMPLE.net/en/q", "http://example.net/EN/",
    "http://example.net:80/en/", "ftp://www.example.com/de/1#a", "http://example.com/de", "http://example.com/fr/?u=http://a.net/", "http://org/fr/é/日本語", "http://w.org/fr/\U0001f600", "http://w.org/es/\U0001f600",
    "http://x.example.net/en/a\nb?c", "http://x.example.org/y\nz", "://x.net/y", "http://y.com/" + "q" * 20_000,
]


def test_odd_urls(spark):
    rows = [(k, u) for k, u in enumerate(ODD)] + [(7, ODD[7]), (None, ODD[17])]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumns({"text": F.lit("t"), "rule": F.lit(1), "gram": F.lit("g")})
    key = lambda r: tuple((v is None, v) for v in r)
    found = sorted((tuple(r) for r in U.filter_urls(df).drop("score").collect()), key=key)
    assert found == sorted(((k, *r) for (k, _), r in zip(rows, plain_filter([u for _, u in rows]), strict=True)), key=key)


@pytest.mark.parametrize("urls", [[], ["http://a.com/x"] * 5])
def test_urls_without_rules(spark, urls):
    df = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string")
    assert [tuple(r)[1:5] for r in U.filter_urls(df).collect()] == [("a.com", "/x", None, "allow")] * len(urls)
