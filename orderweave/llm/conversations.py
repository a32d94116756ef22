"""Conversation structure repair: the cheapest edits that give a conversation well-formed turns.

Well-formed are an optional system turn, then pairs of a user's and an assistant's turn, or nothing at all, by the initials of
the roles: (s?(ua)+)?. Edits are Keep 0, Rerole to user or assistant 3, Delete 4, Insert an empty turn of user or assistant 3;
blank and repeated turns must go, and a truncated turn that stays costs 3 more. Of the cheapest lists of edits that with the
least initials in ASCII is taken (`audit`).

The search is A* on the edit lattice, whose nodes are (turns consumed, phase of the pattern). Its heuristic is the suffix
sum of what can't be avoided: 4 for each turn that must go, 3 for each truncated one. No edit lowers it by more than it
costs, so it is consistent. Nodes are taken in the order of (cost plus heuristic, audit): a node's first visit is its
cheapest one with the least audit, and of equal costs no audit between the same two nodes begins another, so taking the least
at every node gives the least over all.

Two passes, as a conversation may hold any share of all rows. The first sends a few bytes of each turn (its place, faults,
initial, and a digest of role and text) and finds the edits; the second puts them before the conversation's turns and walks
through both in order, so that no task ever holds a conversation's texts. Conversations of more than `PIECE` turns are cut:
each piece is searched from each phase to each phase, and the pieces' best edits are joined in order.

Faults, of which a turn's first one counts: blank (no `[^\\x20\\x09-\\x0D]`), duplicate (an earlier turn has its role and text, by
128 bits of SHA-256), truncated (the last such character isn't one of `.!?`).

Cases: null roles and texts count as one space; turns are in order by turn number (nulls first), then role, then that
digest, so repeated rows are neighbours and all but the first are duplicates; a role whose initial isn't s, u or a, or that is
empty, fits nowhere and can't be kept; rows with a null conversation id are one conversation; very long texts are read
once, in one row; a conversation of which nothing is there gives zeros, an empty audit and nothing repaired; an empty
table gives none; other columns of the input aren't read, so their names can't clash.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Turns that are searched together.
PIECE = 256
#: Phases: nothing yet, after the system's turn, after a user's turn, after a pair. What an inserted or changed turn leads to, and its role.
_NEXT = (2, 2, 3, 2)
_ROLE = ("user", "user", "assistant", "user")
#: By phase and initial (other, s, u, a): the phase after a turn that is kept, or -1.
_KEPT = ((-1, 1, 2, -1), (-1, -1, 2, -1), (-1, -1, -1, 3), (-1, -1, 2, -1))
_ENDS = (0, 3)
#: A turn's code: its initial, plus 4 if it must go, plus 8 if it is truncated.
_GOES, _CUT = 4, 8
_LONG = (1 << 63) - 1

REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def paths(codes: bytes, begin: int, ends: tuple[int, ...], all_ends: bool) -> dict[int, tuple[int, str]]:
    """Cost and audit of the best edits from phase begin: to each of the phases `ends`, or only to the best of them."""
    n = len(codes)
    left = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        left[i] = left[i + 1] + (DELETE if codes[i] & _GOES else TRUNCATED if codes[i] & _CUT else 0)
    open_, done, found = [(left[0], "", 0, begin)], set(), {}
    while open_:
        f, audit, i, phase = heapq.heappop(open_)
        if (i, phase) in done:
            continue
        done.add((i, phase))
        cost = f - left[i]
        if i == n:
            if phase in ends:
                found[phase] = (cost, audit)
                if not all_ends or len(found) == len(ends):
                    break
        else:
            code, ahead = codes[i], left[i + 1]
            heapq.heappush(open_, (cost + DELETE + ahead, audit + "D", i + 1, phase))
            if not code & _GOES:
                more = cost + ahead + (TRUNCATED if code & _CUT else 0)
                heapq.heappush(open_, (more + REROLE, audit + "R", i + 1, _NEXT[phase]))
                if _KEPT[phase][code & 3] >= 0:
                    heapq.heappush(open_, (more + KEEP, audit + "K", i + 1, _KEPT[phase][code & 3]))
        heapq.heappush(open_, (cost + INSERT + left[i], audit + "I", i, _NEXT[phase]))
    return found


def best_edits(codes: bytes, piece: int = PIECE) -> tuple[int, str]:
    """Cost and audit of a conversation."""
    if len(codes) <= piece:
        return min(paths(codes, 0, _ENDS, False).values())
    so_far: dict[int, tuple[int, str]] = {0: (0, "")}
    for lo in range(0, len(codes), piece):
        part, new = codes[lo : lo + piece], {}
        for begin, (cost, audit) in so_far.items():
            for end, (more, edits) in paths(part, begin, (0, 1, 2, 3), True).items():
                if end not in new or cost + more <= new[end][0]:
                    new[end] = min(new.get(end, (_LONG, "")), (cost + more, audit + edits))
        so_far = new
    return min(so_far[p] for p in _ENDS if p in so_far)


def report(turns: np.ndarray, known: np.ndarray, codes: np.ndarray, digests: np.ndarray) -> tuple:
    """A conversation's REPORT. known: which turn numbers aren't null; codes: initials, plus _GOES for a blank turn."""
    blank = codes & _GOES > 0
    first = np.zeros(len(codes), bool)
    first[np.unique(digests, return_index=True)[1]] = True
    again = ~first & ~blank
    codes = np.where(again, codes & 3 | _GOES, codes)
    turns = turns[known]
    gaps = int(turns.max()) - int(turns.min()) + 1 - len(np.unique(turns)) if len(turns) else 0
    initial = codes & 3
    legal = np.zeros(16, bool)
    legal[[1 * 4 + 2, 2 * 4 + 3, 3 * 4 + 2]] = True
    illegal = int((~legal[initial[:-1] * 4 + initial[1:]]).sum())
    cost, audit = best_edits(codes.astype(np.uint8).tobytes())
    return min(gaps, _LONG), int(blank.sum()), int(again.sum()), int((codes & _CUT > 0).sum()), illegal, cost, audit


def _ordered(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, there: Column | None) -> DataFrame:
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (role_col, text_col))
    rows = conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"), (F.lit(True) if there is None else there).alias("there"))
    digest = F.unhex(F.left(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256), F.lit(32)))
    return rows.withColumn("digest", digest)


def _reports(rows: DataFrame) -> DataFrame:
    """conv and REPORT, a row for each conversation."""
    initial = F.coalesce(F.element_at(F.create_map(*(F.lit(v) for p in (("s", 1), ("u", 2), ("a", 3)) for v in p)), F.substring("role", 1, 1)), F.lit(0))
    fault = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), _GOES).when(F.col("text").rlike(r"[^\x20\x09-\x0D.!?][\x20\x09-\x0D]*\z"), _CUT).otherwise(0)
    light = rows.select("conv", "turn", "role", "digest", (initial + fault).cast("byte").alias("code"), "there")
    light = light.repartition("conv").sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "digest").drop("role")
    types = T.StructType([T.StructField("conv", rows.schema["conv"].dataType), *T.StructType.fromDDL(REPORT).fields])
    arrow = to_arrow_schema(types)

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, out = None, [], []

        def closed() -> None:
            if parts:
                turns, known, codes, digests, there = (np.concatenate([p[k] for p in parts]) for k in range(5))
                out.append((now, *(report(turns[there], known[there], codes[there], digests[there]) if there.any() else (0, 0, 0, 0, 0, 0, ""))))

        for batch in batches:
            turn = batch["turn"]
            arrays = (turn.fill_null(0).to_numpy(zero_copy_only=False), turn.is_valid().to_numpy(zero_copy_only=False), batch["code"].to_numpy(zero_copy_only=False), np.array(batch["digest"].to_pylist(), "S16"), batch["there"].to_numpy(zero_copy_only=False))
            conv = batch["conv"].to_pylist()
            cuts = [i for i in range(1, len(conv)) if conv[i] != conv[i - 1]]
            for lo, hi in zip([0, *cuts], [*cuts, len(conv)], strict=True):
                if lo == hi:
                    continue
                if parts and conv[lo] != now:
                    closed()
                    parts = []
                now = conv[lo]
                parts.append(tuple(a[lo:hi] for a in arrays))
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in out], f.type) for k, f in enumerate(arrow)], schema=arrow)
            out = []
        closed()
        yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in out], f.type) for k, f in enumerate(arrow)], schema=arrow)

    return light.mapInArrow(walked, types)


class Repair:
    """Applies an audit to a conversation's turns, one after another; gives role, text and edit of what the repaired one has."""

    def __init__(self, audit: str):
        self.audit, self.at, self.phase = audit, 0, 0

    def _new(self, text: str, edit: str) -> tuple[str, str, str]:
        role, self.phase = _ROLE[self.phase], _NEXT[self.phase]
        return role, text, edit

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._new("", "I")

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == "K":
            self.phase = _KEPT[self.phase]["_sua".index(role[0])]
            yield role, text, "K"
        elif edit == "R":
            yield self._new(text, "R")


def _walked(rows: DataFrame, types: T.StructType, begin, each, end) -> DataFrame:
    """Second pass: begin(conv, report) gives a conversation's state, each(state, role, text, edit) and end(state) rows of `types`."""
    fields = [f.name for f in T.StructType.fromDDL(REPORT)]
    found = _reports(rows).select("conv", F.lit(0).alias("kind"), F.struct(*fields).alias("report"), *(F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("digest", "binary"), ("text", "string"))))
    turns = rows.where("there").select("conv", F.lit(1).alias("kind"), F.lit(None).cast(found.schema["report"].dataType).alias("report"), "turn", "role", "digest", "text")
    both = found.union(turns).repartition("conv").sortWithinPartitions("conv", "kind", F.col("turn").asc_nulls_first(), "role", "digest").drop("turn", "digest")
    arrow = to_arrow_schema(types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repair, state, out = None, None, []

        def closed() -> None:
            if repair is not None:
                for e in repair.inserted():
                    out.extend(each(state, *e))
                out.extend(end(state))

        for batch in batches:
            for conv, kind, told, role, text in zip(*(batch[c].to_pylist() for c in ("conv", "kind", "report", "role", "text")), strict=True):
                if kind == 0:
                    closed()
                    repair, state = Repair(told["audit"]), begin(conv, told)
                else:
                    for e in repair.turn(role, text):
                        out.extend(each(state, *e))
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in out], f.type) for k, f in enumerate(arrow)], schema=arrow)
            out = []
        closed()
        yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in out], f.type) for k, f in enumerate(arrow)], schema=arrow)

    return both.mapInArrow(run, types)


def repaired(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The repaired conversations: conv_col, place (from 1), role, text, edit (K, R or I)."""
    rows = _ordered(conversations, conv_col, turn_col, role_col, text_col, None)
    types = T.StructType([T.StructField(conv_col, rows.schema["conv"].dataType), T.StructField("place", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("role", "text", "edit"))])

    def each(state: list, role: str, text: str, edit: str) -> list[tuple]:
        state[1] += 1
        return [(*state, role, text, edit)]

    return _walked(rows, types, lambda conv, _: [conv, 0], each, lambda _: [])


def reports(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", there: Column | None = None) -> DataFrame:
    """conv_col, REPORT and repaired_sha256 (of the repaired turns as role:text, joined by newlines), a row for each conversation.

    there: which rows are turns; the others only name their conversation.
    """
    rows = _ordered(conversations, conv_col, turn_col, role_col, text_col, there)
    types = T.StructType([T.StructField(conv_col, rows.schema["conv"].dataType), *T.StructType.fromDDL(REPORT).fields, T.StructField("repaired_sha256", T.StringType())])

    def each(state: list, role: str, text: str, edit: str) -> list[tuple]:
        state[1].update(f"{state[2]}{role}:{text}".encode())
        state[2] = "\n"
        return []

    return _walked(rows, types, lambda conv, told: [(conv, *told.values()), hashlib.sha256(), ""], each, lambda s: [(*s[0], s[1].hexdigest())])


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, there: by a checksum of `conv_id:turn`, of 20 turns one is dropped (not there), one emptied, one loses
    its `.!?`, one is repeated and one becomes the user's."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    role = F.when(kind == 4, "user").otherwise(space("role"))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind"))
    copies = F.explode(F.array_repeat(F.col("kind") > 0, F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", "role", "text", copies.alias("there"))


def op11(spark, sf_dir: str) -> DataFrame:
    return reports(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")), there=F.col("there"))
