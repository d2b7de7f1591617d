"""Repair of conversations by depth-first branch and bound.

A repaired conversation has the role initials (s?(ua)+)?: an optional system turn, then user and assistant in turns. Edits
are Keep, Rerole, Delete and Insert; a conversation's plan is the cheapest string of their initials, of equal ones the
least. The search keeps an explicit stack, bounds what the rest of a conversation costs from below, holds the best (cost,
audit) found so far, and remembers for each node the best prefix that reached it, so that worse ones go. It ends with an
empty stack: nothing left can be better.

Rows are dealt by ranges of (conversation, turn), so a conversation of any size spreads over tasks: each fragment of at
most ``FRAGMENT`` rows is searched from every grammar state to every other one, and fragments are chained afterwards.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import BLANK_RUN, two_hashes, written

#: Fixed costs of edits: another role, a row that goes, a row put in, a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Rows searched together.
FRAGMENT = 1024
#: Grammar states: at the start, after a system turn, after a user, after an assistant. The role each expects next, where
#: that leads, and what ends a conversation there.
STATES = range(4)
EXPECTED, AFTER = ("user", "user", "assistant", "user"), (2, 2, 3, 2)
ENDING = ("", "II", "I", "")
_NEVER = 1 << 40


def _kept(state: int, initial: str) -> int | None:
    """The state after a row with this role initial is kept, or None if it can't be."""
    if initial == "s" and state == 0:
        return 1
    return AFTER[state] if initial and EXPECTED[state][0] == initial else None


def _bounds(rows: list[tuple[str, bool, bool]], ends: list[int]) -> list[list[int]]:
    """For each row and state, what the rows from there on cost at least; ``ends`` is the cost of ending in each state."""
    out = [ends]
    for initial, forced, truncated in reversed(rows):
        after, here = out[-1], []
        for s in STATES:
            least = DELETE + after[s]
            if not forced:
                k = _kept(s, initial)
                least = min(least, truncated + REROLE + after[AFTER[s]], _NEVER if k is None else truncated + after[k])
            here.append(least)
        # any number of inserts comes before a row, but more than two lead back to a state that was there
        once = [min(here[s], INSERT + here[AFTER[s]]) for s in STATES]
        out.append([min(once[s], INSERT + once[AFTER[s]]) for s in STATES])
    return out[::-1]


def cheapest(rows: list[tuple[str, bool, bool]], state: int, ends: list[tuple[int, str]]) -> tuple[int, str] | None:
    """The least (cost, audit) for rows (initial, must go, truncated) from a grammar state, or None if there is no way.

    ``ends`` has for each state the cost and the edits of ending there.
    """
    bounds = _bounds(rows, [cost for cost, _ in ends])
    best: tuple[int, str] = (_NEVER, "")
    reached: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, state, 0, "")]
    while stack:
        i, s, cost, audit = stack.pop()
        bound = cost + bounds[i][s]
        if bound >= _NEVER or bound > best[0] or bound == best[0] and audit > best[1][: len(audit)]:
            continue
        if (i, s) in reached and reached[i, s] <= (cost, audit):
            continue  # another prefix does no worse from here
        reached[i, s] = (cost, audit)
        if i == len(rows):
            best = min(best, (cost + ends[s][0], audit + ends[s][1]))
            continue
        initial, forced, truncated = rows[i]
        children = [(DELETE, "D", i + 1, s), (INSERT, "I", i, AFTER[s])]
        if not forced:
            children.append((truncated + REROLE, "R", i + 1, AFTER[s]))
            if (k := _kept(s, initial)) is not None:
                children.append((truncated, "K", i + 1, k))
        children.sort(key=lambda c: (c[0] + bounds[c[2]][c[3]], c[1]), reverse=True)  # the most promising is popped first
        stack += [(j, t, cost + more, audit + letter) for more, letter, j, t in children]
    return best if best[0] < _NEVER else None


_FINISH = [(INSERT * len(e), e) for e in ENDING]


class _Fragment:
    """Counts and rows of a stretch of one conversation."""

    def __init__(self, conv, at: tuple) -> None:
        self.conv, self.at, self.rows = conv, at, []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.low = self.high = None

    def add(self, turn: int | None, initial: str, blank: bool, duplicate: bool, truncated: bool) -> None:
        self.blank += blank
        self.duplicate += duplicate and not blank
        self.truncated += truncated and not blank and not duplicate
        if self.rows:
            self.illegal += self.last + initial not in ("su", "ua", "au")
        else:
            self.first = initial
        self.last = initial
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.high
            self.high = turn
        self.rows.append((initial, blank or duplicate, truncated))

    def row(self, whole: bool) -> dict:
        """The fragment's counts with its plan, or with the plans from each state to each, if more may belong to it."""
        keys = ("conv", "blank", "duplicate", "truncated", "illegal", "turns", "first", "last", "low", "high")
        plans = [cheapest(self.rows, 0, _FINISH)] if whole else [cheapest(self.rows, s, [(0 if t == e else _NEVER, "") for t in STATES]) for s in STATES for e in STATES]
        return {k: getattr(self, k) for k in keys} | {"turn": self.at[0], "h1": self.at[1], "h2": self.at[2], "copy": self.at[3], "plans": [p and {"cost": p[0], "audit": p[1]} for p in plans]}


_PLANS = "plans array<struct<cost: bigint, audit: string>>"
_COUNTS = "blank bigint, duplicate bigint, truncated bigint, illegal bigint, turns bigint, first string, last string, low bigint, high bigint"
_RESULT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def _arrow(conv: pa.DataType, names: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [(n, conv if n == "conv" else kinds[k]) for n, k in (f.split() for f in names.split(", "))]
    return pa.schema(fields)


_PLAN_TYPE = pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string())]))


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows -> fragments; those that may go on before or after this task's rows, or are one of several, are open."""
    now, open_, out, schema = None, True, [], None
    for batch in batches:
        schema = schema or _arrow(batch.schema.field("conv").type, "conv bigint, turn bigint, h1 bigint, h2 bigint, copy bigint, " + _COUNTS).append(pa.field("plans", _PLAN_TYPE))
        for conv, turn, h1, h2, n, initial, blank, duplicate, truncated in zip(*(batch.column(k).to_pylist() for k in ("conv", "turn", "h1", "h2", "n", "initial", "blank", "duplicate", "truncated"))):
            for copy in range(n):
                if now is None or now.conv != conv or len(now.rows) >= FRAGMENT:
                    split = now is not None and now.conv == conv
                    if now is not None:
                        out.append(now.row(not (open_ or split)))
                        open_ = split
                    now = _Fragment(conv, (turn, h1, h2, copy))
                now.add(turn, initial, blank, duplicate or copy > 0, truncated)
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
    if now is not None:
        yield pa.RecordBatch.from_pylist([*out, now.row(False)], schema=schema)


class _Chain:
    """Fragments of one conversation put together, in order."""

    def __init__(self, conv) -> None:
        self.conv, self.counts, self.turns = conv, [0, 0, 0, 0], 0
        self.last = self.low = self.high = None
        self.ways: list[tuple[int, str] | None] = [(0, ""), None, None, None]
        self.sure: list[str] = []  # edits that all ways begin with

    def add(self, counts: tuple, turns: int, first: str, last: str, low: int | None, high: int | None, plans: list) -> None:
        self.counts = [a + b for a, b in zip(self.counts, counts)]
        if self.last is not None:
            self.counts[3] += self.last + first not in ("su", "ua", "au")
        self.last = last
        if low is not None:
            self.turns += turns - (low == self.high)
            self.low, self.high = low if self.low is None else self.low, high
        ways = []
        for e in STATES:
            to = [(w[0] + p["cost"], w[1] + p["audit"]) for s, w in enumerate(self.ways) if w and (p := plans[4 * s + e])]
            ways.append(min(to, default=None))
        common = os.path.commonprefix([w[1] for w in ways if w])
        self.sure.append(common)
        self.ways = [w and (w[0], w[1][len(common) :]) for w in ways]

    def row(self) -> dict:
        cost, audit = min((w[0] + c, w[1] + e) for w, (c, e) in zip(self.ways, _FINISH) if w)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return {"conv": self.conv, "gaps": gaps, **dict(zip(("blank", "duplicate", "truncated", "illegal"), self.counts)), "cost": cost, "audit": "".join(self.sure) + audit}


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, out, schema = None, [], None
    keys = ("conv", "blank", "duplicate", "truncated", "illegal", "turns", "first", "last", "low", "high", "plans")
    for batch in batches:
        schema = schema or _arrow(batch.schema.field("conv").type, "conv bigint, " + _RESULT)
        for conv, b, d, t, i, turns, first, last, low, high, plans in zip(*(batch.column(k).to_pylist() for k in keys)):
            if now is None or now.conv != conv:
                if now is not None:
                    out.append(now.row())
                now = _Chain(conv)
            now.add((b, d, t, i), turns, first, last, low, high, plans)
        if len(out) >= 1000:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out = []
    if now is not None:
        yield pa.RecordBatch.from_pylist([*out, now.row()], schema=schema)


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A conversation's audit, then its rows in order -> the repaired rows, one after another."""
    conv, audit, at, state, place, schema = None, "", 0, 0, 0, None
    out: list[tuple] = []

    def inserted() -> None:
        nonlocal at, state, place
        while at < len(audit) and audit[at] == "I":
            out.append((conv, place, "I", EXPECTED[state], ""))
            at, state, place = at + 1, AFTER[state], place + 1

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, schema)], schema=schema)

    for batch in batches:
        schema = schema or _arrow(batch.schema.field("conv").type, "conv bigint, place bigint, edit string, role string, text string")
        for c, plan, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv", "audit", "role", "text"))):
            inserted()
            if plan is not None:
                conv, audit, at, state, place = c, plan, 0, 0, 0
                continue
            edit = audit[at]
            at += 1
            if edit != "D":
                kept = _kept(state, role[:1]) if edit == "K" else AFTER[state]
                out.append((conv, place, edit, role if edit == "K" else EXPECTED[state], text))
                state, place = kept, place + 1
            if len(out) >= 500:
                yield batch_of(out)
                out.clear()
    if schema is not None:
        inserted()
        yield batch_of(out)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired rows in order -> a digest of each conversation's ``role:text`` lines."""
    conv, digest, schema = None, None, None
    for batch in batches:
        out = []
        schema = schema or _arrow(batch.schema.field("conv").type, "conv bigint, sha string")
        for c, place, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv", "place", "role", "text"))):
            if place == 0:
                if digest is not None:
                    out.append({"conv": conv, "sha": digest.hexdigest()})
                conv, digest = c, hashlib.sha256()
            digest.update((("\n" if place else "") + f"{role}:{text}").encode())
        yield pa.RecordBatch.from_pylist(out, schema=schema)
    if digest is not None:
        yield pa.RecordBatch.from_pylist([{"conv": conv, "sha": digest.hexdigest()}], schema=schema)


class ConversationRepair:
    """Plans and repaired turns of all conversations of a table of turns.

    A conversation's rows are ordered by turn, nulls first; rows of one turn by a hash of role and text, so that equal ones
    stand together. Null roles and texts are one space. A row's first fault counts: blank, duplicate (an earlier row has its
    role and text), truncated (its last character that isn't white space is none of ``.!?``). Rows with a null conversation
    id are one conversation. Turns are integers. An empty table gives empty results; other columns are left behind, whatever
    their names. Texts are taken whole, and no task holds those of more than one Arrow batch.
    """

    def __init__(self, turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> None:
        self.conv_col, self.conv_type = conv_col, turns.schema[conv_col].dataType.simpleString()
        spaced = lambda c: F.coalesce(F.col(c), F.lit(" "))
        slim = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), spaced(role_col).alias("role"), spaced(text_col).alias("text"))
        h1, h2 = two_hashes(F.struct("role", "text"))
        self._rows = slim.withColumn("h1", h1).withColumn("h2", h2)

    @staticmethod
    def _faults() -> tuple[Column, Column]:
        """Blank, and ending in no sentence mark."""
        return ~F.col("text").rlike(r"[^\x20\x09-\x0D]"), ~F.col("text").rlike(rf"[.!?]({BLANK_RUN})?\z")

    def plans(self) -> DataFrame:
        """One row per conversation: (id, gaps, blank, duplicate, truncated, illegal, cost, audit).

        Equal rows of a turn are counted before the shuffle. A conversation within one task's range is planned there; the
        few that cross a border, or are longer than a fragment, are chained. What a chain holds is its audit, one character
        a row.
        """
        blank, cut = self._faults()
        compact = self._rows.select("conv", "turn", "h1", "h2", F.substring("role", 1, 1).alias("initial"), blank.alias("blank"), cut.alias("truncated"))
        compact = written(compact.groupBy(*compact.columns).agg(F.count("*").alias("n")), "turns")
        order = F.struct(F.col("turn").isNotNull().alias("given"), "turn")
        firsts = compact.groupBy("conv", "h1", "h2").agg(F.min(order).alias("first_place"), F.count("*").alias("k")).where("k > 1")
        firsts = firsts.select(F.col("conv").alias("c"), F.col("h1").alias("x"), F.col("h2").alias("y"), "first_place")
        same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("h1") == F.col("x")) & (F.col("h2") == F.col("y"))
        judged = compact.join(firsts, same, "left").withColumn("duplicate", F.coalesce(order > F.col("first_place"), F.lit(False))).drop("c", "x", "y", "first_place")
        by = [F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), F.asc("h1"), F.asc("h2")]
        dealt = written(judged, "judged-turns").repartitionByRange(*by).sortWithinPartitions(*by)
        fragments = written(dealt.mapInArrow(_fragments, f"conv {self.conv_type}, turn bigint, h1 bigint, h2 bigint, copy bigint, {_COUNTS}, {_PLANS}"), "fragments")
        whole = F.size("plans") == 1
        gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
        plan = F.col("plans")[0]
        done = fragments.where(whole).select("conv", gaps, "blank", "duplicate", "truncated", "illegal", plan["cost"].alias("cost"), plan["audit"].alias("audit"))
        parts = fragments.where(~whole).repartition("conv").sortWithinPartitions(*by, "copy")
        chained = parts.mapInArrow(_chained, f"conv {self.conv_type}, {_RESULT}")
        return written(done.unionByName(chained), "plans").withColumnRenamed("conv", self.conv_col)

    def repaired(self, plans: DataFrame) -> DataFrame:
        """(id, place, edit, role, text): the rows of all repaired conversations, each conversation's together and in order.

        Rows stream past their conversation's audit, so that a task holds no conversation's texts.
        """
        none = F.lit(None).cast("string")
        audits = plans.select(F.col(self.conv_col).alias("conv"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2"), "audit", none.alias("role"), none.alias("text"))
        rows = self._rows.select("conv", F.lit(1).alias("kind"), "turn", "h1", "h2", none.alias("audit"), "role", "text")
        dealt = audits.unionByName(rows).repartition("conv").sortWithinPartitions(F.asc_nulls_first("conv"), "kind", F.asc_nulls_first("turn"), "h1", "h2")
        return dealt.mapInArrow(_repaired, f"conv {self.conv_type}, place bigint, edit string, role string, text string").withColumnRenamed("conv", self.conv_col)

    def digests(self, repaired: DataFrame) -> DataFrame:
        """(id, sha): lowercase SHA-256 of each repaired conversation's ``role:text`` rows, joined by newlines.

        Takes the rows as ``repaired`` leaves them. Conversations without rows have none. One digest is one stream of bytes,
        so that a conversation's rows pass through one task, a row at a time.
        """
        rows = repaired.withColumnRenamed(self.conv_col, "conv")
        return rows.mapInArrow(_digests, f"conv {self.conv_type}, sha string").withColumnRenamed("conv", self.conv_col)
