"""Repair of damaged conversations by iterative-deepening A*.

``damaged`` damages rows by a checksum of conversation and turn. ``repair`` reads what is left in order of its turns, names
each row's first fault, and looks for the cheapest edits that make the role initials read ``(s?(ua)+)?``: Delete, Insert,
Keep, Rerole, for each row what it costs in ``COST``; a blank or repeated row has to be deleted, a truncated one costs one
more if it stays.

The search is depth first, in ASCII order of the edits' initials, within a bound of cost that grows from one search to the
next by the least excess met. A state is the next row and what the roles so far allow; a table keeps with how much
cost left a state has failed. The bound of what is still to pay counts forced deletions, truncated rows, rows whose
role cannot stay, and, as one edit mends at most two neighbouring faults of the order, half of each run of rows
whose roles do not follow each other. The first accepting path is the cheapest and of equally cheap ones the least in
ASCII order.

A conversation is searched in segments of ``SEGMENT`` rows, from and to each state of the roles, so a long one takes time
in proportion to its rows. Of two paths to one state after the same rows the cheaper wins, of equals the lesser;
neither can be a prefix of the other, as both end with an edit of the last row. While rows stream by, a task
holds a segment of texts, and of the whole conversation the letters of its edits and a digest per row: its audit and
its hash are one value each.

Defined cases: a null role or text is one space, and so is a null in the checksum; rows without a conversation id form
one conversation; rows are ordered by (turn, role, text), a null turn first; repeated rows are rows of their own, and all
but the first are duplicates; an empty role has no initial and follows nothing; a conversation without rows after
damage has zeros, an empty audit and the hash of the empty string; gaps beyond the range of long are null; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

SEGMENT = 16
COST = {"D": 3, "I": 2, "K": 0, "R": 2}
TRUNCATED_COST = 1
BLANK, DUPLICATE, TRUNCATED = "blank", "duplicate", "truncated"
LEGAL = {"su", "ua", "au"}
#: What the roles so far allow: nothing yet, after a system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a user or assistant row that is put in, and its role.
PUT = {START: (USER, b"user"), SYSTEM: (USER, b"user"), USER: (ASSISTANT, b"assistant"), ASSISTANT: (USER, b"user")}
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: Initials of rows that may stay anywhere; a system row may only come first, any other must be changed or go.
STAYS = {"u", "a"}
LETTER = {START: "", SYSTEM: "s", USER: "u", ASSISTANT: "a"}
ACCEPTING = (START, ASSISTANT)
NEVER = 1 << 60


def damaged(turns: DataFrame, conv_id="conv_id", turn="turn", role="role", text="text") -> DataFrame:
    """(conv_id, turn, role, text, copy) after damage; a dropped row keeps its place with a null text."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", space(conv_id), space(turn)).cast("binary")) % 20
    new_text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(space(text), "[.!?]", "")).when(kind != 0, space(text))
    new_role = F.when(kind == 4, "user").otherwise(space(role))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return turns.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), new_role.alias("role"), new_text.alias("text"), F.explode(copies).alias("copy")
    )


def _own_fault(text: Column) -> Column:
    """The fault a text has by itself."""
    ends = text.rlike(r"[.!?][\x20\x09-\x0D]*\z")
    return F.when(~text.rlike(r"[^\x20\x09-\x0D]"), BLANK).when(~ends, TRUNCATED)


class _Segment:
    """Search over rows given as (initial, fault), from a state to one of some states after the last row."""

    def __init__(self, rows: list[tuple[str, str | None]], targets: tuple[int, ...], last: bool):
        self.rows, self.targets, self.last, n = rows, targets, last, len(rows)
        self.forced = [fault in (BLANK, DUPLICATE) for _, fault in rows]
        self.extra = [TRUNCATED_COST if fault == TRUNCATED else 0 for _, fault in rows]
        ends = {LETTER[t] for t in targets}
        # From each row on: what must be paid, the next row that need not go, whether a system row is left; and for
        # a row that need not go, how many neighbours in a run do not follow each other and what later runs cost.
        self.due, self.stays = [0] * (n + 1), [n] * (n + 1)
        self.run, self.after, self.system = [0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for i in range(n - 1, -1, -1):
            if self.forced[i]:
                self.due[i], self.stays[i], self.system[i] = self.due[i + 1] + COST["D"], self.stays[i + 1], self.system[i + 1]
                continue
            stuck = rows[i][0] not in STAYS
            self.due[i], self.stays[i] = self.due[i + 1] + self.extra[i] + (COST["R"] if stuck else 0), i
            self.system[i] = self.system[i + 1] or rows[i][0] == "s"
            q = self.stays[i + 1]
            if stuck or (rows[i][0] in ends if q == n else rows[q][0] not in STAYS or rows[i][0] + rows[q][0] in LEGAL):
                self.after[i] = self._mends(self.run[q]) + self.after[q]
            else:
                self.run[i], self.after[i] = 1 + self.run[q], self.after[q]

    @staticmethod
    def _mends(run: int) -> int:
        return 2 * ((run + 1) // 2)

    def to_pay(self, i: int, state: int) -> int:
        """At most what the rest costs from row ``i`` in ``state``."""
        if state not in _can_reach(self.targets):
            return NEVER
        p = self.stays[i]
        if p == len(self.rows):
            if state in self.targets:
                return self.due[i]
            return NEVER if i == p and not self.last else self.due[i] + COST["I"]
        follows = self.rows[p][0] not in STAYS or (state, self.rows[p][0]) in KEPT
        # Nothing is there yet: one system row may stay after all.
        spared = COST["R"] if state == START and self.system[i] else 0
        return self.due[i] + self._mends(self.run[p] + (not follows)) + self.after[p] - spared

    def search(self, state: int) -> tuple[int, str] | None:
        """Cost and initials of the best edits, or None if no edits lead to a target."""
        failed: dict[tuple[int, int], int] = {}
        bound, path = self.to_pay(0, state), []
        n = len(self.rows)

        def visit(i: int, state: int, left: int) -> bool:
            nonlocal excess
            need = self.to_pay(i, state)
            if need > left:
                excess = min(excess, need - left)
                return False
            if i == n and state in self.targets:
                return True
            if failed.get((i, state), -1) >= left:
                return False
            for edit, at, after, cost in self._edits(i, state):
                path.append(edit)
                if visit(at, after, left - cost):
                    return True
                path.pop()
            failed[i, state] = left
            return False

        while bound < NEVER:
            excess = NEVER
            if visit(0, state, bound):
                return bound, "".join(path)
            bound += excess
        return None

    def _edits(self, i: int, state: int) -> Iterator[tuple[str, int, int, int]]:
        """The edits possible, in ASCII order: initial, next row, next state, cost."""
        there = i < len(self.rows)
        if there:
            yield "D", i + 1, state, COST["D"]
        if there or self.last:
            yield "I", i, PUT[state][0], COST["I"]
        if there and not self.forced[i]:
            if (after := KEPT.get((state, self.rows[i][0]))) is not None:
                yield "K", i + 1, after, COST["K"] + self.extra[i]
            yield "R", i + 1, PUT[state][0], COST["R"] + self.extra[i]


@cache
def _can_reach(targets: tuple[int, ...]) -> frozenset[int]:
    """States from which some rows may lead to a target."""
    if USER in targets or ASSISTANT in targets:
        return frozenset(range(4))
    return frozenset(range(max(targets) + 1))


class _Conversation:
    """The rows of one conversation as they come."""

    def __init__(self):
        self.held: list[tuple[str, str | None, bytes, bytes]] = []
        self.faults = {BLANK: 0, DUPLICATE: 0, TRUNCATED: 0}
        self.seen: set[bytes] = set()
        self.illegal, self.before = 0, None
        self.low = self.high = self.turn = None
        self.turns = 0
        #: By state: cost, edits as a chain of pieces, hash so far, and place in the order of all edits so far.
        self.ways = {START: (0, None, hashlib.sha256(), 0)}

    def add(self, turn: int | None, initial: str, role: bytes, text: bytes, fault: str | None) -> None:
        if turn is not None:  # rows come by turn
            self.turns += turn != self.turn
            self.low, self.high, self.turn = turn if self.low is None else self.low, turn, turn
        if self.before is not None:
            self.illegal += self.before + initial not in LEGAL
        self.before = initial
        digest = hashlib.blake2b(b"%d:" % len(role) + role + text, digest_size=16).digest()
        if fault != BLANK and digest in self.seen:
            fault = DUPLICATE
        self.seen.add(digest)
        if fault:
            self.faults[fault] += 1
        if len(self.held) == SEGMENT:
            self._advance()
        self.held.append((initial, fault, role, text))

    def _ways_to(self, targets: tuple[int, ...], last: bool) -> list[tuple[int, int, str, int]]:
        """(cost, place, edits, state before) of the ways to some states, the best first."""
        segment, found = _Segment([r[:2] for r in self.held], targets, last), []
        for state, (cost, _, _, place) in self.ways.items():
            if best := segment.search(state):
                found.append((cost + best[0], place, best[1], state))
        return sorted(found)

    def _advance(self) -> None:
        best = {state: ways[0] for state in range(4) if (ways := self._ways_to((state,), last=False))}
        places = sorted(best, key=lambda s: best[s][1:3])
        self.ways = {
            state: (cost, (self.ways[old][1], edits), self._hashed(old, edits), places.index(state))
            for state, (cost, _, edits, old) in best.items()
        }
        self.held = []

    def _hashed(self, state: int, edits: str):
        """The hash of a way, with the rows that edits of the rows held give."""
        digest, rows = self.ways[state][2].copy(), iter(self.held)
        for edit in edits:
            initial, _, role, text = next(rows) if edit != "I" else ("", None, b"", b"")
            if edit == "D":
                continue
            after, put = PUT[state]
            if edit == "K":
                after = KEPT[state, initial]
            digest.update((b"\n" if state != START else b"") + (role if edit == "K" else put) + b":" + text)
            state = after
        return digest

    def result(self) -> tuple:
        cost, _, edits, state = self._ways_to(ACCEPTING, last=True)[0]
        pieces, chain = [edits], self.ways[state][1]
        while chain:
            chain, piece = chain
            pieces.append(piece)
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        audit, digest = "".join(reversed(pieces)), self._hashed(state, edits).hexdigest()
        return (gaps if gaps < 1 << 63 else None, *self.faults.values(), self.illegal, cost, audit, digest)


def repair(rows: DataFrame) -> DataFrame:
    """Per conversation of ``damaged`` rows its faults, the cost of repair, its edits and the hash of what they give."""
    kind = dict(rows.dtypes)["conv_id"]
    flagged = rows.select(
        "conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "role", "text", "copy", _own_fault(F.col("text")).alias("fault")
    )
    ordered = flagged.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text", "copy")
    ordered = ordered.select("conv_id", "turn", "initial", F.col("role").cast("binary"), F.col("text").cast("binary"), "fault")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, out, own, now = [], [], None, None
        types = [pa.int64()] * 6 + [pa.string()] * 2

        def finished():
            columns = zip(*out) if out else [()] * len(types)
            return pa.RecordBatch.from_arrays([pa.array(ids, id_type), *(pa.array(c, t) for c, t in zip(columns, types))], OUT)

        for batch in batches:
            id_type = batch.schema.field("conv_id").type
            for conv, *row in zip(*(batch[c].to_pylist() for c in ("conv_id", "turn", "initial", "role", "text", "fault"))):
                if own is None or conv != now:
                    if own is not None:
                        ids.append(now)
                        out.append(own.result())
                    own, now = _Conversation(), conv
                if row[3] is not None:
                    own.add(*row)
            if out:
                yield finished()
                ids, out = [], []
        if own is not None:
            ids, out = [now], [own.result()]
            yield finished()

    return ordered.mapInArrow(
        run, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    )


OUT = ["conv_id", "gaps", BLANK, DUPLICATE, TRUNCATED, "illegal", "cost", "audit", "repaired_sha256"]
