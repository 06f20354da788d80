"""Conversation repair against a plain search of all edits and against dynamic programming."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import time
import zlib

import pytest

from shelflife.llm import queries, repair
from shelflife.llm.common import read_table

SF = "/root/testdata/sf0.01"
WHITE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string"


def plain_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        space = lambda x: " " if x is None else x
        kind = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = space(role), space(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own = out.setdefault(conv, [])
        own += [(turn is not None, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return {conv: [r[1:] for r in sorted(own, key=lambda r: (r[0], r[1] or 0, r[2].encode(), r[3].encode()))] for conv, own in out.items()}


def plain_faults(rows):
    seen, faults = set(), []
    for _, role, text in rows:
        end = text.rstrip(WHITE)[-1:]
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else None)
        seen.add((role, text))
    return faults


def plain_repair(rows, faults):
    """Cheapest edits by trying, row by row, all that lead to each state: a state keeps its cheapest, then least, edits."""
    put = {"": "u", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}
    ways = {"": (0, "", ())}

    def better(into, state, way):
        into[state] = min(into.get(state, way), way)

    for (_, role, text), fault in zip(rows, faults):
        grown = dict(ways)
        for state, way in ways.items():
            for _ in range(2):
                way, state = (way[0] + 2, way[1] + "I", way[2] + (names[put[state]] + ":",)), put[state]
                better(grown, state, way)
        after = {}
        for state, (cost, audit, lines) in grown.items():
            better(after, state, (cost + 3, audit + "D", lines))
            if fault not in ("blank", "duplicate"):
                extra, first = int(fault == "truncated"), role[:1]
                if (state, first) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                    better(after, first, (cost + extra, audit + "K", lines + (f"{role}:{text}",)))
                better(after, put[state], (cost + 2 + extra, audit + "R", lines + (f"{names[put[state]]}:{text}",)))
        ways = after
    ends = []
    for state, (cost, audit, lines) in ways.items():
        while state not in ("", "a"):
            cost, audit, lines, state = cost + 2, audit + "I", lines + (names[put[state]] + ":",), put[state]
        ends.append((cost, audit, lines))
    return min(ends)


def expected(rows):
    out = {}
    for conv, own in plain_damage(rows).items():
        faults = plain_faults(own)
        cost, audit, lines = plain_repair(own, faults)
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(own)]
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        illegal = sum(p not in ("su", "ua", "au") for p in pairs)
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def found_in(df):
    rows = [tuple(r) for r in df.select(*repair.OUT).collect()]
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: r[1:] for r in rows}


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in read_table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert found_in(queries.QUERIES["op13_conversation_repair"](spark, SF)) == expected(rows)


def odd_rows():
    rng = random.Random(13)
    roles = ["user", "assistant", "assistant", "user", "system", "tool", "", None, "ünder", "usr"]
    texts = ["Fine.", "Fine.", "What?", "cut off", "", None, " \n\t", "é!\n ", "a.b", "\x1f", "x" * 5000 + "."]
    rows = []
    for conv in [*range(300), None]:
        for turn in range(rng.randint(1, 40 if conv in (7, 8, None) else 9)):
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), rng.choice(roles), rng.choice(texts)))
    rows += [(1000, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(200)]
    rows += [(1001, t, "user", f"turn {t}") for t in range(60)]
    rows += [(1002, None, None, None)] * 70
    return rows


def test_odd_rows(spark):
    rows = odd_rows()
    clash = "copy string, fault int, initial string, audit string, cost double"
    df = spark.createDataFrame([(*r, "c", 1, "i", "a", 0.5) for r in rows], f"{SCHEMA}, {clash}").repartition(5)
    assert found_in(repair.repair(repair.damaged(df))) == expected(rows)


def test_no_rows(spark):
    assert repair.repair(repair.damaged(spark.createDataFrame([], SCHEMA))).collect() == []


def test_all_rows_dropped(spark):
    dropped = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    found = found_in(repair.repair(repair.damaged(spark.createDataFrame([(dropped, 0, "user", "Hi.")], SCHEMA))))
    assert found == {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


@pytest.mark.parametrize("segment", [1, 2, 3, 5, 16])
def test_segments_do_not_matter(monkeypatch, segment):
    monkeypatch.setattr(repair, "SEGMENT", segment)
    rng = random.Random(segment)
    for _ in range(300):
        rows = [(k, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["A.", "B", "", f"{k}!", f"{k}"])) for k in range(rng.randint(0, 12))]
        own = repair._Conversation()
        for turn, role, text in rows:
            end = text[-1:]
            own.add(turn, role[:1], role.encode(), text.encode(), "blank" if not end else None if end in ".!?" else "truncated")
        faults = plain_faults(rows)
        cost, audit, lines = plain_repair(rows, faults)
        assert own.result()[-3:] == (cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def test_edits_are_the_first_of_all_strings():
    """Against all strings of edits in order of cost and letters."""
    rng = random.Random(5)
    for _ in range(40):
        rows = [(rng.choice("usax"), rng.choice([None, None, "blank", "truncated"])) for _ in range(rng.randint(0, 4))]
        best = None
        for size in range(9):
            for edits in itertools.product("DIKR", repeat=size):
                if sum(e != "I" for e in edits) != len(rows):
                    continue
                cost, left, options = 0, iter(rows), []
                for e in edits:
                    if e == "I":
                        cost, options = cost + 2, [*options, "ua"]
                        continue
                    initial, fault = next(left)
                    cost += {"D": 3, "K": 0, "R": 2}[e] + (fault == "truncated" and e != "D")
                    if fault == "blank" and e != "D":
                        break
                    options += [] if e == "D" else [initial] if e == "K" else ["ua"]
                else:
                    if any(re.fullmatch("(s?(ua)+)?", "".join(p)) for p in itertools.product(*options)):
                        best = min(best or (cost, edits), (cost, edits))
        assert repair._Segment(rows, repair.ACCEPTING, last=True).search(repair.START) == (best[0], "".join(best[1]))


def test_bound_never_exceeds_the_cost():
    rng = random.Random(6)
    for _ in range(300):
        rows = [(rng.choice("uuaasx"), rng.choice([None, None, "blank", "truncated"])) for _ in range(rng.randint(0, 9))]
        for targets in [repair.ACCEPTING, (0,), (1,), (2,), (3,)]:
            segment = repair._Segment(rows, targets, last=targets == repair.ACCEPTING)
            for state in range(4):
                if found := segment.search(state):
                    assert segment.to_pay(0, state) <= found[0]


def test_time_grows_with_the_rows():
    def seconds(n, roles):
        own, start = repair._Conversation(), time.perf_counter()
        for k in range(n):
            own.add(k, roles[k % len(roles)][:1], roles[k % len(roles)].encode(), f"{k}".encode(), repair.TRUNCATED if k % 3 else None)
        own.result()
        return time.perf_counter() - start

    for roles in (["user", "assistant"], ["tool"], ["user", "user", "tool", "assistant", "system"]):
        seconds(500, roles)
        assert seconds(8000, roles) < 2.5 * seconds(4000, roles) + 0.2
