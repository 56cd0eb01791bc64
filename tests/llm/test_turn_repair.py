"""Repair of conversations against plain Python that tries all edits."""

import functools
import hashlib
import itertools
import re
import sys
import zlib

import pytest
from pyspark.sql import functions as F

from draftlake.llm import turn_repair as tr

SPACES = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string"
WHOLE = re.compile("(s?(ua)+)?")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault, role, text = zlib.crc32(key.encode()) % 20, role if role is not None else " ", text if text is not None else " "
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return out


def classed(rows):
    rows = sorted(((r[1] is not None, r[1] or 0, r[2] if r[2] is not None else " ", r[3] if r[3] is not None else " ", r[1]) for r in rows))
    seen, out = set(), []
    for *_, role, text, turn in [(r[2], r[3], r[4]) for r in rows]:
        end = text.rstrip(SPACES)[-1:]
        fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else ""
        seen.add((role, text))
        out.append((turn, role, text, fault))
    return out


def cheapest(rows):
    """(cost, audit, repaired) of all edit sequences with at most two insertions in a row (more give a state again), from the left."""

    @functools.cache
    def best(i, state, inserted):
        found = [(0, "", ())] if i == len(rows) and state in (0, 3) else []
        target, role = (3, "assistant") if state == 2 else (2, "user")

        def after(cost, letter, line, *there):
            if rest := best(*there):
                found.append((cost + rest[0], letter + rest[1], line + rest[2]))

        if i < len(rows):
            _, own, text, fault = rows[i]
            after(3, "D", (), i + 1, state, 0)
            if fault not in ("blank", "duplicate"):
                worse = fault == "truncated"
                kept = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((state, own[:1]))
                if kept is not None:
                    after(worse, "K", (f"{own}:{text}",), i + 1, kept, 0)
                after(2 + worse, "R", (f"{role}:{text}",), i + 1, target, 0)
        if inserted < 2:
            after(2, "I", (f"{role}:",), i, target, inserted + 1)
        return min(found, default=None)

    sys.setrecursionlimit(10_000)
    return best(0, 0, 0)


def tried(rows, most):
    """All edit strings up to a length, no dynamic programming."""
    best = None
    for n in range(len(rows), most + 1):
        for edits in itertools.product("DIKR", repeat=n):
            if sum(e != "I" for e in edits) != len(rows):
                continue
            i, cost, initials, lines = 0, 0, "", []
            for e in edits:
                role = "assistant" if initials.endswith("u") else "user"
                if e == "I":
                    cost, initials, lines = cost + 2, initials + role[0], [*lines, f"{role}:"]
                    continue
                _, own, text, fault = rows[i]
                i += 1
                if e == "D":
                    cost += 3
                    continue
                if fault in ("blank", "duplicate"):
                    break
                own = own if e == "K" else role
                cost, initials, lines = cost + (fault == "truncated") + 2 * (e == "R"), initials + (own[:1] or "?"), [*lines, f"{own}:{text}"]
            else:
                if WHOLE.fullmatch(initials):
                    best = min(best or (cost, "".join(edits), lines), (cost, "".join(edits), lines))
    return best


def held(spark, rows, searched=cheapest):
    turns = spark.createDataFrame(rows, SCHEMA)
    repaired, report = tr.repair(turns)
    lines = {}
    for r in sorted(repaired.collect(), key=lambda r: (r.at, r.part)):
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    hashed = {r.conv_id: r.repaired_sha256 for r in tr.digests(repaired).collect()}
    told = {r.conv_id: r for r in report.collect()}
    assert set(told) == {r[0] for r in rows}
    for conv, r in told.items():
        own = classed([x for x in rows if x[0] == conv])
        turns = [t for t, *_ in own if t is not None]
        faults = [f for *_, f in own]
        assert r.gaps == (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0)
        assert (r.blank, r.duplicate, r.truncated) == tuple(map(faults.count, ("blank", "duplicate", "truncated")))
        assert r.illegal == sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        want = searched(own)
        assert (r.cost, r.audit, lines.get(conv, [])) == (want[0], want[1], list(want[2])), own
        if lines.get(conv):
            assert hashed[conv] == hashlib.sha256("\n".join(lines[conv]).encode()).hexdigest()
    return told


def test_short_conversations_against_all_edit_strings(spark, rng):
    roles, texts = ["user", "assistant", "system", "tool", "", None], ["a.", "b", " ", "c!", None]
    rows = [(c, t, rng.choice(roles[:4] if c % 3 else roles), rng.choice(texts)) for c in range(60) for t in range(rng.randrange(1, 4))]
    held(spark, rows, lambda own: tried(own, 6))


def test_random_conversations(spark, rng):
    roles, texts = ["user", "assistant", "system", "tool"], [f"{w}{e}" for w in "abcdefgh" for e in ("", ".", "? ")] + ["\n"]
    rows = [(rng.choice([c, c, None]), rng.choice([t, t, t, None]), rng.choice(roles), rng.choice(texts)) for c in range(30) for t in range(rng.randrange(14))]
    held(spark, rows)


def test_long_conversation_over_many_chunks(spark, rng, monkeypatch):
    monkeypatch.setattr(tr, "CHUNK_BITS", 3)
    roles = ["user", "assistant", "assistant", "system"]
    rows = [(7, t, rng.choice(roles), f"{rng.randrange(150)}{rng.choice('.?x')}") for t in range(400)] + [(8, 0, "user", "a."), (8, 1, "assistant", "b.")]
    assert len(held(spark, rows)[7].audit) >= 400


def test_equal_rows_are_one_kept_and_others_deleted(spark):
    told = held(spark, [(1, 0, "user", "a.")] * 40 + [(1, 1, "assistant", "b.")] + [(2, 0, "user", "")] * 5)
    assert told[1].audit == "K" + "D" * 39 + "K" and told[2].audit == "D" * 5


def test_cases(spark):
    turns = spark.createDataFrame([], SCHEMA)
    repaired, report = tr.repair(turns)
    assert repaired.count() == report.count() == tr.digests(repaired).count() == 0
    told = held(spark, [(None, None, None, None), (1, 5, "user", "x" * 2_000_000 + ".")])
    assert told[None].audit == "D" and told[1].audit == "KI" and told[1].cost == 2


def test_damage(spark, rng):
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a. b!", None, "c?"])) for c in [None, *range(40)] for t in [None, *range(5)]]
    got = tr.damage(spark.createDataFrame(rows, SCHEMA).withColumn("fault", F.lit("kept out"))).collect()
    key = lambda r: tuple((x is not None, x or 0 if not isinstance(x, str) else x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(damaged(rows), key=key)


@pytest.mark.parametrize("length", range(9))
def test_blocks_cost_what_single_rows_do(length, rng):
    tables = tr.Tables.made()
    symbols = "".join(rng.choice(tr.SYMBOLS) for _ in range(length))
    before, cost, leaves = tr.summary(symbols)
    for v, vector in enumerate(tables.vectors):
        costs, path = tuple(vector), [tuple(vector)]
        for s in reversed(symbols):
            costs = tuple(tr.before(s, costs))
            path.append(costs)
        assert costs == tuple(c + cost[v] for c in tables.vectors[before[v]])
        for start in range(4):
            state = start
            for s, here, after in zip(symbols, path[:0:-1], path[-2::-1], strict=True):
                state = tr.traced(s, state, list(here), after)[2]
            assert state == leaves[v][start]
