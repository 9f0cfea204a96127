"""Conversation repair against SQL and against trying out every sequence of edits."""

from __future__ import annotations

import hashlib
import heapq
import itertools
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from cohortspark.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string"
WS = " \t\n\x0b\x0c\r"


def cheapest(letters):
    """Least cost and least audit by a search over all edits, without the automaton."""
    todo = [(0, "", 0, "")]
    while todo:
        cost, audit, at, roles = heapq.heappop(todo)
        if at == len(letters) and fits(roles):
            return cost, audit
        if roles.count("u") + roles.count("a") < 2 * len(letters) + 4:
            for r in "ua":
                if fits(roles + r, part=True):
                    heapq.heappush(todo, (cost + 3, audit + "I", at, roles + r))
        if at < len(letters):
            letter = letters[at]
            heapq.heappush(todo, (cost + 4, audit + "D", at + 1, roles))
            if letter != "-":
                extra = 3 if letter.isupper() else 0
                for r in "ua":
                    if fits(roles + r, part=True):
                        heapq.heappush(todo, (cost + 3 + extra, audit + "R", at + 1, roles + r))
                if letter.lower() != "o" and fits(roles + letter.lower(), part=True):
                    heapq.heappush(todo, (cost + extra, audit + "K", at + 1, roles + letter.lower()))


def fits(roles, part=False):
    body = roles[1:] if roles[:1] == "s" else roles
    whole = body == "ua" * (len(body) // 2) and (body or roles != "s")
    return whole or part and body == ("ua" * len(body))[:len(body)]


def by_hand(rows):
    """Contract's columns of one conversation from its original rows."""
    kept = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        mark = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if mark == 1:
            text = ""
        elif mark == 2:
            text = "".join(c for c in text if c not in ".!?")
        elif mark == 4:
            role = "user"
        kept += [(turn, role, text)] * {0: 0, 3: 2}.get(mark, 1)
    kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    seen, letters, faults = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in kept:
        bare, letter = text.rstrip(WS), role[:1] if role[:1] in ("s", "u", "a") else "o"
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            faults[fault] += 1
        letters.append("-" if fault in ("blank", "duplicate") else letter.upper() if fault else letter)
    turns = [t for t, _, _ in kept if t is not None]
    initials = [r[:1] for _, r, _ in kept]
    cost, audit = cheapest("".join(letters))
    lines, rest, state = [], iter(kept), ""
    for edit in audit:
        need = {"": "user", "s": "user", "u": "assistant", "a": "user"}[state]
        if edit == "I":
            lines.append(need + ":")
            state = need[0]
            continue
        _, role, text = next(rest)
        if edit != "D":
            lines.append((need if edit == "R" else role) + ":" + text)
            state = lines[-1][0]
    return dict(gaps=max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, **faults,
                illegal=sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost=cost, audit=audit,
                repaired_sha256=hashlib.sha256("\n".join(lines).encode()).hexdigest())


def sample(seed, n):
    rng = random.Random(seed)
    texts = ["A.", "B", "C! ", "", " \t", None, "x.\n", "long. " * 30, "é?", "A."]
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant", "ua", "User"]
    return [(rng.choice([None, *range(12)]), rng.choice([None, *range(6)]), rng.choice(roles), rng.choice(texts))
            for _ in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_against_trying_all_edits(spark, seed):
    rows = sample(seed, 70)
    frame = spark.createDataFrame(rows, SCHEMA)
    found = {r.conv_id: r.asDict() for r in conversations.report(frame, conversations.damaged(frame)).collect()}
    assert set(found) == {r[0] for r in rows}
    for conv, got in found.items():
        del got["conv_id"]
        assert got == by_hand([r for r in rows if r[0] == conv]), conv
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    told = con.execute(conversations._sql())
    names = [d[0] for d in told.description]
    assert {r[0]: dict(zip(names[1:], r[1:])) for r in told.fetchall()} == found


def test_automaton_on_all_short_signatures():
    automaton = conversations.Automaton()
    every = ["".join(s) for n in range(5) for s in itertools.product("suaUo-", repeat=n)]
    for backwards in sorted(s[::-1] for s in every):
        assert automaton.audit(backwards) == cheapest(backwards[::-1]), backwards
    assert automaton.made == len(every) - 1  # once per distinct ending, the empty one is there


def test_nothing_and_extra_columns(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert conversations.report(none, none).collect() == []
    names = ["rank", "at", "letter", "signature", "audit", "c", "new", "digest", "mark", "o", "h"]
    one = spark.createDataFrame([(5, 1, "user", "Hi there."), (5, 2, "assistant", "Yes.")], SCHEMA)
    wide = one.withColumns({n: F.lit("x") for n in names})
    assert conversations.report(wide, wide).collect() == conversations.report(one, one).collect()


def test_every_message_dropped(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = spark.createDataFrame([(gone, 0, "user", "Hi.")], SCHEMA)
    (got,) = conversations.report(rows, conversations.damaged(rows)).collect()
    assert got.cost == 0 and got.audit == "" and got.repaired_sha256 == hashlib.sha256(b"").hexdigest()


def test_one_long_conversation_and_a_very_long_text(spark):
    rows = [(1, i, ["user", "assistant"][i % 2], f"t{i}." if i % 7 else f"t{i}") for i in range(9_000)]
    rows += [(2, 0, "user", "w " * 2_000_000 + "."), (2, 1, "assistant", "ok.")]
    frame = spark.createDataFrame(rows, SCHEMA)
    found = {r.conv_id: r for r in conversations.report(frame, frame).collect()}
    assert found[1].truncated == len(range(0, 9_000, 7)) and len(found[1].audit) >= 9_000
    assert found[2].audit == "KK" and found[2].cost == 0
    turns = conversations.repaired(frame, conversations.plan(frame))
    told = [r.place for r in turns.where("conv_id = 1").collect()]
    assert sorted(told) == list(range(len(told)))
