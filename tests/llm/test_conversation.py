"""Conversation repair against a dynamic programme over whole conversations."""

import hashlib
import re
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm.conversation import DELETE, FINAL, INSERT, MOVES, NEXT, NONE, Search, repair
from tests.conftest import SF01

SCHEMA = "conv_id long, turn long, role string, text string, audit string, copies long, conv string"
AFTER = {"": "u", "s": "u", "u": "a", "a": "u"}
FULL = {"u": "user", "a": "assistant"}


def expected(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if hit == 0:
            continue
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        out += [(turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    out.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    seen, fault = set(), []
    for _, role, text in out:
        bare = text.strip(" \t\n\x0b\x0c\r")
        fault.append("b" if not bare else "d" if (role, text) in seen else "" if bare[-1] in ".!?" else "t")
        seen.add((role, text))
    turns = [r[0] for r in out if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(out, out[1:]))
    best = {"": (0, "", ())}

    def put(into, at, value):
        if at not in into or value[:2] < into[at][:2]:
            into[at] = value

    def inserted(states):
        for _ in range(3):
            for at, (c, a, o) in list(states.items()):
                put(states, AFTER[at], (c + 5, a + "I", o + (FULL[AFTER[at]] + ":",)))
        return states

    best = inserted(best)
    for (_, role, text), f in zip(out, fault):
        new = {}
        for at, (c, a, o) in best.items():
            put(new, at, (c + 2, a + "D", o))
            if f in ("b", "d"):
                continue
            more = 5 if f == "t" else 0
            if role[:1] == AFTER[at] or (role[:1] == "s" and at == ""):
                put(new, role[:1], (c + more, a + "K", o + (f"{role}:{text}",)))
            put(new, AFTER[at], (c + more + 1, a + "R", o + (f"{FULL[AFTER[at]]}:{text}",)))
        best = inserted(new)
    cost, audit, lines = min((best[at] for at in ("", "a") if at in best), key=lambda v: v[:2])
    return (gaps, fault.count("b"), fault.count("d"), fault.count("t"), illegal, cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def check(df):
    groups = defaultdict(list)
    for r in df.select("conv_id", "turn", "role", "text").collect():
        groups[r[0]].append(tuple(r))
    got = repair(df).collect()
    assert len(got) == len(groups)
    for r in got:
        assert tuple(r)[1:] == expected(groups[r[0]]), r[0]


def test_whole_table(spark):
    check(spark.read.parquet(f"{SF01}/conversations.parquet"))


def test_awkward_rows(spark):
    rows = [(None, None, None, None), (None, None, "user", "Hi."), (None, 3, "assistant", "Yes!"), (1, 5, "user", "a."),
            (1, 5, "user", "a."), (1, 5, "assistant", "a."), (1, 4, "", "x."), (1, None, "tool", "t?"),
            (2, 0, "user", ""), (2, 1, "assistant", " \t\n"), (3, -7, "system", "S."), (3, 9, "user", "é ü 数据。"),
            (3, 9, "umpire", "Out!"), (4, 0, "system", "only."), (5, 0, "user", "x" * 200_000 + ". \n"),
            (5, 1, "assistant", "y " * 60_000)]
    check(spark.createDataFrame([(*r, "x", 1, "x") for r in rows], SCHEMA))
    empty = spark.createDataFrame([], SCHEMA)
    assert repair(empty).collect() == []


def test_all_rows_dropped(spark):
    conv = next(c for c in range(10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = repair(spark.createDataFrame([(conv, 0, "user", "Hi.", "", 0, "")], SCHEMA)).first()
    assert tuple(got) == (conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_a_long_conversation_is_split_over_tasks(spark):
    """Half of all rows are one conversation, cut into many segments."""
    roles = ["user", "assistant", "user", "system", "assistant", "tool"]
    rows = [(7, i if i % 50 else None, roles[(i * i + i // 7) % 6], f"Text {i % 90}" + ".!?, "[i % 5]) for i in range(1500)]
    rows += [(100 + i // 4, i % 4, roles[i % 3], f"Row {i}.") for i in range(1500)]
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check(spark.createDataFrame([(*r, "x", 1, "x") for r in rows], SCHEMA).repartition(5))
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def every_repair(rows, limit):
    """All edit strings of cost ``limit`` at most that give a legal order."""
    found, todo = [], [(0, NONE, 0, "")]
    while todo:
        i, role, cost, audit = todo.pop()
        if i == len(rows) and role in FINAL:
            found.append((cost, audit))
        if cost + INSERT <= limit:
            todo.append((i, NEXT[role], cost + INSERT, audit + "I"))
        if i < len(rows):
            todo += [(i + 1, to, cost + c, audit + letter) for letter, to, c in MOVES[rows[i]][role] if cost + c <= limit]
    return min(found)


@settings(max_examples=150, deadline=None)
@given(st.text("xsuaoSUAO", max_size=5))
def test_search_finds_the_least_of_all_repairs(rows):
    assert Search(rows).best() == every_repair(rows, DELETE * len(rows))


@settings(max_examples=100, deadline=None)
@given(st.text("xsuaoSUAO", max_size=9), st.integers(0, 9))
def test_segments_put_together_give_the_whole(rows, cut):
    best = {NONE: (0, "")}
    for part, exits in ((rows[:cut], range(4)), (rows[cut:], FINAL)):
        step = {}
        for out in exits:
            for entry, (cost, audit) in best.items():
                found = Search(part, (out,)).best(entry)
                if found:
                    step[out] = min(step.get(out, (1 << 60, "")), (cost + found[0], audit + found[1]))
        best = step
    assert min(best.values()) == Search(rows).best()


def test_a_long_search_is_linear():
    rows = "".join("xsuaoSUAO"[(i * i * 7 + i // 3) % 9] for i in range(30_000))
    cost, audit = Search(rows).best()
    assert 0 < cost <= DELETE * len(rows) and audit.count("I") + len(rows) == len(audit)


@pytest.mark.parametrize("rows, best", [("", (0, "")), ("ua", (0, "KK")), ("au", (2, "RR")), ("s", (2, "D")),
                                        ("suaU", (2, "KKKD")), ("u", (2, "D"))])
def test_known_repairs(rows, best):
    assert Search(rows).best() == best
