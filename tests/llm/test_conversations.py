import hashlib
import random
import zlib

import numpy as np
import pytest

from tidemark.llm import conversations as conv

SCHEMA = "conv_id long, turn long, role string, text string"
BLANK = " \t\n\x0b\x0c\r"
NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}


def damaged(rows):
    out = []
    for key, turn, role, text in rows:
        show = lambda value: " " if value is None else str(value)
        role, text = show(role), show(text)
        fate = zlib.crc32(f"{show(key)}:{show(turn)}".encode()) % 20
        if fate == 0:
            continue
        text = "" if fate == 1 else "".join(c for c in text if c not in ".!?") if fate == 2 else text
        role = "user" if fate == 4 else role
        out += [(key, turn, role, text)] * (2 if fate == 3 else 1)
    return out


def ordered(rows):
    return sorted(rows, key=lambda row: (row[1] is not None, row[1] or 0, row[2], hashlib.md5(row[3].encode()).hexdigest()))


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        core = text.rstrip(BLANK)
        out.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def searched(rows, marks):
    """All edits of all turns, state by state; every string is kept until it loses to a cheaper one."""
    best = {0: (0, "", ())}

    def insertions(held):
        for _ in range(2):
            for state, (cost, letters, out) in list(held.items()):
                role = "a" if state == 2 else "u"
                to = NEXT[role][state]
                found = (cost + 5, letters + "I", (*out, ("user" if role == "u" else "assistant", "")))
                held[to] = min(held.get(to, found), found)
        return held

    for (_, _, role, text), mark in zip(rows, marks, strict=True):
        after = {}

        def offer(state, found, after=after):
            after[state] = min(after.get(state, found), found)

        for state, (cost, letters, out) in insertions(dict(best)).items():
            offer(state, (cost + 2, letters + "D", out))
            if mark in ("blank", "duplicate"):
                continue
            more = 5 if mark == "truncated" else 0
            if role[:1] in NEXT and state in NEXT[role[:1]]:
                offer(NEXT[role[:1]][state], (cost + more, letters + "K", (*out, (role, text))))
            for new, name in (("u", "user"), ("a", "assistant")):
                if state in NEXT[new]:
                    offer(NEXT[new][state], (cost + 1 + more, letters + "R", (*out, (name, text))))
        best = after
    done = [found for state, found in insertions(dict(best)).items() if state in (0, 3)]
    return min(done)


def expected(rows):
    rows = ordered(rows)
    marks = faults(rows)
    turns = [row[1] for row in rows if row[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [row[2][:1] for row in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials[:-1], initials[1:], strict=True))
    cost, audit, out = searched(rows, marks)
    digest = hashlib.sha256("\n".join(f"{role}:{text}" for role, text in out).encode()).hexdigest()
    return (gaps, *(marks.count(name) for name in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)


def run(frame, **settings):
    repairs = conv.repair_conversations(frame, **settings)
    rows = repairs.plans.join(conv.repair_digests(repairs), "key").collect()
    return {row.conv: (row.gaps, row.blank, row.duplicate, row.truncated, row.illegal, row.cost, row.audit, row.repaired_sha256) for row in rows}


def drawn(n, longest, seed, ids=40):
    draw = random.Random(seed)
    rows = []
    for key in range(ids):
        for turn in range(draw.randrange(1, longest)):
            role = draw.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None])
            text = draw.choice(["Yes.", "No!", "why", " \t", "", None, f"line {draw.randrange(6)}?", "été.", f"cut {draw.randrange(4)}  "])
            rows.append((key, draw.choice([turn, turn, turn * 2, None]), role, text))
            if draw.random() < 0.1:
                rows.append(rows[-1])
    return rows


@pytest.mark.parametrize("block_turns", [3, 1 << 16])
def test_equals_a_plain_search(spark, block_turns):
    rows = [(key, turn, " " if role is None else role, " " if text is None else text) for key, turn, role, text in drawn(0, 24, 5)]
    got = run(spark.createDataFrame(rows, SCHEMA).repartition(5), block_turns=block_turns)
    want = {key: expected([row for row in rows if row[0] == key]) for key in {row[0] for row in rows}}
    assert got == want


def test_damage_equals_its_rule(spark):
    rows = [*drawn(0, 12, 9), (None, None, None, None), (None, 3, "user", "x.")]
    got = sorted(tuple(map(str, row)) for row in conv.damage(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == sorted(tuple(map(str, row)) for row in damaged(rows))


def test_nulls_one_hot_conversation_very_long_texts_and_clashing_columns(spark):
    draw = random.Random(3)
    hot = [(7, turn, draw.choice(["user", "assistant"]), draw.choice(["ok.", f"t{turn}."])) for turn in range(700)]
    rows = [*hot, (None, None, "user", "a."), (None, 1, "assistant", "b" * 300_000), (8, None, "assistant", "  "), (8, None, "assistant", "  ")]
    frame = spark.createDataFrame([(*row, "x", 1) for row in rows], f"{SCHEMA}, ways string, key int").repartition(6)
    for limit in (16, 1 << 16):
        got = run(frame, block_turns=limit)
        assert got == {key: expected([row for row in rows if row[0] == key]) for key in (7, 8, None)}


def test_repaired_turns_follow_the_grammar(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "user", "Who?"), (1, 2, "assistant", "Me."), (1, 3, "user", "cut"), (2, 0, "system", "Be."), (2, 1, "user", "A?"), (2, 2, "user", "B.")]
    repairs = conv.repair_conversations(spark.createDataFrame(rows, SCHEMA))
    held = {}
    for row in conv.repaired_turns(repairs).orderBy("key", "place").collect():
        held.setdefault(row.key, []).append((row.role, row.text, row.edit))
    assert held["v1"] == [("user", "Who?", "K"), ("assistant", "Me.", "K")]
    assert held["v2"] == [("system", "Be.", "K"), ("user", "A?", "K"), ("assistant", "B.", "R")]


def test_costs_are_the_callers(spark):
    rows = [(1, 0, "user", "Who?")]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert run(frame)[1][5:7] == (2, "D")
    assert run(frame, costs=conv.Costs(delete=9))[1][5:7] == (5, "KI")


def test_halves_agree_with_whole_stretches():
    steps = conv._steps(conv.Costs())
    draw = np.random.default_rng(1)
    for n in (1, 2, 9, 40):
        kinds = np.append(draw.integers(0, 12, n), 12)
        zero = np.zeros(1, dtype=np.int64)
        before, behind = conv._crossings(steps, kinds, zero, zero + n + 1, zero, zero)
        assert (before[1:] == behind[:-1]).all()
        cost, _ = conv._forward(steps, kinds, zero, zero + n + 1, zero)
        assert steps.cost[kinds, before, behind].sum() == cost[0, 0]


def test_empty_table(spark):
    repairs = conv.repair_conversations(spark.createDataFrame([], SCHEMA))
    assert repairs.plans.count() == conv.repair_digests(repairs).count() == 0
