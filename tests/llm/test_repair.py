"""Conversation repair against a plain search over all edits."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from panelforge.llm import repair as rp

STEPS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
NAMES = {"u": "user", "a": "assistant"}


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role = "user" if kind == 4 else role
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out.setdefault(conv, []).extend([(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1))
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.sha256(x[2].encode()).digest())) for c, r in out.items()}


def cheapest(rows):
    """(cost, audit, lines) by keeping the least for each number of rows and each place in the role order."""
    def with_inserts(v):
        for _ in range(3):
            for r in "ua":
                for q, to in STEPS[r].items():
                    if q in v:
                        new = (v[q][0] + 3, v[q][1] + "I", v[q][2] + [NAMES[r] + ":"])
                        v[to] = min(v.get(to, new), new)
        return v

    v = with_inserts({0: (0, "", [])})
    for role, text, fault in rows:
        n = {}
        for q, (cost, audit, lines) in v.items():
            options = [(q, 4, "D", [])]
            if fault < 2:
                options += [(to, 3 * fault, "K", [f"{role}:{text}"]) for to in [STEPS.get(role[:1], {}).get(q)] if to is not None]
                options += [(STEPS[r][q], 3 + 3 * fault, "R", [f"{NAMES[r]}:{text}"]) for r in "ua" if q in STEPS[r]]
            for to, c, e, line in options:
                new = (cost + c, audit + e, lines + line)
                n[to] = min(n.get(to, new), new)
        v = with_inserts(n)
    return min(v[q] for q in (0, 3) if q in v)


def plain(rows):
    out = []
    for conv, own in damaged(rows).items():
        seen, marked, counts = set(), [], [0, 0, 0]
        for _, role, text in own:
            solid = re.sub(r"[\x20\x09-\x0D]+$", "", text)
            fault = 0 if not solid else 1 if (role, text) in seen else 2 if solid[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            marked.append((role, text, {0: 2, 1: 2, 2: 1, None: 0}[fault]))
        initials = [role[:1] for _, role, _ in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit, lines = cheapest(marked)
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    df = df.withColumns({c: F.lit("x") for c in ("pos", "key", "kind", "edits", "letters", "cost", "_id", "_kind", "_copy")})
    return sorted(map(tuple, rp.repair(df).collect()), key=repr)


def test_repairs_are_the_cheapest(spark):
    r = random.Random(3)
    texts = ["Yes.", "No!", "what?", "open end", "", " \t\n", None, "Yes. \n", "naïve …", "a: b\nc."]
    roles = ["user", "assistant", "system", "tool", "", None, "User"]
    rows = [(c, t, r.choices(roles, [6, 6, 2, 1, 1, 1, 1])[0], r.choice(texts)) for c in range(150) for t in r.sample(range(12), r.randint(1, 9))]
    rows += [(None, t, "user", "No id.") for t in (1, 2, None)] + [(5, None, "user", "No turn."), (6, 3, "user", "Twice."), (6, 3, "user", "Twice."), (6, 3, "assistant", "Tie.")]
    assert run(spark, rows) == plain(rows)


def test_long_conversations_and_texts(spark):
    rows = [(1, t, ("user", "assistant", "assistant")[t % 3], f"Line {t}." + " word" * (t % 7) + ("." if t % 2 else "")) for t in range(3000)]
    rows += [(2, t, "user", "long " * 200_000 + ".") for t in range(3)]
    assert run(spark, rows) == plain(rows)


def test_the_table_stays_small():
    r = random.Random(8)
    automaton = rp.Repairs()
    for _ in range(300):
        automaton.repair(bytes(r.choices(range(len(rp.ARCS)), k=200)))
    assert len(automaton.vectors) < 100


def test_empty_table_and_conversations_that_vanish(spark):
    assert run(spark, []) == []
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert run(spark, [(gone, 0, "user", "Hello.")]) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


@pytest.mark.parametrize("rows, cost, audit", [([], 0, ""), ([3, 6], 0, "KK"), ([3], 3, "KI"), ([6], 3, "IK"), ([0], 4, "D"), ([5, 3, 6], 4, "DKK"), ([3, 3, 6, 6], 6, "KIKKIK"), ([9, 9], 6, "RR")])
def test_small_repairs(rows, cost, audit):
    got, edits = rp.Repairs().repair(bytes(rows))
    assert (got, edits.translate(str.maketrans("uaUA", "IIRR"))) == (cost, audit)
