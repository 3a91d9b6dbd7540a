"""Vector codes against plain Lloyd rounds in Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, entries, rounds=2):
    """vec_id, code, error, label error by the definition; and the digest."""
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    size = len(kept[0][1])
    ends = np.cumsum([0, *(len(p) for p in np.array_split(np.arange(size), 16))])
    cut = lambda v, p: v[ends[p] : ends[p + 1]]
    ids = sorted({i for i, _, _ in kept if i is not None})[:entries]
    first = [min(v for i, v, _ in kept if i == k) for k in ids]
    books = [[cut(v, p) for v in first] for p in range(16)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    best = lambda v, p: min(range(len(ids)), key=lambda e: (far(cut(v, p), books[p][e]), e))
    for _ in range(rounds):
        for p in range(16):
            own = [best(v, p) for _, v, _ in kept]
            new = list(books[p])
            for e in range(len(ids)):
                mine = [cut(v, p) for (_, v, _), o in zip(kept, own) if o == e]
                if mine:
                    new[e] = [sum(c) // len(mine) for c in zip(*mine)]
            books[p] = new
    out = []
    for i, v, label in kept:
        code = [best(v, p) for p in range(16)]
        out.append((i, "".join(f"{e:02x}" for e in code), sum(far(cut(v, p), books[p][e]) for p, e in enumerate(code)), label))
    sums = {}
    for *_, error, label in out:
        sums[label] = sums.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, c, e, sums[label]) for i, c, e, label in out), key=repr), digest


def run(spark, rows, entries=64, schema=SCHEMA):
    df = spark.createDataFrame(rows, schema).repartition(3).withColumns({c: F.lit("x") for c in ("code", "error", "x", "head", "row", "_key")})
    codes, digest, tables = vc.compress(df, entries)
    return sorted(map(tuple, vc.with_label_error(codes).select("vec_id", "code", "error", "label_error").collect()), key=repr), digest, tables


@pytest.mark.parametrize("size, scale, entries", [(16, 1.0, 5), (32, 0.02, 8), (37, 1.0, 4), (16, 3e5, 3)])
def test_codes_are_those_of_plain_rounds(spark, size, scale, entries):
    r = random.Random(size)
    rows = [(k, [r.gauss(0, scale) for _ in range(size)], r.choice([0, 1, None])) for k in range(60)]
    rows += [rows[3], rows[3], (None, rows[5][1], 1), (7, rows[6][1], None), (900, None, 1), (901, [None] * size, 1), (902, [math.nan] * size, 1), (903, [math.inf] * size, 0)]
    got, digest, _ = run(spark, rows, entries)
    want, want_digest = plain(rows, entries)
    assert got == want and digest == want_digest


def test_fewer_rows_than_entries_and_ties(spark):
    rows = [(k, [float(k // 2)] * 16, 0) for k in range(6)]
    got, digest, _ = run(spark, rows)
    assert (got, digest) == plain(rows, 64)
    assert {c for _, c, _, _ in got} == {"00" * 16, "02" * 16, "04" * 16}


def test_odd_lengths_empty_tables_and_no_ids(spark):
    rows = [(k, [k / 10] * 16, 1) for k in range(5)] + [(8, [1.0] * 4, 1), (9, [], None)]
    got, _, _ = run(spark, rows)
    assert [r for r in got if r[0] in (8, 9)] == [(8, None, None, 0), (9, None, None, None)]
    assert run(spark, [])[0] == []
    assert run(spark, [(None, [0.1] * 16, 1)])[0] == [(None, None, None, None)]
    with pytest.raises(Exception, match="64 bits"):
        run(spark, [(1, [1e30] * 16, 1)])


def test_heaps_leave_settled_parts_alone(spark):
    """Well-parted vectors: entries hardly move, so a round pops few parts, and codes are the plain ones."""
    r = random.Random(4)
    rows = [(k, [10.0 * (k % 4) + r.gauss(0, 0.02) for _ in range(16)], 0) for k in range(400)]
    got, digest, tables = run(spark, rows, 4)
    assert (got, digest) == plain(rows, 4)
    popped = [t.agg(F.sum("popped")).first()[0] for t in tables]
    assert popped[0] == 400 * 16 and popped[1] < 0.05 * popped[0]


def test_many_labels_are_joined_with_salts(spark, monkeypatch):
    monkeypatch.setattr(vc, "BROADCAST_BYTES", 0)
    r = random.Random(5)
    rows = [(k, [r.gauss(0, 1) for _ in range(16)], None if k % 3 else k % 5) for k in range(50)]
    got, digest, _ = run(spark, rows, 4)
    assert (got, digest) == plain(rows, 4)
