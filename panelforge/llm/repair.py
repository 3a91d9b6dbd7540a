"""Conversation structure repair: cheapest edits to role order, by lazy weighted determinisation.

A conversation's rows are a string over a small alphabet (kind of role, kind of fault). A non-deterministic
weighted automaton reads it: its four states are how far the role initials have come in ``(s?(ua)+)?``, its arcs
keep, rerole or delete a row, and insert one without reading. It is made deterministic only as far as the data
ask for it: the costs of its four states, less the least of them, are one state of the new automaton, and a
table holds the next state and the amount taken off for each state and letter met so far. Costs that can't
be part of a cheapest repair any more are left out of the vector, so the table stays small at any length. A
conversation's cost is one scan over the table. Going back, the arcs whose ends differ by just their weight mark the
states of cheapest repairs; going forward over marked states, the least letter each time gives the audit.

Faults, positions and counts come from windows over rows without their texts. The last step streams the
texts, sorted behind their conversation's edits, into the digest, and holds no conversation in memory. One
conversation is read in order by one task, as its digest is sequential; in the automaton a row of it is one byte.

Edge cases: null conv_id, turn, role or text count as one space where they are text; all rows without conv_id are one
conversation; nulls come first in the order of turns. Rows of one turn go by role, then by the digest of their text,
so the result doesn't depend on the order of the table. A role that doesn't begin with s, u or a can't be kept. A
conversation all of whose rows are dropped has zeros, an empty audit and the digest of no text; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.llm.common import materialize, table

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
BLANKS = " \t\n\x0b\x0c\r"
ROLES = {"u": "user", "a": "assistant"}
#: How far the initials have come: nothing, s, an odd u, a pair. From where to where each initial leads.
START, SYSTEM, USER, PAIR = range(4)
STEPS = {"s": [(START, SYSTEM)], "u": [(START, USER), (SYSTEM, USER), (PAIR, USER)], "a": [(USER, PAIR)]}
INSERTS = [(q, to, r) for r in "ua" for q, to in STEPS[r]]
INITIALS, FAULTS = "sua ", 3
NEVER = 1 << 60
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
RESULT = ", ".join(["conv_id long", *(f"{c} long" for c in COUNTS), "audit string", "repaired_sha256 string"])


def arcs(row: int) -> list[tuple[str, int, int, int]]:
    """What a row may become, least letter first: edit (D, K; U, A to rerole), from, to, cost.

    A row is one number: its role's place in INITIALS (the last for any other), and 0 sound, 1 truncated, 2 to be deleted.
    """
    initial, fault = INITIALS[row // FAULTS], row % FAULTS
    out = [("D", q, q, DELETE) for q in range(4)]
    if fault < 2:
        out += [("K", q, to, KEEP + TRUNCATED * fault) for q, to in STEPS.get(initial, [])]
        out += [(r.upper(), q, to, REROLE + TRUNCATED * fault) for r in "ua" for q, to in STEPS[r]]
    return out


ARCS = [arcs(row) for row in range(len(INITIALS) * FAULTS)]


class Repairs:
    """The deterministic automaton, grown as conversations ask for it."""

    def __init__(self):
        self.vectors: list[tuple[int, ...]] = []
        self.number: dict[tuple[int, ...], int] = {}
        self.next: list[list[tuple[int, int] | None]] = []
        self.back: dict[tuple[int, int, int], int] = {}
        self.forth: dict[tuple[int, int, int, int, int], tuple[str, int]] = {}
        self.start = self._state([0, NEVER, NEVER, NEVER])[0]

    def _state(self, v: list[int]) -> tuple[int, int]:
        """The state of a cost vector once inserts are added, and what was taken off it."""
        for _ in range(2):
            for q, to, _r in INSERTS:
                v[to] = min(v[to], v[q] + INSERT)
        # From PAIR all goes that goes from START, but a system row must be deleted; and all that goes from SYSTEM.
        v[START] = NEVER if v[START] > v[PAIR] + DELETE else v[START]
        v[SYSTEM] = NEVER if v[SYSTEM] > v[PAIR] else v[SYSTEM]
        low = min(v)
        key = tuple(x - low if x < NEVER else NEVER for x in v)
        if key not in self.number:
            self.number[key] = len(self.vectors)
            self.vectors.append(key)
            self.next.append([None] * len(ARCS))
        return self.number[key], low

    def step(self, state: int, row: int) -> tuple[int, int]:
        found = self.next[state][row]
        if found is None:
            v, new = self.vectors[state], [NEVER] * 4
            for _, q, to, cost in ARCS[row]:
                new[to] = min(new[to], v[q] + cost)
            found = self.next[state][row] = self._state(new)
        return found

    def _with_inserts(self, state: int, marked: int) -> int:
        v = self.vectors[state]
        for _ in range(2):
            for q, to, _r in INSERTS:
                if marked >> to & 1 and v[q] < NEVER and v[q] + INSERT == v[to]:
                    marked |= 1 << q
        return marked

    def _before(self, state: int, row: int, marked: int) -> int:
        """The states before a row from which a tight arc leads to a marked state."""
        key = (state, row, marked)
        if key not in self.back:
            after, taken = self.step(state, row)
            v, w, out = self.vectors[state], self.vectors[after], 0
            for _, q, to, cost in ARCS[row]:
                if marked >> to & 1 and v[q] < NEVER and v[q] + cost == w[to] + taken:
                    out |= 1 << q
            self.back[key] = self._with_inserts(state, out)
        return self.back[key]

    def _insert(self, state: int, marked: int, q: int) -> tuple[str, int] | None:
        v = self.vectors[state]
        return next(((r, to) for f, to, r in INSERTS if f == q and marked >> to & 1 and v[q] + INSERT == v[to]), None)

    def _edits(self, state: int, row: int, marked: int, later: int, q: int) -> tuple[str, int]:
        """From q, the least edits up to and with a row: u and a for inserted roles, D, K, U or A; and where they end."""
        key = (state, row, marked, later, q)
        if key not in self.forth:
            after, taken = self.step(state, row)
            w, out, at = self.vectors[after], "", q
            while True:
                v = self.vectors[state][at]
                tight = [(e, to) for e, f, to, cost in ARCS[row] if f == at and later >> to & 1 and v + cost == w[to] + taken]
                inserted = self._insert(state, marked, at)
                if inserted and not (tight and tight[0][0] == "D"):
                    out, at = out + inserted[0], inserted[1]
                    continue
                self.forth[key] = out + tight[0][0], tight[0][1]
                break
        return self.forth[key]

    def repair(self, rows: bytes) -> tuple[int, str]:
        """Least cost and edits of a conversation."""
        state, cost, states = self.start, 0, [self.start]
        for row in rows:
            state, taken = self.next[state][row] or self.step(state, row)
            cost += taken
            states.append(state)
        v = self.vectors[state]
        least = min(v[START], v[PAIR])
        marked = self._with_inserts(state, sum(1 << q for q in (START, PAIR) if v[q] == least))
        marks = bytearray(len(states))
        marks[-1] = marked
        for i in range(len(rows) - 1, -1, -1):
            marks[i] = marked = self._before(states[i], rows[i], marked)
        q, out = START, []
        for i, row in enumerate(rows):
            edits, q = self._edits(states[i], row, marks[i], marks[i + 1], q)
            out.append(edits)
        while not (q in (START, PAIR) and v[q] == least):
            role, q = self._insert(state, marks[-1], q)
            out.append(role)
        return cost + least, "".join(out)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that the row's own key asks for."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), (F.crc32(F.concat_ws(":", text("conv_id"), text("turn")).cast("binary")) % 20).alias("_kind"))
    copies = F.when(F.col("_kind") == 0, 0).when(F.col("_kind") == 3, 2).otherwise(1)
    role = F.when(F.col("_kind") == 4, F.lit("user")).otherwise(F.col("role"))
    words = F.when(F.col("_kind") == 1, F.lit("")).when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", role.alias("role"), words.alias("text"), F.explode(F.array_repeat(F.lit(0), copies)).alias("_copy")).drop("_copy")


def ordered() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("key")]


def keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("key", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))


def faults(rows: DataFrame) -> DataFrame:
    """A row for each conversation that has rows: its counts, and its rows as the automaton's letters in order."""
    last = F.right(F.rtrim(F.col("text"), F.lit(BLANKS)), F.lit(1))
    light = rows.select("conv_id", "turn", "role", "key", F.substring("role", 1, 1).alias("initial"), (last == "").alias("is_blank"), (~last.isin(".", "!", "?")).alias("is_open"))
    inside = Window.partitionBy("conv_id").orderBy(*ordered())
    pair = F.concat(F.lag("initial").over(inside), F.col("initial"))
    placed = light.repartition("conv_id").withColumns({"pos": F.row_number().over(inside), "illegal": F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False)), "fresh": F.coalesce(F.col("turn") != F.lag("turn").over(inside), F.col("turn").isNotNull())})
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "key").orderBy("pos")) > 1
    blank, duplicate = F.col("is_blank"), ~F.col("is_blank") & F.col("again")
    truncated = F.col("is_open") & ~blank & ~duplicate
    fault = F.when(blank | duplicate, 2).when(truncated, 1).otherwise(0)
    at = F.instr(F.lit(INITIALS), F.col("initial"))
    letters = (F.when((F.col("initial") == "") | (at == 0), 3).otherwise(at - 1) * FAULTS + fault).cast("byte")
    gaps = F.max("turn") - F.min("turn") + 1 - F.sum(F.col("fresh").cast("long"))
    flags = {"blank": blank, "duplicate": duplicate, "truncated": truncated, "illegal": F.col("illegal")}
    return placed.withColumn("again", again).groupBy("conv_id").agg(
        F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"),
        *(F.sum(f.cast("long")).alias(c) for c, f in flags.items()),
        F.transform(F.array_sort(F.collect_list(F.struct("pos", letters.alias("letter")))), lambda x: x["letter"]).alias("letters"),
    )


def cheapest(found: DataFrame) -> DataFrame:
    """Adds cost and edits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = Repairs()
        for b in batches:
            repaired = [automaton.repair(bytes(x.tolist())) for x in b["letters"]]
            b = b.drop(columns="letters")
            b["cost"], b["edits"] = [c for c, _ in repaired], [e for _, e in repaired]
            yield b

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema if f.name != "letters")
    return found.mapInPandas(run, f"{schema}, cost long, edits string")


def digests(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """RESULT of each conversation in edits; its rows follow it, in order, in the same stream."""
    heads = edits.select("conv_id", F.lit(0).alias("kind"), *COUNTS, "edits", *(F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("key", "binary"), ("text", "string"))))
    tails = rows.select("conv_id", F.lit(1).alias("kind"), *(F.lit(None).cast("long").alias(c) for c in COUNTS), F.lit(None).cast("string").alias("edits"), F.col("turn").cast("long").alias("turn"), "role", "key", "text")
    stream = heads.unionByName(tails).repartition("conv_id").sortWithinPartitions("conv_id", "kind", *ordered())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, edits, at, sha, lines = None, "", 0, hashlib.sha256(), 0

        def line(text: str) -> None:
            nonlocal lines
            sha.update((("\n" if lines else "") + text).encode())
            lines += 1

        def inserted() -> None:
            nonlocal at
            while at < len(edits) and edits[at] in ROLES:
                line(f"{ROLES[edits[at]]}:")
                at += 1

        def closed() -> pa.RecordBatch:
            inserted()
            audit = edits.translate(str.maketrans("uaUA", "IIRR"))
            arrays = [pa.array([x], pa.int64()) for x in head] + [pa.array([audit]), pa.array([sha.hexdigest()])]
            return pa.RecordBatch.from_arrays(arrays, ["conv_id", *COUNTS, "audit", "repaired_sha256"])

        for b in batches:
            done = []
            columns = [b.column(c).to_pylist() for c in ("conv_id", "kind", *COUNTS, "edits", "role", "text")]
            for conv, kind, *counts, own, role, text in zip(*columns):
                if kind == 0:
                    if head is not None:
                        done.append(closed())
                    head, edits, at, sha, lines = (conv, *counts), own, 0, hashlib.sha256(), 0
                    continue
                inserted()
                edit = edits[at]
                at += 1
                if edit != "D":
                    line(f"{role if edit == 'K' else ROLES[edit.lower()]}:{text}")
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
        if head is not None:
            yield closed()

    return stream.mapInArrow(run, RESULT)


def repair(conversations: DataFrame) -> DataFrame:
    """RESULT of each conversation, for damaged rows of (conv_id, turn, role, text) and the ids of all conversations."""
    rows = keyed(damaged(conversations))
    found = materialize(cheapest(faults(rows)), "edits")
    everyone = conversations.select("conv_id").distinct().withColumnRenamed("conv_id", "_id")
    zeros = {c: F.coalesce(c, F.lit(0)) for c in COUNTS} | {"edits": F.coalesce("edits", F.lit(""))}
    edits = everyone.join(found, F.col("_id").eqNullSafe(F.col("conv_id")), "left").withColumn("conv_id", F.col("_id")).drop("_id").withColumns(zeros)
    return digests(rows, edits)


def op13_conversation_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


def _least(*of: str) -> str:
    return f"list_sort(list_filter([{', '.join(of)}], lambda x: x IS NOT NULL))[1]"


def _edit(state: str, cost: str, name: str, line: str | None = None, when: str = "true") -> str:
    text = f"{state}.r || chr(10) || {line}" if line else f"{state}.r"
    return f"CASE WHEN {state} IS NOT NULL AND {when} THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{name}', 'r': {text}}} END"


def _insert(state: str, role: str) -> str:
    return _edit(state, "3", "I", f"'{role}:'")


def _kept(state: str, initial: str) -> str:
    return _edit(state, "3 * s.fault", "K", "s.role || ':' || s.text", f"s.fault < 2 AND s.initial = '{initial}'")


def _reroled(state: str, role: str) -> str:
    return _edit(state, "3 + 3 * s.fault", "R", f"'{role}:' || s.text", "s.fault < 2")


def _closed(rows: str, rest: str) -> str:
    return f"""SELECT {rest}, v0, v1, {_least("m2", _insert("m3", "user"))} AS v2, m3 AS v3
    FROM (SELECT *, {_least("n3", _insert("m2", "assistant"))} AS m3
    FROM (SELECT *, {_least("n2", _insert("v0", "user"), _insert("v1", "user"))} AS m2 FROM ({rows})))"""


_NONE = "CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, r VARCHAR))"
_BITS = "flatten(list_transform(string_split(k, ''), lambda x: list_transform(range(8), lambda b: (ascii(x) >> b) & 1)))"
_CRC = f"xor(list_reduce(list_concat([4294967295], {_BITS}), lambda c, b: xor(c >> 1, CASE WHEN xor(c & 1, b) = 1 THEN 3988292384 ELSE 0 END)), 4294967295)"

#: DuckDB: damage by the checksum's bits; the four states' least (cost, audit) row by row. Keys are digits, so bytes.
ORACLE = f"""
WITH RECURSIVE kinds AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC} % 20 AS kind
  FROM (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations)),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
       CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
       unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM kinds),
placed AS (SELECT *, left(role, 1) AS initial, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS final,
       row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM damaged),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
       lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM placed),
steps AS MATERIALIZED (SELECT *, CASE WHEN final = '' OR again THEN 2 WHEN final NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS fault FROM seen),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (final = '') AS blank,
       count(*) FILTER (final <> '' AND again) AS duplicate, count(*) FILTER (fault = 1) AS truncated,
       count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM steps GROUP BY conv_id),
walk AS (
  {_closed(f"SELECT DISTINCT conv_id, {{'c': 0::BIGINT, 'a': '', 'r': ''}} AS v0, {_NONE} AS v1, {_NONE} AS n2, {_NONE} AS n3 FROM steps", "conv_id, 0::BIGINT AS i")}
  UNION ALL
  {_closed(f'''SELECT p.conv_id, s.i, {_edit("p.v0", "4", "D")} AS v0,
      {_least(_edit("p.v1", "4", "D"), _kept("p.v0", "s"))} AS v1,
      {_least(_edit("p.v2", "4", "D"), *(f("p.v" + q, r) for q in "013" for f, r in ((_kept, "u"), (_reroled, "user"))))} AS n2,
      {_least(_edit("p.v3", "4", "D"), _kept("p.v2", "a"), _reroled("p.v2", "assistant"))} AS n3
    FROM walk p JOIN steps s ON s.conv_id IS NOT DISTINCT FROM p.conv_id AND s.i = p.i + 1''', "conv_id, i")}
),
ends AS (SELECT w.conv_id, {_least("v0", "v3")} AS e FROM walk w JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.i)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(e.c, 0) AS cost, coalesce(e.a, '') AS audit, sha256(coalesce(substr(e.r, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN ends ON ends.conv_id IS NOT DISTINCT FROM o.conv_id
"""
