"""Vector code compression: product codes whose codebooks are trained by heap-ordered Lloyd rounds.

A vector is cut into 16 consecutive parts, and a part is replaced by the index of the nearest entry of its
position's codebook. Vectors are packed into blocks of bounded size. In a block each entry of each codebook has
a heap of its parts, keyed by slack: the distance to the second nearest entry (a lower bound for all others) less
the distance to the own entry (an upper bound). When entries move, an entry's drift grows by its own move and the
largest move of the others; a part whose slack is above the drift gathered since it was pushed can't have
changed its entry. So a round pops each heap only down to the drift, scans the popped parts exactly, and pushes
them again; all other parts aren't looked at. A heap is kept as its sorted array, so what is popped is a prefix.

Rounds are tables of blocks in the shared folder: a lost executor redoes its own blocks. A block hands on what its
moved parts change in the sums and counts of entries; Spark adds these up, and only the sums, entries times
components, come to the driver, whatever the number of rows.

Edge cases: rows whose vector is null or holds null or non-finite components are dropped. The first codebook
comes from the smallest distinct ids (a repeated id counts once, with its smallest vector; null ids don't count);
every row, repeated or without id, is assigned and moves entries. Vectors of another length than the most common
one (ties to the longer) keep their row, with null code and error, and don't count. Lengths that 16 doesn't divide give
parts that differ by one component. If no row has an id there are no entries, and codes and errors are null; an
empty table gives no rows. Distances are exact: in floating point while no sum leaves its whole numbers, in
Python integers beyond; a component or an error that 64 bits don't hold is an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.common import BROADCAST_BYTES, materialize, table

PARTS, ENTRIES, ROUNDS = 16, 64, 2
BLOCK = 8192
SALTS = 32
STATE = "x binary, bytes int, code binary, heap binary, row binary, popped long, sums array<struct<part: int, entry: int, at: int, n: long, total: decimal(38,0)>>"
SUMS = pa.list_(pa.struct([("part", pa.int32()), ("entry", pa.int32()), ("at", pa.int32()), ("n", pa.int64()), ("total", pa.decimal128(38, 0))]))


def whole(x: np.ndarray) -> np.ndarray:
    """floor(256 * x) of each component."""
    floored = np.floor(x.astype(np.float64) * 256)
    if floored.size and np.abs(floored).max() >= 2.0**62:
        raise OverflowError("a vector has a component beyond 64 bits")
    return floored.astype(np.int64)


def smallest_type(x: np.ndarray) -> np.ndarray:
    top = int(np.abs(x).max(initial=0))
    return x.astype(np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.int64)


def cut(width: int) -> list[slice]:
    """Where each part lies."""
    ends = np.cumsum([len(p) for p in np.array_split(np.arange(width), PARTS)]).tolist()
    return [slice(a, b) for a, b in zip([0, *ends], ends)]


def exact_distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of parts to entries, without rounding."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    if 4 * top * top * max(1, x.shape[1]) < 2**53:
        a, b = x.astype(np.float64), book.astype(np.float64)
        return (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)
    a, b = x.astype(object), book.astype(object)
    d = np.zeros((len(a), len(b)), object)
    for k in range(x.shape[1]):
        d += (a[:, k, None] - b[None, :, k]) ** 2
    return d


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each part its entry (ties to the lower index), squared distance, and slack to the second nearest entry."""
    d = exact_distances(x, book)
    own = d.argmin(1)
    at = np.arange(len(x))
    best = d[at, own]
    if len(book) == 1:
        return own, best, np.full(len(x), np.inf)
    upper = np.sqrt(best.astype(np.float64))
    d[at, own] = d.max(1) if d.dtype == object else np.inf
    lower = np.sqrt(d.min(1).astype(np.float64))
    return own, best, lower - upper - 1e-9 * (1 + lower + upper)  # the margin is far above what roots are rounded by


def moved_sums(part: int, x: np.ndarray, old: np.ndarray | None, new: np.ndarray, entries: int) -> list[tuple]:
    """What parts that go from old to new entries add to the entries' counts and sums, by component."""
    n = np.bincount(new, minlength=entries) - (0 if old is None else np.bincount(old, minlength=entries))
    total = np.zeros((entries, x.shape[1]), np.int64 if len(x) * (int(np.abs(x).max(initial=0)) + 1) < 2**62 else object)
    values = x.astype(total.dtype)
    np.add.at(total, new, values)
    if old is not None:
        np.subtract.at(total, old, values)
    touched = np.flatnonzero((n != 0) | (total != 0).any(1))
    return [(part, int(e), k, int(n[e]), Decimal(int(total[e, k]))) for e in touched for k in range(x.shape[1])]


def push(code: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Parts in heap order: by entry, then by key."""
    return np.lexsort((key, code))


class Book:
    """The entries of all positions, and the drift each has gathered over the rounds."""

    def __init__(self, entries: list[np.ndarray]):
        self.entries = entries
        self.drift = np.zeros((len(entries), len(entries[0]) if entries else 0))

    def moved(self, entries: list[np.ndarray]) -> Book:
        new = Book(entries)
        for p, (a, b) in enumerate(zip(self.entries, entries)):
            move = np.sqrt(((a.astype(np.float64) - b.astype(np.float64)) ** 2).sum(1)) * (1 + 1e-12)
            others = np.array([np.delete(move, e).max(initial=0) for e in range(len(move))])
            new.drift[p] = self.drift[p] + move + others
        return new

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(c)) for book in self.entries for e in book for c in e).encode()).hexdigest()


def first_blocks(book: Book) -> callable:
    """Packs rows into blocks, each part assigned by an exact scan and pushed on the heap of its entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), BLOCK):
                b = batch.slice(start, BLOCK)
                n = len(b)
                x = whole(b.column("embedding").flatten().to_numpy(zero_copy_only=False)).reshape(n, -1)
                code, heap, row, sums = np.zeros((PARTS, n), np.uint8), np.zeros((PARTS, n)), np.zeros((PARTS, n), np.int32), []
                for p, where in enumerate(cut(x.shape[1])):
                    own, _, key = nearest(x[:, where], book.entries[p])
                    sums += moved_sums(p, x[:, where], None, own, len(book.entries[p]))
                    order = push(own, key)
                    code[p], heap[p], row[p] = own, key[order], order
                head = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.StructArray.from_arrays([b.column("vec_id"), b.column("label")], ["vec_id", "label"]))
                yield block(head, smallest_type(x), code, heap, row, n * PARTS, sums)

    return run


def block(head: pa.Array, x: np.ndarray, code: np.ndarray, heap: np.ndarray, row: np.ndarray, popped: int, sums: list[tuple]) -> pa.RecordBatch:
    packed = [pa.array([a.tobytes()], pa.binary()) for a in (x, code, heap, row)]
    names = ["part", "entry", "at", "n", "total"]
    listed = pa.array([[dict(zip(names, s)) for s in sums]], SUMS)
    return pa.RecordBatch.from_arrays([head, packed[0], pa.array([x.itemsize], pa.int32()), *packed[1:], pa.array([popped], pa.int64()), listed], ["head", "x", "bytes", "code", "heap", "row", "popped", "sums"])


def opened(b: pa.RecordBatch, i: int) -> tuple[np.ndarray, ...]:
    """A block's vectors, codes, keys and rows."""
    kind = {2: np.int16, 4: np.int32, 8: np.int64}[b.column("bytes")[i].as_py()]
    n = len(b.column("head")[i])
    read = [np.frombuffer(b.column(c)[i].as_buffer(), t) for c, t in (("x", kind), ("code", np.uint8), ("heap", np.float64), ("row", np.int32))]
    return (read[0].reshape(n, -1), *(a.reshape(PARTS, n).copy() for a in read[1:]))


def pop_and_push(x: np.ndarray, code: np.ndarray, heap: np.ndarray, row: np.ndarray, book: Book) -> tuple[int, list[tuple]]:
    """One round over a block, in place: how many parts were popped, and what the moved ones change in the sums."""
    popped, sums = 0, []
    for p, where in enumerate(cut(x.shape[1])):
        start = np.concatenate([[0], np.cumsum(np.bincount(code[p], minlength=len(book.entries[p])))])
        tops = [np.arange(a, a + np.searchsorted(heap[p, a:b], drift, side="right")) for a, b, drift in zip(start, start[1:], book.drift[p]) if a < b]
        taken = np.concatenate(tops) if tops else np.zeros(0, np.int64)
        if not len(taken):
            continue
        popped += len(taken)
        parts = row[p, taken]
        before = code[p, parts].astype(np.int64)
        own, _, key = nearest(x[parts, where], book.entries[p])
        went = own != before
        sums += moved_sums(p, x[parts[went], where], before[went], own[went], len(book.entries[p]))
        code[p, parts] = own
        heap[p, taken] = key + book.drift[p, own]
        keys = heap[p].copy()
        order = push(code[p, row[p]], keys)
        heap[p], row[p] = keys[order], row[p, order]
    return popped, sums


def next_blocks(book: Book) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                x, code, heap, row = opened(b, i)
                popped, sums = pop_and_push(x, code, heap, row, book)
                yield block(b.column("head").slice(i, 1), x, code, heap, row, popped, sums)

    return run


def last_codes(book: Book) -> callable:
    """The last assignment of each block, as a row for each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                x, code, heap, row = opened(b, i)
                pop_and_push(x, code, heap, row, book)
                error = np.zeros(len(x), object)
                for p, where in enumerate(cut(x.shape[1])):
                    gap = x[:, where].astype(object if x.itemsize == 8 else np.int64) - book.entries[p][code[p]].astype(np.int64)
                    error += (gap * gap).sum(1) if gap.shape[1] else 0
                if len(error) and max(error) >= 2**63:
                    raise OverflowError("an error is beyond 64 bits")
                digits = np.ascontiguousarray(code.T).tobytes().hex()
                head = b.column("head").slice(i, 1).flatten()
                texts = [digits[k : k + 2 * PARTS] for k in range(0, len(digits), 2 * PARTS)]
                yield pa.RecordBatch.from_arrays([head.field("vec_id"), head.field("label"), pa.array(texts, pa.string()), pa.array([int(e) for e in error], pa.int64())], ["vec_id", "label", "code", "error"])

    return run


def first_book(vectors: DataFrame, entries: int) -> Book:
    """The parts of the vectors of the smallest ids."""
    ids = [r[0] for r in vectors.filter("vec_id IS NOT NULL").select("vec_id").distinct().orderBy("vec_id").limit(entries).collect()]
    if not ids:
        return Book([])
    kept = vectors.filter(F.col("vec_id").between(min(ids), max(ids))).groupBy("vec_id").agg(F.min("embedding").alias("v"))
    x = whole(np.array([list(r.v) for r in sorted(kept.collect(), key=lambda r: r.vec_id)], np.float64).reshape(len(ids), -1))
    return Book([x[:, where] for where in cut(x.shape[1])])


def moved_book(book: Book, blocks: DataFrame, totals: dict) -> Book:
    """Entries at the floored mean of their parts; totals, kept over the rounds, grow by what the blocks changed."""
    change = blocks.select(F.explode("sums").alias("s")).select("s.*").groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    for r in change.collect():
        n, total = totals.get((r.part, r.entry, r["at"]), (0, 0))
        totals[r.part, r.entry, r["at"]] = n + r.n, total + int(r.total)
    entries = [b.copy() for b in book.entries]
    for (p, e, k), (n, total) in totals.items():
        if n:
            entries[p][e, k] = total // n
    return book.moved(entries)


def compress(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, str, list[DataFrame]]:
    """vec_id, label, code and error of each row of ``vectors`` (vec_id, embedding, label) with a usable vector, the
    digest of the codebooks, and the tables of blocks of each round."""
    if not 0 < entries <= 256:
        raise ValueError("two hexadecimal digits hold at most 256 entries")
    usable = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.filter(F.coalesce(usable, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    sizes = kept.groupBy(F.size("embedding").alias("size")).count().orderBy(F.col("count").desc(), F.col("size").desc()).first()
    width = sizes["size"] if sizes else 0
    fit = kept.filter(F.size("embedding") == width)
    book = first_book(fit, entries)
    none = kept if not book.entries else kept.filter(F.size("embedding") != width)
    rest = none.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    if not book.entries:
        return rest, book.digest(), []
    label = kept.schema["label"].dataType.simpleString()
    schema, totals, tables = f"head array<struct<vec_id: bigint, label: {label}>>, {STATE}", {}, []
    blocks = materialize(fit.mapInArrow(first_blocks(book), schema), "blocks")
    for k in range(rounds):
        tables.append(blocks)
        book = moved_book(book, blocks, totals)
        if k < rounds - 1:
            blocks = materialize(blocks.mapInArrow(next_blocks(book), schema), "blocks")
    codes = blocks.mapInArrow(last_codes(book), f"vec_id bigint, label {label}, code string, error bigint")
    return codes.unionByName(rest), book.digest(), tables


def with_label_error(codes: DataFrame) -> DataFrame:
    """Adds label_error: the error summed over rows with the same label, nulls together."""
    codes = materialize(codes, "codes")
    sums = codes.groupBy("label").agg(F.sum("error").alias("label_error"))
    null = F.col("label").isNull()
    left = codes.withColumns({"_none": null, "_key": F.coalesce(F.col("label").cast("string"), F.lit(""))})
    right = sums.select(null.alias("_none"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("_key"), "label_error")
    if codes.select("label").distinct().count() * 64 <= BROADCAST_BYTES:
        return left.join(F.broadcast(right), ["_none", "_key"]).drop("_none", "_key")
    salt = F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int")  # a label may hold much of all rows
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn("_salt", salt).join(right, ["_none", "_key", "_salt"]).drop("_none", "_key", "_salt")


def op11_vector_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, digest, _ = compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    return with_label_error(codes).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _assign(parts: str, book: str) -> str:
    return f"""SELECT vec_id, part, arg_min(entry, d * 256 + entry) AS entry, min(d) AS d, any_value(v) AS v
    FROM (SELECT p.vec_id, p.part, p.v, b.entry, CAST(list_sum(list_transform(list_zip(p.v, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
          FROM {parts} p JOIN {book} b ON p.part = b.part) GROUP BY vec_id, part"""


def _moved(assigned: str, book: str) -> str:
    return f"""SELECT b.part, b.entry, CASE WHEN n IS NULL THEN b.c ELSE list_transform([s1, s2, s3, s4], lambda s: CAST((s - ((s % n) + n) % n) // n AS BIGINT)) END AS c
    FROM {book} b LEFT JOIN (SELECT part, entry, count(*) AS n, sum(v[1]) AS s1, sum(v[2]) AS s2, sum(v[3]) AS s3, sum(v[4]) AS s4 FROM {assigned} GROUP BY part, entry) m
    ON m.part = b.part AND m.entry = b.entry"""


#: DuckDB, for vectors of 64 components with distinct ids: every part against every entry in every round.
ORACLE = f"""
WITH kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v,
       row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM embeddings
       WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
parts AS MATERIALIZED (SELECT vec_id, part, entry, v[part * 4 + 1 : part * 4 + 4] AS v FROM kept, (SELECT unnest(range({PARTS})) AS part)),
b0 AS MATERIALIZED (SELECT part, entry, v AS c FROM parts WHERE entry < {ENTRIES}),
a0 AS MATERIALIZED ({_assign("parts", "b0")}), b1 AS MATERIALIZED ({_moved("a0", "b0")}),
a1 AS MATERIALIZED ({_assign("parts", "b1")}), b2 AS MATERIALIZED ({_moved("a1", "b1")}),
a2 AS MATERIALIZED ({_assign("parts", "b2")}),
digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b2),
codes AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY vec_id)
SELECT k.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM codes JOIN kept k ON k.vec_id = codes.vec_id, digest
"""
