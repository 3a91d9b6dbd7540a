"""MinHash near-duplicate detection with an LSH forest, links confirmed on full shingle sets.

1. Each text becomes its set of 5-word shingles (64-bit hashes), a digest of the whole set, and a MinHash
   signature. Documents with equal sets form a class; one representative goes on, so exact copies never
   meet in pairs.
2. The forest has ``TREES`` sorted signature orders of ``LEVELS`` hashes each; together they hold the whole
   signature. Every tree is range-partitioned and sorted by its own hashes. Neighbours in an order have the
   longest common prefixes, so each row is compared with both of its own, however short the prefix (a row
   alone in its region still meets the nearest ones). Rows that share a prefix of ``LEAST_DEPTH`` hashes form a
   region; where it holds more than ``REGION`` rows, its depth grows until its parts do not. Rows of a region
   that are not connected by their neighbours are compared with all of it. Rows with one and the same whole
   order are compared in runs of ``REGION`` that overlap. What passes is linked if the signatures agree often
   enough, five deviations below the threshold. Regions that lie across the edge of two partitions are taken
   from the rows at the edge (at most ``REGION`` on each side), in a second, small pass.
3. Connected candidates are fetched once with their full sets and compared exactly, by an inverted index in
   blocks of bounded size. Of a large group each row first meets one block of the group and the group's centres;
   only rows that are then still apart from the group's largest part go on. Where they are more than ``FEW``, they
   meet the group by sharp signatures, one bit of each of ``BITS`` further hashes, and only pairs whose signatures
   agree (five deviations below the threshold again) are compared with full sets. Rows with over ``PARTNERS`` such
   partners in a block, and the rows of groups with few rows apart, meet all blocks with full sets. Links that pass
   give the components.

A row takes part in ``TREES`` orders whatever the size of its cluster, so nothing grows with pairs. A link at the
threshold is missed only if its two texts are apart in every tree; README gives the measured recall.

Edge cases: null, empty and blank texts have no shingles and are linked with nothing; texts under five words
have one shingle, the whole; rows that share a doc_id are one node, whatever their texts; rows with a null doc_id
are linked with nothing and kept; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.common import BROADCAST_BYTES, materialize, table, unite
from panelforge.llm.components import connected
from panelforge.llm.hashing import word_hashes

SHINGLE = 5
TREES, LEVELS, LEAST_DEPTH = 12, 10, 2
HASHES = TREES * LEVELS
REGION = 1024
#: Agreeing signature places (of HASHES, one byte each) under which a pair cannot reach 0.75: five deviations below.
AGREE = 66
PERCENT = 75
#: Rows of a block of full sets, and how many blocks' worth of rows a group may have to be compared as a whole at once.
BLOCK, CENTRES = 192, 8
#: Bits of a sharp signature, and equal bits under which a pair cannot reach 0.75: five deviations below
#: BITS * 1.75 / 2; of the first half, HALF.
BITS, SHARP, HALF = 8192, 7018, 3478
#: Rows apart that a group may have to be compared with full sets at once; partners a row may have in a block of sharp
#: signatures to be compared pair by pair; rows of such a block.
FEW, PARTNERS, SHARP_BLOCK = 64, 8, 8192

_rng = np.random.default_rng(20)
PLACES = (_rng.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
MULTIPLY = _rng.integers(0, 1 << 31, (HASHES, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
ADD = _rng.integers(0, 1 << 32, (HASHES, 1), dtype=np.uint64).astype(np.uint32)
SHARP_MULTIPLY = _rng.integers(0, 1 << 31, (BITS, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
SHARP_ADD = _rng.integers(0, 1 << 32, (BITS, 1), dtype=np.uint64).astype(np.uint32)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    w = word_hashes(words)
    if not len(w):
        return w
    if len(w) < SHINGLE:
        return _mix((w * PLACES[: len(w)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(w)))
    n = len(w) - SHINGLE + 1
    h = w[:n] * PLACES[0]
    for k in range(1, SHINGLE):
        h += w[k : n + k] * PLACES[k]
    return np.unique(_mix(h))


def signature(s: np.ndarray) -> np.ndarray:
    x = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(x), 4096):
        np.minimum(out, (MULTIPLY * x[None, lo : lo + 4096] + ADD).min(1), out=out)
    return out


def sharp_signature(s: np.ndarray) -> bytes:
    """One bit of each of BITS smallest hashes; two sets agree in (1 + similarity) / 2 of them."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    low = np.full(BITS, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(x), 256):
        np.minimum(low, (SHARP_MULTIPLY * x[None, lo : lo + 256] + SHARP_ADD).min(1), out=low)
    return np.packbits(((low * np.uint32(0x9E3779B1)) >> np.uint32(31)).astype(np.uint8)).tobytes()


def order_bytes(sig: np.ndarray) -> bytes:
    """Two bytes of each hash, big-endian, so that the bytes of a tree sort as its hashes do."""
    return (sig ^ (sig >> np.uint32(16))).astype(">u2").tobytes()


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_key, orders (the trees' keys) and sig (a byte for each hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, set_keys, orders, sigs = [], [], [], []
            for text in b.column(1).to_pylist():
                s = shingles(text)
                sizes.append(len(s))
                if len(s):
                    h = signature(s)
                    set_keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    orders.append(order_bytes(h))
                    sigs.append((h ^ (h >> np.uint32(8))).astype(np.uint8).tobytes())
                else:
                    for c in (set_keys, orders, sigs):
                        c.append(None)
            cols = [b.column(0), pa.array(sizes, pa.int64()), *(pa.array(c, pa.binary()) for c in (set_keys, orders, sigs))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_shingles", "set_key", "orders", "sig"])

    schema = "doc_id long, n_shingles long, set_key binary, orders binary, sig binary"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


class Union:
    def __init__(self, n: int):
        self.parent, self.parts = list(range(n)), n

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.parent[max(i, j)] = min(i, j)
            self.parts -= 1
        return i != j

    def stars(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Each member of a part with the part's smallest id: what a part says, in the fewest hops."""
        root = np.array([self.find(i) for i in range(len(ids))])
        order = np.lexsort((ids, root))
        first = order[_bounds([root[order]])[:-1]]
        centre = np.empty(len(ids), np.int64)
        centre[root[first]] = first
        return [(i, int(c)) for i, c in enumerate(centre[root].tolist()) if i != c]


def by_group(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of whole groups of a partition that is sorted by its first ``keys`` columns."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        end = tuple(c[-1] for c in columns)
        same = np.logical_and.reduce([c == e for c, e in zip(columns, end)])
        cut = int(np.argmax(same))  # the last group of a batch may go on in the next
        if cut or (last is not None and tuple(c[0] for c in columns) != last):
            done = [*held, b.slice(0, cut)] if cut else held
            if done:
                yield pa.Table.from_batches(done)
            held = []
        held.append(b.slice(cut))
        last = end
    if held:
        yield pa.Table.from_batches(held)


def _bounds(columns: list[np.ndarray]) -> np.ndarray:
    """Group starts, and the end."""
    n = len(columns[0])
    new = np.logical_or.reduce([c[1:] != c[:-1] for c in columns]) if n > 1 else np.zeros(0, bool)
    return np.r_[0, np.flatnonzero(new) + 1, n]


LINKS = "a long, b long"


def _links(pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a = np.concatenate([p[0] for p in pairs] or [np.zeros(0, np.int64)])
    b = np.concatenate([p[1] for p in pairs] or [np.zeros(0, np.int64)])
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], names=["a", "b"])


def region_links(ids: np.ndarray, sigs: np.ndarray) -> list[tuple[int, int]]:
    """The parts that pairs with agreeing signatures form in a region, as stars; neighbours in the order first."""
    parts = Union(len(ids))
    for k in np.flatnonzero((sigs[1:] == sigs[:-1]).sum(1) >= AGREE).tolist():
        parts.join(k, k + 1)
    if parts.parts == 1:
        return parts.stars(ids)
    root = np.array([parts.find(i) for i in range(len(ids))])
    largest = np.bincount(root).argmax()
    for i in np.flatnonzero(root != largest).tolist():
        for j in np.flatnonzero((sigs == sigs[i]).sum(1) >= AGREE).tolist():
            parts.join(i, j)
        if parts.parts == 1:
            break
    return parts.stars(ids)


def regions(common: np.ndarray, done: int = 0) -> Iterator[tuple[int, int]]:
    """Bounds of the regions of more than two rows; common: hashes that each row shares with the next.

    A region deepens until it holds at most REGION rows. Regions that end by ``done`` are left out.
    """
    todo = [(0, len(common) + 1, LEAST_DEPTH)]
    while todo:
        lo, hi, depth = todo.pop()
        at = np.r_[lo, lo + 1 + np.flatnonzero(common[lo : hi - 1] < depth), hi]
        for k in np.flatnonzero(np.diff(at) > 2).tolist():
            a, b = int(at[k]), int(at[k + 1])
            if b <= done:
                continue
            if b - a <= REGION:
                yield a, b
            elif depth < LEVELS:
                todo.append((a, b, depth + 1))
            else:
                yield from ((i, min(i + REGION, b)) for i in range(a, b - 1, REGION - 1))


SMALL = 8


def order_links(group: np.ndarray, keys: np.ndarray, ids: np.ndarray, sigs: np.ndarray, done: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links of a run of a sorted order whose first ``done`` rows were seen before; group: the tree."""
    same = group[1:] == group[:-1]
    common = np.where(same, np.logical_and.accumulate(keys[1:] == keys[:-1], axis=1).sum(1), -1)
    near = np.flatnonzero(same & ((sigs[1:] == sigs[:-1]).sum(1) >= AGREE))
    near = near[near + 1 >= done]
    of, region = np.full(len(ids), -1), np.full(len(ids), -1)
    pairs = []
    for n, (lo, hi) in enumerate(regions(common, done)):
        region[lo:hi] = n
        if hi - lo <= SMALL:
            of[lo:hi] = n
        else:
            found = np.array(region_links(ids[lo:hi], sigs[lo:hi]), np.int64).reshape(-1, 2)
            pairs.append((ids[lo:hi][found[:, 0]], ids[lo:hi][found[:, 1]]))
    near = near[(region[near] < 0) | (region[near] != region[near + 1]) | (of[near] >= 0)]  # larger regions have linked theirs
    pairs.append((ids[near], ids[near + 1]))
    for lag in range(2, SMALL):
        at = np.flatnonzero((of[lag:] == of[:-lag]) & (of[lag:] >= 0))
        if not len(at):
            break
        at = at[(sigs[at] == sigs[at + lag]).sum(1) >= AGREE]
        pairs.append((ids[at], ids[at + lag]))
    return pairs


def _fixed(column: pa.Array, kind: str, width: int) -> np.ndarray:
    """A binary column whose values all have one length, as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


HEAD, TAIL, WHOLE = 0, 1, 2
ORDERED = "a long, b long, part int, place long, edge int, tree int, key binary, sig binary"


def links_in_order(members: DataFrame, edges: bool) -> DataFrame:
    """Links (a, b) of partitions sorted by (tree, key); members: tree, key, id, sig.

    With ``edges`` also the rows of each partition's first and last region, at most REGION of each (part, place,
    HEAD or TAIL), or all rows (WHOLE) of a partition that is one region of at most twice as many.
    """
    names = [c.split()[0] for c in ORDERED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: list[np.ndarray] | None = None
        head: list[np.ndarray] | None = None
        n = 0

        def edge(rows: list[np.ndarray], first: int, kind: int) -> pa.RecordBatch:
            m = len(rows[2])
            of = [pa.array(rows[2]), pa.nulls(m, pa.int64()), pa.array(np.full(m, part, np.int32)), pa.array(np.arange(first, first + m)), pa.array(np.full(m, kind, np.int32)), pa.array(rows[0].astype(np.int32))]
            return pa.RecordBatch.from_arrays([*of, *(pa.array([x.tobytes() for x in rows[k]], pa.binary()) for k in (1, 3))], names=names)

        for b in batches:
            if not b.num_rows:
                continue
            new = [b.column(0).to_numpy(), _fixed(b.column(1), ">u2", LEVELS), b.column(2).to_numpy(), _fixed(b.column(3), np.uint8, HASHES)]
            done = 0 if held is None else len(held[2])
            rows = new if held is None else [np.concatenate(p) for p in zip(held, new)]
            n += b.num_rows
            links = _links(order_links(*rows, done))
            m = links.num_rows
            yield pa.RecordBatch.from_arrays([*links.columns, *(pa.nulls(m, t) for t in (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=names)
            if edges and (head is None or len(head[2]) < 2 * REGION):
                head = [c[: 2 * REGION] for c in (new if head is None else [np.concatenate(p) for p in zip(head, new)])]
            held = [c[-REGION:].copy() for c in rows]
        if edges and held is not None:
            alike = [(r[0] == r[0][k]) & (r[1][:, :LEAST_DEPTH] == r[1][k, :LEAST_DEPTH]).all(1) for r, k in ((head, 0), (held, -1))]
            if n <= 2 * REGION and alike[0].all():
                yield edge(head, 0, WHOLE)
            else:
                first, last = min(int(alike[0].sum()), REGION), int(alike[1].sum())
                yield edge([c[:first] for c in head], 0, HEAD)
                yield edge([c[len(c) - last :] for c in held], n - last, TAIL)

    return members.select("tree", "key", "id", "sig").mapInArrow(run, ORDERED)


def candidate_links(one: DataFrame, rows: int) -> DataFrame:
    """Links of all trees, as stars and neighbours; one: id, orders, sig, of which there are ``rows``."""
    step = 2 * LEVELS
    members = one.select("id", "sig", F.posexplode(F.array(*(F.substring("orders", step * t + 1, step) for t in range(TREES)))).alias("tree", "key"))
    # The id ends ties, so that rows with one and the same order spread over partitions as well.
    parts = max(1, -(-rows * TREES // (256 * REGION)))
    order = members.repartitionByRange(max(parts, int(one.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "tree", "key", "id").sortWithinPartitions("tree", "key", "id")
    found = materialize(links_in_order(order, True), "orders")
    edges = found.filter("part IS NOT NULL")
    # One small row for each partition of the order: those that are one region join the runs of rows at their two edges.
    kinds = {r["part"]: r["edge"] for r in edges.filter(F.col("edge") != TAIL).groupBy("part").agg(F.first("edge").alias("edge")).collect()}
    runs, n = {}, 0
    for part in sorted(kinds):
        runs[part] = n
        n += kinds[part] != WHOLE

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            run = [runs[p] + (e == TAIL) for p, e in zip(b.column(0).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(run, pa.int32()), *b.columns], names=["run", *b.schema.names])

    edges = edges.select("part", "place", "edge", "tree", "key", "sig", "a").mapInArrow(tag, "run int, part int, place long, edge int, tree int, key binary, sig binary, a long")
    edges = edges.repartition("run").sortWithinPartitions("run", "part", "place")
    edges = edges.select((F.col("run") * TREES + F.col("tree")).cast("int").alias("tree"), "key", F.col("a").alias("id"), "sig")
    links = found.filter("part IS NULL").select("a", "b").unionByName(links_in_order(edges, False).select("a", "b")).filter("a < b")
    # A row has a few links to smaller ids in each tree: it keeps the one to the smallest, which takes over the others.
    links = links.groupBy("b").agg(F.array_sort(F.collect_set("a")).alias("smaller"))
    smallest = F.get("smaller", F.lit(0))
    return links.select(smallest.alias("a"), F.explode(F.concat(F.array("b"), F.slice("smaller", F.lit(2), F.size("smaller")))).alias("b")).distinct()


def exact_links(ids: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """The parts that pairs with 100 * intersection >= PERCENT * union form, as stars."""
    n = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), n)
    order = np.argsort(flat, kind="stable")
    value, own = flat[order], owner[order]
    bounds = _bounds([value])
    count = np.diff(bounds)
    of = np.empty(len(flat), np.int64)
    of[order] = np.repeat(np.arange(len(count)), count)
    at = np.r_[0, np.cumsum(n)]
    parts = Union(len(sets))
    for i in range(len(sets)):
        g = of[at[i] : at[i + 1]]
        g = g[count[g] > 1]
        size = count[g]
        places = np.repeat(bounds[g] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        shared = np.bincount(own[places], minlength=len(sets))
        for j in np.flatnonzero(100 * shared >= PERCENT * (n[i] + n - shared)).tolist():
            parts.join(i, j)
        if parts.parts == 1:
            break
    return parts.stars(ids)


def confirmed_links(members: DataFrame) -> DataFrame:
    """Links that hold on full sets; members: cc, i, j (blocks), id, set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_group(batches, 3):
            bounds = _bounds([t.column(i).to_numpy() for i in range(3)])
            ids, sets = t.column(3).to_numpy(), t.column(4)
            pairs = []
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                some = [np.frombuffer(s, np.uint64) for s in sets.slice(lo, hi - lo).to_pylist()]
                found = np.array(exact_links(ids[lo:hi], some), np.int64).reshape(-1, 2)
                pairs.append((ids[lo:hi][found[:, 0]], ids[lo:hi][found[:, 1]]))
            yield _links(pairs)

    key = ("cc", "i", "j")
    return members.repartition(*key).sortWithinPartitions(*key).select(*key, "id", "set").mapInArrow(run, LINKS)


def blocks_of(size: Column) -> Column:
    """Blocks of a group of full sets: up to BLOCK rows stay whole; then 64 rows each, more in groups over 3,000 (at most 48 blocks), up to 2,048."""
    rows = F.when(size <= BLOCK, F.lit(BLOCK)).otherwise(F.least(F.greatest(F.ceil(size / 48), F.lit(64)), F.lit(2048)))
    return F.greatest(F.ceil(size / rows), F.lit(1)).cast("int")


def _own(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("id"), blocks).cast("int")


def _sets(docs: DataFrame) -> DataFrame:
    """id, cc, size and set of each text; rows that repeat an id and text count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                sets = pa.array([shingles(t).tobytes() for t in part.column(3).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:3], sets], names=["id", "cc", "size", "set"])

    sets = docs.select("id", "cc", "size", "text").mapInArrow(run, "id long, cc long, size long, set binary")
    return sets.groupBy("id", F.xxhash64("set").alias("digest")).agg(*(F.first(c).alias(c) for c in ("cc", "size", "set"))).drop("digest")


def partners(ids: np.ndarray, labels: np.ndarray, apart: np.ndarray, visits: np.ndarray, bits: np.ndarray) -> tuple[list[int], list[int | None]]:
    """For each visitor of a block the residents of other parts whose sharp signatures agree; None if over PARTNERS.

    Two rows that are both apart meet once, as visitor and resident of the smaller id.
    """
    rest = np.flatnonzero(~visits)
    rest = rest[np.lexsort((ids[rest], apart[rest]))]
    own, own_labels, own_bits = ids[rest], labels[rest], bits[rest]
    linked, half = int((~apart[rest]).sum()), bits.shape[1] // 2
    a: list[int] = []
    b: list[int | None] = []
    for v in np.flatnonzero(visits).tolist():
        to = linked + int(np.searchsorted(own[linked:], ids[v]))
        near = np.flatnonzero(np.bitwise_count(own_bits[:to, :half] ^ bits[v, :half]).sum(1, dtype=np.uint16) <= BITS // 2 - HALF)
        near = near[own_labels[near] != labels[v]]
        near = near[np.bitwise_count(own_bits[near] ^ bits[v]).sum(1, dtype=np.uint16) <= BITS - SHARP]
        found = [None] if len(near) > PARTNERS else own[near].tolist()
        a += [int(ids[v])] * len(found)
        b += found
    return a, b


def sharp_partners(rows: DataFrame) -> DataFrame:
    """cc, a, b: pairs to be compared, or a row a that has too many in a block (b null); rows: cc, id, set, size, label, apart, rows (apart)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = [sharp_signature(np.frombuffer(s, np.uint64)) for s in b.column(6).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(bits, pa.binary())], names=[*names, "bits"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_group(batches, 3):
            bounds = _bounds([t.column(i).to_numpy() for i in range(3)])
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                g = t.slice(lo, hi - lo)
                cc, ids, labels, apart, visits = (g.column(k).to_numpy() for k in (0, 3, 4, 5, 6))
                a, b = partners(ids, labels, apart, visits, _fixed(g.column(7), np.uint64, BITS // 64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), cc[0])), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["cc", "a", "b"])

    names = ["cc", "id", "size", "label", "apart", "rows"]
    signed = rows.select(*names, "set").mapInArrow(sign, "cc long, id long, size long, label long, apart boolean, rows long, bits binary")
    signed = materialize(signed, "sharp")
    blocks = F.ceil(F.col("size") / SHARP_BLOCK).cast("int")
    parts = F.ceil(F.col("rows") / 2048).cast("int")
    visit = signed.filter("apart").withColumn("i", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("j", F.pmod(F.xxhash64(F.lit(3), "id"), parts).cast("int"))
    home = signed.withColumn("i", _own(blocks)).withColumn("j", F.explode(F.sequence(F.lit(0), parts - 1)))
    key = ("cc", "i", "j")
    both = unite([x.select(*key, "id", "label", "apart", F.lit(v).alias("visits"), "bits") for x, v in ((visit, True), (home, False))])
    return both.repartition(*key).sortWithinPartitions(*key).mapInArrow(meet, "cc long, a long, b long")


def pair_links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that hold on full sets; sets: id, set. A row of many pairs goes out once for each 1,024 of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            left, right = ([np.frombuffer(s, np.uint64) for s in t.column(k).to_pylist()] for k in (2, 3))
            both = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(left, right)]
            holds = np.array([100 * n >= PERCENT * (len(x) + len(y) - n) for n, x, y in zip(both, left, right)], bool)
            ids = [t.column(k).to_numpy()[holds] for k in (0, 1)]
            yield _links([(ids[0], ids[1])])

    copies = pairs.groupBy("b").agg(F.ceil(F.count("*") / 1024).cast("int").alias("copies"))
    pairs = pairs.join(copies, "b").withColumn("copy", F.pmod(F.xxhash64("a"), F.col("copies")).cast("int"))
    right = sets.withColumnRenamed("id", "b").join(copies, "b").select("b", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.col("set").alias("right"))
    pairs = pairs.join(right, ["b", "copy"]).join(sets.select(F.col("id").alias("a"), F.col("set").alias("left")), "a")
    return pairs.select("a", "b", "left", "right").mapInArrow(run, LINKS)


def exact_components(sets: DataFrame) -> DataFrame:
    """Links that hold on full sets, enough to connect all that are connected; sets: id, cc (candidate group), size (of it), set."""
    sets = materialize(sets, "sets")
    blocks = blocks_of(F.col("size"))
    small = sets.filter(blocks == 1).select("cc", F.lit(0).alias("i"), F.lit(0).alias("j"), "id", "set")
    large = sets.filter(blocks > 1).withColumn("blocks", blocks)
    groups = materialize(large.groupBy("cc").agg(F.first("blocks").alias("blocks")), "large-groups")
    few = F.broadcast if groups.count() * CENTRES * 64 <= BROADCAST_BYTES else lambda df: df  # what has CENTRES rows a large group at most
    # Centres: the rows with the smallest hashes in each of CENTRES classes of ids; they go to every block.
    h = F.xxhash64(F.lit(7), "id")
    centres = large.groupBy("cc", F.pmod(h, F.lit(CENTRES)).alias("class")).agg(F.min(F.struct(h.alias("h"), "id")).alias("r")).select("cc", "r.id")
    everywhere = large.join(few(centres), ["cc", "id"], "left_semi").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    first = large.withColumn("i", _own(F.col("blocks")))
    first = unite([x.select("cc", "i", F.lit(-1).alias("j"), "id", "set") for x in (everywhere, first)]).dropDuplicates(["cc", "i", "id"])
    links = materialize(confirmed_links(small.unionByName(first)).distinct(), "near-links")

    # Of large groups, rows outside the largest part found so far go on.
    parts = connected(links, "near-parts")
    placed = large.select("cc", "id").distinct().join(parts.withColumnRenamed("node", "id"), "id", "left").select("cc", "id", F.coalesce("label", "id").alias("label"))
    best = placed.groupBy("cc", "label").agg(F.count("*").alias("rows")).groupBy("cc").agg(F.max(F.struct("rows", "label")).alias("best"))
    placed = materialize(placed.join(few(best), "cc").select("cc", "id", "label", (F.col("label") != F.col("best.label")).alias("apart")), "placed")
    apart = placed.filter("apart").select("cc", "id")
    counts = materialize(apart.groupBy("cc").agg(F.count("*").alias("rows")), "rows-apart")
    if counts.isEmpty():
        return links
    loose = counts.filter(F.col("rows") > FEW)
    if not loose.isEmpty():
        met = materialize(sharp_partners(large.join(placed, ["cc", "id"]).join(few(loose), "cc")), "partners")
        links = links.unionByName(pair_links(met.filter("b IS NOT NULL").select("a", "b").distinct(), large.select("id", "set")))
        dense = met.filter("b IS NULL").select("cc", F.col("a").alias("id"))
        apart = materialize(apart.join(few(loose), "cc", "left_anti").unionByName(dense).distinct(), "dense")
    apart = materialize(large.join(apart, ["cc", "id"], "left_semi"), "apart")
    # A block takes its visitors in parts of about 2,048, and its own rows once for each part.
    visitors = apart.groupBy("cc").agg(F.ceil(F.count("*") / 2048).cast("int").alias("parts"))
    meet = apart.join(few(visitors), "cc").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    meet = meet.withColumn("j", F.pmod(F.xxhash64(F.lit(3), "id"), F.col("parts")).cast("int"))
    home = large.join(few(visitors), "cc").withColumn("i", _own(F.col("blocks"))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    again = unite([x.select("cc", "i", "j", "id", "set") for x in (meet, home)]).dropDuplicates(["cc", "i", "j", "id"])
    return links.unionByName(confirmed_links(again)).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable over links) and kept."""
    signed = materialize(sign(docs), "signatures")
    with_set = signed.filter(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull())
    classes = materialize(with_set.groupBy("set_key").agg(F.min("doc_id").alias("id")), "classes")
    one = with_set.join(classes.select("set_key", F.col("id").alias("doc_id")), ["set_key", "doc_id"]).dropDuplicates(["set_key", "doc_id"])
    one = materialize(one.select(F.col("doc_id").alias("id"), "orders", "sig"), "representatives")

    links = materialize(candidate_links(one, one.count()), "candidates")
    together = connected(links, "together")
    sizes = together.groupBy("label").agg(F.count("*").alias("size"))
    together = together.join(sizes, "label").select(F.col("node").alias("id"), F.col("label").alias("cc"), "size")
    together = materialize(together, "candidate-groups")
    if together.count() * 64 <= BROADCAST_BYTES:
        together = F.broadcast(together)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(together, "id")
    links = exact_components(_sets(texts))

    # Classes of one doc_id with several texts are one node.
    several = signed.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(*(f(F.coalesce("set_key", F.lit(b""))).alias(n) for f, n in ((F.min, "lo"), (F.max, "hi"))))
    several = materialize(several.filter("lo <> hi").select("doc_id"), "several")
    of_class = with_set.join(several, "doc_id", "left_semi").select("doc_id", "set_key").distinct().join(classes, "set_key")
    own = of_class.groupBy("doc_id").agg(F.min("id").alias("a"))
    links = links.unionByName(own.join(of_class, "doc_id").select("a", F.col("id").alias("b")).distinct())
    components = connected(links, "components")

    named = classes.join(components.withColumnRenamed("node", "id"), "id", "left").select("set_key", F.coalesce("label", "id").alias("component_id"))
    found = signed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key")).join(named, "set_key", "left")
    shared = own.join(components.withColumnRenamed("node", "a"), "a", "left").select("doc_id", F.coalesce("label", "a").alias("of_doc"))
    found = found.join(shared, "doc_id", "left")
    component = F.coalesce("of_doc", "component_id", "doc_id")
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
