r"""Language-model scores from a probabilistic suffix tree.

Tokens are runs of anything but ASCII white space, A-Z lower-cased, and an end. The tree models the bytes of
the tokens joined by single spaces, the end as a line feed, so it gives a proper probability to every token
sequence. A state is a context of up to ``depth`` bytes (a parameter, at most 7: a key holds depth + 1 bytes).
Bottom up from the root, a context is retained if its next-symbol counts diverge enough from what its longest
retained suffix predicts (gain in bits against ``penalty`` bits for each of its symbols). Its distribution is
smoothed with that suffix's (Witten-Bell). A text is scored from the longest retained suffix at each byte.

Counts of tokens and of (depth + 1)-grams come from one pass over all training documents; shorter contexts
are sums of longer ones. Penalty and depth are the same at every size: the tree stays a table for each depth, which
gives the score of every gram of the training documents. Neither these scores nor token counts are sent
whole: the ``head`` most frequent tokens and the ``memo`` most frequent grams go to every task, and the other
occurrences join the tables, tokens by their 64-bit hash. Grams that training doesn't have are first scored
by joining them, once each, with the tree depth by depth.

Edge cases: null and empty texts are the end alone; without training documents all counts are zero and the
tree is uniform over bytes; repeated rows, null doc_ids and texts of any length are scored row by row; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.llm.common import fold, materialize, table
from panelforge.llm.hashing import HashTable, word_hashes

DEPTH = 5
END = b"\n"
CHARS_AT_ONCE = 1_000_000
WORD, GRAM, TEXT = 0, 1, 2


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


@dataclass
class Part:
    """A text, or a part of a long one: its words, the bytes before it, and whether the text ends here."""

    words: list[bytes]
    lead: bytes
    last: bool = True

    def body(self) -> bytes:
        return b" ".join(self.words) + (END if self.last else b" ")


def parts(text: str | None, depth: int = DEPTH, most: int = CHARS_AT_ONCE // 8) -> list[Part]:
    """A text in parts of up to ``most`` words; each knows the bytes before it, so parts give what the whole gives."""
    words, lead, out = tokens(text), END * depth, []
    for lo in range(0, max(1, len(words)), most):
        out.append(Part(words[lo : lo + most], lead, lo + most >= len(words)))
        lead = (lead + out[-1].body()[-depth:])[-depth:]
    return out


def word_keys(docs: list[Part]) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative keys of all tokens with their ends, and the number of tokens of each part."""
    flat = [w for p in docs for w in (*p.words, *([END] if p.last else []))]
    return (word_hashes(flat) >> np.uint64(1)).astype(np.int64), np.array([len(p.words) + p.last for p in docs])


def gram_keys(docs: list[Part], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """The ``depth`` bytes before each byte and the byte itself as one integer, and the number of bytes of each part."""
    bodies = [p.body() for p in docs]
    data = np.frombuffer(b"".join(p.lead + t for p, t in zip(docs, bodies)), np.uint8).astype(np.int64)
    sizes = np.array([len(t) for t in bodies])
    keep = np.ones(len(data), bool)
    starts = np.r_[0, np.cumsum(sizes + depth)[:-1]]
    keep[(starts[:, None] + np.arange(depth)).ravel()] = False
    key = np.zeros(len(data) - depth, np.int64)
    for k in range(depth + 1):
        key = (key << 8) | data[k : len(data) - depth + k]
    return key[keep[depth:]], sizes


def some_at_once(texts: list[str | None], depth: int) -> Iterator[tuple[list[int], list[Part]]]:
    """Parts of texts, and the text each is of, of about CHARS_AT_ONCE bytes together."""
    of: list[int] = []
    held: list[Part] = []
    size = 0
    for k, t in enumerate(texts):
        for p in parts(t, depth):
            n = sum(map(len, p.words)) + len(p.words)
            if held and size + n > CHARS_AT_ONCE:
                yield of, held
                of, held, size = [], [], 0
            of.append(k)
            held.append(p)
            size += n
    if held:
        yield of, held


class _Counts:
    """Counts by key, summed up now and then."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, keys: np.ndarray) -> None:
        self.parts.append(np.unique(keys, return_counts=True))
        self.held += len(self.parts[-1][0])

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        keys, of = np.unique(np.concatenate([p[0] for p in self.parts]), return_inverse=True)
        n = np.bincount(of, np.concatenate([p[1] for p in self.parts])).astype(np.int64)
        self.parts, self.held = [], 0
        return keys, n


def gather(docs: DataFrame, depth: int = DEPTH, flush: int = 3_000_000) -> DataFrame:
    """kind, key and n of all tokens and grams of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {WORD: _Counts(), GRAM: _Counts()}

        def out(kind: int) -> Iterator[pa.RecordBatch]:
            if found[kind].parts:
                keys, n = found[kind].merged()
                for lo in range(0, len(keys), 100_000):
                    some = slice(lo, lo + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys[some]), kind, np.int32)), pa.array(keys[some]), pa.array(n[some])], names=["kind", "key", "n"])

        for b in batches:
            texts = b.column(0).to_pylist()
            for _, words in some_at_once(texts, depth):
                found[WORD].add(word_keys(words)[0])
                found[GRAM].add(gram_keys(words, depth)[0])
                for kind, c in found.items():
                    if c.held > flush:
                        yield from out(kind)
        yield from out(WORD)
        yield from out(GRAM)

    counts = docs.select(F.col("text").cast("string")).mapInArrow(run, "kind int, key long, n long")
    return counts.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def suffix_counts(grams: DataFrame, depth: int = DEPTH) -> list[DataFrame]:
    """key and n of the contexts of each depth with a next byte; each is a table, summed from the one below."""
    levels = [grams.select("key", "n")]
    for d in range(depth - 1, -1, -1):
        shorter = levels[-1].groupBy(F.col("key").bitwiseAND((1 << 8 * (d + 1)) - 1).alias("key")).agg(F.sum("n").alias("n"))
        levels.append(materialize(shorter, "suffixes"))
    return levels[::-1]


def grow(levels: list[DataFrame], penalty: float) -> list[DataFrame]:
    """The tree as a table for each depth: key and p, the probability of its last byte; below the root also n, total, kinds and kept (its context is a state)."""
    every = levels[0].sparkSession.range(256).select(F.col("id").alias("key"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))  # 256 rows
    root = every.join(levels[0], "key", "left").select("key", F.coalesce("n", F.lit(0)).alias("n"))
    tree = [root.select("key", ((F.col("n") + 0.5) / (total + 128)).alias("p"))]
    for d in range(1, len(levels)):
        up = tree[-1].select(F.col("key").alias("suffix"), F.col("p").alias("p_up"))
        pairs = levels[d].withColumn("suffix", F.col("key").bitwiseAND((1 << 8 * d) - 1)).join(up, "suffix")
        of = Window.partitionBy(F.shiftrightunsigned("key", 8))  # at most 256 symbols
        pairs = pairs.withColumns({"total": F.sum("n").over(of), "kinds": F.count("*").over(of)})
        gain = F.sum(F.col("n") * F.log2(F.col("n") / F.col("total") / F.col("p_up"))).over(of)
        pairs = pairs.withColumn("kept", gain >= penalty * F.col("kinds"))
        own = (F.col("n") + F.col("kinds") * F.col("p_up")) / (F.col("total") + F.col("kinds"))
        tree.append(materialize(pairs.select("key", "n", "total", "kinds", "kept", F.when(F.col("kept"), own).otherwise(F.col("p_up")).alias("p")), "tree-level"))
    return tree


def _states(level: DataFrame) -> DataFrame:
    """Retained contexts of one depth and the weight of their suffix for symbols they never had."""
    return level.filter("kept").select(F.shiftrightunsigned("key", 8).alias("context"), (F.col("kinds") / (F.col("total") + F.col("kinds"))).alias("weight")).distinct()


def observed(tree: list[DataFrame]) -> DataFrame:
    """key, n and value (log10 probability of the last byte) of the grams of the training documents."""
    return tree[-1].select("key", "n", F.log10("p").alias("value"))


def unobserved(tree: list[DataFrame], keys: DataFrame) -> DataFrame:
    """key and value of any grams, joined with the tree depth by depth from the root."""
    found = keys.join(F.broadcast(tree[0].withColumnRenamed("key", "last")), F.col("key").bitwiseAND(255) == F.col("last")).select("key", "p")
    deepest = len(tree) - 1
    for d in range(1, deepest + 1):
        own = tree[d].select(F.col("key").alias("suffix"), F.col("p").alias("own"))
        suffix = F.col("key") if d == deepest else F.col("key").bitwiseAND((1 << 8 * (d + 1)) - 1)
        found = found.withColumns({"suffix": suffix, "context": F.shiftrightunsigned("key", 8).bitwiseAND((1 << 8 * d) - 1)})
        found = found.join(own, "suffix", "left").join(_states(tree[d]), "context", "left")
        found = found.select("key", F.coalesce("own", F.col("weight") * F.col("p"), "p").alias("p"))
    return found.select("key", F.log10("p").alias("value"))


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The rows with the largest n, by whole classes (eighths of a power of two), as many classes as ``most`` rows hold.

    Only the sizes of the classes, a few hundred numbers, come to the driver; no task sorts all rows.
    """
    level = F.floor(F.log2("n") * 8)
    total, least = 0, None
    for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("rows")).orderBy(F.col("level").desc()).collect():
        total += r["rows"]
        if total > most:
            break
        least = r["level"]
    return counts.filter(level >= least if least is not None else F.lit(False))


def hash_table(rows: DataFrame) -> HashTable:
    """The rows (key, value) as one table; their number is the caller's care. Only the rows pass the driver, each worker builds its table."""
    found = rows.toArrow()
    return HashTable(found.column(0).to_numpy(), found.column(1).to_numpy())


SCORED = "row long, doc_id long, kind int, key long, n_tokens long, n_known long, base_score double, score double"


def score_texts(docs: DataFrame, grams: HashTable, head: HashTable, depth: int = DEPTH) -> DataFrame:
    """A row per text with what the frequent grams and tokens give, and a row per token and per gram that is not among them."""
    shared = docs.sparkSession.sparkContext.broadcast((grams, head))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, head = shared.value
        row = TaskContext.get().partitionId() << 36
        for b in batches:
            texts, ids = b.column(1).to_pylist(), b.column(0)
            for of_text, words in some_at_once(texts, depth):
                # Parts of one text have one row number, and their rows add up.
                rows = row + np.array(of_text)
                doc_ids = ids.take(pa.array(of_text))

                def looked_up(table: HashTable, keys: np.ndarray, sizes: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray, list[pa.RecordBatch]]:
                    """Sum and number of the values that the table has, by text, and the rows of the other keys."""
                    value = table.get(keys)
                    none = np.isnan(value)
                    starts = np.cumsum(sizes) - sizes
                    rest = np.flatnonzero(none)
                    of = np.searchsorted(starts, rest, side="right") - 1
                    m = len(rest)
                    zero, empty = pa.array(np.zeros(m, np.int64)), pa.array(np.zeros(m))
                    some = [pa.RecordBatch.from_arrays([pa.array(rows[of]), doc_ids.take(pa.array(of)), pa.array(np.full(m, kind, np.int32)), pa.array(keys[rest]), zero, zero, empty, empty], names=names)] if m else []
                    return np.add.reduceat(np.where(none, 0, value), starts), np.add.reduceat((~none).astype(np.int64), starts), some

                keys, sizes = word_keys(words)
                base, known, other_words = looked_up(head, keys, sizes, WORD)
                keys, lengths = gram_keys(words, depth)
                score, _, other_grams = looked_up(frequent, keys, lengths, GRAM)
                # Rows of texts get keys of their own, so that they spread over the join's partitions.
                yield pa.RecordBatch.from_arrays([pa.array(rows), doc_ids, pa.array(np.full(len(words), TEXT, np.int32)), pa.array(rows), pa.array(sizes), pa.array(known), pa.array(base), pa.array(score)], names=names)
                yield from other_words
                yield from other_grams
            row += len(texts)

    names = [c.split()[0] for c in SCORED.split(", ")]
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCORED)


def lm_scores(docs: DataFrame, training: DataFrame, head: int = 200_000, penalty: float = 3.0, memo: int = 2_000_000, depth: int = DEPTH) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of each row of docs."""
    if not 1 <= depth <= 7:
        raise ValueError("depth must lie between 1 and 7")
    counts = materialize(gather(training, depth), "counts")
    words = counts.filter(F.col("kind") == WORD).select("key", "n")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tree = grow(suffix_counts(counts.filter(F.col("kind") == GRAM), depth), penalty)
    grams = observed(tree)
    below = total + 0.5 * (distinct + 1)
    words = words.withColumn("value", F.log10((F.col("n") + 0.5) / F.lit(below)))
    tables = [hash_table(most_frequent(c, most).select("key", "value")) for c, most in ((grams, memo), (words, head))]

    scored = materialize(score_texts(docs, *tables, depth), "scored")
    unseen = scored.filter(F.col("kind") == GRAM).select("key").distinct().join(grams.select("key"), "key", "left_anti")
    unseen = unobserved(tree, materialize(unseen, "unseen"))
    values = words.select(F.lit(WORD).alias("kind"), "key", "value")
    for some in (grams, unseen):
        values = values.unionByName(some.select(F.lit(GRAM).alias("kind"), "key", "value"))
    joined = scored.join(values, ["kind", "key"], "left")
    is_word = F.col("kind") == WORD
    term = F.when(is_word, F.coalesce("value", F.log10(F.lit(0.5) / F.lit(below)))).otherwise(F.col("base_score"))
    return joined.groupBy("row", "doc_id").agg(
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(is_word & F.col("value").isNotNull(), 1).otherwise(0)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        F.sum(term).alias("base_score"),
        F.sum(F.when(F.col("kind") == GRAM, F.col("value")).otherwise(F.col("score"))).alias("score"),
    ).drop("row")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm_scores(docs, docs.filter(fold("doc_id", 5) != 1)).withColumn("held_out", fold("doc_id", 5) == 1)
