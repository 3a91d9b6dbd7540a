"""Benchmark decontamination: exact windows of benchmark items found in documents by a prefix-filtered join.

An item's windows are its runs of ``width`` words (a shorter item is one window). To contain a window a
text must contain all of its words, so one word is a necessary prefix; taking the window's rarest word,
by its count over all documents, makes the fewest candidates. Document words join that prefix word; its
place in the window fixes where the window would start (positional bound) and end (length bound); the
window's words are then compared with the document's. DataFrame functions only.

The window and word tables go to every task only while their text is under ``broadcast_bytes``; larger
benchmarks take shuffled joins: document words alone meet the prefixes, those that are one come back to their document,
whose words are cut around them, and only these few words meet the windows. Prefixes that many documents hold are salted.

Edge cases: a null or empty text has no words; items without words are ignored, and repeated items count
once; windows of an item without an id count as hits, but the item isn't listed; every row is a document of its
own, also where rows repeat a doc_id or have none; an empty benchmark leaves every document clean; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.common import BROADCAST_BYTES, alnum_words, materialize, table

#: A word no text can hold; each document gets it once, so that documents without a hit keep their row.
DOCUMENT = "\x00document"

#: Occurrences over which a prefix word is salted, and the salts it gets.
FREQUENT, SALTS = 100_000, 64


def item_windows(items: DataFrame, width: int) -> DataFrame:
    """window_words, n (their number) and the sorted ids of the items they occur in."""
    words = items.select(F.col("item_id").cast("string").alias("item_id"), alnum_words(F.col("text")).alias("w"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - width, F.lit(0)))
    windows = words.filter(F.size("w") > 0).select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, width))).alias("window_words"))
    return windows.groupBy("window_words").agg(F.collect_set("item_id").alias("items")).withColumn("n", F.size("window_words"))


def _sized(df: DataFrame, size: Column, limit: int) -> tuple[DataFrame, bool]:
    """df, to be broadcast if the sum of its sizes is within the limit."""
    total = df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    return (F.broadcast(df), True) if total <= limit else (df, False)


def rarest_word(windows: DataFrame, words: DataFrame, limit: int) -> DataFrame:
    """windows with their rarest word over all documents (``prefix``) and its place (``at``, from 0)."""
    vocabulary = windows.select(F.explode("window_words").alias("word")).distinct()
    vocabulary, small = _sized(vocabulary, F.octet_length("word") + 16, limit)
    counts = words.select(F.explode("w").alias("word")).join(vocabulary, "word").groupBy("word").agg(F.count("*").alias("c"))
    if small:
        counts = F.broadcast(counts)  # no more words than the vocabulary
    placed = windows.select("window_words", F.posexplode("window_words").alias("at", "word"))
    ranked = placed.join(counts, "word", "left").groupBy("window_words").agg(F.min(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "word", "at")).alias("r"))
    return windows.join(ranked, "window_words").select("window_words", "items", "n", F.col("r.word").alias("prefix"), F.col("r.at").alias("at"), F.col("r.c").alias("c"))


def find_windows(docs: DataFrame, items: DataFrame, width: int = 10, broadcast_bytes: int = BROADCAST_BYTES, frequent: int = FREQUENT) -> DataFrame:
    """row, doc_id, n_words and, for each hit, start and end (words, end exclusive) and items; one row without a hit per document."""
    windows = materialize(item_windows(items, width), "windows")
    words = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", alnum_words(F.col("text")).alias("w"))
    windows = materialize(rarest_word(windows, words, broadcast_bytes), "prefixes")
    windows, whole = _sized(windows, F.octet_length(F.concat_ws(" ", "window_words")) + F.size("items") * 32 + 64, broadcast_bytes)
    start = F.col("p") - F.col("at")
    fits = (start >= 0) & (start + F.col("n") <= F.col("size"))
    hit = F.struct(start.alias("s"), (start + F.col("n")).alias("e"))
    if whole:
        spark = docs.sparkSession
        none = {"window_words": "array<string>", "items": "array<string>", "n": "int", "at": "int", "c": "long"}
        marker = spark.range(1).select(*(F.lit(None).cast(t).alias(c) for c, t in none.items()), F.lit(DOCUMENT).alias("prefix"))
        tokens = words.select("row", "doc_id", "w", F.posexplode(F.concat("w", F.array(F.lit(DOCUMENT)))).alias("p", "prefix"))
        joined = tokens.join(F.broadcast(windows.unionByName(marker)), "prefix").withColumn("size", F.size("w"))
        is_document = F.col("prefix") == DOCUMENT
        same = fits & (F.slice("w", F.greatest(start, F.lit(0)) + 1, F.col("n")) == F.col("window_words"))
        return joined.filter(is_document | same).select("row", "doc_id", F.when(is_document, F.col("size")).alias("n_words"), F.when(~is_document, hit).alias("span"), F.when(~is_document, F.col("items")).alias("items"))

    # Words meet the prefixes by themselves; where they are one, a document's words are cut around them once, in its own row.
    salts = F.when(F.col("c") > frequent, F.lit(SALTS)).otherwise(F.lit(1))
    prefixes = materialize(windows.groupBy("prefix").agg(F.max(salts).alias("salts")), "salted-prefixes")
    often, _ = _sized(prefixes.filter("salts > 1"), F.octet_length("prefix") + 16, broadcast_bytes)  # the prefixes that documents hold often are few
    tokens = words.select("row", F.posexplode("w").alias("p", "prefix")).join(often, "prefix", "left")
    tokens = tokens.select("row", "p", "prefix", F.pmod(F.xxhash64("row", "p"), F.coalesce("salts", F.lit(1))).alias("salt"))
    dealt = prefixes.select("prefix", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("salts") - 1).cast("long"))).alias("salt"))
    places = tokens.join(dealt, ["prefix", "salt"], "left_semi").groupBy("row").agg(F.collect_list(F.struct("p", "prefix", "salt")).alias("places"))  # of one document
    base = lambda x: F.greatest(x["p"] - width + 1, F.lit(0))
    cut = F.transform("places", lambda x: F.struct(x["p"].alias("p"), x["prefix"].alias("prefix"), x["salt"].alias("salt"), base(x).alias("base"), F.slice("w", base(x) + 1, 2 * width - 1).alias("w")))
    near = words.join(places, "row").select("row", "doc_id", F.size("w").alias("size"), F.explode(cut).alias("x")).select("row", "doc_id", "size", "x.*")
    copies = windows.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), (salts - 1).cast("long"))))
    same = fits & (F.slice("w", F.greatest(start - F.col("base"), F.lit(0)) + 1, F.col("n")) == F.col("window_words"))
    hits = near.join(copies, ["prefix", "salt"]).filter(same).select("row", "doc_id", F.lit(None).cast("int").alias("n_words"), hit.alias("span"), "items")
    return hits.unionByName(words.select("row", "doc_id", F.size("w").alias("n_words"), F.lit(None).cast("struct<s:int,e:int>").alias("span"), F.lit(None).cast("array<string>").alias("items")))


def decontaminate(docs: DataFrame, items: DataFrame, width: int = 10, broadcast_bytes: int = BROADCAST_BYTES, frequent: int = FREQUENT) -> DataFrame:
    """One row per row of docs: words, words inside a window, items with windows in it and the digest of their ids."""
    hits = find_windows(docs, items, width, broadcast_bytes, frequent)
    # A document's spans are at most its own words, its items at most the benchmark's: both groups are bounded.
    by_doc = hits.groupBy("row", "doc_id").agg(F.max("n_words").cast("long").alias("n_words"), F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("found"))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("hit"))
    covered = F.aggregate("spans", zero, lambda a, x: F.struct(F.greatest(a["end"], x["e"]).alias("end"), (a["hit"] + F.greatest(F.lit(0), x["e"] - F.greatest(a["end"], x["s"]))).alias("hit")))
    return by_doc.select(
        "doc_id",
        "n_words",
        covered["hit"].cast("long").alias("n_hit"),
        F.size("found").cast("long").alias("n_items"),
        F.sha2(F.array_join("found", ",").cast("binary"), 256).alias("items_sha256"),
        (covered["hit"] > 0).alias("contaminated"),
    )


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: DuckDB: every window of every document is compared with every item window.
ORACLE = r"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
items AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, w[i:i + 9] AS win, least(len(w), 10) AS n
  FROM items, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT r, n, i, w[i:i + n - 1] AS win
  FROM words, sizes, unnest(range(1, greatest(len(w) - n + 1, 0) + 1)) AS t(i)),
hits AS (SELECT DISTINCT g.r, g.i, g.n, v.item_id FROM grams g JOIN windows v ON g.win = v.win AND g.n = v.n),
hit_words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
hit_items AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY r)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words w LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)
"""
