"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts become lower-case letters and single spaces; all their 2- and 3-grams are hashed into ``BUCKETS``
buckets. Counts by language come from a Spark aggregation; the log-probability matrix (languages x buckets) is broadcast,
and tasks score batches of whole texts as sparse rows in numpy. More than ``LANGUAGES_AT_ONCE`` languages are taken in blocks, each
with a matrix of its own; a document keeps its best language and the sum over all so far. No language is left out.
Texts over ``CHARS_AT_ONCE`` characters are taken in runs that carry two characters over.

The model is fitted on a bounded sample of the training documents: about ``sample`` documents, each row drawn by
itself (all of them where there are fewer). Every document is scored whole.

Edge cases: a null text or one without a letter is ``und`` with score 0; so is every document if nothing
can be learned; of languages of equal score the first by name counts; rows with a null lang are not learned from;
repeated rows are drawn and scored each by itself, whatever their doc_id; a null doc_id is scored; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.common import fold, materialize, table

BITS = 15
BUCKETS = 1 << BITS
CHARS_AT_ONCE = 1_000_000
LANGUAGES_AT_ONCE = 128


@cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def _mixed(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all pairs and triples of characters."""
    two = a[:-1] * np.uint32(2654435761) + a[1:] * np.uint32(2246822519)
    three = two[:-1] * np.uint32(3266489917) + a[2:] * np.uint32(668265263)
    mix = lambda h: ((h ^ (h >> np.uint32(15))) * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    return mix(two), mix(three)


def ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of every n-gram, the first n-gram of each text, and whether the text has a letter."""
    low = [f" {(t or '').lower()} " for t in texts]
    chars = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) for t in low])
    ends = np.cumsum(sizes)
    letter = _letters()[chars]
    chars = np.where(letter, chars, np.uint32(32))
    first = np.zeros(len(chars), bool)
    first[ends[:-1]] = True
    keep = letter | first | np.r_[True, letter[:-1]]  # one space for a run of other characters
    has_letter = np.add.reduceat(letter, ends - sizes) > 0
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)[keep]
    a = chars[keep]
    two, three = _mixed(a)
    in2, in3 = doc[:-1] == doc[1:], doc[:-2] == doc[2:]
    ids = np.concatenate([two[in2], three[in3]])
    of = np.concatenate([doc[:-1][in2], doc[:-2][in3]])
    order = np.argsort(of, kind="stable")  # two sorted runs, merged
    starts = np.searchsorted(of[order], np.arange(len(texts)))
    return ids[order], starts, has_letter


def slices(texts: list[str | None], most: int) -> Iterator[slice]:
    """Runs of texts of about ``most`` characters; a longer text stands alone."""
    lo = total = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > lo and total + n > most:
            yield slice(lo, i)
            lo, total = i, 0
        total += n
    if lo < len(texts):
        yield slice(lo, len(texts))


def long_ngrams(text: str, most: int) -> Iterator[tuple[np.ndarray, bool]]:
    """The n-grams of one text, those that end in each run of ``most`` characters, and whether the run has a letter.

    The last two characters are carried over, so all n-grams are those of the whole text.
    """
    low, carried, after_letter = f" {text.lower()} ", np.zeros(0, np.uint32), True
    for lo in range(0, len(low), most):
        chars = np.frombuffer(low[lo : lo + most].encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[chars]
        new = np.where(letter, chars, np.uint32(32))[letter | np.r_[after_letter, letter[:-1]]]
        a = np.concatenate([carried, new])
        two, three = _mixed(a)
        yield np.concatenate([two[max(len(carried) - 1, 0) :], three[max(len(carried) - 2, 0) :]]), bool(letter.any())
        carried, after_letter = a[-2:], bool(letter[-1])


def gram_counts(labelled: DataFrame) -> DataFrame:
    """lang, bucket, n over the given texts; bucket -1 counts the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for b in batches:
            langs, texts = np.array(b.column(0).to_pylist(), object), b.column(1).to_pylist()
            for lang, k in zip(*np.unique(langs.astype(str), return_counts=True)):
                found.setdefault(str(lang), np.zeros(BUCKETS + 1, np.int64))[BUCKETS] += k
            for part in slices(texts, CHARS_AT_ONCE):
                if len(texts[part][0] or "") > CHARS_AT_ONCE:
                    for ids, _ in long_ngrams(texts[part][0], CHARS_AT_ONCE):
                        found[langs[part][0]][:BUCKETS] += np.bincount(ids, minlength=BUCKETS)
                    continue
                ids, starts, _ = ngrams(texts[part])
                sizes = np.diff(np.r_[starts, len(ids)])
                of = np.repeat(langs[part], sizes)
                for lang in set(langs[part]):
                    found[lang][:BUCKETS] += np.bincount(ids[of == lang], minlength=BUCKETS)
        for lang, n in found.items():
            some = np.flatnonzero(n)
            bucket = np.where(some == BUCKETS, -1, some).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(bucket), pa.array(n[some])], names=["lang", "bucket", "n"])

    counts = labelled.select("lang", "text").mapInArrow(run, "lang string, bucket int, n long")
    return counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def gram_table(docs: DataFrame, sample: int = 20_000) -> DataFrame:
    """gram_counts of about ``sample`` documents with a language, drawn row by row; of all where there are fewer."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = known.select("lang").count()
    if rows > sample:
        known = known.filter(F.rand(7) < sample / rows)
    return materialize(gram_counts(known), "gram-counts")


def blocks(counts: DataFrame, size: int = LANGUAGES_AT_ONCE) -> Iterator[tuple[list[str], np.ndarray]]:
    """Languages and their log probabilities (languages x buckets + 1; the last column is the prior), ``size`` languages at a time."""
    texts = {r.lang: r.n for r in counts.filter("bucket = -1").collect()}  # no more than the sample's texts
    langs, whole = sorted(texts), sum(texts.values())
    for lo in range(0, len(langs), size):
        some = langs[lo : lo + size]
        of = counts.filter(F.col("lang").isin(some)).toPandas()
        n = np.zeros((len(some), BUCKETS + 1))
        n[of["lang"].map({x: k for k, x in enumerate(some)}).to_numpy(int), of["bucket"].to_numpy(int)] = of["n"]
        grams = n[:, :BUCKETS] + 0.5
        yield some, np.hstack([np.log(grams / grams.sum(1, keepdims=True)), np.log(n[:, BUCKETS:] / whole)])


def fit(docs: DataFrame, sample: int = 20_000) -> tuple[list[str], np.ndarray]:
    """All languages and their log probabilities in one matrix."""
    found = list(blocks(gram_table(docs, sample)))
    return [x for langs, _ in found for x in langs], np.vstack([m for _, m in found] or [np.zeros((0, BUCKETS + 1))])


SCORED = "doc_id long, text string, lang_pred string, top double, total double, has_letter boolean"


def scored(docs: DataFrame, langs: list[str], logp: np.ndarray) -> DataFrame:
    """SCORED rows after another block of languages: the best language so far, its log probability, the log of the sum over all so far."""
    shared = docs.sparkSession.sparkContext.broadcast(logp)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            texts = b.column(1).to_pylist()
            scores, has_letter = np.repeat(model[:, BUCKETS:], len(texts), axis=1), np.zeros(len(texts), bool)
            for part in slices(texts, CHARS_AT_ONCE):
                if len(texts[part][0] or "") > CHARS_AT_ONCE:
                    for ids, letters in long_ngrams(texts[part][0], CHARS_AT_ONCE):
                        scores[:, part.start] += [row[ids].sum() for row in model]
                        has_letter[part.start] |= letters
                    continue
                ids, starts, letters = ngrams(texts[part])
                has_letter[part] = letters
                some = np.diff(np.r_[starts, len(ids)]) > 0  # a text without a letter may have no n-gram
                if some.any():
                    scores[:, np.arange(part.start, part.stop)[some]] += np.array([np.add.reduceat(row[ids], starts[some]) for row in model])
            best = scores.argmax(0)
            top, old = scores.max(0), b.column(3).to_numpy(zero_copy_only=False)
            total = np.logaddexp(b.column(4).to_numpy(zero_copy_only=False), top + np.log(np.exp(scores - top).sum(0)))
            pred = [langs[k] if t > o else p for k, t, o, p in zip(best.tolist(), top, old, b.column(2).to_pylist())]  # ties stay with the earlier name
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(pred, pa.string()), pa.array(np.maximum(top, old)), pa.array(total), pa.array(has_letter)], names=["doc_id", "text", "lang_pred", "top", "total", "has_letter"])

    return docs.mapInArrow(run, SCORED)


def predict(docs: DataFrame, models: Iterable[tuple[list[str], np.ndarray]]) -> DataFrame:
    """doc_id, lang_pred and score (the posterior of that language) of every text, block of languages by block."""
    low = F.lit(float("-inf"))
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit(None).cast("string").alias("lang_pred"), low.alias("top"), low.alias("total"), F.lit(False).alias("has_letter"))
    for langs, logp in models:
        x = scored(x, langs, logp)
    known = F.col("has_letter") & F.col("lang_pred").isNotNull()
    return x.select("doc_id", F.when(known, F.col("lang_pred")).otherwise("und").alias("lang_pred"), F.when(known, F.exp(F.col("top") - F.col("total"))).otherwise(0.0).alias("score"))


def identify(docs: DataFrame, sample: int = 20_000, size: int = LANGUAGES_AT_ONCE) -> DataFrame:
    """Learn from the documents outside the held-out fold, predict all."""
    models = blocks(gram_table(docs.filter(fold("doc_id", 4) != 2), sample), size)
    return predict(docs, models).withColumn("held_out", fold("doc_id", 4) == 2)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
