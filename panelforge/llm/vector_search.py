"""Exact top-k search by inner product with multi-resolution segment statistics.

A vector is cut into 1, 4 and 16 segments; each keeps its mean and deviation. By Cauchy-Schwarz the inner
product of two segments of m components is at most m * (mean * mean + deviation * deviation), so the sum
over segments bounds the score from above (its negative, the distance, from below).

Queries are dealt into blocks and candidates into slices, both by hash and of bounded size, so no slice depends
on the values of the vectors and a common vector makes no hot task. In a first pass each block meets one slice:
the k-th best score a query finds there is a threshold that goes with it to all the other slices. In a slice,
rows that are alike in their statistics form groups; a query skips the groups whose box of statistics stays
under its threshold, bounds the rows of the others from coarse to fine, drops what can't reach the threshold,
and computes exact integer scores of the survivors, which raise the threshold further. A window over the
query's few rows per slice merges what the slices found. Nothing passes through the driver.

Edge cases: vectors that are null, or hold null or non-finite components, and null ids take no part; rows
that repeat a vec_id count once (the smallest vector); vectors of another length than the query's are no
candidates; ties go to the smaller vec_id; an empty table gives no rows. Scores are exact: in floating point
while no sum can leave its whole numbers, in Python integers beyond that; a score, or a component, that 64 bits
don't hold is an error.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.llm.common import materialize, table

SEGMENTS = (1, 4, 16)
RESULT = "query_id long, vec_id long, score long"


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id and v, the vector with each component x as floor(256 * x)."""
    usable = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    floored = vectors.filter(F.coalesce(usable, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("v"))
    return floored.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))


def segment_features(x: np.ndarray, segments: int) -> np.ndarray:
    """Rows of weighted means and deviations, whose dot product bounds the inner product of two vectors."""
    parts = [p for p in np.array_split(x, min(segments, max(1, x.shape[1])), axis=1) if p.shape[1]]
    out = [np.sqrt(p.shape[1]) * p.mean(1) for p in parts] + [np.sqrt(p.shape[1]) * p.std(1) for p in parts]
    return np.stack(out, 1) if out else np.zeros((len(x), 1))


def alike(features: np.ndarray, size: int) -> list[np.ndarray]:
    """Row numbers in groups of at most ``size``, halved again and again at the median of the feature that varies most."""
    done, todo = [], [np.arange(len(features))]
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            done.append(rows)
            continue
        rows = rows[np.argsort(features[rows, features[rows].std(0).argmax()], kind="stable")]
        todo += [rows[: len(rows) // 2], rows[len(rows) // 2 :]]
    return done


def exact_type(q: np.ndarray, c: np.ndarray) -> type:
    """The fastest number type in which every sum of products of the two sides is exact."""
    most = [float(np.abs(x.astype(np.float64)).max(initial=0)) for x in (q, c)]
    if max(most) >= 2**62:
        raise OverflowError("a vector has a component beyond 64 bits")
    top = most[0] * most[1] * max(1, q.shape[1])
    return np.float32 if top < 2**24 else np.float64 if top < 2**53 else object


def k_best(at: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query (``at``) its k best rows, ties to the smaller id, in order."""
    order = np.lexsort((ids, -scores, at))
    at, ids, scores = at[order], ids[order], scores[order]
    start = np.searchsorted(at, at)
    keep = np.arange(len(at)) - start < k
    return at[keep], ids[keep], scores[keep]


def best_in_slice(qid: np.ndarray, q: np.ndarray, least: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int, size: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query its k best candidates of this slice that reach ``least``: query numbers, ids, scores."""
    kind = exact_type(q, c)
    exact_q, exact_c, least = q.astype(kind), c.astype(kind), least.astype(np.float64)
    slack = 1e-9 * (1 + np.sqrt((q.astype(np.float64) ** 2).sum(1)) * np.sqrt((c.astype(np.float64) ** 2).sum(1)).max(initial=0))
    levels = [(segment_features(q, s), segment_features(c, s)) for s in SEGMENTS]
    box_q, box_c = levels[-1]
    groups = alike(box_c, size)
    low, high = (np.stack([at(box_c[g], axis=0) for g in groups]) for at in (np.min, np.max))
    reach = np.maximum(box_q, 0) @ high.T + np.minimum(box_q, 0) @ low.T
    found = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for g in np.argsort(-reach.mean(0), kind="stable"):
        rows, queries = groups[g], np.flatnonzero(reach[:, g] >= least - slack)
        for fq, fc in levels:
            may = fq[queries] @ fc[rows].T >= (least - slack)[queries, None]
            queries, rows = queries[may.any(1)], rows[may.any(0)]
        if not len(queries):
            continue
        scores = exact_q[queries] @ exact_c[rows].T
        other = cid[rows] != qid[queries, None]
        if len(rows) > k and kind is not object:  # the k-th best of this group, before any pair is listed
            own = np.where(other, scores, -np.inf)
            least[queries] = np.maximum(least[queries], np.partition(own, len(rows) - k, axis=1)[:, len(rows) - k])
        i, j = np.nonzero(other & (scores >= least[queries, None]).astype(bool))
        if not len(i):
            continue
        if kind is object and max(map(abs, scores[i, j])) >= 2**63:
            raise OverflowError("a score is beyond 64 bits")
        pair = queries[i], cid[rows[j]], scores[i, j].astype(np.int64)
        found = k_best(*(np.concatenate(x) for x in zip(found, pair)), k)
        full = np.flatnonzero(np.bincount(found[0], minlength=len(q)) >= k)
        last = np.searchsorted(found[0], full, side="right") - 1
        least[full] = np.maximum(least[full], np.nextafter(found[2][last].astype(np.float64), -np.inf) if kind is object else found[2][last])
    return found


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, block: int = 4096, piece: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best rows other than its own."""
    rows = materialize(integer_vectors(vectors), "vectors")
    n, n_query, dim = rows.agg(F.count("*"), F.coalesce(F.sum(is_query.cast("int")), F.lit(0)), F.coalesce(F.max("dim"), F.lit(0))).first()
    fit = max(64, (4096 * 256) // max(1, dim))  # longer vectors come in smaller blocks and slices
    blocks, pieces = max(1, -(-n_query // min(block, fit))), max(1, -(-n // min(piece, fit)))
    b, p = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"), F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(pieces)).cast("int")
    queries = rows.filter(is_query).select("dim", b.alias("b"), "vec_id", "v")
    candidates = rows.select(F.col("dim").alias("width"), p.alias("p"), F.col("vec_id").alias("cand"), F.col("v").alias("c"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        q, c = (np.stack(x.to_numpy()).astype(np.int64).reshape(len(x), -1) for x in (left["v"], right["c"]))
        qid = left["vec_id"].to_numpy()
        at, ids, scores = best_in_slice(qid, q, left["least"].to_numpy(), right["cand"].to_numpy(), c, k)
        return pd.DataFrame({"query_id": qid[at], "vec_id": ids, "score": scores})

    def meet(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.groupBy("dim", "b", "p").cogroup(right.groupBy("width", "b", "p")).applyInPandas(run, RESULT)

    # A slice p is the first one of the blocks p, p + pieces, ...
    first = queries.select("dim", "b", F.pmod("b", F.lit(pieces)).alias("p"), "vec_id", "v", F.lit(float("-inf")).alias("least"))
    hosts = candidates.filter(F.col("p") < blocks).withColumn("b", F.explode(F.sequence("p", F.lit(blocks - 1), F.lit(pieces))))
    found = materialize(meet(first, hosts), "first-slice")
    if pieces > 1:
        # Either side repeats once per block of the other, never once per row of it.
        least = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("found"), F.min("score").alias("kth")).filter(F.col("found") >= k)
        rest = F.filter(F.sequence(F.lit(0), F.lit(pieces - 1)), lambda x: x != F.pmod("b", F.lit(pieces)))
        floor = F.coalesce(F.col("kth").cast("double"), F.lit(float("-inf")))  # as a double it may round up, past 2**53
        floor = F.when(F.abs(floor) < 2.0**53, floor).otherwise(floor - F.abs(floor) * 1e-15)
        later = queries.join(least, "vec_id", "left").select("dim", "b", F.explode(rest).alias("p"), "vec_id", "v", floor.alias("least"))
        others = candidates.withColumn("b", F.explode(F.filter(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda x: F.pmod(x, F.lit(pieces)) != F.col("p"))))
        found = found.unionByName(meet(later, others))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


#: DuckDB: every query against every row.
ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
