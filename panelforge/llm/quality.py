"""Quality classifier: a byte-level convolutional network in numpy.

A text is its UTF-8 bytes. Each of ``FILTERS`` learned filters looks at ``WIDTH`` consecutive bytes, every
``STRIDE`` bytes; as bytes are symbols, a filter is a table of weights by place and byte. Activations are
max-pooled over overlapping chunks (two half chunks each) that cover the whole text, and the mean, the
largest and the smallest of a filter over the chunks are combined by a logistic layer into one probability.

The network is fitted on a bounded sample: at most ``per_class`` labelled texts of each class, taken whole in
the order of a hash of their id until they hold ``class_bytes`` bytes, outside the held-out fold. Every document
is scored whole. Gradients flow only through the places that won the pooling, so training takes seconds.

Edge cases: null and empty texts are scored as the empty text; if one class has no labelled text, every
score is the share of label 1 in the sample (0.5 without any); a document with several label rows takes
its lowest quality; repeated rows are scored once each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.llm.common import fold, table

WIDTH, STRIDE, FILTERS, HALF = 6, 2, 32, 256
CLASS_BYTES = 6 << 20
BYTES_AT_ONCE = 262_144


@dataclass
class Network:
    tables: np.ndarray  # WIDTH x 256 x FILTERS
    bias: np.ndarray  # FILTERS
    weights: np.ndarray  # 3 * FILTERS
    offset: float
    constant: float | None = None


def _layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, each text padded by WIDTH bytes at least to whole half chunks (at least two), and the number of half chunks of each."""
    halves = np.array([max(2, -(-(len(t) + WIDTH) // HALF)) for t in texts])
    data = np.zeros(halves.sum() * HALF + WIDTH, np.uint8)
    at = np.r_[0, np.cumsum(halves)] * HALF
    for t, i in zip(texts, at):
        data[i : i + len(t)] = np.frombuffer(t, np.uint8)
    return data, halves


def _activations(net: Network, data: np.ndarray, halves: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Blocks lo to hi x places x filters. The places of a text's last block that reach beyond it, into the next text, don't count."""
    data, blocks = data[lo * HALF : hi * HALF + WIDTH], hi - lo
    n = blocks * HALF
    out = np.take(net.tables[0], data[0:n:STRIDE], axis=0)
    tmp = np.empty_like(out)
    for k in range(1, WIDTH):
        np.take(net.tables[k], data[k : n + k : STRIDE], axis=0, out=tmp, mode="clip")
        out += tmp
    out = out.reshape(blocks, HALF // STRIDE, FILTERS)
    last = np.cumsum(halves) - 1 - lo
    out[last[(last >= 0) & (last < blocks)], -((WIDTH - 1) // STRIDE) :] = -np.inf
    return out


def _winners(net: Network, data: np.ndarray, halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The winning place of each block and filter and its activation, some blocks at a time."""
    won, best = [], []
    blocks, step = int(halves.sum()), BYTES_AT_ONCE // HALF
    for lo in range(0, blocks, step):
        act = _activations(net, data, halves, lo, min(lo + step, blocks))
        won.append(act.argmax(1))
        best.append(np.take_along_axis(act, won[-1][:, None], 1)[:, 0])
    return np.concatenate(won), np.concatenate(best)


def _pool(half_max: np.ndarray, halves: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunk values (relu), the first chunk of each text, and whether the second half of a chunk won."""
    last = np.cumsum(halves) - 1
    second = half_max[1:] > half_max[:-1]
    chunk = np.maximum(half_max[1:], half_max[:-1])
    keep = np.ones(len(chunk), bool)
    keep[last[:-1]] = False
    return np.maximum(chunk[keep] + bias, 0), np.r_[0, np.cumsum(halves - 1)[:-1]], second[keep]


def _features(h: np.ndarray, starts: np.ndarray, chunks: np.ndarray) -> np.ndarray:
    return np.hstack([np.add.reduceat(h, starts) / chunks[:, None], np.maximum.reduceat(h, starts), np.minimum.reduceat(h, starts)])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def forward(net: Network, texts: list[bytes]) -> np.ndarray:
    data, halves = _layout(texts)
    blocks, step = int(halves.sum()), BYTES_AT_ONCE // HALF
    half_max = np.concatenate([_activations(net, data, halves, i, min(i + step, blocks)).max(1) for i in range(0, blocks, step)])
    h, starts, _ = _pool(half_max, halves, net.bias)
    return _sigmoid(_features(h, starts, halves - 1) @ net.weights + net.offset)


def train(texts: list[bytes], labels: np.ndarray, epochs: int = 12, batch: int = 48, rate: float = 0.01, seed: int = 7) -> Network:
    """Adam on the logistic loss; both classes weigh the same."""
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, 0.25, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.05, 3 * FILTERS), 0.0)
    if not 0 < labels.sum() < len(labels):
        net.constant = float(labels.mean()) if len(labels) else 0.5
        return net
    share = labels.mean()
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    params = [net.tables, net.bias, net.weights, np.zeros(1)]
    moments = [(np.zeros(p.shape), np.zeros(p.shape)) for p in params]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        lr = rate * (1 - epoch / epochs)
        for lo in range(0, len(order), batch):
            pick = order[lo : lo + batch]
            data, halves = _layout([texts[i] for i in pick])
            blocks = int(halves.sum())
            won, half_max = _winners(net, data, halves)
            h, starts, second = _pool(half_max, halves, net.bias)
            chunks = halves - 1
            x = _features(h, starts, chunks)
            error = (_sigmoid(x @ net.weights + params[3][0]) - labels[pick]) * weight[pick] / len(pick)
            gx = error[:, None] * net.weights[None]
            of = np.repeat(np.arange(len(pick)), chunks)
            g_mean, g_max, g_min = np.split(gx, 3, 1)
            top, low = x[:, FILTERS : 2 * FILTERS], x[:, 2 * FILTERS :]
            gh = (g_mean / chunks[:, None])[of] + g_max[of] * (h == top[of]) + g_min[of] * (h == low[of])
            gh *= h > 0
            left = np.arange(blocks - 1)[np.isin(np.arange(blocks - 1), np.cumsum(halves)[:-1] - 1, invert=True)]
            block = left[:, None] + second
            f = np.broadcast_to(np.arange(FILTERS), block.shape)
            at = block * HALF + won[block, f] * STRIDE
            g_tables = np.stack([np.bincount((data[at + k].astype(np.int64) * FILTERS + f).ravel(), gh.ravel(), 256 * FILTERS).reshape(256, FILTERS) for k in range(WIDTH)])
            step += 1
            for p, g, (m, v) in zip(params, [g_tables, gh.sum(0), error @ x + 1e-4 * net.weights, np.array([error.sum()])], moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(p.dtype)
            net.offset = float(params[3][0])
    return net


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int, class_bytes: int = CLASS_BYTES) -> DataFrame:
    """Rows (text, quality): of each class at most per_class, and no more once they hold class_bytes; docs outside the fold are the caller's care."""
    marks = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    marks = marks.withColumn("h", F.xxhash64("doc_id", F.lit(3)))
    # twice as many ids as wanted, as some have no text
    ids = [marks.filter(F.col("quality") == q).orderBy("h", "doc_id").limit(2 * per_class) for q in (0, 1)]
    some = docs.filter("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(ids[0].unionByName(ids[1])), "doc_id")
    order = Window.partitionBy("quality").orderBy("h", "doc_id", "size", F.xxhash64("text"))
    some = some.withColumn("size", F.octet_length("text").cast("long"))
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    some = some.withColumns({"r": F.row_number().over(order), "before": before})
    return some.filter((F.col("r") <= per_class) & (F.col("before") < class_bytes)).select("text", "quality")


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1200, class_bytes: int = CLASS_BYTES) -> Network:
    rows = labelled_sample(docs, labels, per_class, class_bytes).toPandas()
    rows = rows.sort_values(["quality", "text"], kind="stable")
    return train([t.encode("utf-8", "surrogatepass") for t in rows["text"]], rows["quality"].to_numpy(int))


def text_scores(net: Network, texts: list[str | None]) -> np.ndarray:
    """Scores of whole texts, some at a time."""
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    out = np.full(len(data), 0.5 if net.constant is None else net.constant)
    lo = len(data) if net.constant is not None else 0
    while lo < len(data):
        hi, size = lo, 0
        while hi < len(data) and (hi == lo or size + len(data[hi]) < 4 * BYTES_AT_ONCE):
            size += len(data[hi])
            hi += 1
        out[lo:hi] = forward(net, data[lo:hi])
        lo = hi
    return out


def score(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = text_scores(shared.value, b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out)], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, per_class: int = 1200) -> DataFrame:
    """Learn outside the held-out fold; score all documents."""
    net = fit(docs.filter(fold("doc_id", 3) != 1), labels, per_class)
    return score(docs, net).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


def keep_quality(docs: DataFrame, net: Network, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, that score at least the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(text_scores(shared.value, b.column(at).to_pylist()) >= threshold))

    return docs.mapInArrow(run, docs.schema)
