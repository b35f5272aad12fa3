"""Quality classifier: histogram gradient-boosted trees over document statistics.

Trees are complete binary trees of fixed depth, so the whole ensemble is three flat arrays (feature, threshold, leaf)
and a batch is scored by ``DEPTH`` vectorised index steps for each tree.  Fitted on at most ``FIT_ROWS`` labelled rows (those
with the smallest id hash); scored in Arrow batches over whole texts, from the text alone.

Defined cases: null and empty texts have all-zero statistics and get the model's score for those; equal texts get equal
scores; with labels of one class or none every score is the smoothed label mean (0.5 without labels); an empty table gives
an empty result; repeated labels of an id count as good if one of them does, and of rows that share a labelled id one is learned from
(the smallest hash of the text); splits of equal gain take the first feature and the lowest edge; a text of any length is counted
whole, in memory of a few times its size; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _spark as S
from . import _stats, _text as X

FIT_ROWS = 20_000
FOLDS, HELD = 3, 1
TREES, DEPTH, BINS, RATE, L2, MIN_ROWS = 60, 4, 64, 0.15, 1.0, 5


@dataclass
class Forest:
    base: float
    feature: np.ndarray  # (trees, 2^depth - 1)
    threshold: np.ndarray  # go right where value > threshold
    leaf: np.ndarray  # (trees, 2^depth)

    def score(self, rows: np.ndarray) -> np.ndarray:
        z = np.full(len(rows), self.base)
        at = np.arange(len(rows))
        inner = self.feature.shape[1]
        for t in range(len(self.leaf)):
            node = np.zeros(len(rows), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (rows[at, self.feature[t, node]] > self.threshold[t, node])
            z += self.leaf[t, node - inner]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def grow(rows: np.ndarray, y: np.ndarray) -> Forest:
    """Second-order boosting of the log loss on quantile-binned features."""
    n, k = rows.shape if len(rows) else (0, len(_stats.FEATURES))
    mean = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(mean / (1 - mean))) if n else 0.0
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    trees = TREES if n and 0 < y.sum() < n else 0
    out = Forest(base, np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf, np.float32), np.zeros((trees, leaves)))
    if not trees:
        return out
    edges = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, BINS + 1)[1:-1]).astype(np.float32)) for f in range(k)]
    bins = np.stack([np.searchsorted(edges[f], rows[:, f], "left") for f in range(k)], 1)
    z = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for depth in range(DEPTH):
            first, width = 2**depth - 1, 2**depth
            local = node - first
            best = np.full(width, 1e-6)
            choice = np.zeros((width, 2), np.int64)
            split = np.zeros(width, bool)
            for f in range(k):
                key = local * BINS + bins[:, f]
                sums = [np.bincount(key, x, width * BINS).reshape(width, BINS).cumsum(1) for x in (g, h, np.ones(n))]
                (gl, hl, nl), (gt, ht, nt) = sums, (s[:, -1:] for s in sums)
                gain = gl**2 / (hl + L2) + (gt - gl) ** 2 / (ht - hl + L2) - gt**2 / (ht + L2)
                gain[(nl < MIN_ROWS) | (nt - nl < MIN_ROWS)] = 0
                gain[:, len(edges[f]) :] = 0
                at = gain.argmax(1)
                top = gain[np.arange(width), at]
                better = top > best
                best[better], split[better] = top[better], True
                choice[better] = np.stack([np.full(width, f), at], 1)[better]
            for j in np.flatnonzero(split):
                f, b = choice[j]
                out.feature[t, first + j], out.threshold[t, first + j] = f, edges[f][b]
            right = np.zeros(n, bool)
            f, b = choice[local, 0], choice[local, 1]
            right = split[local] & (bins[np.arange(n), f] > b)
            node = 2 * node + 1 + right
        leaf = node - inner
        value = -RATE * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + L2)
        out.leaf[t] = value
        z += value[leaf]
    return out


def _featured(batches):
    for batch in batches:
        for i, n, buf, off in X.slices(batch.column("text")):
            x = _stats.features(buf, off)
            yield pa.RecordBatch.from_arrays(
                [batch.column("label").slice(i, n).cast(pa.int32()), X.list_array(pa.array(x.ravel()), np.full(n, x.shape[1]))],
                ["label", "x"],
            )


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Forest:
    """Fit on at most ``rows`` labelled documents of the learning folds."""
    lab = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (S.crc_fold("doc_id", FOLDS) != HELD))
        .groupBy("doc_id").agg((F.max("quality") > 0).cast("int").alias("label"))
    )
    some = S.bounded_sample(lab, "doc_id", rows)
    got = S.sample_rows(docs, some, rows).select("label", "text").mapInArrow(_featured, "label int, x array<float>").toArrow()
    if not got.num_rows:
        return grow(np.zeros((0, len(_stats.FEATURES)), np.float32), np.zeros(0))
    x = got["x"].combine_chunks().flatten().to_numpy().reshape(got.num_rows, -1)
    y = got["label"].to_numpy().astype(float)
    order = np.lexsort((y, *x.T))  # the fit does not depend on the order in which rows arrive
    return grow(x[order], y[order])


def score(docs: DataFrame, model: Forest) -> DataFrame:
    def run(batches):
        for batch in batches:
            for i, n, buf, off in X.slices(batch.column("text")):
                p = model.score(_stats.features(buf, off))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, n), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"]
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = S.table(spark, sf_dir, "documents", "doc_id", "text")
    out = score(docs, fit(docs, S.table(spark, sf_dir, "labels")))
    return out.select("doc_id", (S.crc_fold("doc_id", FOLDS) == HELD).alias("held_out"), "score", "predicted")
