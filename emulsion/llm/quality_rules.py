"""Quality rules: exact base counts, then hashed n-gram logistic regression, calibrated, against a fixed threshold.

The regression sees relative frequencies of hashed word unigrams, word bigrams and byte 4-grams.  It is fitted on a
bounded sample of labelled rows (``FIT_ROWS``, those with the smallest id hash), Platt-calibrated on a quarter of them
that the fit did not see, and scored in Arrow batches over every whole text.

Defined cases: a null text counts as empty; an empty text has zero counts, fails the base (under ``MIN_WORDS`` words)
and is rejected; repeated rows are scored each for itself; an empty table gives an empty result; with no labels of both
classes the verdict is the base rules' alone (score 1.0); of rows that share a labelled id one is learned from (the smallest hash of
the text); a text of any length is counted whole, in memory of a few times its size; ``score`` reads no other column, ``keep`` keeps
all of them, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _spark as S
from . import _stats, _text as X

FIT_ROWS = 3000
DIM = 1 << 16
EPOCHS = 80
SCALE = 40.0
THRESHOLD = 0.5
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
CHAR_N = 4
#: Entries of the sample that a step of the fit works on at a time, in the driver.
BLOCK_ENTRIES = 1 << 18

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, score double, kept boolean"
)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def probability(self, logit):
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * logit + self.offset, -60, 60)))


def _blocks(buf: np.ndarray, off: np.ndarray, words: X.Words):
    """(feature index, document) arrays of the three feature kinds."""
    yield (words.hash & X.U(DIM - 1)).astype(np.int32), words.doc
    h, at = X.windows(words.hash, words.first, 2)
    yield (X.mix(h ^ X.U(0xB16)) & X.U(DIM - 1)).astype(np.int32), words.doc[at]
    if len(buf) >= CHAR_N:
        g = buf[: len(buf) - CHAR_N + 1].astype(np.uint32)
        for j in range(1, CHAR_N):
            g |= buf[j : len(buf) - CHAR_N + 1 + j].astype(np.uint32) << np.uint32(8 * j)
        g *= np.uint32(0x9E3779B1)
        g ^= g >> np.uint32(15)
        doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
        at = np.flatnonzero(doc[: len(g)] == doc[CHAR_N - 1 :])
        yield (g[at] & np.uint32(DIM - 1)).astype(np.int32), doc[at]


def logits(model: Model, buf: np.ndarray, off: np.ndarray, words: X.Words) -> np.ndarray:
    out = np.full(len(off) - 1, model.bias)
    for f, doc in _blocks(buf, off, words):
        n = np.bincount(doc, minlength=len(out))
        out += SCALE * np.bincount(doc, model.weights[f], len(out)) / np.maximum(n, 1)
    return out


def _sparse(batches):
    for batch in batches:
        for i, n, buf, off in X.slices(batch.column("text")):
            words = X.Words(buf, off)
            keys, vals = [], []
            for f, doc in _blocks(buf, off, words):
                k, c = np.unique(doc.astype(np.int64) * DIM + f, return_counts=True)
                total = np.bincount(doc, minlength=n)
                keys.append(k)
                vals.append(SCALE * c / total[k // DIM])
            k, v = np.concatenate(keys), np.concatenate(vals)
            order = np.argsort(k, kind="stable")
            k, v = k[order], v[order]
            sizes = np.bincount(k // DIM, minlength=n)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("label").slice(i, n).cast(pa.int32()),
                    X.list_array(pa.array((k % DIM).astype(np.int32)), sizes),
                    X.list_array(pa.array(v.astype(np.float32)), sizes),
                ],
                ["label", "idx", "val"],
            )


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps on smoothed targets."""
    pos, neg = max(1, y.sum()), max(1, (1 - y).sum())
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -60, 60)))
        w = p * (1 - p) + 1e-9
        g = np.array([((p - t) * z).sum() + 1e-3 * (a - 1), (p - t).sum() + 1e-3 * b])
        h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return (float(a), float(b)) if np.isfinite([a, b]).all() and a > 0 else (1.0, 0.0)


def _cut(sizes: np.ndarray, idx: np.ndarray, val: np.ndarray):
    """Runs of rows as (sizes, idx, val), views of about ``BLOCK_ENTRIES`` entries, which a row has 3 * DIM of at most."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    a = 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + BLOCK_ENTRIES, "right")) - 1)
        yield sizes[a:b], idx[ends[a] : ends[b]], val[ends[a] : ends[b]]
        a = b


def fit_rows(labels: np.ndarray, sizes: np.ndarray, idx: np.ndarray, val: np.ndarray) -> Model | None:
    return descend(labels, list(_cut(sizes, idx, val)))


def descend(labels: np.ndarray, blocks: list) -> Model | None:
    """Adam on the mean log loss with L2; every fourth row is kept for calibration.

    The rows come as blocks (sizes, idx, val); what a step needs beside them is as large as one block, as the driver holds it.
    Sums are taken in the order of the entries, so where blocks are cut doesn't change a bit."""
    if len(labels) < 8 or labels.min() == labels.max():
        return None
    train = np.arange(len(labels)) % 4 != 3
    y = labels.astype(np.float64)
    # both classes weigh the same in the fit; the calibration then restores the true rate
    weight = train * np.where(y > 0, 0.5 / max(1, y[train].sum()), 0.5 / max(1, (1 - y[train]).sum()))
    w, m, v = np.zeros(DIM), np.zeros(DIM), np.zeros(DIM)
    bias = mb = vb = 0.0
    z, e = np.zeros(len(y)), np.zeros(len(y))

    def logit(sizes, idx, val):
        row = np.repeat(np.arange(len(sizes)), sizes)
        return row, np.bincount(row, w[idx] * val, len(sizes)) + bias

    for t in range(1, EPOCHS + 1):
        a, g = 0, np.zeros(DIM)
        for sizes, idx, val in blocks:
            b = a + len(sizes)
            row, z[a:b] = logit(sizes, idx, val)
            e[a:b] = weight[a:b] * (1 / (1 + np.exp(-np.clip(z[a:b], -60, 60))) - y[a:b])
            np.add.at(g, idx.astype(np.intp), e[a:b][row] * val)
            a = b
        g, gb = g + 1e-6 * w, e.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        fix = np.sqrt(1 - 0.99**t) / (1 - 0.9**t)
        w -= 0.05 * fix * m / (np.sqrt(v) + 1e-8)
        bias -= 0.05 * fix * mb / (np.sqrt(vb) + 1e-8)
    z = np.concatenate([logit(*x)[1] for x in blocks])
    held = ~train
    slope, offset = _platt(z[held], y[held]) if 0 < y[held].sum() < held.sum() else (1.0, 0.0)
    return Model(w, float(bias), slope, offset)


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model | None:
    """Fit on at most ``rows`` labelled documents (duplicate labels of a document: the largest counts)."""
    lab = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg((F.max("quality") > 0).cast("int").alias("label"))
    )
    some = S.bounded_sample(lab, "doc_id", rows)
    data = S.sample_rows(docs, some, rows).orderBy(F.xxhash64("doc_id"), "doc_id").select("label", "text")
    got = data.mapInArrow(_sparse, "label int, idx array<int>, val array<float>").toArrow()
    if not got.num_rows:
        return None
    blocks = []
    for batch in got.to_batches():  # views of what was received: no copy of the sample
        idx, val = batch["idx"], batch["val"]
        blocks += _cut(np.diff(idx.offsets.to_numpy()), idx.flatten().to_numpy(), val.flatten().to_numpy())
    return descend(got["label"].to_numpy(), blocks)


def score(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """One row of SCHEMA for each row of ``docs`` (doc_id, text)."""

    def run(batches):
        for batch in batches:
            for i, n, buf, off in X.slices(batch.column("text")):
                words = X.Words(buf, off)
                c = _stats.base_counts(buf, off, words)
                p = model.probability(logits(model, buf, off, words)) if model else np.ones(n)
                failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(i, n),
                        *(pa.array(c[k].astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
                        pa.array(failed), pa.array(p), pa.array(~failed & (p >= threshold)),
                    ],
                    [x.split()[0] for x in SCHEMA.split(", ")],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns.  The verdict is a function of the text, so it is taken
    in the same pass as the rows and needs no join: rows with equal or null ids keep their own verdicts."""
    model = fit(docs, labels)
    schema = docs.schema

    def run(batches):
        for batch in batches:
            for i, n, buf, off in X.slices(batch.column("text")):
                words = X.Words(buf, off)
                nw, nr = np.diff(words.first), _stats.repeat_words(words, n)
                p = model.probability(logits(model, buf, off, words)) if model else np.ones(n)
                ok = (nw >= MIN_WORDS) & (100 * nr <= MAX_REPEAT_PERCENT * nw) & (p >= threshold)
                yield batch.slice(i, n).filter(pa.array(ok))

    return S.map_batches(docs, run, schema)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = S.table(spark, sf_dir, "documents", "doc_id", "text")
    return score(docs, fit(docs, S.table(spark, sf_dir, "labels")))
