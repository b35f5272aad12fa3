"""Language identification by rank-order n-gram profiles.

A profile is a language's ``PROFILE`` most frequent character n-grams (orders 1-3, over lower-cased text in which every
run of non-letters is one space), in order of frequency.  A document is compared by the out-of-place distance of its own most
frequent n-grams; n-grams absent from a profile cost ``PROFILE``.  Profiles are learned from at most ``FIT_DOCS`` documents
of each language (those with the smallest id hash).

Defined cases: a null text, or one without a letter, is ``und`` with score 0; ties in frequency are broken by n-gram
code, ties in distance by language name; with nothing to learn from, every text is ``und``; equal texts get equal answers;
repeated rows are answered each for itself, and of rows that share an id and a language one is learned from (the smallest hash of the
text); an empty table gives an empty result; a text of any length is counted whole; other columns are not read.
The score is 1 - distance / largest possible distance of the document.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _spark as S
from . import _text as X

FOLDS, HELD = 4, 2
FIT_DOCS = 1000
PROFILE = 400
ORDERS = (1, 2, 3)
_POINTS = 0x110000


@lru_cache(1)
def _alphabet() -> np.ndarray:
    """Code point -> lower-case code point for letters, 32 for everything else."""
    out = np.full(_POINTS, 32, np.uint32)
    for c in range(_POINTS):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def codes(text: str) -> np.ndarray:
    """Letters and single spaces of a text, with a space at both ends; empty if it has no letter."""
    text = unicodedata.normalize("NFC", text) if not text.isascii() else text
    c = _alphabet()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    c = np.concatenate([[32], c, [32]]).astype(np.uint64)
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 32) | (c[:-1] != 32)
    c = c[keep]
    return c if len(c) > 1 else c[:0]


def ranked(c: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram codes by falling count, counts), at most ``top``; 21 bits a character, so orders never collide."""
    grams = []
    for n in ORDERS:
        if len(c) >= n:
            g = c[: len(c) - n + 1].copy()
            for j in range(1, n):
                g = (g << np.uint64(21)) | c[j : len(c) - n + 1 + j]
            grams.append(g if n > 1 else g[g != 32])
    if not grams:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    g, k = np.unique(np.concatenate(grams), return_counts=True)
    order = np.argsort(-k, kind="stable")[:top]
    return g[order], k[order]


def _texts(column: pa.Array):
    for x in column:
        yield x.as_py() or ""


def _counts(batches):
    """N-gram counts of a task's documents by language, whole, as (lang, gram, n)."""
    for batch in batches:
        by: dict[str, list] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), _texts(batch.column("text")), strict=True):
            by.setdefault(lang, []).append(ranked(codes(text), 1 << 62))
        for lang, got in by.items():
            g, at = np.unique(np.concatenate([x for x, _ in got]), return_inverse=True)
            n = np.bincount(at, np.concatenate([k for _, k in got]), len(g)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])


def fit(docs: DataFrame, rows: int = FIT_DOCS, top: int = PROFILE) -> dict[str, np.ndarray]:
    """Profiles of every learned language; the driver receives ``top`` rows for each language."""
    learn = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (S.crc_fold("doc_id", FOLDS) != HELD))
    key = F.xxhash64("doc_id")
    # of a language with many documents only small hashes take part in the ranking, about four for each that is chosen
    many = learn.groupBy("lang").agg(F.count("*").alias("n"))
    small = (key.cast("double") + 2.0**63) * F.col("n") <= 2.0**64 * 4 * rows
    ids = learn.select("lang", "doc_id").join(many, "lang").where(small).select("lang", "doc_id").distinct()
    chosen = ids.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(key, "doc_id"))).where(F.col("r") <= rows).select("lang", "doc_id")
    some = learn.select("doc_id", "lang", "text").join(chosen, ["lang", "doc_id"], "left_semi")
    one = some.groupBy("lang", "doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    counts = one.select("lang", "text").mapInArrow(_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = counts.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("r") <= top)
    out: dict[str, dict[int, int]] = {}
    for row in best.select("lang", "gram", "r").collect():
        out.setdefault(row.lang, {})[row.r] = row.gram
    return {k: np.array([v[r] for r in sorted(v)], np.int64).view(np.uint64) for k, v in sorted(out.items())}


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], top: int = PROFILE) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of ``docs`` (doc_id, text)."""
    langs = sorted(profiles)
    vocab = np.unique(np.concatenate([profiles[k] for k in langs])) if langs else np.zeros(0, np.uint64)
    rank = np.full((len(vocab) + 1, len(langs)), -1, np.int64)
    for j, k in enumerate(langs):
        rank[np.searchsorted(vocab, profiles[k]), j] = np.arange(len(profiles[k]))

    def one(text: str) -> tuple[str, float]:
        c = codes(text)
        if not len(c) or not langs:
            return "und", 0.0
        g, _ = ranked(c, top)
        at = np.searchsorted(vocab, g)
        at[(at == len(vocab)) | (vocab[np.minimum(at, len(vocab) - 1)] != g)] = len(vocab)
        r = rank[at]
        cost = np.where(r < 0, top, np.abs(r - np.arange(len(g))[:, None])).sum(0)
        j = int(cost.argmin())
        return langs[j], float(1 - cost[j] / (top * len(g)))

    def run(batches):
        for batch in batches:
            got = [one(x) for x in _texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([k for k, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = S.table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    out = predict(docs, fit(docs))
    return out.select("doc_id", (S.crc_fold("doc_id", FOLDS) == HELD).alias("held_out"), "lang_pred", "score")
