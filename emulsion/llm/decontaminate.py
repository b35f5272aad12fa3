"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Words are runs of letters and digits of the lower-cased text.  Each MASK of SPAN words hashes its selected positions and
ignores the others; equal seeds of a test item and a training text propose an alignment (a diagonal), and every proposed
alignment is verified: a text holds an item if some STRETCH aligned words agree but for MAX_SUBSTITUTIONS.  The masks are
chosen so that any two substitutions in 13 words leave one of them intact, so no such overlap is missed (a test tries all
placements).  Items of SPAN to STRETCH - 1 words must agree whole; shorter items are no evidence and match nothing.

Scale: windows of every text are hashed where they are read; only the benchmark's seeds are joined, broadcast if they are
at most BROADCAST_SEEDS rows and shuffled otherwise; only hits move on.  Hits go back to the texts by a broadcast if they are at most
BROADCAST_HITS and by a shuffled join otherwise.

Defined cases: null and empty texts and items match nothing; repeated rows each get their row; a null id gets its own row (the
key is id and text hash); extra columns of any name are ignored by ``find`` and kept by ``remove``; an empty table gives an empty
result and an empty benchmark finds nothing; a text of any length is searched whole, in memory of a few times its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _spark as S

SPAN = 8
MASKS = ((0, 1, 2, 3, 6, 7), (0, 1, 3, 5, 6, 7))
STRETCH = 13
MAX_SUBSTITUTIONS = 2
BROADCAST_SEEDS = 2_000_000
#: Places of texts that share a seed with an item.
BROADCAST_HITS = 200_000
WORD_BREAK = r"[^\p{L}\p{N}]+"


def word_hashes(text: str) -> Column:
    """64-bit hashes of the words of a text column, in order; null for null."""
    words = F.filter(F.split(F.lower(F.col(text)), WORD_BREAK), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def windows(df: DataFrame, *keep: str) -> DataFrame:
    """(keep, at, seed) of every window of SPAN words of the arrays ``h`` and every mask.

    The window's words stand beside one another as columns, so hashing runs in generated code."""
    n = F.size("h") - SPAN + 1
    beside = F.arrays_zip(*(F.slice("h", 1 + o, n).alias(f"w{o}") for o in range(SPAN)))
    rows = df.where(F.size("h") >= SPAN).select(*keep, F.posexplode(beside).alias("at", "w"))
    hashes = F.array(*(F.xxhash64(F.lit(m), *(F.col(f"w.w{o}") for o in mask)) for m, mask in enumerate(MASKS)))
    return rows.select(*keep, "at", F.explode(hashes).alias("seed"))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")


def items_of(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), word_hashes("text").alias("b")).where(F.size("b") >= SPAN).distinct()


def verified(b: Column, a: Column) -> Column:
    """Do some STRETCH aligned words (all, of a shorter item) of the arrays agree but for the substitutions?"""
    n = F.size(b)
    span = F.least(n, F.lit(STRETCH))
    same = F.transform(F.arrays_zip(b.alias("b"), a.alias("a")), lambda z: F.coalesce((z["b"] == z["a"]).cast("int"), F.lit(0)))
    need = F.when(n >= STRETCH, F.lit(STRETCH - MAX_SUBSTITUTIONS)).otherwise(n)
    return F.exists(F.sequence(F.lit(1), n - span + 1), lambda i: F.aggregate(F.slice(same, i, span), F.lit(0), lambda s, x: s + x) >= need)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Distinct (doc_id, text_key, item_id) of texts that hold an item."""
    offsets = windows(items_of(benchmark).withColumn("h", F.col("b")), "item_id").select("item_id", "seed", F.col("at").alias("of_item"))
    small = offsets.limit(BROADCAST_SEEDS + 1).count() <= BROADCAST_SEEDS
    keyed = _keyed(docs)
    spread = windows(keyed.select("doc_id", "text_key", word_hashes("text").alias("h")), "doc_id", "text_key")
    hits = spread.join(F.broadcast(offsets) if small else offsets, "seed")
    found = hits.select("doc_id", "text_key", "item_id", (F.col("at") - F.col("of_item")).alias("diagonal")).distinct()
    by_doc = found.groupBy(F.col("doc_id").alias("d"), F.col("text_key").alias("k")).agg(F.collect_list(F.struct("item_id", "diagonal")).alias("ds"))
    # the texts that have a hit are read again; they are few, unless the benchmark's words are the corpus's own
    by_doc = S.Scratch(docs.sparkSession, "leaks").put("hits", by_doc)
    few = by_doc.agg(F.coalesce(F.sum(F.size("ds")), F.lit(0))).first()[0] <= BROADCAST_HITS
    texts = keyed.join(F.broadcast(by_doc) if few else by_doc, keyed["doc_id"].eqNullSafe(by_doc["d"]) & (keyed["text_key"] == by_doc["k"]))
    rows = texts.select("doc_id", "text_key", word_hashes("text").alias("h"), "ds").select("doc_id", "text_key", "h", F.explode("ds").alias("x"))
    items = items_of(benchmark)
    rows = rows.select("doc_id", "text_key", "h", F.col("x.item_id").alias("item_id"), F.col("x.diagonal").cast("int").alias("g")).join(F.broadcast(items) if small else items, "item_id")
    # the aligned slice: positions before the text's start are null
    lead = F.array_repeat(F.lit(None).cast("long"), F.greatest(-F.col("g"), F.lit(0)))
    a = F.concat(lead, F.slice("h", F.greatest(F.col("g"), F.lit(0)) + 1, F.size("b") + F.least(F.col("g"), F.lit(0))))
    a = F.slice(F.concat(a, F.array_repeat(F.lit(None).cast("long"), F.size("b"))), F.lit(1), F.size("b"))
    return rows.select("doc_id", "text_key", "item_id", "b", a.alias("a")).where(verified(F.col("b"), F.col("a"))).select("doc_id", "text_key", "item_id").distinct()


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, contaminated, n_items, item_ids) of every row of ``docs``."""
    by_doc = leaks(docs, benchmark).groupBy(F.col("doc_id").alias("d"), F.col("text_key").alias("k")).agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    keys = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"))
    out = keys.join(by_doc, keys["doc_id"].eqNullSafe(by_doc["d"]) & (keys["text_key"] == by_doc["k"]), "left")
    ids = F.coalesce("item_ids", F.array().cast("array<bigint>"))
    return out.select("doc_id", (F.size(ids) > 0).alias("contaminated"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"))


def remove(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text holds no item, with all their columns."""
    name = S.free_name(docs.columns, "leaked_text_key")
    gone = leaks(docs, benchmark).select(F.col("text_key").alias(name)).distinct()
    gone = S.Scratch(docs.sparkSession, "leaks").put("texts", gone)
    few = gone.count() <= BROADCAST_HITS
    return docs.join(F.broadcast(gone) if few else gone, F.xxhash64(docs["text"]) == gone[name], "left_anti")


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(S.table(spark, sf_dir, "documents", "doc_id", "text"), S.table(spark, sf_dir, "benchmark", "item_id", "text"))
