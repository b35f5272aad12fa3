"""The corpus pipeline: four filters and an encoder of emulsion.llm, each over all rows that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs.  All but the last return the columns of documents; the last adds token_ids, n_tokens and decoded.

Defined cases, of every stage: null and empty texts go at the quality rules (too few words) and are kept as they are by the
other stages; a null id is a row of its own, never the copy of another; rows that share an id are judged by their own texts and, in
near-dedup, stay together; texts of any length are taken whole; an empty table gives an empty one; empty labels leave the
base rules alone, an empty benchmark removes nothing; further columns, of any name, are kept, and the last stage appends
underscores to the names of its own where a column has them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from emulsion.llm import decontaminate, minhash_dedup, quality_rules, sentencepiece_codec, suffix_dedup
from emulsion.llm._spark import Scratch, table
from emulsion.llm.token_output import public_tokenizer


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more) stays."""
    return minhash_dedup.dedup(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that also stand in an earlier document are cut from the text."""
    return suffix_dedup.strip(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text with its piece ids and what they decode to."""
    return sentencepiece_codec.roundtrip(docs, public_tokenizer("piece_bpe_32k.model"))


STAGES = [("quality_rules", quality), ("minhash_dedup", near_dedup), ("suffix_dedup", passages), ("decontamination", benchmark), ("sentencepiece", encode)]

#: SQL can't express learned rules, sketches or the encoder; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.put(name, stage(spark, docs, sf_dir))
    return docs
