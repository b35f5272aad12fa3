"""Content-addressed artifacts: fingerprints, canonical recipe bytes, keys and overlap checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE = 65536
RECIPE_MAGIC, RECIPE_VERSION, RECIPE_KIND = b"RMR\0", 1, 1


def sample_offsets(size: Column, sample: int = SAMPLE) -> Column:
    """Ascending distinct offsets of the head, middle and tail samples; only the head of a small file."""
    return F.when(size <= sample, F.array(F.lit(0).cast("long"))).otherwise(F.array_sort(F.array_distinct(F.array(F.lit(0).cast("long"), F.floor((size - sample) / 2), (size - sample).cast("long")))))


def sampled_fingerprint(text: Column, sample: int = SAMPLE) -> Column:
    """SHA-256 of the length and of head, middle and tail, so its cost does not follow the length."""
    n = F.length(text)
    mid = F.greatest(F.floor((n - sample) / 2), F.lit(0)).cast("int") + 1
    tail = F.greatest(n - sample, F.lit(0)).cast("int") + 1
    return F.sha2(F.concat_ws("|", n.cast("string"), F.substring(text, 1, sample), F.substr(text, mid, F.lit(sample)), F.substr(text, tail, F.lit(sample))), 256)


def little_endian(value: Column, size: int) -> Column:
    return F.unhex(F.concat(*(F.lpad(F.hex(F.shiftright(value.cast("long"), 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(size))))


def recipe_bytes(backend: Column, backend_rev: Column, adapter_rev: Column, model_rev: Column, flags: Column, digest: Column) -> Column:
    """The canonical 64-byte recipe manifest."""
    head = F.lit(RECIPE_MAGIC + RECIPE_VERSION.to_bytes(2, "little") + RECIPE_KIND.to_bytes(2, "little"))
    return F.concat(head, *(little_endian(c, 4) for c in (backend, backend_rev, adapter_rev, model_rev, flags)), digest, F.lit(b"\0" * 4))


def object_path(key_hex: Column) -> Column:
    return F.concat_ws("/", F.substring(key_hex, 1, 2), F.concat(key_hex, F.lit(".rrc")))


def overlaps(segments: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Segments that begin before an earlier one of their file has ended."""
    w = Window.partitionBy(key).orderBy(start, end)
    return segments.withColumn("_e", F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))).where(F.col("_e") > F.col(start)).drop("_e")


def best_candidate(rows: DataFrame, key: str, score: list[str], pick: str) -> DataFrame:
    """The best row of each key with how many share its score; more than one is ambiguous."""
    s = F.struct(*score)
    top = rows.groupBy(key).agg(F.max(s).alias("_s"), F.min_by(F.struct(F.col(pick)), F.struct(*(-F.col(c) for c in score), F.col(pick))).alias("_p"))
    ties = rows.withColumn("_r", s).join(top, key).where("_r = _s").groupBy(key).agg(F.count("*").alias("n_best"), F.first("_p").alias("_p"))
    return ties.select(key, F.col(f"_p.{pick}").alias(pick), "n_best", (F.col("n_best") > 1).alias("ambiguous"))
