"""Benchmark sample logs: CSV with a header, JSON arrays, and JSON lines of which malformed ones are skipped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLE = "fixture string, mode string, workers string, backend string, iteration int, latency_ms double, real_seconds double, status string"

KEYS = ("fixture", "mode", "workers", "backend")


def read(spark: SparkSession, path: str) -> DataFrame:
    if path.endswith(".csv"):
        return spark.read.option("header", True).csv(path)
    multi = path.endswith(".json")
    rows = spark.read.option("multiLine", multi).option("mode", "DROPMALFORMED").json(path)
    return flatten(rows)


def flatten(rows: DataFrame) -> DataFrame:
    """Nested ``sample`` and its ``metrics`` become columns; the inner value wins."""
    for group in ("sample", "metrics"):
        kind = {f.name: f.dataType for f in rows.schema.fields}.get(group)
        if kind is None or not hasattr(kind, "fields"):
            continue
        inner = {f.name: F.col(f"{group}.{f.name}") for f in kind.fields}
        keep = [c for c in rows.columns if c != group and c not in inner]
        rows = rows.select(*keep, *(v.alias(k) for k, v in inner.items()))
    return rows


def load_baseline(spark: SparkSession, path: str, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The groups of an earlier report, a list of them or an object with ``groups``; keys are texts, empty where missing, and of equal
    keys the last counts.  A report without groups gives no rows."""
    rows = spark.read.option("multiLine", True).json(path)
    if "groups" in rows.columns:
        kind = rows.schema["groups"].dataType
        if not hasattr(getattr(kind, "elementType", None), "fields"):
            return spark.createDataFrame([], ", ".join(f"{k} string" for k in keys))
        rows = rows.select(F.explode("groups").alias("g")).select("g.*")
    text = {k: F.coalesce(F.col(k).cast("string"), F.lit("")) if k in rows.columns else F.lit("") for k in keys}
    named = rows.withColumns(text)
    rest = [c for c in named.columns if c not in keys]
    numbered = named.withColumn("_place", F.monotonically_increasing_id())
    return numbered.groupBy(*keys).agg(F.max_by(F.struct(*map(F.col, rest)), "_place").alias("x")).select(*keys, "x.*") if rest else named.distinct()


def manifest_columns(path: Column, content: Column) -> dict[str, Column]:
    """Path, name, size and SHA-256 of a file's whole content."""
    return {"path": path, "name": F.element_at(F.split(path, "/"), -1), "size_bytes": F.octet_length(content).cast("long"), "sha256": F.sha2(content, 256)}


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A row for each file under a path or pattern; a file is one row of its task, so it must fit there (2 GB at most).

    Spark's reader of whole files passes over empty ones, so these have no row."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(*(c.alias(n) for n, c in manifest_columns(F.col("path"), F.col("content")).items()))


def write_report(report: DataFrame, path: str) -> None:
    """JSON with nulls where a number is not finite."""
    safe = [F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in report.dtypes]
    report.select(*safe).write.mode("overwrite").json(path)
