"""Session helpers: table access and lineage cuts in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a new local folder in local mode and an error on a cluster."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        at = "file://" + tempfile.mkdtemp(prefix="emulsion-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def free_name(columns, name: str) -> str:
    """``name``, with underscores appended until no column has it (names compare without case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def map_batches(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow(run, schema)`` for columns of any names, also those that Spark's own method can't resolve (as a.b)."""
    names, out = df.columns, [f.name for f in schema]
    plain = type(schema)([type(f)(f"c{i}", f.dataType, True) for i, f in enumerate(schema)])

    def renamed(batches):
        for batch in run(b.rename_columns(names) for b in batches):
            yield batch.rename_columns([f"c{i}" for i in range(len(out))])

    return df.toDF(*(f"c{i}" for i in range(len(names)))).mapInArrow(renamed, plain).toDF(*out)


class Scratch:
    """Tables written once and read back: lineage is cut, a lost executor costs a reread and nothing else.

    What is not dropped before is deleted when the application ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/emulsion/{name}-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def put(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names or ("",):
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def free_shuffles(self) -> None:
        """Lets Spark delete the shuffle files of plans that nothing refers to any more."""
        import gc
        import time

        for _ in range(2):  # what the first collection lets go of, the second one finds
            gc.collect()
            self.spark._jvm.System.gc()
            time.sleep(0.5)


def crc_fold(column: str, folds: int):
    """crc32 of the id as text, modulo ``folds``; null counts as the text ''."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % folds


def bounded_sample(df: DataFrame, id_column: str, rows: int) -> DataFrame:
    """At most ``rows`` rows, those with the smallest hash of the id: the same rows at any partitioning."""
    return df.orderBy(F.xxhash64(F.col(id_column)), F.col(id_column)).limit(rows)


#: Ids of a sample up to this count are sent to every executor; each takes 8 bytes and a label.
BROADCAST_IDS = 200_000


def sample_rows(docs: DataFrame, sample: DataFrame, rows: int) -> DataFrame:
    """(doc_id, label, text) of one row of ``docs`` for each id of ``sample`` (doc_id, label; at most ``rows`` distinct ids).

    Of rows that share an id the one with the smallest hash of the text counts, so the result is bounded too.  The ids are
    broadcast where they are few, so no text is shuffled but those of the sample."""
    some = docs.select("doc_id", "text").where("doc_id is not null").join(F.broadcast(sample) if rows <= BROADCAST_IDS else sample, "doc_id")
    return some.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
