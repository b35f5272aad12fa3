"""Sharding by size-tiered compaction with a versioned manifest, in DataFrame functions only.

``append`` writes the rows of every task as one small immutable shard, with no shuffle, and commits a manifest that adds
them.  ``compact`` puts shards into tiers by size (each tier FANOUT times the next) and merges a tier by reading its shards
with Spark's own packing of files into read tasks of TARGET_BYTES: a task reads several whole shards and writes one, so
rows are moved once, without a shuffle, a join or a key.  Shards are never changed.

A version is one small file that names a folder of manifest rows; it is written aside and renamed into place without
overwriting, so of two writers one finds the name taken, takes up the other's version and tries again (this needs a file system
whose rename is atomic, such as HDFS).  Readers see a whole version or the one before.  ``vacuum`` deletes data files that no kept
version names and that are older than an age, so neither old versions nor writers at work lose a file.

Scale: a merge job takes at most MERGE_SHARDS shards, so the driver holds that many names, not the table's; reading names
a folder in place of its files wherever all of them belong to the version.

Defined cases: nulls, empty and long texts, repeated rows and extra columns of any name are stored as they are; an empty table
appends no shard and reads back as an empty table of its schema; a single shard in a tier is left alone; ``locate`` calls its
columns shard_path and shard_bytes, with underscores appended where the table has such a column.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import _spark as S

TARGET_BYTES = 64 << 20
FANOUT = 4
#: Shards that one merge job takes; the rest of a tier is left to the next job.
MERGE_SHARDS = 20_000
CODEC = "zstd"
KEEP_VERSIONS = 2
KEEP_SECONDS = 24 * 3600
MANIFEST = "path string, shard_id string, bytes long, rows long, folder string, of_folder long"


class ShardedTable:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._path = lambda p: self._jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # ---- manifest
    def versions(self) -> list[int]:
        """The committed versions that are kept, ascending."""
        at = self._path(f"{self.root}/_versions")
        names = [x.getPath().getName() for x in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())

    def version(self) -> int:
        """The newest committed version; 0 before the first."""
        return max(self.versions(), default=0)

    def _folder(self, version: int) -> str:
        """The folder of manifest rows that a version names."""
        reader = self._jvm.java.io.BufferedReader(self._jvm.java.io.InputStreamReader(self._fs.open(self._path(f"{self.root}/_versions/v{version:08d}")), "UTF-8"))
        try:
            return reader.readLine()
        finally:
            reader.close()

    def manifest(self, version: int | None = None) -> DataFrame:
        v = self.version() if version is None else version
        if not v:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/_manifests/{self._folder(v)}")

    def _commit(self, shards: DataFrame, base: int) -> int | None:
        """Publish ``shards`` as version base + 1; None if another writer has published that version."""
        name = uuid.uuid4().hex
        shards.write.parquet(f"{self.root}/_manifests/{name}")
        aside = self._path(f"{self.root}/_versions/.{name}")
        out = self._fs.create(aside)
        out.write(bytearray(name.encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(aside, self._path(f"{self.root}/_versions/v{base + 1:08d}"), options)
        except Exception as e:
            self._fs.delete(aside, False)
            self._fs.delete(self._path(f"{self.root}/_manifests/{name}"), True)
            if "FileAlreadyExistsException" in str(e):
                return None
            raise
        return base + 1

    def _written(self, at: str) -> DataFrame:
        """A manifest row for each file with rows under ``at``; footers and listings only, no text."""
        # without a column of the table's own, _metadata can only be Spark's
        files = self.spark.read.schema(StructType()).option("recursiveFileLookup", True).parquet(at)
        meta = F.col("_metadata")
        got = files.select(meta["file_path"].alias("path"), meta["file_size"].alias("bytes")).groupBy("path", "bytes").agg(F.count("*").alias("rows"))
        got = got.withColumn("folder", F.regexp_replace("path", "/[^/]*$", ""))
        shard = F.regexp_replace(F.substring_index("path", "/_data/", -1), r"/|part-|\.zstd\.parquet|\.c\d+", "").alias("shard_id")
        n = self._fs.getContentSummary(self._path(at)).getFileCount() if self._fs.exists(self._path(at)) else 0
        return got.select("path", shard, "bytes", "rows", "folder", F.lit(n).cast("long").alias("of_folder"))

    # ---- writers
    def _store(self, df: DataFrame, kind: str) -> str:
        at = f"{self.root}/_data/{kind}-{uuid.uuid4().hex}"
        df.write.option("compression", CODEC).option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(at)
        return at

    def append(self, df: DataFrame) -> int:
        """Store the rows of ``df`` as small shards, one for each non-empty task; the version that holds them."""
        new = self._written(self._store(df, "append"))
        while True:
            base = self.version()
            version = self._commit(self.manifest(base).unionByName(new), base)
            if version:
                return version

    def plan(self, target: int = TARGET_BYTES, fanout: int = FANOUT) -> DataFrame:
        """(path, shard_id, bytes, tier) of shards to merge: those of half the target at most, in tiers that hold two or more."""
        tier = F.floor(F.log(float(fanout), F.lit(float(target)) / F.greatest(F.col("bytes"), F.lit(1)))).cast("int")
        small = self.manifest().where(F.col("bytes") * 2 <= target).select("path", "shard_id", "bytes", tier.alias("tier"))
        several = small.groupBy("tier").agg(F.count("*").alias("n")).where("n > 1").select("tier")
        return small.join(several, "tier", "left_semi")

    def _packed(self, target: int) -> SparkSession:
        """A session whose read tasks take whole files up to ``target`` bytes together."""
        session = self.spark.newSession()
        for key, value in (("maxPartitionBytes", target), ("openCostInBytes", 0), ("minPartitionNum", 1)):
            session.conf.set(f"spark.sql.files.{key}", str(value))
        session.conf.unset("spark.sql.files.maxPartitionNum")
        return session

    def compact(self, schema, target: int = TARGET_BYTES, fanout: int = FANOUT, most: int = MERGE_SHARDS) -> int:
        """Merge until no tier holds two shards; the version that is then current."""
        packed = self._packed(target)
        while True:
            plan = self.plan(target, fanout)
            first = plan.agg(F.max("tier")).first()[0]  # the smallest shards first
            if first is None:
                return self.version()
            some = plan.where(F.col("tier") == first).orderBy("shard_id").limit(most).select("path", "bytes").collect()
            paths = [x.path for x in some]
            gone = self.spark.createDataFrame([(p,) for p in paths], "path string")
            # read tasks hold a target each; where a session's settings make them smaller, whole tasks are put together
            fewer = -(-sum(x.bytes for x in some) // target)
            new = self._written(self._store(packed.read.schema(schema).parquet(*paths).coalesce(fewer), "merge"))
            while True:
                base = self.version()
                now = self.manifest(base)
                if now.join(gone, "path", "left_semi").count() < len(paths):
                    break  # another writer has merged some of them: the new files are named by no version
                if self._commit(now.join(gone, "path", "left_anti").unionByName(new), base):
                    break

    # ---- readers
    def paths(self, version: int | None = None) -> list[str]:
        """What to read for a version: folders where all their files belong to it, files elsewhere."""
        rows = self.manifest(version)
        whole = rows.groupBy("folder", "of_folder").agg(F.count("*").alias("n")).where("n = of_folder").select("folder")
        some = rows.join(whole, "folder", "left_anti").select("path")
        return [x[0] for x in whole.union(some).collect()]

    def read(self, schema, version: int | None = None) -> DataFrame:
        """The rows of a version."""
        paths = self.paths(version)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def locate(self, schema, version: int | None = None) -> DataFrame:
        """The rows of a version with the shard each lies in and its size (columns shard_path, shard_bytes)."""
        rows = self.read(schema, version)
        path, size = (S.free_name(rows.columns, x) for x in ("shard_path", "shard_bytes"))
        if not self.paths(version):
            return rows.withColumns({path: F.lit("").cast("string"), size: F.lit(0).cast("long")})
        meta = rows.metadataColumn("_metadata")
        return rows.select("*", meta["file_path"].alias(path), meta["file_size"].alias(size))

    def vacuum(self, keep: int = KEEP_VERSIONS, seconds: float = KEEP_SECONDS) -> int:
        """Forget all but the newest ``keep`` versions and delete data files that no kept version names and that are older than
        ``seconds``; how many.  With ``seconds`` under the time that a writer takes no other writer may be at work."""
        versions = self.versions()
        for v in versions[: -max(1, keep)]:
            self._fs.delete(self._path(f"{self.root}/_manifests/{self._folder(v)}"), True)
            self._fs.delete(self._path(f"{self.root}/_versions/v{v:08d}"), False)
        live = self.manifest(0)
        for v in versions[-max(1, keep) :]:
            live = live.union(self.manifest(v))
        live = live.select("path", "folder", "of_folder").distinct()
        whole = live.groupBy("folder", "of_folder").agg(F.count("*").alias("n")).where("n = of_folder").select("folder")
        name = lambda path: path.rsplit("/_data/", 1)[1]
        skip = {name(x.folder) for x in whole.collect()}
        named = {name(x.path) for x in live.join(whole, "folder", "left_anti").select("path").collect()}
        at = self._path(f"{self.root}/_data")
        before, gone = 1000 * (time.time() - seconds), 0
        for folder in self._fs.listStatus(at) if self._fs.exists(at) else []:
            if folder.getPath().getName() in skip:
                continue
            old = [x.getPath() for x in self._fs.listStatus(folder.getPath()) if x.isFile() and x.getModificationTime() <= before]
            dead = [p for p in old if f"{folder.getPath().getName()}/{p.getName()}" not in named]
            gone += sum(bool(self._fs.delete(p, False)) and p.getName().startswith("part-") for p in dead)
            if folder.getModificationTime() <= before and not self._fs.listStatus(folder.getPath()):
                self._fs.delete(folder.getPath(), False)
        return gone


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append the documents as they arrive, compact, and read every row back from the shards of the newest manifest."""
    docs = S.table(spark, sf_dir, "documents")
    table = ShardedTable(spark, S.Scratch(spark, "shards").root)
    table.append(docs)
    version = table.compact(docs.schema)
    table.vacuum(keep=1, seconds=0)  # the table is this query's own
    out = table.locate(docs.schema)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return out.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.length(text).cast("long").alias("n_bytes"), F.crc32(text).alias("text_crc32"),
        F.substring_index(out.columns[-2], "/", -1).alias("shard"), F.col(out.columns[-1]).alias("shard_bytes"), F.lit(version).alias("version"),
    )
