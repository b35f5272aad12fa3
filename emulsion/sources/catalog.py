"""File catalogs and format detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Accepted extensions, the backend of each, and the magic bytes of each format
GALLERY = ("cr3", "dng", "tif", "tiff")
BACKENDS = {
    "cr3": "cr3", "dng": "dng", "tif": "dng", "tiff": "dng", "cr2": "cr2", "nef": "nef", "arw": "arw", "orf": "orf", "pef": "pef", "rw2": "rw2", "raf": "raf",
}
TIFF_MAGICS = (b"II*\0", b"MM\0*", b"II+\0", b"MM\0+")
MAX_ITEMS = 10_000
MAX_BYTES = 2 << 30

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def extension(path: Column) -> Column:
    return ascii_lower(F.regexp_extract(path, r"[^/.][^/]*\.([^./]+)$", 1))


def is_supported(path: Column) -> Column:
    return extension(path).isin(*GALLERY)


def backend(path: Column) -> Column:
    """The backend an extension names, or null."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in BACKENDS.items() for x in kv)), extension(path))


def sniff(head: Column) -> Column:
    """The format that a file's first bytes show: one of raf, orf, rw2, cr3, cr2, tiff, unknown."""
    at = lambda i, b: F.substring(head, i + 1, len(b)) == F.lit(b)
    tiff = at(0, TIFF_MAGICS[0]) | at(0, TIFF_MAGICS[1]) | at(0, TIFF_MAGICS[2]) | at(0, TIFF_MAGICS[3])
    return (
        F.when(at(0, b"FUJIFILMCCD-RAW"), "raf").when(at(0, b"IIRO") | at(0, b"IIRS") | at(0, b"MMOR"), "orf").when(at(0, b"IIU\0"), "rw2")
        .when(at(4, b"ftypcrx "), "cr3").when(at(0, b"II*\0") & at(8, b"CR\2\0"), "cr2").when(tiff, "tiff").otherwise("unknown")
    )


def resolve(path: Column, head: Column) -> Column:
    """Strong magic overrides the extension."""
    strong = F.when(sniff(head).isin("raf", "orf", "rw2", "cr3", "cr2"), sniff(head))
    return F.coalesce(strong, backend(path))


def first_by_name(rows: DataFrame, name: Column, tie: str, limit: int = MAX_ITEMS) -> DataFrame:
    return rows.orderBy(ascii_lower(name), tie).limit(limit)


def scan_folder(files: DataFrame, path: str, limit: int = MAX_ITEMS) -> DataFrame:
    """Supported files by lower-cased name, at most ``limit``: a top-k, so no full sort."""
    return first_by_name(files.where(is_supported(F.col(path))), F.element_at(F.split(path, "/"), -1), path, limit)


def cover(rows: DataFrame, group: Column, name: Column, pick: str) -> DataFrame:
    """Of each group the row of the least lower-cased name, compared whole."""
    return rows.groupBy(group).agg(F.min_by(pick, F.struct(ascii_lower(name), F.col(pick))).alias("cover"))


def first_per_folder(files: DataFrame, path: str) -> DataFrame:
    return cover(files, F.regexp_replace(path, "/[^/]*$", "").alias("folder"), F.element_at(F.split(path, "/"), -1), path)


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Whole files of a folder with their format; oversized files keep their row with an error and no content."""
    files = spark.read.format("binaryFile").load(path)
    small = F.col("length") < MAX_BYTES
    return files.select(
        "path", "length", resolve(F.col("path"), F.col("content")).alias("format"), F.when(small, F.col("content")).alias("content"),
        F.when(~small, F.struct(F.lit("too_large").alias("kind"), F.lit("over 2 GiB").alias("message"))).alias("error"),
    )
