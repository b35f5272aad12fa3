"""ISO base media boxes: the tree, and the sample tables of tracks resolved to byte ranges."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .dng import ERROR, _each_file
from .tiff import FormatError

# Boxes that hold boxes
CONTAINERS = ("moov", "trak", "mdia", "minf", "stbl", "dinf")
MAX_DEPTH, MAX_BOXES = 16, 65536
BOXES = f"path string, box int, parent int, depth int, kind string, start bigint, length bigint, {ERROR}"
SAMPLE_TABLES = f"path string, track int, name string, position bigint, a bigint, b bigint, {ERROR}"


def boxes(data: bytes) -> list[dict]:
    """Every box in file order; sizes of 32 bits, 64 bits and to the end of the parent.  ``start`` and ``length`` are of the payload."""
    out: list[dict] = []

    def walk(at: int, end: int, parent: int, depth: int) -> None:
        if depth > MAX_DEPTH:
            raise FormatError("limit", "depth")
        while at < end:
            if at + 8 > end:
                raise FormatError("bounds", f"box header at {at}")
            size, head = int.from_bytes(data[at : at + 4], "big"), 8
            kind = data[at + 4 : at + 8].decode("latin-1")
            if size == 1:
                if at + 16 > end:
                    raise FormatError("bounds", f"box header at {at}")
                size, head = int.from_bytes(data[at + 8 : at + 16], "big"), 16
            elif size == 0:
                size = end - at
            if size < head or at + size > end:
                raise FormatError("bounds", f"box {kind!r} at {at}")
            if len(out) >= MAX_BOXES:
                raise FormatError("limit", "boxes")
            me = len(out)
            out.append({"box": me, "parent": parent, "depth": depth, "kind": kind, "start": at + head, "length": size - head})
            if kind in CONTAINERS:
                walk(at + head, at + size, me, depth + 1)
            at += size

    walk(0, len(data), -1, 0)
    return out


def _tables(path: str, data: bytes) -> Iterator[dict]:
    found = boxes(data)
    trak = {}
    for b in found:
        trak[b["box"]] = b["box"] if b["kind"] == "trak" else trak.get(b["parent"])
    ids = {}
    for b in found:
        if b["kind"] == "tkhd" and trak[b["box"]] is not None:
            at = b["start"]
            ids[trak[b["box"]]] = struct.unpack_from(">I", data, at + (20 if data[at] == 1 else 12))[0]
    for b in found:
        owner, at, end = trak[b["box"]], b["start"], b["start"] + b["length"]
        if owner is None or b["kind"] not in ("stsz", "stsc", "stco", "co64"):
            continue
        row = {"path": path, "track": ids.get(owner, 0)}
        head = 12 if b["kind"] == "stsz" else 8
        if at + head > end:
            raise FormatError("bounds", b["kind"])
        fixed, n = struct.unpack_from(">II", data, at + 4) if b["kind"] == "stsz" else (0, struct.unpack_from(">I", data, at + 4)[0])
        width = {"stsz": 0 if fixed else 4, "stsc": 12, "stco": 4, "co64": 8}[b["kind"]]
        if at + head + n * width > end:
            raise FormatError("bounds", f"{n} entries of {b['kind']}")
        for i in range(n):
            p = at + head + i * width
            if b["kind"] == "stsz":
                yield row | {"name": "size", "position": i, "a": fixed or struct.unpack_from(">I", data, p)[0]}
            elif b["kind"] == "stsc":
                first, per, _ = struct.unpack_from(">III", data, p)
                yield row | {"name": "run", "position": i, "a": first, "b": per}
            else:
                yield row | {"name": "chunk", "position": i + 1, "a": struct.unpack_from(">Q" if width == 8 else ">I", data, p)[0]}


def box_table(files: DataFrame) -> DataFrame:
    return _each_file(files, BOXES, lambda path, data: ({"path": path} | b for b in boxes(data)))


def sample_tables(files: DataFrame) -> DataFrame:
    """Sample sizes, sample-to-chunk runs and chunk offsets of every track as one long table."""
    return _each_file(files, SAMPLE_TABLES, _tables)


def sample_locations(tables: DataFrame) -> DataFrame:
    """(path, track, sample, start, length): a chunk takes the last run that begins at or before it, samples follow each other in a chunk.

    Windows are over one track, whose tables are bounded by its file.
    """
    key = ["path", "track"]
    good = tables.where("error is null and name <> 'size'")
    w = Window.partitionBy(*key).orderBy("at", F.col("name").desc()).rowsBetween(Window.unboundedPreceding, 0)
    lined = good.withColumn("at", F.when(F.col("name") == "run", F.col("a")).otherwise(F.col("position")))
    chunks = lined.withColumn("n", F.last(F.when(F.col("name") == "run", F.col("b")), True).over(w)).where("name = 'chunk'")
    before = Window.partitionBy(*key).orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    placed = chunks.where("n > 0").select(*key, F.col("a").alias("offset"), "position", F.explode(F.expr("sequence(first, first + n - 1)")).alias("sample"))
    sizes = tables.where("error is null and name = 'size'").select(*key, F.col("position").alias("sample"), F.col("a").alias("length"))
    within = Window.partitionBy(*key, "position").orderBy("sample").rowsBetween(Window.unboundedPreceding, -1)
    return placed.join(sizes, [*key, "sample"]).select(*key, "sample", (F.col("offset") + F.coalesce(F.sum("length").over(within), F.lit(0))).alias("start"), "length")
