"""DNG files as tables: directories, raw metadata, storage segments, and samples decoded segment by segment.

Parsing a file and decoding a segment are two steps with an exchange between them: a segment is the unit of parallelism, so
one large file doesn't keep one task busy, and no row holds a whole frame.  A bad file or segment keeps a row with ``error``.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import lossless_jpeg
from .packed import unpack
from .tiff import Directory, FormatError, Tiff

# Tag numbers of TIFF, TIFF/EP and DNG
SUBFILE, WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, MAKE, MODEL, ORIENTATION = 254, 256, 257, 258, 259, 262, 271, 272, 274
STRIP_OFFSETS, SAMPLES_PER_PIXEL, ROWS_PER_STRIP, STRIP_COUNTS, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 273, 277, 278, 279, 322, 323, 324, 325
CFA_DIM, CFA_PATTERN, VERSION, LINEARIZATION, BLACK_DIM, BLACK, WHITE = 33421, 33422, 50706, 50712, 50713, 50714, 50717
CROP_ORIGIN, CROP_SIZE, NEUTRAL, ACTIVE = 50719, 50720, 50728, 50829
CFA_PHOTOMETRIC, UNCOMPRESSED, LOSSLESS = 32803, 1, 7
MAX_VERSION = (1, 7, 1, 0)
MAX_SAMPLES, MAX_SEGMENTS = 128 << 20, 1 << 20

ERROR = "error struct<kind:string,message:string>"
DIRECTORIES = f"path string, directory int, depth int, tag int, type int, count bigint, raw binary, {ERROR}"
METADATA = (
    "path string, make string, model string, orientation int, width int, height int, bits int, compression int, cfa_rows int, cfa_columns int, cfa array<int>, "
    f"black array<double>, white array<double>, active array<bigint>, crop array<bigint>, white_balance array<double>, {ERROR}"
)
SEGMENTS = (
    "path string, segment int, y int, x int, height int, width int, stored_height int, stored_width int, bits int, compression int, little boolean, "
    f"payload binary, curve binary, {ERROR}"
)
SAMPLES = f"path string, segment int, y int, x int, height int, width int, samples array<int>, {ERROR}"


def _error(e: Exception) -> dict:
    kind = e.kind if isinstance(e, FormatError) else "corrupt"
    return {"kind": kind, "message": str(e)}


def raw_directory(tiff: Tiff) -> Directory:
    """The colour-filter directory: a primary image before others, then the largest; a tie is an error."""
    scored = [
        ((d.scalar(SUBFILE, 0) == 0, d.scalar(WIDTH) * d.scalar(HEIGHT)), d)
        for d in tiff.directories() if d.get(PHOTOMETRIC) and d.scalar(PHOTOMETRIC) == CFA_PHOTOMETRIC
    ]
    if not scored:
        raise FormatError("no_raw_directory")
    top = max(s for s, _ in scored)
    best = [d for s, d in scored if s == top]
    if len(best) > 1:
        raise FormatError("ambiguous_raw_directory", f"{len(best)} directories share a score")
    return best[0]


def _open(data: bytes) -> tuple[Tiff, Directory, Directory]:
    tiff = Tiff(data)
    main = tiff.directory(tiff.first)
    version = tuple(main.need(VERSION).unsigned)
    if len(version) != 4 or version[0] != 1 or version > MAX_VERSION:
        raise FormatError("version", ".".join(map(str, version)))
    return tiff, main, raw_directory(tiff)


def _layout(raw: Directory) -> tuple[int, int, int, int]:
    h, w, bits, compression = raw.scalar(HEIGHT), raw.scalar(WIDTH), raw.scalar(BITS), raw.scalar(COMPRESSION, 1)
    if not h or not w or h * w > MAX_SAMPLES or raw.scalar(SAMPLES_PER_PIXEL, 1) != 1:
        raise FormatError("frame", f"{w} x {h}")
    if compression not in (UNCOMPRESSED, LOSSLESS):
        raise FormatError("compression", str(compression))
    return h, w, bits, compression


def _directories(path: str, data: bytes) -> Iterator[dict]:
    for i, d in enumerate(Tiff(data).directories()):
        for e in d.entries:
            yield {"path": path, "directory": i, "depth": d.depth, "tag": e.tag, "type": e.type, "count": e.count, "raw": e.raw}


def _metadata(path: str, data: bytes) -> Iterator[dict]:
    _, main, raw = _open(data)
    h, w, bits, compression = _layout(raw)
    text = lambda tag: e.text if (e := main.get(tag)) else ""
    numbers = lambda d, tag: [float(v) for v in e.values] if (e := d.get(tag)) else None
    rows, columns = raw.need(CFA_DIM).unsigned
    cfa = list(raw.need(CFA_PATTERN).values)
    if len(cfa) != rows * columns or not cfa:
        raise FormatError("cfa", f"{len(cfa)} cells for {rows} x {columns}")
    active = list(e.unsigned) if (e := raw.get(ACTIVE)) else [0, 0, h, w]
    if len(active) != 4 or not (active[0] < active[2] <= h and active[1] < active[3] <= w):
        raise FormatError("active_area", str(active))
    crop = None
    if raw.get(CROP_SIZE):
        (cx, cy), (cw, ch) = numbers(raw, CROP_ORIGIN) or (0.0, 0.0), numbers(raw, CROP_SIZE)
        crop = [active[1] + int(cx), active[0] + int(cy), int(cw), int(ch)]
    neutral = numbers(main, NEUTRAL)
    if neutral and (len(neutral) != 3 or min(neutral) <= 0):
        raise FormatError("neutral", str(neutral))
    yield {
        "path": path, "make": text(MAKE), "model": text(MODEL), "orientation": main.scalar(ORIENTATION, 1), "width": w, "height": h, "bits": bits, "compression": compression,
        "cfa_rows": rows, "cfa_columns": columns, "cfa": cfa, "black": numbers(raw, BLACK) or [0.0], "white": numbers(raw, WHITE) or [float((1 << bits) - 1)], "active": active,
        "crop": crop, "white_balance": [neutral[1] / n for n in neutral] if neutral else None,
    }


def _segments(path: str, data: bytes) -> Iterator[dict]:
    tiff, _, raw = _open(data)
    h, w, bits, compression = _layout(raw)
    tiled = raw.get(TILE_OFFSETS) is not None
    if tiled == (raw.get(STRIP_OFFSETS) is not None):
        raise FormatError("storage", "strips or tiles, not both")
    th, tw = (raw.scalar(TILE_HEIGHT), raw.scalar(TILE_WIDTH)) if tiled else (min(raw.scalar(ROWS_PER_STRIP, h), h), w)
    offsets, counts = (raw.need(t).unsigned for t in ((TILE_OFFSETS, TILE_COUNTS) if tiled else (STRIP_OFFSETS, STRIP_COUNTS)))
    if not th or not tw or not len(offsets) == len(counts) == -(-h // th) * -(-w // tw) <= MAX_SEGMENTS:
        raise FormatError("segments", f"{len(offsets)} offsets and {len(counts)} lengths")
    spans = sorted(zip(offsets, counts, strict=True))
    if any(a + n > b for (a, n), (b, _) in zip(spans, spans[1:], strict=False)):
        raise FormatError("overlap", "segments overlap")
    curve = np.asarray(e.unsigned, "<u2").tobytes() if (e := raw.get(LINEARIZATION)) else None
    across = -(-w // tw)
    for i, (at, n) in enumerate(zip(offsets, counts, strict=True)):
        y, x = i // across * th, i % across * tw
        yield {
            "path": path, "segment": i, "y": y, "x": x, "height": min(th, h - y), "width": min(tw, w - x), "stored_height": th if tiled else min(th, h - y), "stored_width": tw,
            "bits": bits, "compression": compression, "little": tiff.order == "<", "payload": tiff.slice(at, n), "curve": curve,
        }


def decode_segment(row: dict) -> np.ndarray:
    """Samples of one segment, cropped to the image and, where there is a curve, linearised; indices beyond it take its last entry."""
    h, w, bits, payload = row["stored_height"], row["stored_width"], row["bits"], bytes(row["payload"])
    if row["compression"] == UNCOMPRESSED:
        got = unpack(payload, h, w, bits, row["little"])
    else:
        got, precision = lossless_jpeg.decode(payload)
        if precision != bits or got.size != h * w:
            raise FormatError("segment", f"{got.size} samples of {precision} bits")
        got = got.reshape(h, w)
    got = got[: row["height"], : row["width"]]
    if row["curve"] is not None and len(row["curve"]):
        curve = np.frombuffer(row["curve"], "<u2")
        got = curve[np.minimum(got, len(curve) - 1)]
    return got


def _arrow(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


def _each_file(files: DataFrame, schema: str, parse) -> DataFrame:
    """Rows that ``parse`` gives for each (path, content), a batch of them per file; null content gives an ``unreadable`` error."""

    to = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.to_pylist():
                try:
                    if file["content"] is None:
                        raise FormatError("unreadable", "no content")
                    rows = list(parse(file["path"], file["content"]))
                except (ValueError, TypeError, KeyError, struct.error) as e:
                    rows = [{"path": file["path"], "error": _error(e)}]
                yield pa.RecordBatch.from_pylist(rows, to)

    return files.select("path", "content").mapInArrow(run, schema)


def directories(files: DataFrame) -> DataFrame:
    """One row per entry of every directory of each TIFF file."""
    return _each_file(files, DIRECTORIES, _directories)


def metadata(files: DataFrame) -> DataFrame:
    return _each_file(files, METADATA, _metadata)


def segments(files: DataFrame) -> DataFrame:
    """Stored strips or tiles with their bytes; an exact count, bounds and no overlap are required."""
    return _each_file(files, SEGMENTS, _segments)


def decode(files: DataFrame) -> DataFrame:
    """Samples of every segment, row-major in the segment's rectangle."""
    kept = ("path", "segment", "y", "x", "height", "width", "error")
    to = _arrow(SAMPLES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (row,) = batch.slice(i, 1).to_pylist()
                out = {n: row[n] for n in kept}
                if row["error"] is None:
                    try:
                        out["samples"] = decode_segment(row).reshape(-1).astype(np.int32)
                    except (ValueError, TypeError) as e:
                        out["error"] = _error(e)
                yield pa.RecordBatch.from_pylist([out], to)

    return segments(files).repartition("path", "segment").mapInArrow(run, SAMPLES)


def pixels(decoded: DataFrame) -> DataFrame:
    """(path, y, x, value) of decoded segments, for the raster operators."""
    at = decoded.where("error is null").select("path", "y", "x", "width", F.posexplode("samples").alias("i", "value"))
    return at.select("path", F.expr("y + i div width").cast("int").alias("y"), F.expr("x + i % width").alias("x"), "value")
