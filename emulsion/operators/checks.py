"""Checks and derived values of frame metadata, tile plans and cache counters, as column expressions and plain aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import frame as X

# Limits of a tile plan, in samples and bytes
HALO, LARGEST_TILE, SMALLEST_TILE, ALIGNED = 1, 1024, 32, 128
ATLAS_BYTES = 512 << 20
SINGLE_TILE = (7, 8)
COLOURS = {"red": 0, "green": 1, "blue": 2}
KINDS = {"cr2": "cr2", "cr3": "cr3", "dng": "dng", "tif": "dng", "tiff": "dng"}


# ---- frames
def grid_error(width: Column, height: Column, components: Column, values: Column, name: str) -> Column:
    """Why a repeating grid of levels is not valid: its length, then a value that is not finite; null if it is."""
    want = width * height * components
    odd = F.exists(values, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when((want == 0) | (want != F.size(values)), f"{name} length").when(odd, f"{name} not finite")


def frame_error(m: dict[str, Column]) -> Column:
    """The first rule that a frame breaks, or null: size, bit depth, black grid, CFA length, CFA components, rectangles (structs or
    null), colour calibration, white level."""
    odd = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    outside = lambda r: m[r].isNotNull() & ~X.fits_within(m[r]["x"], m[r]["y"], m[r]["width"], m[r]["height"], m["width"], m["height"])
    cells = m["cfa_width"] * m["cfa_height"]
    mosaic = m["cfa"].isNotNull()
    return F.coalesce(
        F.when((m["width"] == 0) | (m["height"] == 0) | (m["components"] == 0), "empty frame"),
        F.when((m["bits"] < 1) | (m["bits"] > 16), "bit depth"),
        grid_error(m["black_width"], m["black_height"], m["black_components"], m["black"], "black level"),
        F.when(mosaic & ((cells == 0) | (cells != F.size(m["cfa"]))), "cfa length"),
        F.when((m["photometric"] == "cfa") & ((m["components"] != 1) | ~mosaic), "cfa components"),
        F.when(outside("active"), "active area"),
        F.when(outside("crop"), "crop area"),
        F.when(F.exists(m["calibration"], odd), "colour calibration"),
        F.when((F.size(m["white"]) == 0) | F.exists(m["white"], lambda v: odd(v) | (v <= 0)), "white level"),
    )


def bayer_quad(width: Column, height: Column, cells: Column) -> Column:
    """The codes of a 2x2 grid of one red, two green and one blue cell, row by row; null for any other grid."""
    code = F.transform(cells, lambda c: F.coalesce(*(F.when(c == k, v) for k, v in COLOURS.items())))
    good = (width == 2) & (height == 2) & (F.size(cells) == 4) & (F.array_sort(code) == F.array(*map(F.lit, (0, 1, 1, 2))))
    return F.when(good, code)


def shader_code(orientation: Column) -> Column:
    """The place of an orientation in ORIENTATIONS; 0 for one that is unknown."""
    place = F.array_position(F.array(*map(F.lit, X.ORIENTATIONS)), orientation)
    return F.greatest(F.coalesce(place, F.lit(0)) - 1, F.lit(0)).cast("int")


def display_size(orientation: Column, crop: Column) -> Column:
    """struct(width, height) of the crop as shown."""
    turned = F.coalesce(X.swaps(orientation), F.lit(False))
    return F.struct(F.when(turned, crop["height"]).otherwise(crop["width"]).alias("width"), F.when(turned, crop["width"]).otherwise(crop["height"]).alias("height"))


def byte_length(width: Column, height: Column, components: Column) -> Column:
    """Bytes of the 16-bit samples of a frame."""
    return width.cast("long") * height * components * 2


def exact_u32(value: Column) -> Column:
    """A double as a whole number of 32 unsigned bits, or null."""
    whole = value.isNotNull() & ~F.isnan(value) & (value >= 0) & (value <= X.U32) & (value == F.floor(value))
    return F.when(whole, value.cast("long"))


def finite_f32(value: Column) -> Column:
    """A double as a finite float, or null."""
    narrow = value.cast("float")
    return F.when(narrow.isNotNull() & ~F.isnan(narrow) & (F.abs(narrow) != float("inf")), narrow)


# ---- names and durations
def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def raw_kind(path: Column) -> Column:
    """The kind of a raw file by its extension in any case; 'unknown' for others."""
    ending = F.lower(F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1))
    return F.coalesce(*(F.when(ending == k, v) for k, v in KINDS.items()), F.lit("unknown"))


def _shown(ns: Column, unit: int, places: int) -> Column:
    """ns / unit with ``places`` decimals, ties to the even digit, as text."""
    step = unit // 10**places
    low, rest = F.floor(ns / step), ns % step
    up = (rest * 2 > step) | ((rest * 2 == step) & (low % 2 == 1))
    n = low + up.cast("long")
    if not places:
        return n.cast("string")
    return F.concat(F.floor(n / 10**places).cast("string"), F.lit("."), F.lpad((n % 10**places).cast("string"), places, "0"))


def duration_text(ns: Column) -> Column:
    """Milliseconds with two decimals from 1 ms, whole microseconds from 1 us, else nanoseconds."""
    return F.when(ns >= 1_000_000, F.concat(_shown(ns, 1_000_000, 2), F.lit(" MS"))).when(ns >= 1000, F.concat(_shown(ns, 1000, 0), F.lit(" US"))).otherwise(F.concat(ns.cast("string"), F.lit(" NS")))


def enclosing_duration_text(prefix: str, ns: Column) -> Column:
    """The same after a prefix, with one decimal and no space."""
    shown = F.when(ns >= 1_000_000, F.concat(_shown(ns, 1_000_000, 1), F.lit("MS"))).when(ns >= 1000, F.concat(_shown(ns, 1000, 0), F.lit("US"))).otherwise(F.concat(ns.cast("string"), F.lit("NS")))
    return F.concat(F.lit(f"{prefix} "), shown)


# ---- tiles
def _up(a: Column, b: Column) -> Column:
    return F.floor((a + b - 1) / b)


def layers(width: Column, height: Column, tile: Column) -> Column:
    return F.when(tile > 0, _up(width, tile) * _up(height, tile)).otherwise(F.lit((1 << 63) - 1))


def default_tile(width: Column, height: Column, largest: Column, most_layers: Column) -> Column:
    """The tile of a frame on a device: the aligned default, doubled while it needs too many layers, or one tile for the whole frame where its atlas
    has at most 7/8 of the samples."""
    room = F.greatest(largest - 2 * HALO, F.lit(0))

    def aligned(extent: Column) -> Column:
        return F.floor(extent / ALIGNED) * ALIGNED - 2 * HALO

    start = F.least(F.lit(LARGEST_TILE), room)
    first = F.when(aligned(start + 2 * HALO) >= SMALLEST_TILE, aligned(start + 2 * HALO)).otherwise(start)

    def grow(tile: Column, _) -> Column:
        wider = aligned(F.least((tile + 2 * HALO) * 2, largest))
        return F.when((layers(width, height, tile) > most_layers) & (wider > tile), wider).otherwise(tile)

    tile = F.aggregate(F.sequence(F.lit(1), F.lit(32)), first.cast("long"), lambda t, k: grow(t, k).cast("long"))
    single = F.greatest(width, height)
    texels = lambda t: (t + 2 * HALO) * (t + 2 * HALO) * layers(width, height, t)
    one = (single >= SMALLEST_TILE) & (single <= room) & (texels(single) * SINGLE_TILE[1] <= texels(tile) * SINGLE_TILE[0])
    return F.when(one, single).otherwise(tile)


def tiling(frames: DataFrame) -> DataFrame:
    """``frames`` (width, height, largest, most_layers, ...) with tile, tiles_x, tiles_y, layers, extent, bytes and error; where there is an error the
    plan is null."""
    w, h, tile = F.col("width"), F.col("height"), F.col("tile")
    out = frames.withColumn("tile", default_tile(w, h, F.col("largest"), F.col("most_layers")))
    out = out.withColumns({"tiles_x": _up(w, tile), "tiles_y": _up(h, tile), "layers": layers(w, h, tile), "extent": tile + 2 * HALO})
    out = out.withColumn("bytes", F.col("extent") * F.col("extent") * F.col("layers") * 2)
    error = F.when((tile < SMALLEST_TILE) | (F.col("extent") > F.col("largest")), "tile too large").when(F.col("layers") > F.col("most_layers"), "too many tiles").when(F.col("bytes") > ATLAS_BYTES, "atlas too large")
    out = out.withColumn("error", error)
    return out.withColumns({c: F.when(F.col("error").isNull(), F.col(c)) for c in ("tile", "tiles_x", "tiles_y", "layers", "extent", "bytes")})


def row_bands(frames: DataFrame, band: int) -> DataFrame:
    """(columns of ``frames``, first_row, rows): each frame's rows (height) in bands of ``band`` rows, the last one shorter."""
    starts = F.when(F.col("height") > 0, F.sequence(F.lit(0).cast("long"), F.col("height").cast("long") - 1, F.lit(band).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return frames.select("*", F.explode(starts).alias("first_row")).withColumn("rows", F.least(F.lit(band), F.col("height") - F.col("first_row")))


# ---- counters of a cache
def cache_counters(events: DataFrame) -> DataFrame:
    """Counters of each run from its events (run, seq, kind, generation, bytes, ns, ok).

    A hit, miss or read error counts only if its generation is that of the run's latest begin_lookup; pending_bytes is a gauge that queued sets
    and superseded clears; last_ns are those of the last counted hit and of the last finished write."""
    before = Window.partitionBy("run").orderBy("seq")
    kind = lambda *names: F.col("kind").isin(*names)
    now = F.last(F.when(kind("begin_lookup"), F.col("generation")), ignorenulls=True).over(before)
    rows = events.withColumn("live", F.coalesce(now == F.col("generation"), F.lit(False)))
    count = lambda c: F.count(F.when(c, 1))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("bytes"))), F.lit(0))
    hit, done = kind("hit") & F.col("live"), kind("finished")
    return rows.groupBy("run").agg(
        count(hit).alias("hits"), count(kind("miss") & F.col("live")).alias("misses"), count(kind("read_error") & F.col("live")).alias("read_errors"),
        total(hit).alias("bytes_served"), F.max_by("ns", F.when(hit, F.col("seq"))).alias("last_read_ns"),
        F.coalesce(F.max_by(F.when(kind("queued"), F.col("bytes")).otherwise(0), F.when(kind("queued", "superseded"), F.col("seq"))), F.lit(0)).alias("pending_bytes"),
        count(kind("superseded")).alias("superseded"), count(done & F.col("ok")).alias("committed"), total(done & F.col("ok")).alias("bytes_written"),
        count(done & ~F.col("ok")).alias("failures"), F.max_by("ns", F.when(done, F.col("seq"))).alias("last_write_ns"),
    )


def prefetch_counters(events: DataFrame) -> DataFrame:
    """Counters of each run's latest prefetch (run, seq, kind, generation, bytes): begin (bytes is what it plans) resets them, and cached,
    stored and failed count from then on if they are of its generation."""
    start = events.where("kind = 'begin'").groupBy("run").agg(F.max(F.struct("seq", "generation", F.col("bytes").alias("planned"))).alias("s"))
    start = start.select("run", F.col("s.seq").alias("since"), F.col("s.generation").alias("current"), F.col("s.planned").alias("planned"))
    rows = events.join(start, "run", "right")
    live = (F.col("seq") > F.col("since")) & (F.col("generation") == F.col("current"))
    count = lambda *names: F.count(F.when(live & F.col("kind").isin(*names), 1))
    return rows.groupBy("run", "current", "planned").agg(
        count("cached", "stored", "failed").alias("completed"), count("cached").alias("cached"), count("stored").alias("stored"), count("failed").alias("failures"),
        F.coalesce(F.sum(F.when(live & (F.col("kind") == "stored"), F.col("bytes"))), F.lit(0)).alias("bytes"),
    )
