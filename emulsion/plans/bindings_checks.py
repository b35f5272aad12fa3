"""Frame checks, names, tile plans and cache counters bound to driver tables, beside their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import frame as X
from ..operators import checks as C
from .bindings import query, t

META_SQL = """m AS (SELECT o_orderkey, o_orderkey % 7 * 100 AS w, o_custkey % 5 * 80 AS h, 1 + CAST(o_orderkey % 11 = 0 AS INT) AS comps, o_custkey % 19 AS bits,
 CASE WHEN o_orderkey % 13 = 0 THEN [64.0, 64.0, 64.0] WHEN o_orderkey % 17 = 0 THEN [64.0, 'nan'::DOUBLE, 1.0, 2.0] ELSE [64.0, 65.0, 66.0, 67.0] END AS black,
 CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_custkey % 23 = 0 THEN ['red', 'green'] ELSE ['red', 'green', 'green', 'blue'] END AS cfa,
 CASE WHEN o_orderstatus = 'F' THEN 'cfa' ELSE 'linear' END AS photometric, CAST(floor(o_totalprice) AS BIGINT) % 300 AS ax, o_orderkey % 3 = 0 AS has_crop,
 CASE WHEN o_custkey % 29 = 0 THEN 'inf'::DOUBLE ELSE 1.5 END AS gain, CASE WHEN o_orderkey % 19 = 0 THEN 0.0 ELSE 4095.0 END AS white FROM orders)"""


def meta(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    numbers = lambda *x: F.array(*(F.lit(float(v)) for v in x))
    words = lambda *x: F.array(*map(F.lit, x))
    return t(spark, d, "orders").select(
        "o_orderkey", (k % 7 * 100).alias("width"), (c % 5 * 80).alias("height"), (1 + (k % 11 == 0).cast("int")).alias("components"), (c % 19).alias("bits"),
        F.when(k % 13 == 0, numbers(64, 64, 64)).when(k % 17 == 0, numbers(64, "nan", 1, 2)).otherwise(numbers(64, 65, 66, 67)).alias("black"),
        F.when(k % 5 == 0, None).when(c % 23 == 0, words("red", "green")).otherwise(words("red", "green", "green", "blue")).alias("cfa"),
        F.when(F.col("o_orderstatus") == "F", "cfa").otherwise("linear").alias("photometric"), (F.floor("o_totalprice") % 300).alias("ax"), (k % 3 == 0).alias("has_crop"),
        F.when(c % 29 == 0, float("inf")).otherwise(1.5).alias("gain"), F.when(k % 19 == 0, 0.0).otherwise(4095.0).alias("white"),
    )


@query(f"""WITH {META_SQL} SELECT o_orderkey, CASE WHEN w = 0 OR h = 0 THEN 'empty frame' WHEN bits NOT BETWEEN 1 AND 16 THEN 'bit depth'
 WHEN len(black) <> 4 THEN 'black level length' WHEN len(list_filter(black, lambda v: isnan(v))) > 0 THEN 'black level not finite' WHEN cfa IS NOT NULL AND len(cfa) <> 4 THEN 'cfa length'
 WHEN photometric = 'cfa' AND (comps <> 1 OR cfa IS NULL) THEN 'cfa components' WHEN ax + 200 > w OR 40 > h THEN 'active area' WHEN has_crop AND (300 > w OR ax > h) THEN 'crop area'
 WHEN isinf(gain) THEN 'colour calibration' WHEN white <= 0 THEN 'white level' END AS error FROM m""")
def frame_check(spark, d):
    """The first rule that a frame breaks, for frames made of the orders' numbers."""
    m = {c: F.col(c) for c in ("width", "height", "components", "bits", "black", "cfa", "photometric")}
    rect = lambda x, y, w, h: F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), w.cast("long").alias("width"), h.cast("long").alias("height"))
    two, one = F.lit(2), F.lit(1)
    m |= {"black_width": two, "black_height": two, "black_components": one, "cfa_width": two, "cfa_height": two, "calibration": F.array(F.lit(1.0), "gain"), "white": F.array("white")}
    m |= {"active": rect(F.col("ax"), F.lit(0), F.lit(200), F.lit(40)), "crop": F.when(F.col("has_crop"), rect(F.lit(0), F.lit(0), F.lit(300), F.col("ax")))}
    return meta(spark, d).select("o_orderkey", C.frame_error(m).alias("error"))


QUAD_SQL = """q AS (SELECT l_orderkey, l_linenumber, 2 AS w, [l_partkey % 4, l_suppkey % 3, l_orderkey % 3, l_linenumber % 3] AS c FROM lineitem)"""


@query(f"WITH {QUAD_SQL} SELECT l_orderkey, l_linenumber, c AS quad FROM q WHERE list_sort(c) = [0, 1, 1, 2]")
def bayer_quads(spark, d):
    names = F.array(*map(F.lit, ("red", "green", "blue", "emerald")))
    cell = lambda c, n: F.get(names, (F.col(c) % n).cast("int"))
    cells = F.array(cell("l_partkey", 4), cell("l_suppkey", 3), cell("l_orderkey", 3), cell("l_linenumber", 3))
    quad = C.bayer_quad(F.lit(2), F.lit(2), cells).cast("array<bigint>").alias("quad")
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", quad).where("quad is not null")


@query("""WITH f AS (SELECT o_orderkey, 1 + o_orderkey % 400 AS w, 1 + o_custkey % 300 AS h, 1 + o_custkey % 3 AS c, o_orderkey % 10 AS tag FROM orders)
SELECT o_orderkey, w * h * c * 2 AS bytes, CASE WHEN tag BETWEEN 1 AND 8 THEN CAST(tag - 1 AS INT) ELSE 0 END AS code,
 CASE WHEN tag BETWEEN 5 AND 8 THEN h ELSE w END AS shown_width, CASE WHEN tag BETWEEN 5 AND 8 THEN w ELSE h END AS shown_height FROM f""")
def frame_sizes(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    w, h, o = 1 + k % 400, 1 + c % 300, X.orientation_name(k % 10)
    shown = C.display_size(o, F.struct(w.alias("width"), h.alias("height")))
    return t(spark, d, "orders").select(
        "o_orderkey", C.byte_length(w, h, 1 + c % 3).alias("bytes"), C.shader_code(o).alias("code"), shown["width"].alias("shown_width"), shown["height"].alias("shown_height")
    )


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN v >= 0 AND v <= 4294967295 AND v = trunc(v) THEN CAST(v AS BIGINT) END AS whole,
 CASE WHEN abs(n) < 3.4028235677973366e38 THEN CAST(n AS FLOAT) END AS narrow
FROM (SELECT *, CASE WHEN l_linenumber % 3 = 0 THEN -l_quantity WHEN l_linenumber % 3 = 1 THEN l_quantity * 1e8 ELSE l_quantity / 4 END AS v, l_extendedprice * power(10.0, l_linenumber * 6.0) AS n FROM lineitem)""")
def exact_numbers(spark, d):
    n = F.col("l_linenumber")
    v = F.when(n % 3 == 0, -F.col("l_quantity")).when(n % 3 == 1, F.col("l_quantity") * 1e8).otherwise(F.col("l_quantity") / 4)
    wide = F.col("l_extendedprice") * F.pow(F.lit(10.0), n * 6.0)
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", C.exact_u32(v).alias("whole"), C.finite_f32(wide).alias("narrow"))


@query("""SELECT page_id, name, CASE lower(regexp_extract(name, '^.+\\.([^.]*)$', 1)) WHEN 'cr2' THEN 'cr2' WHEN 'cr3' THEN 'cr3' WHEN 'dng' THEN 'dng' WHEN 'tif' THEN 'dng' WHEN 'tiff' THEN 'dng' ELSE 'unknown' END AS kind
FROM (SELECT page_id, regexp_replace(url, '^.*/', '') || (['.CR2', '.cr3', '.Dng', '.tif', '.TIFF', '.jpg', ''])[CAST(page_id % 7 AS INT) + 1] AS name FROM pages)""")
def raw_kinds(spark, d):
    ending = F.get(F.array(*map(F.lit, (".CR2", ".cr3", ".Dng", ".tif", ".TIFF", ".jpg", ""))), (F.col("page_id") % 7).cast("int"))
    path = F.concat("url", ending)
    return t(spark, d, "pages").select("page_id", C.file_name(path).alias("name"), C.raw_kind(path).alias("kind"))


NS_SQL = "(CAST(round(value * 1000) AS BIGINT) * CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 37 ELSE 5000 END) AS ns"


@query(f"""WITH e AS (SELECT event_id, {NS_SQL} FROM events),
 r AS (SELECT *, ns // 10000 + CAST(ns % 10000 > 5000 OR (ns % 10000 = 5000 AND ns // 10000 % 2 = 1) AS BIGINT) AS c, ns // 100000 + CAST(ns % 100000 > 50000 OR (ns % 100000 = 50000 AND ns // 100000 % 2 = 1) AS BIGINT) AS t,
  ns // 1000 + CAST(ns % 1000 > 500 OR (ns % 1000 = 500 AND ns // 1000 % 2 = 1) AS BIGINT) AS u FROM e)
SELECT event_id, CASE WHEN ns >= 1000000 THEN (c // 100) || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') || ' MS' WHEN ns >= 1000 THEN u || ' US' ELSE ns || ' NS' END AS shown,
 CASE WHEN ns >= 1000000 THEN 'ALL ' || (t // 10) || '.' || (t % 10) || 'MS' WHEN ns >= 1000 THEN 'ALL ' || u || 'US' ELSE 'ALL ' || ns || 'NS' END AS enclosing FROM r""")
def duration_texts(spark, d):
    """Durations as people read them; ties go to the even digit."""
    ns = F.round(F.col("value") * 1000).cast("long") * F.when(F.col("event_id") % 3 == 0, 1).when(F.col("event_id") % 3 == 1, 37).otherwise(5000)
    return t(spark, d, "events").select("event_id", C.duration_text(ns).alias("shown"), C.enclosing_duration_text("ALL", ns).alias("enclosing"))


GROWN = "CASE WHEN CAST(ceil(w / a) * ceil(h / a) AS BIGINT) > most AND least((a + 2) * 2, top) // 128 * 128 - 2 > a THEN least((a + 2) * 2, top) // 128 * 128 - 2 ELSE a END"


@query(f"""WITH f AS (SELECT o_orderkey, 1 + (o_orderkey * 37) % 30000 AS w, 1 + (o_custkey * 53) % 20000 AS h, ([64, 512, 2048, 8192, 16384])[CAST(o_orderkey % 5 AS INT) + 1]::BIGINT AS top, ([1, 8, 256, 2048])[CAST(o_custkey % 4 AS INT) + 1]::BIGINT AS most FROM orders),
 s AS (SELECT *, least(1024, top - 2) AS first FROM f), a AS (SELECT *, CASE WHEN (first + 2) // 128 * 128 - 2 >= 32 THEN (first + 2) // 128 * 128 - 2 ELSE first END AS a0 FROM s),
 g AS (SELECT o_orderkey, w, h, top, most, list_reduce(range(1, 33), lambda a, k: {GROWN}, a0) AS tile FROM a),
 o AS (SELECT *, greatest(w, h) AS one, CAST(ceil(w / tile) * ceil(h / tile) AS BIGINT) AS n FROM g),
 p AS (SELECT o_orderkey, w, h, top, most, CASE WHEN one BETWEEN 32 AND top - 2 AND (one + 2) * (one + 2) * 8 <= (tile + 2) * (tile + 2) * n * 7 THEN one ELSE tile END AS tile FROM o),
 q AS (SELECT *, CAST(ceil(w / tile) AS BIGINT) AS nx, CAST(ceil(h / tile) AS BIGINT) AS ny, (tile + 2) AS ext FROM p),
 e AS (SELECT *, CASE WHEN tile < 32 OR ext > top THEN 'tile too large' WHEN nx * ny > most THEN 'too many tiles' WHEN ext * ext * nx * ny * 2 > 536870912 THEN 'atlas too large' END AS error FROM q)
SELECT o_orderkey, error, CASE WHEN error IS NULL THEN tile END AS tile, CASE WHEN error IS NULL THEN nx END AS tiles_x, CASE WHEN error IS NULL THEN ny END AS tiles_y, CASE WHEN error IS NULL THEN nx * ny END AS layers,
 CASE WHEN error IS NULL THEN ext END AS extent, CASE WHEN error IS NULL THEN ext * ext * nx * ny * 2 END AS bytes FROM e""")
def tile_plans(spark, d):
    """Tile plans of frames of many sizes on devices of several limits."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda values, i: F.get(F.array(*(F.lit(v).cast("long") for v in values)), i.cast("int"))
    frames = t(spark, d, "orders").select(
        "o_orderkey", (1 + (k * 37) % 30000).alias("width"), (1 + (c * 53) % 20000).alias("height"), pick((64, 512, 2048, 8192, 16384), k % 5).alias("largest"), pick((1, 8, 256, 2048), c % 4).alias("most_layers")
    )
    return C.tiling(frames).select("o_orderkey", "error", "tile", "tiles_x", "tiles_y", "layers", "extent", "bytes")


@query("""SELECT o_orderkey, r AS first_row, least(16, o_custkey % 90 - r) AS rows FROM (SELECT o_orderkey, o_custkey, unnest(range(0, o_custkey % 90, 16)) AS r FROM orders)""")
def row_bands(spark, d):
    frames = t(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 90).alias("height"))
    return C.row_bands(frames, 16).drop("height")


CACHE_SQL = """e AS (SELECT user_id AS run, event_id AS seq, (['begin_lookup', 'hit', 'miss', 'read_error', 'queued', 'superseded', 'finished'])[CAST(event_id % 7 AS INT) + 1] AS kind,
 event_id // 50 % 3 AS generation, CAST(floor(value) AS BIGINT) AS bytes, event_id * 3 AS ns, event_type <> 'error' AS ok FROM events)"""


def cache_events(spark, d, names):
    kind = F.get(F.array(*map(F.lit, names)), (F.col("event_id") % len(names)).cast("int"))
    return t(spark, d, "events").select(
        F.col("user_id").alias("run"), F.col("event_id").alias("seq"), kind.alias("kind"), (F.floor(F.col("event_id") / 50) % 3).alias("generation"),
        F.floor("value").alias("bytes"), (F.col("event_id") * 3).alias("ns"), (F.col("event_type") != "error").alias("ok"),
    )


@query(f"""WITH {CACHE_SQL}, l AS (SELECT *, generation = (SELECT arg_max(b.generation, b.seq) FROM e b WHERE b.run = e.run AND b.kind = 'begin_lookup' AND b.seq <= e.seq) AS live FROM e)
SELECT run, count(*) FILTER (kind = 'hit' AND live) AS hits, count(*) FILTER (kind = 'miss' AND live) AS misses, count(*) FILTER (kind = 'read_error' AND live) AS read_errors,
 CAST(coalesce(sum(bytes) FILTER (kind = 'hit' AND live), 0) AS BIGINT) AS bytes_served, arg_max(ns, seq) FILTER (kind = 'hit' AND live) AS last_read_ns,
 coalesce(arg_max(CASE WHEN kind = 'queued' THEN bytes ELSE 0 END, seq) FILTER (kind IN ('queued', 'superseded')), 0) AS pending_bytes, count(*) FILTER (kind = 'superseded') AS superseded,
 count(*) FILTER (kind = 'finished' AND ok) AS committed, CAST(coalesce(sum(bytes) FILTER (kind = 'finished' AND ok), 0) AS BIGINT) AS bytes_written, count(*) FILTER (kind = 'finished' AND NOT ok) AS failures,
 arg_max(ns, seq) FILTER (kind = 'finished') AS last_write_ns FROM l GROUP BY run""")
def cache_counters(spark, d):
    names = ("begin_lookup", "hit", "miss", "read_error", "queued", "superseded", "finished")
    return C.cache_counters(cache_events(spark, d, names))


@query("""WITH e AS (SELECT user_id AS run, event_id AS seq, (['stored', 'cached', 'failed', 'stored', 'begin', 'cached', 'stored', 'cached', 'stored', 'stored', 'cached'])[CAST(event_id % 11 AS INT) + 1] AS kind, event_id // 50 % 3 AS generation, CAST(floor(value) AS BIGINT) AS bytes FROM events),
 s AS (SELECT run, max(seq) AS since, arg_max(generation, seq) AS current, arg_max(bytes, seq) AS planned FROM e WHERE kind = 'begin' GROUP BY run),
 l AS (SELECT s.*, e.kind, e.bytes FROM s LEFT JOIN e ON e.run = s.run AND e.seq > s.since AND e.generation = s.current)
SELECT run, current, planned, count(kind) AS completed, count(*) FILTER (kind = 'cached') AS cached, count(*) FILTER (kind = 'stored') AS stored, count(*) FILTER (kind = 'failed') AS failures,
 CAST(coalesce(sum(bytes) FILTER (kind = 'stored'), 0) AS BIGINT) AS bytes FROM l GROUP BY run, current, planned""")
def prefetch_counters(spark, d):
    names = ("stored", "cached", "failed", "stored", "begin", "cached", "stored", "cached", "stored", "stored", "cached")
    return C.prefetch_counters(cache_events(spark, d, names))
