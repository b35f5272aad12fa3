"""Raster operators on a pixel table (frame, y, x, v): neighbourhoods, tiles, thumbnails.

A neighbourhood is gathered by one aggregation over the pixels sent to their neighbours' cells (each pixel is emitted at most
nine times), so no window sorts a frame and no self-join multiplies rows; frames spread over (frame, y, x)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import frame as X

RED, GREEN, BLUE = 0, 1, 2
RGGB = (RED, GREEN, GREEN, BLUE)


def pixels(vectors: DataFrame, row: str, values: str) -> DataFrame:
    """(y, x, v) of a table with one array for each row."""
    return vectors.select(F.col(row).cast("int").alias("y"), F.posexplode(values).alias("x", "v"))


def neighbourhood(px: DataFrame, keys: list[str], width: Column, height: Column) -> DataFrame:
    """(keys, y, x, n) where n maps (dy + 1) * 3 + dx + 1 to the clamped neighbour's value."""
    # a pixel is the neighbour (dy, dx) of the cell at (y - dy, x - dx), and where that leaves the frame, clamping makes edge pixels
    # the neighbour of edge cells instead
    offsets = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)))
    sent = px.withColumn("_h", height).withColumn("_w", width).withColumn("o", F.explode(offsets))
    clamp = lambda c, n: F.greatest(F.least(c, n - 1), F.lit(0))
    at = sent.withColumn("cy", F.col("y") - F.col("o.dy")).withColumn("cx", F.col("x") - F.col("o.dx"))
    inside = at.where((F.col("cy").between(0, F.col("_h") - 1)) & (F.col("cx").between(0, F.col("_w") - 1)))
    code = (F.col("o.dy") + 1) * 3 + F.col("o.dx") + 1
    slots = [F.max(F.when(code == k, F.col("v"))).alias(f"n{k}") for k in range(9)]
    got = inside.groupBy(*keys, F.col("cy").alias("y"), F.col("cx").alias("x")).agg(*slots, F.first("_w").alias("_w"), F.first("_h").alias("_h"))
    out = []
    for k in range(9):
        dy, dx = k // 3 - 1, k % 3 - 1
        ry = clamp(F.col("y") + dy, F.col("_h")) - F.col("y")
        rx = clamp(F.col("x") + dx, F.col("_w")) - F.col("x")
        slot = (ry + 1) * 3 + rx + 1
        out.append(F.get(F.array(*(F.col(f"n{j}") for j in range(9))), slot.cast("int")).alias(f"p{k}"))
    return got.select(*keys, "y", "x", *out)


def bilinear(near: DataFrame, cfa: tuple[int, ...] = RGGB) -> DataFrame:
    """RGB of every cell of a Bayer mosaic from its clamped 3x3 neighbourhood (columns p0 to p8)."""
    p = [F.col(f"p{k}") for k in range(9)]
    ph = X.phase(F.col("x"), F.col("y"))
    axial, diagonal = (p[1] + p[3] + p[5] + p[7]) / 4, (p[0] + p[2] + p[6] + p[8]) / 4
    horizontal, vertical = (p[3] + p[5]) / 2, (p[1] + p[7]) / 2

    def channel(want: int) -> Column:
        out = None
        for k, own in enumerate(cfa):
            beside = cfa[k ^ 1]
            if own == want:
                value = p[4]
            elif want == GREEN:
                value = axial
            elif own != GREEN:
                value = diagonal
            else:
                value = horizontal if beside == want else vertical
            out = F.when(ph == k, value) if out is None else out.when(ph == k, value)
        return out

    keep = [c for c in near.columns if c not in {f"p{k}" for k in range(9)}]
    return near.select(*keep, *(channel(c).alias(n) for c, n in ((RED, "r"), (GREEN, "g"), (BLUE, "b"))))


def tiles(px: DataFrame, size: int) -> DataFrame:
    return px.withColumn("tile_y", F.floor(F.col("y") / size).cast("int")).withColumn("tile_x", F.floor(F.col("x") / size).cast("int"))


def tiles_with_halo(px: DataFrame, size: int, halo: int, width: Column, height: Column) -> DataFrame:
    """Every tile with ``halo`` clamped pixels around it: (tile_y, tile_x, ly, lx, v).

    A pixel goes to the at most four tiles whose halo reaches it, then edge pixels are repeated outwards."""
    span = F.array(*(F.lit(d) for d in range(-halo, halo + 1)))

    def reached(c: Column, n: Column) -> Column:
        # (tile, local position) pairs of a coordinate: itself, and where it is at the border, the clamped ones beyond
        own = F.floor(c / size).cast("int")
        near = F.array_distinct(F.transform(span, lambda d: F.floor((c + d) / size).cast("int")))
        last = F.floor((n - 1) / size).cast("int")
        near = F.filter(near, lambda t: (t >= 0) & (t <= last))

        def places(t: Column) -> Column:
            local = c - t * size
            first = F.when(c == 0, F.lit(-halo)).otherwise(local)
            edge = F.when(c == n - 1, F.lit(size + halo - 1)).otherwise(local)
            lo, hi = F.greatest(F.least(first, local), F.lit(-halo)), F.least(F.greatest(edge, local), F.lit(size + halo - 1))
            return F.when(lo <= hi, F.transform(F.sequence(lo, hi), lambda k: F.struct(t.alias("t"), k.cast("int").alias("k")))).otherwise(F.array().cast("array<struct<t:int,k:int>>"))

        del own
        return F.flatten(F.transform(near, places))

    out = px.withColumn("ry", F.explode(reached(F.col("y"), height))).withColumn("rx", F.explode(reached(F.col("x"), width)))
    return out.select(F.col("ry.t").alias("tile_y"), F.col("rx.t").alias("tile_x"), F.col("ry.k").alias("ly"), F.col("rx.k").alias("lx"), "v")


def thumbnail(px: DataFrame, width: int, height: int, longest: int, white: float) -> DataFrame:
    """Nearest-neighbour gray thumbnail: (oy, ox, gray); every output pixel is one input pixel, found from its own side."""
    top = max(width, height)
    ow = max(1, math.ceil(width * longest / top)) if top > longest else width
    oh = max(1, math.ceil(height * longest / top)) if top > longest else height

    def outputs(c: str, n: int, o: int) -> Column:
        first = F.ceil(F.col(c) * o / n).cast("int")
        last = (F.ceil((F.col(c) + 1) * o / n) - 1).cast("int")
        return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))

    gray = F.floor(F.least(F.greatest(F.col("v") / white, F.lit(0.0)), F.lit(1.0)) * 255 + 0.5).cast("int")
    return px.select(F.explode(outputs("y", height, oh)).alias("oy"), "x", "v").select("oy", F.explode(outputs("x", width, ow)).alias("ox"), gray.alias("gray"))


def plan_tiling(width: int, height: int, tile: int, halo: int) -> dict[str, int]:
    nx, ny = -(-width // tile), -(-height // tile)
    return {"tiles_x": nx, "tiles_y": ny, "layers": nx * ny, "extent": tile + 2 * halo, "bytes": nx * ny * (tile + 2 * halo) ** 2 * 2}
