"""Column expressions of the sensor-frame model: rectangles, CFA and level lookups, colour, orientation.

Everything is built-in Spark expressions, so it stays inside whole-stage code generation and pushes down."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

U32 = 4294967295
# Rec.709 luma weights, sRGB primaries, the Bradford cone matrix, white points by EXIF light-source code
LUMA = (0.2126, 0.7152, 0.0722)
SRGB_TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
BRADFORD = ((0.8951, 0.2664, -0.1614), (-0.7502, 1.7135, 0.0367), (0.0389, -0.0685, 1.0296))
ILLUMINANT_XY = {17: (0.44757, 0.40745), 20: (0.33242, 0.34743), 21: (0.31271, 0.32902), 22: (0.29902, 0.31485), 23: (0.34567, 0.35850)}
ORIENTATIONS = ("normal", "mirror_horizontal", "rotate180", "mirror_vertical", "transpose", "rotate90", "transverse", "rotate270")


# ---- rectangles
def checked_end(x: Column, y: Column, w: Column, h: Column) -> Column:
    """struct(x, y) one past the rectangle, or null beyond 32 unsigned bits."""
    ex, ey = x.cast("long") + w.cast("long"), y.cast("long") + h.cast("long")
    return F.when((ex <= U32) & (ey <= U32), F.struct(ex.alias("x"), ey.alias("y")))


def is_empty(w: Column, h: Column) -> Column:
    return (w == 0) | (h == 0)


def fits_within(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    end = checked_end(x, y, w, h)
    return F.coalesce((end["x"] <= width) & (end["y"] <= height), F.lit(False))


def effective_crop(crop: Column, active: Column, width: Column, height: Column) -> Column:
    """The crop if it is valid, else the active area if valid, else the full frame (structs of x, y, width, height)."""

    def ok(r: Column) -> Column:
        return r.isNotNull() & ~is_empty(r["width"], r["height"]) & fits_within(r["x"], r["y"], r["width"], r["height"], width, height)

    full = F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), width.cast("long").alias("width"), height.cast("long").alias("height"))
    return F.when(ok(crop), crop).when(ok(active), active).otherwise(full)


# ---- CFA and levels
def phase(x: Column, y: Column) -> Column:
    return (y % 2) * 2 + x % 2


def cell(values: Column, w: Column, h: Column, row: Column, column: Column) -> Column:
    """A repeating grid's cell, row-major; null for a degenerate grid."""
    return F.when((w > 0) & (h > 0), F.get(values, ((row % h) * w + column % w).cast("int")))


def bayer_black(values: Column, w: Column, h: Column) -> Column:
    """Four black levels by phase: one value for all, a 2x2 grid as it is, of others the top-left 2x2 with 0 where missing."""
    at = lambda r, c: F.coalesce(F.when((w > c) & (h > r), F.get(values, (F.lit(r) * w + c).cast("int"))), F.lit(0.0))
    one = F.array(*[F.get(values, 0)] * 4)
    return F.when((F.size(values) == 1), one).otherwise(F.array(at(0, 0), at(0, 1), at(1, 0), at(1, 1)))


def bayer_white(values: Column, cfa: Column) -> Column:
    """Four white levels by phase: one for all, four by position, otherwise by colour index, with the first where missing."""
    n = F.size(values)
    by_colour = F.transform(cfa, lambda c: F.coalesce(F.get(values, c.cast("int")), F.get(values, 0)))
    return F.when(n == 1, F.array_repeat(F.get(values, 0), 4)).when(n == 4, values).otherwise(by_colour)


def normalized(raw: Column, black: Column, white: Column) -> Column:
    """max(raw - black, 0) / max(white - black, 1); not clamped above one."""
    return F.greatest(raw - black, F.lit(0.0)) / F.greatest(white - black, F.lit(1.0))


def linearize(raw: Column, table: Column) -> Column:
    """Look a sample up, clamped to the last entry."""
    return F.element_at(table, F.least(raw.cast("int"), F.size(table) - 1) + 1)


def default_white(bits: Column) -> Column:
    return F.expr("1L").cast("long") * F.pow(F.lit(2.0), bits).cast("long") - 1


# ---- colour
def apply_3x3(m: list[list[Column]], v: list[Column]) -> list[Column]:
    return [m[r][0] * v[0] + m[r][1] * v[1] + m[r][2] * v[2] for r in range(3)]


def multiply_3x3(a: list[list[Column]], b: list[list[Column]]) -> list[list[Column]]:
    return [[a[r][0] * b[0][c] + a[r][1] * b[1][c] + a[r][2] * b[2][c] for c in range(3)] for r in range(3)]


def determinant(m: list[list[Column]]) -> Column:
    return (
        m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1])
        - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0])
        + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])
    )


def invert_3x3(m: list[list[Column]], eps: float = 1e-8) -> list[list[Column]]:
    """The adjugate inverse; null where the determinant is not finite or under eps."""
    det = determinant(m)
    good = ~F.isnan(det) & (F.abs(det) >= eps) & (F.abs(det) < float("inf"))

    def minor(r: int, c: int) -> Column:
        i, j = [k for k in range(3) if k != c], [k for k in range(3) if k != r]
        s = m[i[0]][j[0]] * m[i[1]][j[1]] - m[i[0]][j[1]] * m[i[1]][j[0]]
        return s if (r + c) % 2 == 0 else -s

    return [[F.when(good, minor(r, c) / det) for c in range(3)] for r in range(3)]


def literal_3x3(m) -> list[list[Column]]:
    return [[F.lit(float(x)) for x in row] for row in m]


def xy_to_xyz(x: Column, y: Column) -> tuple[Column, Column, Column]:
    good = (y > 0) & ~F.isnan(x) & ~F.isnan(y)
    return F.when(good, x / y), F.when(good, F.lit(1.0)), F.when(good, (1 - x - y) / y)


def bradford(src: list[Column], dst: list[Column]) -> list[list[Column]]:
    """Chromatic adaptation from one white point to another; null on a bad white."""
    b = literal_3x3(BRADFORD)
    s, d = apply_3x3(b, src), apply_3x3(b, dst)
    scale = [[(F.when(s[r] != 0, d[r] / s[r]) if r == c else F.lit(0.0)) for c in range(3)] for r in range(3)]
    return multiply_3x3(invert_3x3(b), multiply_3x3(scale, b))


def expose(v: Column, stops: Column) -> Column:
    finite = ~F.isnan(stops) & (F.abs(stops) < float("inf"))
    return F.when(finite, v * F.pow(F.lit(2.0), stops)).otherwise(v)


def aces(v: Column) -> Column:
    """The fitted filmic curve, clamped to 0..1; negative and non-finite values give 0."""
    good = ~F.isnan(v) & (F.abs(v) < float("inf"))
    x = F.greatest(v, F.lit(0.0))
    y = (x * (x * 2.51 + 0.03)) / (x * (x * 2.43 + 0.59) + 0.14)
    return F.when(good, F.least(F.greatest(y, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))


def tone_map_rgb(r: Column, g: Column, b: Column) -> list[Column]:
    """Negatives move towards luma just far enough, then all are scaled by aces(largest) / largest."""
    luma = F.greatest(r * LUMA[0] + g * LUMA[1] + b * LUMA[2], F.lit(0.0))
    low = F.least(r, g, b)
    t = F.when(low < 0, F.when(luma > low, luma / (luma - low)).otherwise(F.lit(0.0))).otherwise(F.lit(1.0))
    mixed = [luma + (c - luma) * t for c in (r, g, b)]
    top = F.greatest(*mixed)
    return [F.when(top > 0, F.greatest(c, F.lit(0.0)) * aces(top) / top).otherwise(F.lit(0.0)) for c in mixed]


def green_gains(r: Column, g: Column, b: Column) -> list[Column]:
    """g / c for each channel; null unless all are finite and positive."""
    good = (r > 0) & (g > 0) & (b > 0) & (F.greatest(r, g, b) < float("inf"))
    return [F.when(good, g / c) for c in (r, g, b)]


def luma_normalized(gains: list[Column]) -> list[Column]:
    total = sum(x * w for x, w in zip(gains, LUMA, strict=True))
    return [x / total for x in gains]


# ---- orientation
def swaps(orientation: Column) -> Column:
    return orientation.isin("transpose", "rotate90", "transverse", "rotate270")


def orientation_name(tag: Column) -> Column:
    """EXIF 1..8 to a name, null otherwise."""
    return F.get(F.array(*map(F.lit, ORIENTATIONS)), (tag - 1).cast("int"))


def to_sensor(orientation: Column, u: Column, v: Column) -> tuple[Column, Column]:
    """Display coordinates in 0..1 to sensor coordinates in 0..1."""
    o = lambda *names: orientation.isin(*names)
    x = F.when(o("mirror_horizontal", "rotate180"), 1 - u).when(o("transpose", "rotate90"), v).when(o("transverse", "rotate270"), 1 - v).otherwise(u)
    y = F.when(o("rotate180", "mirror_vertical"), 1 - v).when(o("transpose", "rotate270"), u).when(o("transverse", "rotate90"), 1 - u).otherwise(v)
    return x, y


# ---- text forms
def duration_ms(text: Column) -> Column:
    """Text such as 12.5ms, 3s, 250us or 9ns in milliseconds; null for anything else."""
    n = F.regexp_extract(text, r"^\s*([0-9]+(?:\.[0-9]+)?)\s*(ns|us|µs|ms|s)\s*$", 1)
    unit = F.regexp_extract(text, r"^\s*([0-9]+(?:\.[0-9]+)?)\s*(ns|us|µs|ms|s)\s*$", 2)
    scale = F.when(unit == "ns", 1e-6).when(unit.isin("us", "µs"), 1e-3).when(unit == "ms", 1.0).when(unit == "s", 1e3)
    return F.expr("try_cast(1 as double)") * F.when(n != "", n.try_cast("double")) * scale


def canonical_decimal(text: Column) -> Column:
    """A decimal string without sign or leading zeros as decimal(20,0), else null."""
    return F.when(text.rlike("^(0|[1-9][0-9]*)$"), text.try_cast("decimal(20,0)"))


def canonical_hex(text: Column, size: int) -> Column:
    return F.when(text.rlike(f"^[0-9a-f]{{{2 * size}}}$"), F.unhex(text))
