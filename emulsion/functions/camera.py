"""Camera calibration as column expressions: plane checks, white points, choice of a matrix, the transform to linear sRGB."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import frame as X

# Chromaticities of the EXIF light sources with a standard white, by code
WHITES = {(1, 4, 9, 10, 21): (0.31271, 0.32902), (3, 17): (0.44757, 0.40745), (11, 22): (0.29902, 0.31485), (18,): (0.34842, 0.35161), (19,): (0.31006, 0.31616), (20,): (0.33242, 0.34743), (23,): (0.34567, 0.35850)}
D65 = 21
PLANE_TOLERANCE = 1e-3
LEAST = 1e-8
Matrix = list[list[Column]]


def finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))


def all_of(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def largest(values: list[Column]) -> Column:
    return F.greatest(*(F.abs(v) for v in values))


def green_planes(first: list[Column], second: list[Column]) -> Column:
    """struct(kind, difference): 'absent' if the second green plane is zero, 'consistent' if it differs from the first by no more than the
    tolerance of the first's scale, else 'divergent' with the largest difference."""
    apart = F.greatest(*(F.abs(a - b) for a, b in zip(first, second, strict=True)))
    near = apart <= F.greatest(largest(first), F.lit(1.0)) * PLANE_TOLERANCE
    kind = F.when(all_of(b == 0 for b in second), "absent").when(near, "consistent").otherwise("divergent")
    return F.struct(kind.alias("kind"), F.when(kind == "divergent", apart).alias("difference"))


def to_linear_srgb(m: Matrix) -> tuple[Matrix, Column]:
    """(camera to linear sRGB, why there is none) for an XYZ to camera matrix of four planes: rows of the product with sRGB's primaries are scaled to
    sum to one, so that neutral stays neutral, and the result is inverted."""
    rows = X.multiply_3x3(m[:3], X.literal_3x3(X.SRGB_TO_XYZ))
    sums = [r[0] + r[1] + r[2] for r in rows]
    scaled = [[F.when(s != 0, v / s) for v in r] for r, s in zip(rows, sums, strict=True)]
    det = X.determinant(scaled)
    error = F.coalesce(
        F.when(~all_of(finite(v) for r in m for v in r), "not finite"),
        F.when(green_planes(m[1], m[3])["kind"] == "divergent", "green planes differ"),
        F.when(~all_of(finite(s) & (F.abs(s) >= LEAST) for s in sums), "degenerate row"),
        F.when(~(finite(det) & (F.abs(det) >= LEAST)), "singular"),
    )
    return [[F.when(error.isNull(), v) for v in r] for r in X.invert_3x3(scaled, LEAST)], error


def white_of(code: Column) -> list[Column]:
    """X, Y and Z of a light source's white; null for a code without one."""
    x, y = (F.coalesce(*(F.when(code.isin(*codes), F.lit(xy[i])) for codes, xy in WHITES.items())) for i in range(2))
    return list(X.xy_to_xyz(x, y))


def choose_matrix(first: Matrix, first_code: Column, second: Matrix, second_code: Column) -> Matrix:
    """The XYZ to camera matrix for D65 of a pair of calibrations (elements null where there is none): one made for D65 as it is, else one for a
    known white adapted to D65, in both cases the second before the first; else the first as it is, else the second."""
    pairs = ((second, second_code), (first, first_code))
    there = lambda m: m[0][0].isNotNull()
    d65 = list(X.xy_to_xyz(*(F.lit(v) for v in WHITES[1, 4, 9, 10, D65])))
    adapted = [X.multiply_3x3(m, X.bradford(d65, white_of(code))) for m, code in pairs]
    return [
        [
            F.coalesce(
                *(F.when(there(m) & (code == D65), m[r][c]) for m, code in pairs),
                *(F.when(there(m), a[r][c]) for (m, _), a in zip(pairs, adapted, strict=True)),
                first[r][c], second[r][c],
            )
            for c in range(3)
        ]
        for r in range(3)
    ]


def rgb_planes(colours: Column) -> Column:
    """The places of red, green and blue among three plane colours; null unless each stands there once."""
    places = F.array(*((F.array_position(colours, c) - 1).cast("int") for c in ("red", "green", "blue")))
    return F.when((F.size(colours) == 3) & (F.array_sort(places) == F.array(*map(F.lit, range(3)))), places)


def neutral_gains(neutral: Column, planes: Column) -> Column:
    """Green-relative gains of red, green, blue and the second green from an as-shot neutral; ones without a neutral, null where green is not
    positive or a gain is not finite."""
    gain = [1 / F.when(F.get(neutral, F.get(planes, i)) != 0, F.get(neutral, F.get(planes, i))) for i in range(3)]
    good = (gain[1] > 0) & all_of(finite(g) for g in gain)
    return F.when(neutral.isNull(), F.array(*[F.lit(1.0)] * 4)).otherwise(F.when(good, F.array(*(g / gain[1] for g in (gain[0], gain[1], gain[2], gain[1])))))
