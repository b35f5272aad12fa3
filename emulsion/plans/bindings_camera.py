"""Camera calibration bound to driver tables, beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import camera as C
from ..functions import frame as X
from .bindings import query, t

PRIMARIES = ("0.4124564 0.3575761 0.1804375", "0.2126729 0.7151522 0.0721750", "0.0193339 0.1191920 0.9503041")
SRGB = [row.split() for row in PRIMARIES]
CONES = [row.split() for row in ("0.8951 0.2664 -0.1614", "-0.7502 1.7135 0.0367", "0.0389 -0.0685 1.0296")]


# SQL text of 3x3 arithmetic
def product(a, b):
    return [["(" + " + ".join(f"{a[r][k]} * {b[k][c]}" for k in range(3)) + ")" for c in range(3)] for r in range(3)]


def det(m):
    part = lambda i, j, k: f"{m[0][i]} * ({m[1][j]} * {m[2][k]} - {m[1][k]} * {m[2][j]})"
    return f"({part(0, 1, 2)} - {part(1, 0, 2)} + {part(2, 0, 1)})"


def inverse(m, d):
    def cofactor(r, c):
        (i, j), (k, n) = [x for x in range(3) if x != c], [x for x in range(3) if x != r]
        return f"({'-' if (r + c) % 2 else ''}({m[i][k]} * {m[j][n]} - {m[i][n]} * {m[j][k]}) / {d})"

    return [[cofactor(r, c) for c in range(3)] for r in range(3)]


def cells(name, rows=3):
    return [[f"{name}[{3 * r + c + 1}]" for c in range(3)] for r in range(rows)]


def listed(m):
    return "[" + ", ".join(x for r in m for x in r) + "]"


def matrix(rows, name="m"):
    return [[F.get(F.col(name), 3 * r + c) for c in range(3)] for r in range(rows)]


def flat(m, places=6):
    return F.array(*(F.round(x, places) for r in m for x in r))


PROFILE = """SELECT vec_id, CASE WHEN vec_id % 6 = 0 THEN list_concat(e[1:9], [0.0, 0.0, 0.0]) WHEN vec_id % 6 = 1 THEN list_concat(e[1:9], e[4:6])
 WHEN vec_id % 6 = 2 THEN list_concat(e[1:3], e[1:3], [2 * e[1], 2 * e[2], 2 * e[3]], [0.0, 0.0, 0.0]) WHEN vec_id % 6 = 3 THEN list_concat([0.0, 0.0, 0.0], e[4:9], [0.0, 0.0, 0.0])
 WHEN vec_id % 6 = 4 THEN list_concat(e[1:8], ['nan'::DOUBLE], e[4:6]) ELSE e[1:12] END AS m FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)"""


def profile(spark, d):
    e, at = F.col("e"), lambda i, n: F.slice(F.col("e"), i, n)
    zeros = F.array(*[F.lit(0.0)] * 3)
    k = F.col("vec_id") % 6
    m = (
        F.when(k == 0, F.concat(at(1, 9), zeros)).when(k == 1, F.concat(at(1, 9), at(4, 3))).when(k == 2, F.concat(at(1, 3), at(1, 3), F.transform(at(1, 3), lambda x: 2 * x), zeros))
        .when(k == 3, F.concat(zeros, at(4, 6), zeros)).when(k == 4, F.concat(at(1, 8), F.array(F.lit(float("nan"))), at(4, 3))).otherwise(at(1, 12))
    )
    rows = t(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return rows.where(e.isNotNull()).select("vec_id", m.alias("m"))


APART = "greatest(" + ", ".join(f"abs(m[{i}] - m[{i + 6}])" for i in (4, 5, 6)) + ")"


@query(f"""WITH p AS ({PROFILE}), g AS (SELECT vec_id, CASE WHEN m[10] = 0 AND m[11] = 0 AND m[12] = 0 THEN 'absent' WHEN {APART} <= 0.001 * greatest(abs(m[4]), abs(m[5]), abs(m[6]), 1.0) THEN 'consistent' ELSE 'divergent' END AS kind, {APART} AS a FROM p)
SELECT vec_id, kind, CASE WHEN kind = 'divergent' THEN round(a, 6) END AS difference FROM g""")
def green_planes(spark, d):
    m = matrix(4)
    got = profile(spark, d).select("vec_id", C.green_planes(m[1], m[3]).alias("g"))
    return got.select("vec_id", "g.kind", F.round("g.difference", 6).alias("difference"))


ROWS, SUMS = product(cells("m"), SRGB), cells("q")
WIDE = " + ".join


@query(f"""WITH p AS ({PROFILE}), a AS (SELECT vec_id, m, {listed(ROWS)} AS q FROM p), s AS (SELECT *, [q[1] + q[2] + q[3], q[4] + q[5] + q[6], q[7] + q[8] + q[9]] AS s FROM a),
 n AS (SELECT *, list_transform(range(1, 10), lambda i: q[i] / s[(i - 1) // 3 + 1]) AS n FROM s), e AS (SELECT *, {det(cells('n'))} AS d FROM n),
 r AS (SELECT *, CASE WHEN len(list_filter(m, lambda v: NOT isfinite(v))) > 0 THEN 'not finite'
  WHEN NOT (m[10] = 0 AND m[11] = 0 AND m[12] = 0) AND {APART} > 0.001 * greatest(abs(m[4]), abs(m[5]), abs(m[6]), 1.0) THEN 'green planes differ'
  WHEN least(abs(s[1]), abs(s[2]), abs(s[3])) < 1e-8 THEN 'degenerate row' WHEN NOT isfinite(d) OR abs(d) < 1e-8 THEN 'singular' END AS error FROM e)
SELECT vec_id, error, CASE WHEN error IS NULL THEN round({inverse(cells('n'), 'd')[0][0]}, 4) END AS rr, CASE WHEN error IS NULL THEN round({inverse(cells('n'), 'd')[1][2]}, 4) END AS gb,
 CASE WHEN error IS NULL THEN round({inverse(cells('n'), 'd')[2][1]}, 4) END AS bg FROM r""")
def camera_to_srgb(spark, d):
    """Three elements of the transform, or why there is none, for calibrations made of the embeddings."""
    m, error = C.to_linear_srgb(matrix(4))
    return profile(spark, d).select("vec_id", error.alias("error"), F.round(m[0][0], 4).alias("rr"), F.round(m[1][2], 4).alias("gb"), F.round(m[2][1], 4).alias("bg"))


def white_sql(code):
    xy = " ".join(f"WHEN {code} IN ({', '.join(map(str, codes))}) THEN [{x}, {y}]" for codes, (x, y) in C.WHITES.items())
    return f"(CASE {xy} END)"


CODES = "[21, 17, 3, 20, 0, 24, 11, 18, 19, 23, 1]"
CODE = lambda i: f"({CODES})[CAST({i} AS INT) + 1]"


@query(f"""SELECT l_orderkey, l_linenumber, round(w[1] / w[2], 6) AS x, CASE WHEN w IS NOT NULL THEN 1.0::DOUBLE END AS y, round((1 - w[1] - w[2]) / w[2], 6) AS z
FROM (SELECT l_orderkey, l_linenumber, {white_sql('l_partkey % 27')} AS w FROM lineitem)""")
def illuminant_whites(spark, d):
    x, y, z = C.white_of(F.col("l_partkey") % 27)
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(x, 6).alias("x"), y.alias("y"), F.round(z, 6).alias("z"))


def adaptation(white):
    """SQL of the Bradford adaptation from D65 to a white [x, y]."""
    cone = lambda x, y: [f"({CONES[r][0]} * {x} / {y} + {CONES[r][1]} + {CONES[r][2]} * (1 - {x} - {y}) / {y})" for r in range(3)]
    src, dst = cone("0.31271", "0.32902"), cone(f"{white}[1]", f"{white}[2]")
    scale = [[f"({dst[r]} / {src[r]})" if r == c else "0.0" for c in range(3)] for r in range(3)]
    return product(inverse(CONES, det(CONES)), product(scale, CONES))


FIRST, SECOND = cells("f"), cells("s")


@query(f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e, {CODE('vec_id % 11')} AS c1, {CODE('vec_id // 11 % 11')} AS c2 FROM embeddings),
 p AS (SELECT vec_id, c1, c2, CASE WHEN vec_id % 5 <> 0 THEN e[1:9] END AS f, CASE WHEN vec_id % 3 <> 0 THEN e[10:18] END AS s, {white_sql('c1')} AS w1, {white_sql('c2')} AS w2 FROM v),
 m AS (SELECT vec_id, CASE WHEN s IS NOT NULL AND c2 = 21 THEN s WHEN f IS NOT NULL AND c1 = 21 THEN f WHEN s IS NOT NULL AND w2 IS NOT NULL THEN {listed(product(SECOND, adaptation('w2')))}
  WHEN f IS NOT NULL AND w1 IS NOT NULL THEN {listed(product(FIRST, adaptation('w1')))} ELSE coalesce(f, s) END AS m FROM p)
SELECT vec_id, round(m[1], 6) AS a, round(m[5], 6) AS b, round(m[9], 6) AS c, round(m[3], 6) AS d FROM m""")
def calibration_choice(spark, d):
    """Which matrix of a calibration pair is used, adapted to D65 where that is needed."""
    codes = F.array(*map(F.lit, (21, 17, 3, 20, 0, 24, 11, 18, 19, 23, 1)))
    e, k = F.col("embedding").cast("array<double>"), F.col("vec_id")
    rows = t(spark, d, "embeddings").select(
        "vec_id", F.get(codes, (k % 11).cast("int")).alias("c1"), F.get(codes, (F.floor(k / 11) % 11).cast("int")).alias("c2"), F.when(k % 5 != 0, F.slice(e, 1, 9)).alias("f"), F.when(k % 3 != 0, F.slice(e, 10, 9)).alias("s")
    )
    m = C.choose_matrix(matrix(3, "f"), F.col("c1"), matrix(3, "s"), F.col("c2"))
    return rows.select("vec_id", *(F.round(m[r][c], 6).alias(n) for n, r, c in (("a", 0, 0), ("b", 1, 1), ("c", 2, 2), ("d", 0, 2))))


PLANES_SQL = """SELECT o_orderkey, [(['red', 'green', 'blue', 'other'])[CAST(o_orderkey % 4 AS INT) + 1], (['red', 'green', 'blue'])[CAST(o_custkey % 3 AS INT) + 1], (['red', 'green', 'blue'])[CAST((o_orderkey + o_custkey) % 3 AS INT) + 1]] AS c,
 CASE WHEN o_orderkey % 5 > 0 THEN [0.5, 1.0, o_custkey % 4 / 4.0] END AS n FROM orders"""


@query(f"""WITH p AS ({PLANES_SQL}), q AS (SELECT *, [list_position(c, 'red'), list_position(c, 'green'), list_position(c, 'blue')] AS i FROM p), r AS (SELECT * FROM q WHERE list_sort(i) = [1, 2, 3])
SELECT o_orderkey, i[1] - 1 AS red, i[2] - 1 AS green, i[3] - 1 AS blue, CASE WHEN n IS NULL THEN 1.0 WHEN n[3] > 0 THEN round(n[i[2]] / n[i[1]], 6) END AS red_gain,
 CASE WHEN n IS NULL THEN 1.0 WHEN n[3] > 0 THEN round(n[i[2]] / n[i[3]], 6) END AS blue_gain FROM r""")
def neutral_gains(spark, d):
    """Plane order and as-shot gains of frames whose planes are red, green and blue in some order."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    names = lambda i, n: F.get(F.array(*map(F.lit, ("red", "green", "blue", "other")[:n])), i.cast("int"))
    neutral = F.when(k % 5 > 0, F.array(F.lit(0.5), F.lit(1.0), c % 4 / 4.0))
    planes = C.rgb_planes(F.array(names(k % 4, 4), names(c % 3, 3), names((k + c) % 3, 3)))
    rows = t(spark, d, "orders").select("o_orderkey", planes.alias("i"), neutral.alias("n")).where("i is not null")
    gains = C.neutral_gains(F.col("n"), F.col("i"))
    place = lambda j: F.get("i", j)
    return rows.select("o_orderkey", place(0).alias("red"), place(1).alias("green"), place(2).alias("blue"), F.round(gains[0], 6).alias("red_gain"), F.round(gains[2], 6).alias("blue_gain"))


@query(f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS m FROM embeddings), i AS (SELECT vec_id, m, {det(cells('m'))} AS d FROM v)
SELECT vec_id, abs(d) >= 1e-8 AS good, CASE WHEN abs(d) >= 1e-8 THEN round({inverse(cells('m'), 'd')[0][1]}, 3) END AS a, CASE WHEN abs(d) >= 1e-8 THEN round({inverse(cells('m'), 'd')[2][0]}, 3) END AS b FROM i""")
def matrix_inverse(spark, d):
    rows = t(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("m"))
    out = X.invert_3x3(matrix(3))
    return rows.select("vec_id", out[0][1].isNotNull().alias("good"), F.round(out[0][1], 3).alias("a"), F.round(out[2][0], 3).alias("b"))


@query("""WITH o AS (SELECT o_orderkey, o_orderkey % 3 + 1 AS w, o_custkey % 3 + 1 AS h, o_custkey % 7 AS r, o_orderkey % 5 AS c, (CAST([10.0, 20.0, 30.0, 40.0, 50.0, 60.0, 70.0, 80.0, 90.0] AS DOUBLE[]))[1:CAST((o_orderkey % 3 + 1) * (o_custkey % 3 + 1) AS INT)] AS v FROM orders)
SELECT o_orderkey, v[CAST(r % h * w + c % w AS INT) + 1] AS cell, CASE WHEN len(v) = 1 THEN [v[1], v[1], v[1], v[1]]
 ELSE [v[1], CASE WHEN w > 1 THEN v[2] ELSE 0.0::DOUBLE END, CASE WHEN h > 1 THEN v[w + 1] ELSE 0.0::DOUBLE END, CASE WHEN w > 1 AND h > 1 THEN v[w + 2] ELSE 0.0::DOUBLE END] END AS quad FROM o""")
def level_grids(spark, d):
    """A cell of a repeating grid, and the four black levels that a 2x2 pattern takes from it."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    w, h = k % 3 + 1, c % 3 + 1
    v = F.slice(F.array(*(F.lit(10.0 * i) for i in range(1, 10))), F.lit(1), (w * h).cast("int"))
    return t(spark, d, "orders").select("o_orderkey", X.cell(v, w, h, c % 7, k % 5).alias("cell"), X.bayer_black(v, w, h).alias("quad"))
