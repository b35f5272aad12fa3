"""Ranks from counts by value against plain sorting."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from emulsion.operators import analytics as A
from emulsion.operators import requests as Q


def test_quantiles_trim_and_rank(spark):
    draw = random.Random(5)
    make = {
        "even": lambda: draw.uniform(-3, 3), "ties": lambda: float(draw.randrange(-2, 3)), "wide": lambda: draw.choice((-1, 1)) * 10 ** draw.uniform(-300, 300),
        "near": lambda: 100 + draw.random() * 1e-9, None: lambda: draw.gauss(0, 1),
    }
    data = [(k, f()) for k, f in make.items() for _ in range(draw.randrange(50, 400))] + [("one", 7.0), ("zero", 0.0), ("zero", -0.0), ("none", None), ("even", None), (None, None)]
    rows = spark.createDataFrame(data, "k string, v double").repartition(5)
    plain: dict = {}
    for k, v in data:
        if v is not None:
            plain.setdefault(k, []).append(v)
    got = {r.k: r for r in A.quantiles(rows, ["k"], "v", {"a": 0.0, "p50": 0.5, "p95": 0.95, "z": 1.0}).collect()}
    assert set(got) == set(plain)
    trimmed = {r.k: r for r in A.trimmed_mean(rows, ["k"], "v").collect()}
    ranked = {r.k: r.nearest_rank for r in A.nearest_rank(rows, ["k"], "v", 95).collect()}
    for k, v in plain.items():
        v.sort()
        assert got[k].n == len(v)
        for c, q in (("a", 0), ("p50", 0.5), ("p95", 0.95), ("z", 1)):
            assert math.isclose(got[k][c], float(np.quantile(v, q)), rel_tol=1e-9, abs_tol=1e-12), (k, c)
        cut = min(int(len(v) * 0.1), (len(v) - 1) // 2)
        inner = v[cut : len(v) - cut]
        assert trimmed[k].n_used == len(inner)
        assert math.isclose(trimmed[k].trimmed_mean, math.fsum(inner) / len(inner), rel_tol=1e-9, abs_tol=1e-9)
        assert ranked[k] == v[math.ceil((len(v) - 1) * 95 / 100)]
    assert {r.k: r.n for r in A.summary(rows, ["k"], "v").collect()}["none"] == 0


def test_value_range_keeps_order(spark):
    v = [-math.inf, -1.7e308, -1.0, -1e-320, 0.0, 5e-324, 1e-5, 1.0, 1.0000001, 2.0, 1.7e308, math.inf, math.nan]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(v)], "i int, v double").orderBy("i").select(A.value_range(F.col("v"))).collect()]
    assert got == sorted(got) and got[3] < got[4] < got[5]


def test_warmup_with_ties_and_null_keys(spark):
    data = [("a", t, i) for i, t in enumerate([3, 1, 1, 1, 2, None, 5])] + [("b", 1, 9), (None, 2, 10), (None, 1, 11), (None, 3, 12)]
    rows = spark.createDataFrame(data, "k string, t int, i int")
    for n in (0, 1, 2, 3, 20):
        kept = A.after_warmup(rows, ["k"], ["t"], n)
        assert kept.columns == rows.columns
        got: dict = {}
        for r in kept.collect():
            got.setdefault(r.k, []).append((r.t is not None, r.t or 0))
        for k in ("a", "b", None):
            want = sorted((t is not None, t or 0) for g, t, _ in data if g == k)[n:]
            assert sorted(got.get(k, [])) == want, (n, k)


def test_running_total_with_nulls_and_many_ranges(spark):
    draw = random.Random(2)
    data = [(None if i % 9 == 0 else draw.randrange(40), i, draw.randrange(10)) for i in range(500)]
    rows = spark.createDataFrame(data, "o int, i int, v int").repartition(6)
    for down in (False, True):
        order = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=down)
        total, want = 0, {}
        for _, i, v in order:
            total += v
            want[i] = total
        for buckets in (None, 2, 33, 700):
            assert {r.i: r.running_total for r in Q.running_total(rows, ["o", "i"], "v", buckets, down).collect()} == want
