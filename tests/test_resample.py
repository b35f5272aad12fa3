"""Resamples dealt over tasks against those drawn one after the other."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from emulsion.operators import analytics as A
from emulsion.operators import resample as R


def test_a_jump_goes_as_far_as_single_steps():
    key, _ = R._key(5)
    out = R._raw(np.random.RandomState(R._generator(key, R.STATE)), (1 << 16) + 999)
    for power in (0, 3, 16):
        draws = np.random.RandomState(R._generator(R.jumped(key, R.jump(power)), R.STATE))
        assert (R._raw(draws, 999) == out[1 << power :][:999]).all()


def in_stretches(v, resamples, seed):
    values, c = np.unique(np.array(v, float), return_counts=True)
    ends, n = np.cumsum(c), len(v)
    width, last, out = n.bit_length(), R.stretches(n, resamples), {}
    for size, make in ((4, lambda: R.Means(values, ends, width)), (3, lambda: R.Ranks(values, ends, width, A.QUANTILES))):
        own = [R.counted(seed + size, width, k, [n], R.jumps(width, k))[0] for k in range(last)]
        got = {}
        for k in range(last):
            for _, i, x in R.together([R.walk(make(), n, sum(own[:k]), own[k], resamples)], seed + size, width, k, R.jumps(width, k)):
                assert i not in got
                got[i] = x
        assert sorted(got) == list(range(resamples))
        out |= {x: (A._quantile([g[x] for g in got.values()], 0.025), A._quantile([g[x] for g in got.values()], 0.975)) for x in got[0]}
    return out


@pytest.mark.parametrize("spread", [8.0, 0.02])
@pytest.mark.parametrize("v", [[0.01 * (i * i % 7919) for i in range(5000)], [math.ldexp(1.0 + i, i % 900) for i in range(300)], [-0.5, 2.25], [1.0] * 4096])
def test_stretches_give_the_resamples_of_single_draws(monkeypatch, v, spread):
    monkeypatch.setattr(R, "STRETCH", 17)
    monkeypatch.setattr(R, "stretch", lambda width: 17)
    monkeypatch.setattr(R, "SPREAD", spread)
    assert in_stretches(v, 150, 7) == A._intervals(sorted(v), list(A.STATISTICS), 150, 7)
    monkeypatch.setattr(R, "TABLE_WIDTH", 1)
    assert in_stretches(v, 20, 7) == A._intervals(sorted(v), list(A.STATISTICS), 20, 7)


def test_large_groups_are_dealt_over_tasks(spark):
    """With small groups, a null key and a group with a missing value beside them."""
    key = F.when(F.col("id") < 9000, "large").when(F.col("id") < 13_500, "other").when(F.col("id") < 18_000, "holes").when(F.col("id") < 22_500, None).otherwise("small")
    rows = spark.range(22_700).select(key.alias("k"), "id", F.when(F.col("id") != 17_000, (F.col("id") * 7919 % 10_007) / 100).alias("v")).repartition(5)
    got = A.bootstrap_all(rows, ["k"], "v", ["v", "id"], resamples=40)
    old = A._grouped_bootstrap(rows, ["k"], "v", ["v", "id"], A.STATISTICS, 40, A.BASE_SEED)
    assert got.schema == old.schema
    assert sorted(map(str, got.collect())) == sorted(map(str, old.collect()))


def test_a_large_group_is_never_one_task(spark, monkeypatch):
    def whole(*_):
        raise AssertionError("a whole group")

    monkeypatch.setattr(A, "_grouped_bootstrap", whole, raising=False)
    rows = spark.range(20_000).select(F.lit("a").alias("k"), "id", F.rand(1).alias("v"))
    plan = A.bootstrap_all(rows, ["k"], "v", ["v", "id"], resamples=10)._jdf.queryExecution().toString()
    assert "mapinpandas" in plan.lower()


def test_groups_of_a_width_share_the_output(monkeypatch):
    monkeypatch.setattr(R, "stretch", lambda width: 18)
    monkeypatch.setattr(R, "SPREAD", 0.02)
    groups = [np.arange(n) / 8 for n in (5000, 4500)]
    own = R.counted(9, 13, 0, [5000, 4500], [])
    walks = lambda: [R.walk(R.Ranks(v, np.arange(len(v)) + 1, 13, A.QUANTILES), len(v), 0, k, 1000) for v, k in zip(groups, own, strict=True)]
    both = list(R.together(walks(), 9, 13, 0, []))
    for i in (0, 1):
        alone = [(number, x) for _, number, x in R.together([walks()[i]], 9, 13, 0, [])]
        assert len(alone) == -(-own[i] // len(groups[i])) and alone == [(number, x) for j, number, x in both if j == i]
