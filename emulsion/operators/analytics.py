"""Benchmark analytics over samples grouped by key columns.

Scale: counts, sums and extremes combine on the map side.  Ranks, and so exact percentiles, trimmed means and MADs, come from counts
by value: equal values become one row before the shuffle, and a group is cut into ranges of its values, so no task holds a group
whose values spread (values within a 1,024th of a doubling share a task).
Where ranges are cut doesn't depend on the data, so a task that runs again finds the same ones.  Null keys are a group, null values
count for nothing.  The bootstrap of a group under ``DEALT`` rows is a grouped Python function over its values; that of a larger one is dealt over
tasks by resamples, each with the group's counts by value."""

from __future__ import annotations

import math
import random
from itertools import groupby, islice

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import resample as R

OK = ("0", "ok", "success", "")
OUTLIER_Z, MAD_SCALE, TRIM = 3.5, 0.67448975, 0.10
GATE = 0.05
BASE_SEED = 0x52524148
RESAMPLES = 10_000
STATISTICS = ("mean", "p50", "p95", "p99")
QUANTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
#: Ranges of values for each doubling; a group has at most about 4.3 million, whatever its rows.
RANGES = 1024
#: Places drawn at a time; bounds the memory of a task beside the group itself.
BLOCK_DRAWS = 1 << 18
#: Groups of at least so many rows have their resamples dealt over tasks.
DEALT = 4096
#: Groups for which a piece of the generator's output is drawn once.
TOGETHER = 16


def samples(rows: DataFrame) -> DataFrame:
    """Filter by status, take milliseconds (seconds win where the column is there) and drop what is no finite number."""
    have = set(rows.columns)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("")
    status = F.coalesce(F.col("status").cast("string"), F.lit("0")) if "status" in have else F.lit("0")
    number = lambda c: F.expr(f"try_cast({c} as double)") if c in have else F.lit(None).cast("double")
    if "real_seconds" in have:
        ms = F.when(F.col("real_seconds").isNotNull(), number("real_seconds") * 1000).otherwise(number("latency_ms"))
    else:
        ms = number("latency_ms")
    out = rows.where(status.isin(*OK)).withColumn("ms", ms).where(F.col("ms").isNotNull() & ~F.isnan("ms") & (F.abs("ms") < float("inf")))
    return out.withColumns({c: text(c) for c in ("fixture", "mode", "workers", "backend")})


def _joined(rows: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on keys where null is a key like others."""
    named = other.withColumnsRenamed({k: f"_key{i}" for i, k in enumerate(keys)})
    same = [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)] or [F.lit(True)]
    return rows.join(named, same, how).drop(*(f"_key{i}" for i in range(len(keys))))


def after_warmup(rows: DataFrame, keys: list[str], order: list[str], discard: int) -> DataFrame:
    """Without the first ``discard`` rows of each group; of rows equal in ``order`` any may go.

    Only the first rows of each partition are ranked; they give the last place that goes, and rows are compared with it."""
    if discard <= 0:
        return rows
    place = F.struct(*order)
    first = rows.select(*keys, place.alias("_at")).withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("_at"))).where(F.col("_n") <= discard)
    last = first.groupBy(*keys).agg(F.max("_at").alias("_last"), F.collect_list("_at").alias("_all"))
    last = last.select(*keys, "_last", F.size(F.filter("_all", lambda x: x == F.col("_last"))).alias("_go"))
    near = _joined(rows, last, keys).withColumn("_at", place).where(F.col("_at") >= F.col("_last"))
    tied = near.where(F.col("_at") == F.col("_last")).withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("_at"))).where(F.col("_n") > F.col("_go"))
    return near.where(F.col("_at") > F.col("_last")).select(*rows.columns).unionByName(tied.select(*rows.columns))


def value_range(value: Column) -> Column:
    """The number of a value's range, greater for greater values; NaN is greater than all."""
    v = value.cast("double")
    size = F.floor(F.least(F.greatest(F.log2(F.abs(v)), F.lit(-1075.0)), F.lit(1025.0)) * RANGES) + 1076 * RANGES
    return F.when(F.isnan(v), F.lit(1 << 40)).when(v > 0, size).when(v < 0, -size).otherwise(F.lit(0)).cast("long")


def by_value(rows: DataFrame, keys: list[str], value: str, weight: str | None = None) -> DataFrame:
    """(keys, v, c, below, n): each value of a group, how often it is there, how many rows are less, and the rows of the group.

    A row stands for ``weight`` rows."""
    often = F.sum(weight) if weight else F.count("*")
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(often.alias("c")).withColumn("_range", value_range(F.col("v")))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    totals = counts.groupBy(*keys, "_range").agg(F.sum("c").alias("_t"))
    base = totals.select(
        *keys, "_range", F.coalesce(F.sum("_t").over(before(Window.partitionBy(*keys).orderBy("_range"))), F.lit(0)).alias("_base"),
        F.sum("_t").over(Window.partitionBy(*keys)).alias("n"),
    )
    own = F.coalesce(F.sum("c").over(before(Window.partitionBy(*keys, "_range").orderBy("v"))), F.lit(0))
    return _joined(counts, base, [*keys, "_range"]).select(*keys, "v", "c", (F.col("_base") + own).alias("below"), "n")


def _at(rank: Column) -> Column:
    """The value of a rank from 0, over rows of ``by_value``."""
    return F.max(F.when((F.col("below") <= rank) & (rank < F.col("below") + F.col("c")), F.col("v")))


def _picked(wanted: dict[str, float]) -> tuple[list[Column], list[Column]]:
    """Aggregates over rows of ``by_value`` that pick the two neighbours of each percentile, and what is between them."""
    where = {x: (F.col("n") - 1) * F.lit(float(q)) for x, q in wanted.items()}
    both = [_at(f(p)).alias(f"_{s}_{x}") for x, p in where.items() for s, f in (("lo", F.floor), ("hi", F.ceil))]
    part = lambda x: F.col(f"_lo_{x}") + (F.col(f"_hi_{x}") - F.col(f"_lo_{x}")) * (where[x] - F.floor(where[x]))
    return both, [part(x).alias(x) for x in wanted]


def _quantiles_of(values: DataFrame, keys: list[str], wanted: dict[str, float], *more: Column) -> DataFrame:
    both, out = _picked(wanted)
    got = values.groupBy(*keys).agg(F.max("n").alias("n"), *both, *more)
    return got.select(*(c for c in got.columns if not c.startswith(("_lo_", "_hi_"))), *out)


def quantiles(rows: DataFrame, keys: list[str], value: str, wanted: dict[str, float], weight: str | None = None) -> DataFrame:
    """(keys, n, the wanted): exact percentiles with interpolation, one row for each group that has a value."""
    return _quantiles_of(by_value(rows, keys, value, weight), keys, wanted)


def _plain(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.count(value).alias("n"), F.min(value).alias("min_v"), F.max(value).alias("max_v"), F.avg(value).alias("mean_v"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("stdev_v"),
    )


def summary(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    return _joined(_plain(rows, keys, value), quantiles(rows, keys, value, QUANTILES).drop("n"), keys, "left")


def _mads(values: DataFrame, keys: list[str], medians: DataFrame) -> DataFrame:
    """The MAD of each group from its rows of ``by_value``."""
    far = _joined(values, medians, keys).select(*keys, "c", F.abs(F.col("v") - F.col("median")).alias("_far"))
    return quantiles(far, keys, "_far", {"mad": 0.5}, "c").drop("n")


def with_mad(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Adds n, median and MAD of the group; the groups' statistics are joined as they are few."""
    values = by_value(rows, keys, value)
    one = _quantiles_of(values, keys, {"median": 0.5})
    both = _joined(one, _mads(values, keys, one.drop("n")), keys)
    return _joined(rows, both, keys, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def is_outlier(value: Column, n: Column, median: Column, mad: Column) -> Column:
    """Modified z above the limit; none under four samples; with MAD 0 all that differ from the median."""
    z = F.abs(MAD_SCALE * (value - median) / F.when(mad != 0, mad))
    return (n >= 4) & F.when(mad == 0, value != median).otherwise(z > OUTLIER_Z)


def _trimmed(share: float) -> tuple[Column, Column]:
    cut = F.least(F.floor(F.col("n") * share), F.floor((F.col("n") - 1) / 2))
    used = F.greatest(F.least(F.col("below") + F.col("c"), F.col("n") - cut) - F.greatest("below", cut), F.lit(0))
    return F.sum(F.col("v") * used) / F.sum(used), F.sum(used)


def trimmed_mean(rows: DataFrame, keys: list[str], value: str, ties: list[str] | None = None, share: float = TRIM) -> DataFrame:
    """The mean of a group without ``share`` of its rows at each end, and how many rows are in it; which of equal rows go (``ties``) doesn't change it."""
    mean, used = _trimmed(share)
    return by_value(rows, keys, value).groupBy(*keys).agg(mean.alias("trimmed_mean"), used.alias("n_used"))


def nearest_rank(rows: DataFrame, keys: list[str], value: str, percent: int) -> DataFrame:
    """sorted[ceil((n - 1) * p / 100)]: another percentile than the interpolated one."""
    return by_value(rows, keys, value).groupBy(*keys).agg(_at(F.ceil((F.col("n") - 1) * percent / 100.0)).alias("nearest_rank"))


def gate(old: DataFrame, new: DataFrame, keys: list[str], metrics: list[str], threshold: float = GATE) -> DataFrame:
    """A verdict for each key and metric in both reports."""
    o = old.select(*keys, *(F.col(m).alias(f"_{m}") for m in metrics))
    rows = new.join(o, keys).select(*keys, F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"_{m}").alias("before"), F.col(m).alias("after")) for m in metrics))).alias("x"))
    change = (F.col("x.after") - F.col("x.before")) / F.when(F.col("x.before") > 0, F.col("x.before"))
    status = F.when(change > threshold, "regression").when(change < -threshold, "improvement").otherwise("ok")
    return rows.select(*keys, "x.metric", "x.before", "x.after", change.alias("relative_change"), status.alias("status")).where("relative_change is not null")


def verdicts(old: DataFrame, new: DataFrame, keys: list[str], metrics: list[str], threshold: float = GATE) -> DataFrame:
    """``gate`` with intervals: a change within the threshold is inconclusive where the ratio's interval holds 1.

    A metric's limits are its columns ``_ci_lo`` and ``_ci_hi``; without them it is its own interval.  The ratio's interval is the widest
    of the two, as the runs are independent; a limit of it is null where it would divide by nothing."""
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)

    def lines(rows: DataFrame, prefix: str) -> DataFrame:
        def line(m: str) -> Column:
            at = lambda c: finite(F.col(c if c in rows.columns else m).cast("double"))
            return F.struct(F.lit(m).alias("metric"), at(m).alias(prefix), at(f"{m}_ci_lo").alias(f"{prefix}_lo"), at(f"{m}_ci_hi").alias(f"{prefix}_hi"))

        return rows.select(*keys, F.explode(F.array(*map(line, metrics))).alias("x")).select(*keys, "x.*")

    both = _joined(lines(new, "after"), lines(old, "before"), [*keys, "metric"]).where((F.col("before") > 0) & F.col("after").isNotNull())
    over = lambda x, y: F.col(x) / F.when(F.col(y) != 0, F.col(y))
    out = both.withColumns({
        "absolute_change": F.col("after") - F.col("before"), "ratio": F.col("after") / F.col("before"), "relative_change": (F.col("after") - F.col("before")) / F.col("before"),
        "ratio_lo": over("after_lo", "before_hi"), "ratio_hi": over("after_hi", "before_lo"),
    })
    change = F.col("relative_change")
    open_ = (F.col("ratio_lo") <= 1) & (F.col("ratio_hi") >= 1)
    return out.withColumn("status", F.when(change > threshold, "regression").when(change < -threshold, "improvement").when(open_, "inconclusive").otherwise("ok"))


def speedup_vs_cold(groups: DataFrame, keys: list[str], mode: str, cold: str | tuple[str, ...], value: str, order: list[str] | None = None) -> DataFrame:
    """Cold median over own median, by the other keys; of several cold groups the first by ``order`` (the mode) counts."""
    names = (cold,) if isinstance(cold, str) else cold
    base = groups.where(F.col(mode).isin(*names)).groupBy(*keys).agg(F.min_by(value, F.struct(*(order or [mode]))).alias("_cold"))
    return groups.join(base, keys, "left").withColumn("speedup_vs_cold", F.col("_cold") / F.when(F.col(value) > 0, F.col(value))).drop("_cold")


def _quantile(v: list[float], q: float) -> float:
    v = sorted(v)
    at = (len(v) - 1) * q
    lo, hi = math.floor(at), math.ceil(at)
    return v[lo] if lo == hi else v[lo] + (v[hi] - v[lo]) * (at - lo)


def _resampled(n: int, resamples: int, seed: int):
    """Blocks of resamples as rows of n places, the places that ``random.Random(seed).randrange(n)`` draws one after the other."""
    *key, at = random.Random(seed).getstate()[1]
    bits = np.random.MT19937()
    bits.state = {"bit_generator": "MT19937", "state": {"key": np.array(key, np.uint32), "pos": at}}
    width = n.bit_length()
    left = np.zeros(0, np.uint64)
    for done in range(0, resamples, rows := max(1, BLOCK_DRAWS // n)):
        need = min(rows, resamples - done) * n
        while len(left) < need:
            raw = bits.random_raw(1024 + (need - len(left) << width) // n) >> np.uint64(32 - width)
            left = np.concatenate([left, raw[raw < n]])
        yield left[:need].reshape(-1, n).astype(np.intp)
        left = left[need:]


def _mean_of(v: np.ndarray):
    """The mean of each row of places, equal to ``math.fsum`` over the length: both parts of the values have exact sums wherever their range allows it."""
    n, size = len(v), np.abs(v[v != 0])
    if not len(size):
        return lambda at: np.zeros(len(at))
    unit = math.ldexp(1.0, math.frexp(float(size.max()) * n)[1] - 52)
    if not n * unit <= math.ldexp(1.0, math.frexp(float(size.min()))[1] + 1):
        return lambda at: np.array([math.fsum(r) / n for r in v[at].tolist()])
    high = np.rint(v / unit) * unit
    low = v - high
    return lambda at: (high[at].sum(1) + low[at].sum(1)) / n


def _intervals(v: list[float], names: list[str], resamples: int, seed: int) -> dict[str, tuple[float, float]]:
    """95 % interval of each statistic; names of one length share their seed, and so their resamples."""
    out = {}
    for size in {len(x) for x in names}:
        some = [x for x in names if len(x) == size]
        if len(v) < 2 or resamples <= 0:
            out |= {x: (math.fsum(v) / len(v) if x == "mean" else _quantile(v, QUANTILES[x]),) * 2 for x in some}
            continue
        values = np.array(v, float)
        mean = _mean_of(values)
        at = {x: (len(v) - 1) * QUANTILES[x] for x in some if x != "mean"}
        got: dict[str, list[float]] = {x: [] for x in some}
        for places in _resampled(len(v), resamples, seed + size):
            if "mean" in got:
                got["mean"] += mean(places).tolist()
            if at:
                drawn = np.partition(values[places], sorted({f(k) for k in at.values() for f in (math.floor, math.ceil)}), axis=1)
                for x, k in at.items():
                    lo, hi = drawn[:, math.floor(k)], drawn[:, math.ceil(k)]
                    got[x] += (lo + (hi - lo) * (k - math.floor(k))).tolist()
        out |= {x: (_quantile(g, 0.025), _quantile(g, 0.975)) for x, g in got.items()}
    return out


def bootstrap_all(rows: DataFrame, keys: list[str], value: str, order: list[str], statistics: tuple[str, ...] = STATISTICS, resamples: int = RESAMPLES, seed: int = BASE_SEED) -> DataFrame:
    """95 % interval of each statistic of each group, from seeded resamples, the same at any partitioning.

    Groups of at least ``DEALT`` rows, all finite numbers and ordered by value, are dealt over tasks; the others have a task for each group and seed."""
    if order[0] != value or resamples <= 0:
        return _grouped_bootstrap(rows, keys, value, order, statistics, resamples, seed)
    v = F.col(value).cast("double")
    sound = F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))
    known = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.every(sound).alias("_sound"))
    dealt = F.col("_sound") & (F.col("_n") >= DEALT)
    most = known.agg(F.max(F.when(dealt, F.col("_n"))), F.max(F.when(~dealt, F.col("_n")))).head()
    parts = []
    if most[0] is None or most[1] is not None:
        some = rows if most[0] is None else _joined(rows, known.where(~dealt).select(*keys), keys)
        parts.append(_grouped_bootstrap(some, keys, value, order, statistics, resamples, seed))
    if most[0] is not None:
        some = rows if most[1] is None else _joined(rows, known.where(dealt).select(*keys), keys)
        parts.append(_dealt_bootstrap(some, known.where(dealt), keys, value, statistics, resamples, seed))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _dealt_bootstrap(rows: DataFrame, known: DataFrame, keys: list[str], value: str, statistics: tuple[str, ...], resamples: int, seed: int) -> DataFrame:
    """The intervals of large groups: what each stretch of the generators' output holds is counted, then a task has the resamples that begin in some stretches."""
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
    sizes = sorted({len(x) for x in statistics})
    fields = ", ".join(f"`{k}` {t}" for k, t in rows.select(*keys).dtypes)

    def count(frames):
        import pandas as pd

        for f in frames:
            for size, width, k, ns in zip(f["_size"], f["_width"], f["_k"], f["_ns"], strict=True):
                got = R.counted(seed + int(size), int(width), int(k), [int(n) for n in ns], R.jumps(int(width), int(k)))
                yield pd.DataFrame({"_n": ns, "_size": size, "_k": k, "_own": got})

    def draw(frames):
        import pandas as pd

        rows = (r for f in frames for r in f.itertuples(index=False, name=None))
        for (size, width, k), group in groupby(rows, lambda r: tuple(map(int, r[:3]))):
            some = [x for x in statistics if len(x) == size]
            quantiles = {x: QUANTILES[x] for x in some if x in QUANTILES}
            while part := list(islice(group, TOGETHER)):
                walks, of = [], []
                for *key, n, v, c, own, before in (r[3:] for r in part):
                    ends = np.cumsum(c)
                    takers = [R.Means(v, ends, width)] if "mean" in some else []
                    takers += [R.Ranks(v, ends, width, quantiles)] if quantiles else []
                    walks += [R.walk(x, int(n), int(before), int(own), resamples) for x in takers]
                    of += [(*key, n)] * len(takers)
                got: list[list[dict]] = [[] for _ in walks]
                for i, _, x in R.together(walks, seed + size, width, k, R.jumps(width, k)):
                    got[i].append(x)
                for (*key, n), mine in zip(of, got, strict=True):
                    for x in mine[0] if mine else ():
                        yield pd.DataFrame({q: [y] * len(mine) for q, y in zip(keys, key, strict=True)} | {"metric": x, "n": n, "_estimate": [m[x] for m in mine]})

    def limits(pdf):
        got = pdf["_estimate"].tolist()
        if len(got) != resamples:
            raise RuntimeError(f"{len(got)} of {resamples} resamples")
        return pdf.iloc[:1].drop(columns="_estimate").assign(ci_lo=_quantile(got, 0.025), ci_hi=_quantile(got, 0.975))

    last = F.element_at(F.array(*(F.lit(R.stretches((1 << w) - 1, resamples) - 1) for w in range(1, 63))), F.length(F.bin("_n")))
    each = known.select("_n").distinct().select("_n", F.length(F.bin("_n")).alias("_width"), F.explode(F.array(*map(F.lit, sizes))).alias("_size"))
    each = each.withColumn("_k", F.explode(F.sequence(F.lit(0), last.cast("int"))))
    shared = each.groupBy("_size", "_width", "_k").agg(F.collect_list("_n").alias("_ns")).repartition(tasks)
    own = shared.mapInPandas(count, "_n long, _size int, _k int, _own long")
    before = F.coalesce(F.sum("_own").over(Window.partitionBy("_n", "_size").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = own.withColumn("_before", before)
    counts = rows.groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    values = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"), F.array_sort(F.collect_list(F.struct("_v", "_c"))).alias("_all")).select(*keys, "_n", F.col("_all._v").alias("_v"), F.col("_all._c").alias("_c"))
    place = ["_size", "_width", "_k"]
    work = values.join(own, "_n").select("_size", F.length(F.bin("_n")).alias("_width"), "_k", *keys, "_n", "_v", "_c", "_own", "_before").repartition(tasks, *place).sortWithinPartitions(*place)
    got = work.mapInPandas(draw, f"{fields}, metric string, n long, _estimate double")
    return got.groupBy(*keys, "metric").applyInPandas(limits, f"{fields}, metric string, n long, ci_lo double, ci_hi double")


def _grouped_bootstrap(rows: DataFrame, keys: list[str], value: str, order: list[str], statistics: tuple[str, ...], resamples: int, seed: int) -> DataFrame:
    """The intervals of groups, each group's values in one task."""
    sizes = sorted({len(x) for x in statistics})
    fields = ", ".join(f"`{k}` {t}" for k, t in rows.select(*keys).dtypes)
    kept = list(dict.fromkeys([*keys, value, *order]))

    def run(pdf):
        import pandas as pd

        v = pdf.sort_values(order)[value].tolist()
        got = _intervals(v, [x for x in statistics if len(x) == pdf["_size"].iloc[0]], resamples, seed)
        out = {k: [pdf[k].iloc[0]] * len(got) for k in keys}
        return pd.DataFrame(out | {"metric": list(got), "n": [len(v)] * len(got), "ci_lo": [x[0] for x in got.values()], "ci_hi": [x[1] for x in got.values()]})

    each = rows.select(*kept, F.explode(F.array(*map(F.lit, sizes))).alias("_size"))
    return each.groupBy(*keys, "_size").applyInPandas(run, f"{fields}, metric string, n long, ci_lo double, ci_hi double")


def bootstrap(rows: DataFrame, keys: list[str], value: str, order: list[str], statistic: str = "p50", resamples: int = RESAMPLES, seed: int = BASE_SEED) -> DataFrame:
    return bootstrap_all(rows, keys, value, order, (statistic,), resamples, seed).drop("metric")


def report_without_intervals(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The summary of each group with MAD, outliers, trimmed mean, percentiles without outliers (null where there are none) and warnings.

    n_used counts the rows that are no outliers, n_trimmed those of the trimmed mean."""
    values = by_value(rows, keys, value)
    mean, used = _trimmed(TRIM)
    ranks = _quantiles_of(values, keys, QUANTILES | {"median": 0.5}, mean.alias("trimmed_mean"), used.alias("n_trimmed"))
    spread = _joined(ranks.select(*keys, "median"), _mads(values, keys, ranks.select(*keys, "median")), keys)
    out_of = F.coalesce(is_outlier(F.col("v"), F.col("n"), F.col("median"), F.col("mad")), F.lit(False))
    flagged = _joined(values, spread, keys).withColumn("_out", out_of)
    gone, kept = (F.sum(F.when(x, F.col("c")).otherwise(F.lit(0))) for x in (F.col("_out"), ~F.col("_out")))
    mads = flagged.groupBy(*keys).agg(F.max("mad").alias("mad_v"), gone.alias("outlier_count"), F.when(kept > 0, kept).otherwise(F.sum("c")).alias("n_used"))
    inner = quantiles(flagged.where(~F.col("_out")).select(*keys, "v", "c"), keys, "v", {"filtered_p50": 0.5, "filtered_p95": 0.95}, "c").drop("n")
    out = _plain(rows, keys, value)
    for more in (ranks.drop("n", "median"), mads, inner):
        out = _joined(out, more, keys, "left")
    out = out.withColumn("outlier_count", F.coalesce("outlier_count", F.lit(0))).withColumn("n_used", F.coalesce("n_used", F.lit(0)))
    out = out.withColumns({c: F.when(F.col("outlier_count") > 0, F.col(c)) for c in ("filtered_p50", "filtered_p95")})
    few = F.when(F.col("n") < 10, "n<10").when(F.col("n") < 30, "n<30").otherwise("")
    return out.withColumn("warning", few)


def report(rows: DataFrame, keys: list[str], value: str, ties: list[str], resamples: int = RESAMPLES) -> DataFrame:
    """The report with the 95 % intervals of mean, p50, p95 and p99."""
    limits = bootstrap_all(rows.where(F.col(value).isNotNull()), keys, value, [value, *ties], resamples=resamples)
    at = lambda x, c: F.max(F.when(F.col("metric") == x, F.col(c))).alias(f"{x}_{c}")
    wide = limits.groupBy(*keys).agg(*(at(x, c) for x in STATISTICS for c in ("ci_lo", "ci_hi")))
    return _joined(report_without_intervals(rows, keys, value), wide, keys, "left")


# ---- telemetry
def counters(events: DataFrame) -> DataFrame:
    return events.where("kind = 'counter'").groupBy("name", "stage").agg(F.sum("value").alias("total"))


def gauges(events: DataFrame) -> DataFrame:
    """The newest value by sequence."""
    return events.where("kind = 'gauge'").groupBy("name", "stage").agg(F.max_by("value", "sequence").alias("value"))


def spans(events: DataFrame) -> DataFrame:
    """Begin and end of the same name paired by nesting rank within a run."""
    w = Window.partitionBy("run_id", "name", "stage", "kind").orderBy("sequence")
    ranked = events.withColumn("k", F.row_number().over(w))
    keys = ["run_id", "name", "stage", "k"]
    b = ranked.where("kind = 'span_begin'").select(*keys, F.col("ts_ns").alias("began"))
    e = ranked.where("kind = 'span_end'").select(*keys, F.col("ts_ns").alias("ended"))
    return b.join(e, keys).withColumn("duration_ns", F.col("ended") - F.col("began"))


def chrome_trace(events: DataFrame) -> DataFrame:
    ph = F.when(F.col("kind") == "span_begin", "B").when(F.col("kind") == "span_end", "E").otherwise("C")
    args = F.when(F.col("value").isNotNull(), F.map_concat(F.coalesce("args", F.create_map().cast("map<string,string>")), F.create_map(F.lit("value"), F.col("value").cast("string")))).otherwise(F.col("args"))
    return events.select("name", F.col("stage").alias("cat"), ph.alias("ph"), (F.col("ts_ns") / 1000).alias("ts"), args.alias("args"))
