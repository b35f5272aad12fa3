"""Latest-wins request streams as batch operators over ordered event tables."""

from __future__ import annotations

from collections import OrderedDict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEHIND, AHEAD = 2, 5


def micros(ts: Column) -> Column:
    """Microseconds since 1970 on the column's own clock, with or without time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def latest_wins(events: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """The newest event of each key: one combining aggregation, no window."""
    newest = F.max_by(F.struct(*columns), F.struct(*order))
    return events.groupBy(key).agg(newest.alias("x")).select(key, "x.*")


def prefetch_window(items: DataFrame, key: str, order: list[str], value: str, behind: int = BEHIND, ahead: int = AHEAD) -> DataFrame:
    """The items around each item, clipped at the ends."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-behind, ahead)
    return items.select("*", F.count(value).over(w).alias("n_jobs"), F.first(value).over(w).alias("first_job"), F.last(value).over(w).alias("last_job"))


def prefetch_order(offset: Column) -> Column:
    """Rank of an offset: the centre, then behind from near to far, then ahead."""
    return F.when(offset == 0, F.lit(0)).when(offset < 0, -offset).otherwise(offset + BEHIND)


def drop_stale(events: DataFrame, key: str, generation: str, order: list[str]) -> DataFrame:
    """Events whose generation is the newest submitted so far for their key."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumn("_g", F.max(generation).over(w)).where(F.col(generation) == F.col("_g")).drop("_g")


def debounce(events: DataFrame, key: str, ts: str, order: list[str], quiet_ms: int) -> DataFrame:
    """Events after which nothing of the key follows for ``quiet_ms``: what a debounced writer commits."""
    w = Window.partitionBy(key).orderBy(*order)
    gap = (micros(F.lead(ts).over(w)) - micros(F.col(ts))) / 1000
    return events.withColumn("_gap", gap).where(F.col("_gap").isNull() | (F.col("_gap") >= quiet_ms)).drop("_gap")


def as_of(left: DataFrame, right: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Each left row with the last right value at or before it: one union and one window, never a range join."""
    tag = left.select(key, *order, F.lit(None).cast(dict(right.dtypes)[value]).alias("_v"), F.lit(1).alias("_side"))
    rows = tag.unionByName(right.select(key, *order, F.col(value).alias("_v"), F.lit(0).alias("_side")))
    w = Window.partitionBy(key).orderBy(*order, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("matched", F.last("_v", ignorenulls=True).over(w)).where("_side = 1").drop("_v", "_side")


def _range_of(number: Column, cuts: list) -> Column:
    """How many cuts are less than a number, by halving."""

    def part(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(number > cuts[mid], part(mid + 1, hi)).otherwise(part(lo, mid))

    return part(0, len(cuts))


def running_total(rows: DataFrame, order: list[str], value: str, buckets: int | None = None, descending: bool = False) -> DataFrame:
    """A running sum over one global order without one task for all rows: rows are cut into ranges of the leading order column (as many
    as the session has shuffle partitions), the ranges' totals, one row each, are accumulated, and each range adds its base.  The cuts
    are approximate percentiles found by a job of its own; where they lie doesn't change the sums.  Rows without a leading column come
    first.  Rows equal in the leading column share a range."""
    lead = order[0]
    buckets = buckets or max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    number = micros(F.col(lead)) if dict(rows.dtypes)[lead].startswith("timestamp") else F.col(lead)
    cuts = rows.select(F.percentile_approx(number, [i / buckets for i in range(1, buckets)], max(10_000, 10 * buckets)).alias("c")).first()[0] or []
    b = F.when(number.isNull(), F.lit(-1)).otherwise(_range_of(number, sorted(set(cuts))))
    b = -b if descending else b
    cut = rows.withColumn("_b", b)
    totals = cut.groupBy("_b").agg(F.sum(value).alias("_t"))
    base = totals.select(F.col("_b").alias("_b2"), F.coalesce(F.sum("_t").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    keys = [F.col(c).desc() if descending else F.col(c) for c in order]
    w = Window.partitionBy("_b").orderBy(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = cut.withColumn("_own", F.sum(value).over(w)).join(F.broadcast(base), F.col("_b") == F.col("_b2"))  # at most buckets + 1 rows
    return out.withColumn("running_total", F.col("_own") + F.col("_base")).drop("_b", "_b2", "_own", "_base")


def evicted(artifacts: DataFrame, order: list[str], size: str, budget: int) -> DataFrame:
    """Oldest-first eviction: what does not fit once the newest are kept."""
    return running_total(artifacts, order, size, descending=True).where(F.col("running_total") > budget)


class WeightedLru:
    """A byte-weighted least-recently-used store with pins; prefetch never evicts what is pinned."""

    def __init__(self, capacity: int):
        self.capacity, self.used = capacity, 0
        self.items: OrderedDict = OrderedDict()
        self.pinned: set = set()

    def get(self, key) -> bool:
        if key not in self.items:
            return False
        self.items.move_to_end(key)
        return True

    def remove(self, key) -> None:
        self.used -= self.items.pop(key, 0)

    def insert(self, key, size: int, honour_pins: bool = False) -> tuple[bool, list]:
        gone: list = []
        if size > self.capacity:
            return False, gone
        self.remove(key)
        while self.used + size > self.capacity:
            victim = next((k for k in self.items if not honour_pins or k not in self.pinned), None)
            if victim is None:
                return False, gone
            self.remove(victim)
            gone.append(victim)
        self.items[key] = size
        self.used += size
        return True, gone


def lru_replay(events: DataFrame, key: str, order: list[str], item: str, size: str, capacity: int) -> DataFrame:
    """Replays requests of each key through its own store: one row for each request with hit and number evicted."""
    kinds = dict(events.dtypes)
    fields = ", ".join(f"{c} {kinds[c]}" for c in dict.fromkeys([key, *order]))

    def run(pdf):
        pdf = pdf.sort_values(order, kind="stable")
        store, hits, gone = WeightedLru(capacity), [], []
        for k, n in zip(pdf[item], pdf[size], strict=True):
            hit = store.get(k)
            hits.append(hit)
            gone.append(0 if hit else len(store.insert(k, int(n))[1]))
        return pdf[list(dict.fromkeys([key, *order]))].assign(hit=hits, n_evicted=gone)

    return events.groupBy(key).applyInPandas(run, f"{fields}, hit boolean, n_evicted long")
