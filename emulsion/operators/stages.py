"""Stage states and admission of background work, replayed from logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IDLE_MS = 200


def fail_stages(stages: DataFrame, key: str, index: str, state: str) -> DataFrame:
    """What a failure does to each key's ordered stages: the first running one, or else the first pending one, is failed, and pending
    or running ones after it are skipped.  Keys with a failed stage, or with neither kind, stay as they are.

    Aggregates before the join, so a key with very many stages isn't collected.
    """
    first = lambda s: F.min(F.when(F.col(state) == s, F.col(index)))
    hit = stages.groupBy(F.col(key).alias("_k")).agg(
        F.when(~F.coalesce(F.bool_or(F.col(state) == "failed"), F.lit(False)), F.coalesce(first("running"), first("pending"))).alias("_at")
    )
    now = F.when(F.col(index) == F.col("_at"), "failed").when((F.col(index) > F.col("_at")) & F.col(state).isin("pending", "running"), "skipped").otherwise(F.col(state))
    return stages.join(hit, F.col(key).eqNullSafe(F.col("_k")), "left").withColumn(state, now).drop("_k", "_at")


def first_latch(events: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """The first value of each key; later ones don't change it."""
    return events.where(F.col(value).isNotNull()).groupBy(key).agg(F.min_by(value, F.struct(*order)).alias(value))


def admit(log: DataFrame, gate: str, order: list[str], ms: Column, idle_ms: int = IDLE_MS) -> DataFrame:
    """Attempts of background work with ``admitted``: no foreground request is open, no permit is held, and the gate was idle long enough.

    ``log`` has kind (request, finish, defer, begin, end, attempt) and epoch.  A finish counts only for the newest epoch requested so far;
    idle time runs from it or from a defer, and must be longer than ``idle_ms``.  One gate is one process's log, so a window over it stays small.
    """
    past = Window.partitionBy(gate).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    kind = F.col("kind")
    seen = log.withColumn("_newest", F.max(F.when(kind == "request", F.col("epoch"))).over(past)).withColumn("_ms", ms)
    closes = (kind == "finish") & (F.col("epoch") == F.col("_newest"))
    seen = seen.withColumn("_open", F.last(F.when(kind == "request", True).when(closes, False), True).over(past))
    seen = seen.withColumn("_since", F.last(F.when(closes | (kind == "defer"), F.col("_ms")), True).over(past))
    seen = seen.withColumn("_held", F.sum(F.when(kind == "begin", 1).when(kind == "end", -1).otherwise(0)).over(past))
    rested = F.col("_since").isNull() | (F.col("_ms") - F.col("_since") > idle_ms)
    free = ~F.coalesce(F.col("_open"), F.lit(False)) & (F.col("_held") <= 0) & rested
    return seen.where(kind == "attempt").withColumn("admitted", free).drop("_newest", "_ms", "_open", "_since", "_held")
