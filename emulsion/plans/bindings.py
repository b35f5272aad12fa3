"""Each operator bound to a driver table, beside the SQL that gives the same rows.

Floating results are rounded on both sides, because sums may be taken in any order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import blake3 as B3
from ..functions import frame as X
from ..operators import analytics as A
from ..operators import artifacts as K
from ..operators import raster as R
from ..operators import requests as Q
from ..sources import benchlog as L
from ..sources import catalog as C

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


# ---- analytics
SUMMARY_SQL = """count(value) AS n, min(value) AS min_v, max(value) AS max_v, round(avg(value), 6) AS mean_v,
 round(coalesce(stddev_samp(value), 0.0), 6) AS stdev_v, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99"""


@query(f"SELECT event_type, {SUMMARY_SQL} FROM events GROUP BY event_type")
def latency_summary(spark, d):
    return rounded(A.summary(t(spark, d, "events"), ["event_type"], "value"), "mean_v", "stdev_v", "p50", "p95", "p99")


MAD_SQL = """m AS (SELECT event_type, quantile_cont(value, 0.5) AS median, count(*) AS n FROM events GROUP BY 1),
 d AS (SELECT e.*, m.median, m.n FROM events e JOIN m USING (event_type)),
 s AS (SELECT event_type, quantile_cont(abs(value - median), 0.5) AS mad FROM d GROUP BY 1),
 f AS (SELECT d.*, s.mad, d.n >= 4 AND CASE WHEN s.mad = 0 THEN d.value <> d.median ELSE abs(0.67448975 * (d.value - d.median) / s.mad) > 3.5 END AS out FROM d JOIN s USING (event_type))"""


@query(f"WITH {MAD_SQL} SELECT event_id, event_type, value FROM f WHERE out")
def mad_outliers(spark, d):
    rows = A.with_mad(t(spark, d, "events"), ["event_type"], "value")
    return rows.where(A.is_outlier(F.col("value"), F.col("n"), F.col("median"), F.col("mad"))).select("event_id", "event_type", "value")


TRIM_SQL = """r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS rn, count(*) OVER (PARTITION BY event_type) AS c FROM events),
 tm AS (SELECT event_type, avg(value) AS trimmed_mean, count(*) AS n_used FROM r WHERE rn > least(floor(c * 0.1), floor((c - 1) / 2)) AND rn <= c - least(floor(c * 0.1), floor((c - 1) / 2)) GROUP BY 1)"""


@query(f"WITH {TRIM_SQL} SELECT event_type, round(trimmed_mean, 6) AS trimmed_mean, n_used FROM tm")
def trimmed_mean(spark, d):
    return rounded(A.trimmed_mean(t(spark, d, "events"), ["event_type"], "value"), "trimmed_mean")


@query(f"""WITH {MAD_SQL}, {TRIM_SQL}, g AS (SELECT event_type, {SUMMARY_SQL} FROM events GROUP BY 1), o AS (SELECT event_type, round(max(mad), 6) AS mad_v, CAST(sum(out::int) AS BIGINT) AS outlier_count FROM f GROUP BY 1)
SELECT g.*, o.mad_v, o.outlier_count, round(tm.trimmed_mean, 6) AS trimmed_mean, tm.n_used, CASE WHEN g.n < 10 THEN 'n<10' WHEN g.n < 30 THEN 'n<30' ELSE '' END AS warning FROM g JOIN o USING (event_type) JOIN tm USING (event_type)""")
def bench_report(spark, d):
    """The columns of the SQL, where n_used means the rows of the trimmed mean; bench_report_full has the whole report."""
    out = A.report_without_intervals(t(spark, d, "events"), ["event_type"], "value")
    out = out.drop("n_used", "filtered_p50", "filtered_p95").withColumnRenamed("n_trimmed", "n_used")
    return rounded(out, "mean_v", "stdev_v", "p50", "p95", "p99", "mad_v", "trimmed_mean")


@query()
def bench_report_full(spark, d):
    """With intervals, percentiles without outliers, and n_used of the outlier filter."""
    return A.report(t(spark, d, "events"), ["event_type"], "value", ["event_id"])


@query("SELECT event_type, count(*) AS n, min(value) AS min_v, max(value) AS max_v FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS r FROM events) WHERE r > 2 GROUP BY 1")
def warmup_discard(spark, d):
    kept = A.after_warmup(t(spark, d, "events"), ["event_type"], ["ts", "event_id"], 2)
    return kept.groupBy("event_type").agg(F.count("*").alias("n"), F.min("value").alias("min_v"), F.max("value").alias("max_v"))


@query("""WITH q AS (SELECT event_type, event_id % 2 AS side, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95 FROM events GROUP BY 1, 2),
 l AS (SELECT event_type, side, 'p50' AS metric, p50 AS v FROM q UNION ALL SELECT event_type, side, 'p95', p95 FROM q),
 j AS (SELECT a.event_type, a.metric, a.v AS before, b.v AS after, (b.v - a.v) / a.v AS c FROM l a JOIN l b ON a.event_type = b.event_type AND a.metric = b.metric AND a.side = 0 AND b.side = 1 WHERE a.v > 0)
SELECT event_type, metric, round(before, 6) AS before, round(after, 6) AS after, round(c, 6) AS relative_change, CASE WHEN c > 0.05 THEN 'regression' WHEN c < -0.05 THEN 'improvement' ELSE 'ok' END AS status FROM j""")
def baseline_gate(spark, d):
    e = t(spark, d, "events")
    by = lambda side: A.quantiles(e.where(F.col("event_id") % 2 == side), ["event_type"], "value", {"p50": 0.5, "p95": 0.95}).drop("n")
    return rounded(A.gate(by(0), by(1), ["event_type"], ["p50", "p95"]), "before", "after", "relative_change")


VERDICT_Q = ", ".join(f"quantile_cont(value, {q}) AS {n}" for n, q in (("p50", 0.5), ("p50_lo", 0.48), ("p50_hi", 0.52), ("p95", 0.95), ("p95_lo", 0.94), ("p95_hi", 0.96)))


@query(f"""WITH q AS (SELECT event_type, user_id % 4 AS fixture, event_id % 2 AS side, {VERDICT_Q} FROM events GROUP BY 1, 2, 3),
 l AS (SELECT event_type, fixture, side, 'p50' AS metric, p50 AS v, p50_lo AS lo, p50_hi AS hi FROM q UNION ALL SELECT event_type, fixture, side, 'p95', p95, p95_lo, p95_hi FROM q),
 j AS (SELECT a.event_type, a.fixture, a.metric, a.v AS before, b.v AS after, b.v / a.v AS ratio, (b.v - a.v) / a.v AS c, b.lo / a.hi AS rl, b.hi / a.lo AS rh FROM l a JOIN l b ON a.event_type = b.event_type AND a.fixture = b.fixture AND a.metric = b.metric AND a.side = 0 AND b.side = 1 WHERE a.v > 0)
SELECT event_type, fixture, metric, round(before, 6) AS before, round(after, 6) AS after, round(ratio, 6) AS ratio, round(c, 6) AS relative_change, round(rl, 6) AS ratio_lo, round(rh, 6) AS ratio_hi,
 CASE WHEN c > 0.05 THEN 'regression' WHEN c < -0.05 THEN 'improvement' WHEN rl <= 1 AND rh >= 1 THEN 'inconclusive' ELSE 'ok' END AS status FROM j""")
def baseline_verdict(spark, d):
    """The verdict with intervals; percentiles beside a percentile stand for its limits, so that SQL has them too."""
    e = t(spark, d, "events").withColumn("fixture", F.col("user_id") % 4)
    keys, wanted = ["event_type", "fixture"], {"p50": 0.5, "p50_ci_lo": 0.48, "p50_ci_hi": 0.52, "p95": 0.95, "p95_ci_lo": 0.94, "p95_ci_hi": 0.96}
    by = lambda side: A.quantiles(e.where(F.col("event_id") % 2 == side), keys, "value", wanted)
    out = A.verdicts(by(0), by(1), keys, ["p50", "p95"])
    return rounded(out.select(*keys, "metric", "before", "after", "ratio", "relative_change", "ratio_lo", "ratio_hi", "status"), "before", "after", "ratio", "relative_change", "ratio_lo", "ratio_hi")


@query("SELECT event_type, (list_sort(list(value)))[CAST(ceil((count(*) - 1) * 95 / 100.0) AS BIGINT) + 1] AS nearest_rank FROM events GROUP BY 1")
def nearest_rank_p95(spark, d):
    return A.nearest_rank(t(spark, d, "events"), ["event_type"], "value", 95)


@query("""WITH g AS (SELECT user_id % 10 AS fixture, event_type AS mode, quantile_cont(value, 0.5) AS p50 FROM events GROUP BY 1, 2), b AS (SELECT fixture, p50 AS cold FROM g WHERE mode = 'view')
SELECT fixture, mode, round(p50, 6) AS p50, round(cold / p50, 6) AS speedup_vs_cold FROM g LEFT JOIN b USING (fixture)""")
def speedup_vs_cold(spark, d):
    e = t(spark, d, "events").select((F.col("user_id") % 10).alias("fixture"), F.col("event_type").alias("mode"), "value")
    g = A.quantiles(e, ["fixture", "mode"], "value", {"p50": 0.5}).drop("n")
    return rounded(A.speedup_vs_cold(g, ["fixture"], "mode", "view", "p50"), "p50", "speedup_vs_cold")


@query()
def bootstrap_ci(spark, d):
    """Intervals of the mean, p50, p95 and p99 of each event type, a row for each."""
    return A.bootstrap_all(t(spark, d, "events"), ["event_type"], "value", ["value", "event_id"])


def telemetry(spark, d):
    kind = F.when(F.col("event_type") == "view", "span_begin").when(F.col("event_type") == "click", "span_end").when(F.col("event_type") == "purchase", "counter").otherwise("gauge")
    return t(spark, d, "events").select(
        (F.col("user_id") % 16).cast("string").alias("run_id"), F.col("event_id").alias("sequence"), (Q.micros(F.col("ts")) * 1000).alias("ts_ns"), kind.alias("kind"),
        F.concat(F.lit("m"), F.get_json_object("props", "$.k").cast("int") % 5).alias("name"), F.lit("decode").alias("stage"), "value", F.lit(None).cast("map<string,string>").alias("args"),
    )


TELEMETRY_SQL = """tel AS (SELECT CAST(user_id % 16 AS VARCHAR) AS run_id, event_id AS sequence, epoch_us(ts) * 1000 AS ts_ns,
 CASE event_type WHEN 'view' THEN 'span_begin' WHEN 'click' THEN 'span_end' WHEN 'purchase' THEN 'counter' ELSE 'gauge' END AS kind,
 'm' || (CAST(json_extract_string(props, '$.k') AS INT) % 5) AS name, 'decode' AS stage, value FROM events)"""


@query(f"""WITH {TELEMETRY_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY run_id, name, stage, kind ORDER BY sequence) AS k FROM tel)
SELECT b.run_id, b.name, b.stage, b.k, b.ts_ns AS began, e.ts_ns AS ended, e.ts_ns - b.ts_ns AS duration_ns FROM r b JOIN r e ON b.run_id = e.run_id AND b.name = e.name AND b.stage = e.stage AND b.k = e.k AND b.kind = 'span_begin' AND e.kind = 'span_end'""")
def span_pairing(spark, d):
    return A.spans(telemetry(spark, d)).withColumn("k", F.col("k").cast("long"))


@query(f"""WITH {TELEMETRY_SQL} SELECT name, stage, 'counter' AS kind, round(sum(value), 4) AS value FROM tel WHERE kind = 'counter' GROUP BY 1, 2
UNION ALL SELECT name, stage, 'gauge', arg_max(value, sequence) FROM tel WHERE kind = 'gauge' GROUP BY 1, 2""")
def counter_gauge(spark, d):
    e = telemetry(spark, d)
    c = A.counters(e).select("name", "stage", F.lit("counter").alias("kind"), F.round("total", 4).alias("value"))
    return c.unionByName(A.gauges(e).select("name", "stage", F.lit("gauge").alias("kind"), "value"))


@query(f"""WITH {TELEMETRY_SQL} SELECT name, stage AS cat, CASE kind WHEN 'span_begin' THEN 'B' WHEN 'span_end' THEN 'E' ELSE 'C' END AS ph, count(*) AS n, max(ts_ns / 1000) AS last_ts FROM tel GROUP BY 1, 2, 3""")
def chrome_trace(spark, d):
    return A.chrome_trace(telemetry(spark, d)).groupBy("name", "cat", "ph").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"))


# ---- requests
@query("SELECT event_id, user_id, count(event_id) OVER w AS n_jobs, first_value(event_id) OVER w AS first_job, last_value(event_id) OVER w AS last_job FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 5 FOLLOWING)")
def prefetch_window(spark, d):
    return Q.prefetch_window(t(spark, d, "events").select("event_id", "user_id", "ts"), "user_id", ["ts", "event_id"], "event_id").drop("ts")


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1")
def latest_wins(spark, d):
    return Q.latest_wins(t(spark, d, "events"), "user_id", ["ts", "event_id"], ["event_id", "event_type"])


@query("SELECT event_id, size, running_total FROM (SELECT event_id, event_id % 97 + 1 AS size, CAST(sum(event_id % 97 + 1) OVER (ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_total FROM events) WHERE running_total > 100000")
def oldest_first_prune(spark, d):
    rows = t(spark, d, "events").select("event_id", "ts", (F.col("event_id") % 97 + 1).alias("size"))
    return Q.evicted(rows, ["ts", "event_id"], "size", 100_000).select("event_id", "size", "running_total")


@query("""SELECT c.event_id, c.user_id, arg_max(s.event_id, (s.ts, s.event_id)) AS signup_id FROM events c LEFT JOIN events s ON s.event_type = 'signup' AND s.user_id = c.user_id AND (s.ts, s.event_id) <= (c.ts, c.event_id)
WHERE c.event_type = 'click' GROUP BY 1, 2""")
def asof_chunk_map(spark, d):
    e = t(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    out = Q.as_of(e.where("event_type = 'click'"), e.where("event_type = 'signup'").withColumn("sid", F.col("event_id")), "user_id", ["ts", "event_id"], "sid")
    return out.select("event_id", "user_id", F.col("matched").alias("signup_id"))


@query("SELECT event_id, user_id, generation FROM (SELECT event_id, user_id, g AS generation, max(g) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS top FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS g FROM events)) WHERE generation = top")
def stale_drop(spark, d):
    rows = t(spark, d, "events").select("event_id", "user_id", "ts", F.get_json_object("props", "$.k").cast("long").alias("generation"))
    return Q.drop_stale(rows, "user_id", "generation", ["ts", "event_id"]).drop("ts")


@query("SELECT event_id, user_id FROM (SELECT event_id, user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM events) WHERE nx IS NULL OR epoch_us(nx) - epoch_us(ts) >= 3600000000")
def debounced_writes(spark, d):
    return Q.debounce(t(spark, d, "events").select("event_id", "user_id", "ts"), "user_id", "ts", ["ts", "event_id"], 3_600_000).drop("ts")


@query()
def lru_replay(spark, d):
    rows = t(spark, d, "events").select("event_id", "user_id", "ts", F.get_json_object("props", "$.k").alias("item"), (F.col("event_id") % 50 + 1).alias("size"))
    return Q.lru_replay(rows, "user_id", ["ts", "event_id"], "item", "size", 256)


@query("SELECT event_type, count(*) AS lookups, CAST(sum((value < 20)::int) AS BIGINT) AS hits, round(avg((value < 20)::int), 6) AS hit_rate FROM events GROUP BY 1")
def hit_rate(spark, d):
    hit = (F.col("value") < 20).cast("int")
    return rounded(t(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("lookups"), F.sum(hit).alias("hits"), F.avg(hit).alias("hit_rate")), "hit_rate")


# ---- artifacts and catalogs
@query("SELECT conv_id, turn, CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS segment_start FROM conversations")
def prefix_sum_offsets(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return t(spark, d, "conversations").select("conv_id", "turn", F.coalesce(F.sum(F.length("text")).over(w), F.lit(0)).cast("long").alias("segment_start"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_shipdate AS a, l_shipdate + to_days(CAST(l_quantity AS INT)) AS b FROM lineitem)
SELECT l_orderkey, l_linenumber FROM (SELECT *, max(b) OVER (PARTITION BY l_orderkey ORDER BY a, b, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM s) WHERE e > a""")
def segment_overlap(spark, d):
    rows = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").alias("a"), F.expr("l_shipdate + make_dt_interval(cast(l_quantity as int))").alias("b"))
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("a", "b", "l_linenumber").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("e", F.max("b").over(w)).where("e > a").select("l_orderkey", "l_linenumber")


@query("""WITH m AS (SELECT l_orderkey, max(l_quantity) AS q FROM lineitem GROUP BY 1)
SELECT l_orderkey, min(l_linenumber) AS l_linenumber, count(*) AS n_best, count(*) > 1 AS ambiguous FROM lineitem JOIN m USING (l_orderkey) WHERE l_quantity = q GROUP BY 1""")
def argmax_with_tie(spark, d):
    return K.best_candidate(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_orderkey", ["l_quantity"], "l_linenumber")


@query("SELECT source, arg_min(doc_id, (lower(substr(text, 1, 20)), doc_id)) AS cover FROM documents GROUP BY 1")
def cover_first_per_group(spark, d):
    key = F.struct(F.lower(F.substring("text", 1, 20)), F.col("doc_id"))
    return t(spark, d, "documents").groupBy("source").agg(F.min_by("doc_id", key).alias("cover"))


@query("SELECT source, arg_min(doc_id, (translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), doc_id)) AS cover FROM documents GROUP BY 1")
def cover_whole_name_per_group(spark, d):
    """Of each source the document of the least text, compared whole; cover_first_per_group is bound to 20 characters by its SQL."""
    return C.cover(t(spark, d, "documents"), F.col("source"), F.col("text"), "doc_id")


def com_or_net(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url").where(F.col("url").rlike(r"^https?://[^/]+\.(com|net)/"))


@query("SELECT page_id, url FROM pages WHERE regexp_matches(url, '^https?://[^/]+\\.(com|net)/') ORDER BY lower(url), page_id LIMIT 100")
def scan_filter_sort_limit(spark, d):
    return C.first_by_name(com_or_net(t(spark, d, "pages")), F.col("url"), "page_id", 100)


@query(f"SELECT page_id, url FROM pages WHERE regexp_matches(url, '^https?://[^/]+\\.(com|net)/') ORDER BY lower(url), page_id LIMIT {C.MAX_ITEMS}")
def scan_filter_sort_max_items(spark, d):
    """With the catalog's own limit; scan_filter_sort_limit is bound to 100 by its SQL."""
    return C.first_by_name(com_or_net(t(spark, d, "pages")), F.col("url"), "page_id")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def cache_probe_anti(spark, d):
    return t(spark, d, "documents").select("doc_id", "source").join(t(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def cache_probe_semi(spark, d):
    return t(spark, d, "documents").select("doc_id", "source").join(t(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")


@query("""SELECT doc_id, sha256(length(text) || '|' || substr(text, 1, 64) || '|' || substr(text, CAST(greatest(floor((length(text) - 64) / 2), 0) AS BIGINT) + 1, 64) || '|' || substr(text, greatest(length(text) - 64, 0) + 1, 64)) AS fingerprint FROM documents""")
def sampled_fingerprint(spark, d):
    return t(spark, d, "documents").select("doc_id", K.sampled_fingerprint(F.col("text"), 64).alias("fingerprint"))


@query("SELECT doc_id, CASE WHEN n_chars <= 1000 THEN [CAST(0 AS BIGINT)] ELSE list_sort(list_distinct([0, CAST(floor((n_chars - 1000) / 2) AS BIGINT), n_chars - 1000])) END AS offsets FROM documents")
def sample_offsets(spark, d):
    return t(spark, d, "documents").select("doc_id", K.sample_offsets(F.col("n_chars"), 1000).alias("offsets"))


@query(f"""SELECT doc_id, sha256(length(text) || '|' || substr(text, 1, {K.SAMPLE}) || '|' || substr(text, CAST(greatest(floor((length(text) - {K.SAMPLE}) / 2), 0) AS BIGINT) + 1, {K.SAMPLE}) || '|' || substr(text, greatest(length(text) - {K.SAMPLE}, 0) + 1, {K.SAMPLE})) AS fingerprint FROM documents""")
def sampled_fingerprint_64k(spark, d):
    """With the operator's own sample, so that texts up to that size are hashed whole; sampled_fingerprint is bound to 64 characters by its SQL."""
    return t(spark, d, "documents").select("doc_id", K.sampled_fingerprint(F.col("text")).alias("fingerprint"))


@query(f"SELECT doc_id, CASE WHEN n_chars <= {K.SAMPLE} THEN [CAST(0 AS BIGINT)] ELSE list_sort(list_distinct([0, CAST(floor((n_chars - {K.SAMPLE}) / 2) AS BIGINT), n_chars - {K.SAMPLE}])) END AS offsets FROM documents")
def sample_offsets_64k(spark, d):
    return t(spark, d, "documents").select("doc_id", K.sample_offsets(F.col("n_chars")).alias("offsets"))


@query("SELECT doc_id, source || '/' || doc_id || '.txt' AS path, doc_id || '.txt' AS name, CAST(strlen(text) AS BIGINT) AS size_bytes, sha256(text) AS sha256 FROM documents")
def file_manifest(spark, d):
    """The manifest of the texts, each taken as a file of its source."""
    at = F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return t(spark, d, "documents").select("doc_id", *(c.alias(n) for n, c in L.manifest_columns(at, F.col("text").cast("binary")).items()))


@query("SELECT source, count(*) AS entries, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY 1")
def store_usage(spark, d):
    return t(spark, d, "documents").groupBy("source").agg(F.count("*").alias("entries"), F.sum(F.octet_length("text")).cast("long").alias("bytes"))


@query()
def recipe_identity(spark, d):
    """The canonical recipe of each part and its id, a derived key of the recipe bytes."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            ids = [B3.derive_key("emulsion recipe id v1", x).hex() for x in b.column("recipe").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("p_partkey"), pa.array([x.hex() for x in b.column("recipe").to_pylist()]), pa.array(ids)], ["p_partkey", "recipe_hex", "recipe_id"])

    n = F.col("p_size")
    rows = t(spark, d, "part").select("p_partkey", K.recipe_bytes(n, n + 1, F.lit(1), F.lit(2), F.lit(0), F.unhex(F.sha2(F.col("p_name"), 256))).alias("recipe"))
    return rows.mapInArrow(run, "p_partkey long, recipe_hex string, recipe_id string")


@query("SELECT p_partkey, substr(h, 1, 2) || '/' || h || '.rrc' AS path FROM (SELECT p_partkey, sha256(p_name) AS h FROM part)")
def object_path(spark, d):
    return t(spark, d, "part").select("p_partkey", K.object_path(F.sha2(F.col("p_name"), 256)).alias("path"))


# ---- scalar raster math
@query("SELECT l_orderkey, l_linenumber, ([0, 10, 40, 90, 160, 250, 360, 490, 640, 810, 1000, 1210, 1440, 1690, 1960, 2250, 2560, 2890, 3240, 3610, 4000])[least(CAST(l_quantity AS INT), 20) + 1] AS linear FROM lineitem")
def lut_clamp(spark, d):
    table = F.array(*(F.lit(10 * i * i) for i in range(21)))
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.linearize(F.col("l_quantity"), table).alias("linear"))


@query("""SELECT l_orderkey, l_linenumber, round(least(greatest((x * (2.51 * x + 0.03)) / (x * (2.43 * x + 0.59) + 0.14), 0.0), 1.0), 6) AS mapped
FROM (SELECT l_orderkey, l_linenumber, greatest(l_extendedprice / 50000.0, 0.0)::DOUBLE AS x FROM lineitem)""")
def tone_map(spark, d):
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(X.aces(F.col("l_extendedprice") / 50000.0), 6).alias("mapped"))


EMB3 = "CAST(embedding[1] AS DOUBLE) AS r, CAST(embedding[2] AS DOUBLE) AS g, CAST(embedding[3] AS DOUBLE) AS b"


def emb3(spark, d):
    e = lambda i: F.get("embedding", i).cast("double")
    return t(spark, d, "embeddings").select("vec_id", e(0).alias("r"), e(1).alias("g"), e(2).alias("b"))


@query(f"""SELECT vec_id, round(0.4124564 * r + 0.3575761 * g + 0.1804375 * b, 6) AS x, round(0.2126729 * r + 0.7151522 * g + 0.0721750 * b, 6) AS y, round(0.0193339 * r + 0.1191920 * g + 0.9503041 * b, 6) AS z FROM (SELECT vec_id, {EMB3} FROM embeddings)""")
def matrix3x3(spark, d):
    out = X.apply_3x3(X.literal_3x3(X.SRGB_TO_XYZ), [F.col("r"), F.col("g"), F.col("b")])
    return emb3(spark, d).select("vec_id", *(F.round(c, 6).alias(n) for c, n in zip(out, "xyz", strict=True)))


@query(f"""WITH v AS (SELECT vec_id, {EMB3} FROM embeddings), l AS (SELECT *, greatest(0.2126 * r + 0.7152 * g + 0.0722 * b, 0.0) AS y, least(r, g, b) AS lo FROM v),
 k AS (SELECT *, CASE WHEN lo < 0 THEN CASE WHEN y > lo THEN y / (y - lo) ELSE 0.0 END ELSE 1.0 END AS t FROM l),
 m AS (SELECT vec_id, y + (r - y) * t AS r, y + (g - y) * t AS g, y + (b - y) * t AS b FROM k), p AS (SELECT *, greatest(r, g, b) AS top FROM m),
 a AS (SELECT *, least(greatest((top * (2.51 * top + 0.03)) / (top * (2.43 * top + 0.59) + 0.14), 0.0), 1.0) AS f FROM p)
SELECT vec_id, CASE WHEN top > 0 THEN round(greatest(r, 0.0) * f / top, 6) ELSE 0.0 END AS r, CASE WHEN top > 0 THEN round(greatest(g, 0.0) * f / top, 6) ELSE 0.0 END AS g, CASE WHEN top > 0 THEN round(greatest(b, 0.0) * f / top, 6) ELSE 0.0 END AS b FROM a""")
def tone_map_rgb(spark, d):
    rgb = X.tone_map_rgb(F.col("r"), F.col("g"), F.col("b"))
    return emb3(spark, d).select("vec_id", *(F.round(c, 6).alias(n) for c, n in zip(rgb, "rgb", strict=True)))


@query(f"SELECT vec_id, CASE WHEN r > 0 AND g > 0 AND b > 0 THEN round(g / r, 5) END AS gr, CASE WHEN r > 0 AND g > 0 AND b > 0 THEN 1.0::DOUBLE END AS gg, CASE WHEN r > 0 AND g > 0 AND b > 0 THEN round(g / b, 5) END AS gb FROM (SELECT vec_id, {EMB3} FROM embeddings)")
def white_balance_gains(spark, d):
    gains = X.green_gains(F.col("r"), F.col("g"), F.col("b"))
    return emb3(spark, d).select("vec_id", *(F.round(c, 5).alias(n) for c, n in zip(gains, ("gr", "gg", "gb"), strict=True)))


@query(f"SELECT vec_id, round(r * pow(2.0, g), 6) AS exposed FROM (SELECT vec_id, {EMB3} FROM embeddings)")
def exposure(spark, d):
    return emb3(spark, d).select("vec_id", F.round(X.expose(F.col("r"), F.col("g")), 6).alias("exposed"))


@query("""SELECT l_orderkey, l_linenumber, x + w <= 40 AND y + h <= 20 AS fits, w = 0 OR h = 0 AS empty FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS x, CAST(l_linenumber AS BIGINT) AS y, CAST(round(l_tax * 100) AS BIGINT) AS w, CAST(round(l_discount * 100) AS BIGINT) AS h FROM lineitem)""")
def rect_fits(spark, d):
    x, y = F.col("l_quantity").cast("long"), F.col("l_linenumber").cast("long")
    w, h = F.round(F.col("l_tax") * 100).cast("long"), F.round(F.col("l_discount") * 100).cast("long")
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.fits_within(x, y, w, h, F.lit(40), F.lit(20)).alias("fits"), X.is_empty(w, h).alias("empty"))


ORIENT_SQL = """o AS (SELECT vec_id, (['normal', 'mirror_horizontal', 'rotate180', 'mirror_vertical', 'transpose', 'rotate90', 'transverse', 'rotate270'])[vec_id % 8 + 1] AS o, (vec_id % 17) / 16.0 AS u, (vec_id % 13) / 12.0 AS v FROM embeddings)"""


@query(f"""WITH {ORIENT_SQL} SELECT vec_id, o AS orientation, o IN ('transpose', 'rotate90', 'transverse', 'rotate270') AS swaps,
 round(CASE WHEN o IN ('mirror_horizontal', 'rotate180') THEN 1 - u WHEN o IN ('transpose', 'rotate90') THEN v WHEN o IN ('transverse', 'rotate270') THEN 1 - v ELSE u END, 6)::DOUBLE AS sx,
 round(CASE WHEN o IN ('rotate180', 'mirror_vertical') THEN 1 - v WHEN o IN ('transpose', 'rotate270') THEN u WHEN o IN ('transverse', 'rotate90') THEN 1 - u ELSE v END, 6)::DOUBLE AS sy FROM o""")
def orientation_map(spark, d):
    o = X.orientation_name(F.col("vec_id") % 8 + 1)
    rows = t(spark, d, "embeddings").select("vec_id", o.alias("orientation"), ((F.col("vec_id") % 17) / 16.0).alias("u"), ((F.col("vec_id") % 13) / 12.0).alias("v"))
    sx, sy = X.to_sensor(F.col("orientation"), F.col("u"), F.col("v"))
    return rows.select("vec_id", "orientation", X.swaps(F.col("orientation")).alias("swaps"), F.round(sx, 6).alias("sx"), F.round(sy, 6).alias("sy"))


@query("SELECT p_partkey, txt, round(CASE u WHEN 'ms' THEN 1.0 WHEN 's' THEN 1000.0 WHEN 'us' THEN 0.001 ELSE 0.000001 END * p_size, 9)::DOUBLE AS ms FROM (SELECT p_partkey, p_size, u, p_size || u AS txt FROM (SELECT p_partkey, p_size, (['ns', 'us', 'ms', 's'])[p_partkey % 4 + 1] AS u FROM part))")
def parse_duration(spark, d):
    unit = F.get(F.array(*map(F.lit, ("ns", "us", "ms", "s"))), (F.col("p_partkey") % 4).cast("int"))
    rows = t(spark, d, "part").select("p_partkey", F.concat(F.col("p_size").cast("string"), unit).alias("txt"))
    return rows.withColumn("ms", F.round(X.duration_ms(F.col("txt")), 9))


# ---- pixel tables: embeddings as a raster, y = vec_id, x = array position
PX = "px AS (SELECT CAST(vec_id AS INT) AS y, CAST(i - 1 AS INT) AS x, CAST(embedding[i] AS DOUBLE) AS v FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)), dim AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM px)"


def raster(spark, d):
    px = R.pixels(t(spark, d, "embeddings"), "vec_id", "embedding").withColumn("v", F.col("v").cast("double"))
    dims = px.agg(F.max("y") + 1, F.max("x") + 1).first()
    return px, int(dims[0]), int(dims[1])


NEAR = "n AS (SELECT c.y, c.x, " + ", ".join(f"(SELECT p.v FROM px p WHERE p.y = least(greatest(c.y + {k // 3 - 1}, 0), h - 1) AND p.x = least(greatest(c.x + {k % 3 - 1}, 0), w - 1)) AS p{k}" for k in range(9)) + " FROM px c, dim)"


@query(f"WITH {PX}, {NEAR} SELECT y, x, round((p1 + p3 + p5 + p7) / 4, 6) AS axial FROM n")
def axial_neighbourhood(spark, d):
    px, h, w = raster(spark, d)
    near = R.neighbourhood(px, [], F.lit(w), F.lit(h))
    return near.select("y", "x", F.round((F.col("p1") + F.col("p3") + F.col("p5") + F.col("p7")) / 4, 6).alias("axial"))


@query(f"""WITH {PX}, {NEAR}, q AS (SELECT *, (y % 2) * 2 + x % 2 AS ph FROM n)
SELECT y, x, round(CASE ph WHEN 0 THEN p4 WHEN 1 THEN (p3 + p5) / 2 WHEN 2 THEN (p1 + p7) / 2 ELSE (p0 + p2 + p6 + p8) / 4 END, 6) AS r,
 round(CASE WHEN ph IN (1, 2) THEN p4 ELSE (p1 + p3 + p5 + p7) / 4 END, 6) AS g,
 round(CASE ph WHEN 3 THEN p4 WHEN 2 THEN (p3 + p5) / 2 WHEN 1 THEN (p1 + p7) / 2 ELSE (p0 + p2 + p6 + p8) / 4 END, 6) AS b FROM q""")
def full_demosaic(spark, d):
    px, h, w = raster(spark, d)
    return rounded(R.bilinear(R.neighbourhood(px, [], F.lit(w), F.lit(h))), "r", "g", "b")


@query(f"WITH {PX} SELECT CAST(floor(y / 64) AS INT) AS tile_y, CAST(floor(x / 16) AS INT) AS tile_x, count(*) AS n, round(min(v), 6) AS lo, round(max(v), 6) AS hi FROM px GROUP BY 1, 2")
def tile_grid(spark, d):
    px, _, _ = raster(spark, d)
    tiled = px.withColumn("tile_y", F.floor(F.col("y") / 64).cast("int")).withColumn("tile_x", F.floor(F.col("x") / 16).cast("int"))
    return rounded(tiled.groupBy("tile_y", "tile_x").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")), "lo", "hi")


@query(f"""WITH {PX}, g AS (SELECT ty.t AS tile_y, tx.t AS tile_x, ly.k AS ly, lx.k AS lx FROM dim, unnest(range(0, CAST(ceil(h / 32.0) AS BIGINT))) ty(t), unnest(range(0, CAST(ceil(w / 32.0) AS BIGINT))) tx(t), unnest(range(-1, 33)) ly(k), unnest(range(-1, 33)) lx(k))
SELECT CAST(tile_y AS INT) AS tile_y, CAST(tile_x AS INT) AS tile_x, CAST(ly AS INT) AS ly, CAST(lx AS INT) AS lx, round(p.v, 6) AS v FROM g, dim, px p WHERE p.y = least(greatest(tile_y * 32 + ly, 0), h - 1) AND p.x = least(greatest(tile_x * 32 + lx, 0), w - 1)""")
def halo_tiles(spark, d):
    px, h, w = raster(spark, d)
    return rounded(R.tiles_with_halo(px, 32, 1, F.lit(w), F.lit(h)), "v")


@query(f"""WITH {PX}, o AS (SELECT h, w, CAST(ceil(h * 100.0 / greatest(h, w)) AS BIGINT) AS oh, CAST(ceil(w * 100.0 / greatest(h, w)) AS BIGINT) AS ow FROM dim),
 g AS (SELECT a.k AS oy, b.k AS ox, CAST(floor(a.k * h / oh) AS BIGINT) AS y, CAST(floor(b.k * w / ow) AS BIGINT) AS x FROM o, unnest(range(0, oh)) a(k), unnest(range(0, ow)) b(k))
SELECT CAST(oy AS INT) AS oy, CAST(ox AS INT) AS ox, CAST(floor(least(greatest(p.v / 2.0, 0), 1) * 255 + 0.5) AS INT) AS gray FROM g JOIN px p USING (y, x)""")
def thumbnail_nearest(spark, d):
    px, h, w = raster(spark, d)
    return R.thumbnail(px, w, h, 100, 2.0)


@query(f"WITH {PX} SELECT y, x, round(greatest(v * 1000 - b, 0) / greatest(w - b, 1), 6) AS level FROM (SELECT y, x, v, ([10.0, 20.0, 30.0, 40.0])[(y % 2) * 2 + x % 2 + 1]::DOUBLE AS b, 900.0::DOUBLE AS w FROM px)")
def normalise_levels(spark, d):
    px, _, _ = raster(spark, d)
    black = F.get(F.array(*map(F.lit, (10.0, 20.0, 30.0, 40.0))), X.phase(F.col("x"), F.col("y")).cast("int"))
    return px.select("y", "x", F.round(X.normalized(F.col("v") * 1000, black, F.lit(900.0)), 6).alias("level"))
