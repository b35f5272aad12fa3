"""Operators that the bound queries do not cover."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

import emulsion.plans as plans
from emulsion.functions import blake3 as B3
from emulsion.functions import frame as X
from emulsion.operators import analytics as A
from emulsion.operators import artifacts as K
from emulsion.operators import raster as R
from emulsion.operators import requests as Q
from emulsion.sources import benchlog
from emulsion.sources import catalog as C


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_blake3_known_values():
    # published test vectors: the input is bytes 0, 1, ..., 250, 0, 1, ...
    data = lambda n: bytes(i % 251 for i in range(n))
    assert B3.blake3(b"").hex() == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert B3.blake3(data(1)).hex() == "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213"
    assert B3.blake3(data(1024)).hex() == "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7"
    assert B3.blake3(data(2049))[:4].hex() == "5f4d72f4"


def test_matrix_inverse_and_adaptation(spark):
    m = X.literal_3x3(X.SRGB_TO_XYZ)
    back = X.multiply_3x3(X.invert_3x3(m), m)
    got = one(spark, *(back[r][c].alias(f"m{r}{c}") for r in range(3) for c in range(3)))
    assert [round(v, 9) for v in got] == [1, 0, 0, 0, 1, 0, 0, 0, 1]
    flat = X.invert_3x3(X.literal_3x3([[1, 2, 3], [2, 4, 6], [0, 1, 0]]))
    assert one(spark, flat[0][0].alias("x"))[0] is None
    white = [F.lit(v) for v in (0.9504, 1.0, 1.0888)]
    same = X.apply_3x3(X.bradford(white, white), white)
    assert [round(v, 6) for v in one(spark, *(c.alias(n) for c, n in zip(same, "abc")))] == [0.9504, 1.0, 1.0888]


def test_levels_and_rectangles(spark):
    black = X.bayer_black(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)), F.lit(3), F.lit(1))
    assert one(spark, black.alias("b")).b == [1.0, 2.0, 0.0, 0.0]
    white = X.bayer_white(F.array(F.lit(10.0), F.lit(20.0), F.lit(30.0)), F.array(F.lit(0), F.lit(1), F.lit(1), F.lit(2)))
    assert one(spark, white.alias("w")).w == [10.0, 20.0, 20.0, 30.0]
    rect = lambda *v: F.struct(*(F.lit(x).cast("long").alias(n) for n, x in zip(("x", "y", "width", "height"), v)))
    crop = X.effective_crop(rect(5, 5, 100, 100), rect(0, 0, 0, 3), F.lit(50), F.lit(40))
    assert tuple(one(spark, crop.alias("c")).c) == (0, 0, 50, 40)
    assert one(spark, X.fits_within(F.lit(4294967295), F.lit(0), F.lit(2), F.lit(1), F.lit(10), F.lit(10)).alias("f")).f is False


def test_text_forms(spark):
    rows = spark.createDataFrame([("1.5ms",), ("2s",), ("7us",), ("9ns",), ("x",), (None,)], "t string")
    assert [r[0] for r in rows.select(F.round(X.duration_ms(F.col("t")), 9)).collect()] == [1.5, 2000.0, 0.007, 9e-06, None, None]
    nums = spark.createDataFrame([("0",), ("01",), ("-1",), ("18446744073709551615",)], "t string")
    assert [r[0] is None for r in nums.select(X.canonical_decimal(F.col("t"))).collect()] == [False, True, True, False]


def test_sniff_and_catalog(spark):
    heads = {b"FUJIFILMCCD-RAW 0201": "raf", b"IIRS\x08": "orf", b"IIU\0\x18": "rw2", b"\0\0\0\x18ftypcrx isom": "cr3", b"II*\0\x10\0\0\0CR\x02\0": "cr2", b"MM\0*": "tiff", b"": "unknown", b"MMSR": "unknown"}
    df = spark.createDataFrame([(bytearray(k), v) for k, v in heads.items()], "h binary, want string")
    assert all(r.got == r.want for r in df.withColumn("got", C.sniff(F.col("h"))).collect())
    files = spark.createDataFrame([("/a/B.DNG",), ("/a/a.cr3",), ("/a/x.nef",), ("/b/z.tif",), ("/b/.dng",), ("/b/noext",)], "path string")
    assert [r.path for r in C.scan_folder(files, "path").collect()] == ["/a/a.cr3", "/a/B.DNG", "/b/z.tif"]
    assert {r.folder: r.cover for r in C.first_per_folder(files.where(C.is_supported(F.col("path"))), "path").collect()} == {"/a": "/a/a.cr3", "/b": "/b/z.tif"}
    assert [r[0] for r in files.select(C.backend(F.col("path"))).collect()] == ["dng", "cr3", "nef", "dng", None, None]


def test_benchlog(spark, tmp_path):
    p = tmp_path / "s.jsonl"
    p.write_text(json.dumps({"sample": {"fixture": "f", "mode": "cold", "status": 0, "metrics": {"latency_ms": 5.0}}}) + "\n" + '{"sample": {"fixt')
    rows = benchlog.read(spark, str(p)).collect()
    assert rows[0].fixture == "f" and rows[0].latency_ms == 5.0
    c = tmp_path / "s.csv"
    c.write_text("fixture,mode,real_seconds,status\na,cold,0.5,0\na,cold,NaN,0\na,cold,1.0,1\na,cold,,ok\n")
    assert [(r.fixture, r.ms) for r in A.samples(benchlog.read(spark, str(c))).collect()] == [("a", 500.0)]


def test_outliers_with_zero_mad_and_few_samples(spark):
    rows = spark.createDataFrame([("a", v) for v in (1.0, 1.0, 1.0, 1.0, 9.0)] + [("b", v) for v in (1.0, 2.0, 99.0)], "k string, v double")
    got = A.with_mad(rows, ["k"], "v").where(A.is_outlier(F.col("v"), F.col("n"), F.col("median"), F.col("mad"))).collect()
    assert [(r.k, r.v) for r in got] == [("a", 9.0)]


def test_bootstrap_is_the_same_at_any_partitioning(spark):
    rows = spark.createDataFrame([(i % 3, i, float(i * i % 17)) for i in range(60)], "k int, i int, v double")
    a = A.bootstrap(rows, ["k"], "v", ["i"], resamples=50).collect()
    b = A.bootstrap(rows.repartition(7), ["k"], "v", ["i"], resamples=50).collect()
    assert sorted(a) == sorted(b) and all(r.ci_lo <= r.ci_hi for r in a)


def drawn_one_by_one(v, name, resamples, seed):
    rng, got = random.Random(seed + len(name)), []
    for _ in range(resamples):
        some = [v[rng.randrange(len(v))] for _ in v]
        got.append(math.fsum(some) / len(some) if name == "mean" else A._quantile(some, {"p50": 0.5, "p95": 0.95, "p99": 0.99}[name]))
    return A._quantile(got, 0.025), A._quantile(got, 0.975)


@pytest.mark.parametrize("v", [[0.1 * i * i for i in range(300)], [1e-300, 3.0, 1e300, -7.1], [0.0, 0.0], [5.5, -5.5, 0.1]])
def test_intervals_equal_those_of_single_draws(v):
    got = A._intervals(v, list(A.STATISTICS), 400, 7)
    assert got == {x: drawn_one_by_one(v, x, 400, 7) for x in A.STATISTICS}
    assert A._intervals([2.5], list(A.STATISTICS), 400, 7) == dict.fromkeys(A.STATISTICS, (2.5, 2.5))


def test_bootstrap_query_has_all_statistics_and_resamples(spark):
    d = "/root/testdata/sf0.001"
    got = {(r.event_type, r.metric): (r.ci_lo, r.ci_hi) for r in plans.QUERIES["bootstrap_ci"](spark, d).collect()}
    kinds = {}
    for r in spark.read.parquet(f"{d}/events.parquet").orderBy("value", "event_id").collect():
        kinds.setdefault(r.event_type, []).append(r.value)
    assert set(got) == {(k, x) for k in kinds for x in ("mean", "p50", "p95", "p99")}
    k = min(kinds, key=lambda k: len(kinds[k]))
    assert got[k, "mean"] == drawn_one_by_one(kinds[k], "mean", 10_000, 0x52524148)
    assert got[k, "p99"] == drawn_one_by_one(kinds[k], "p99", 10_000, 0x52524148)


def test_lru_pins_and_oversize():
    s = Q.WeightedLru(10)
    assert s.insert("a", 4) == (True, []) and s.insert("b", 4) == (True, [])
    s.get("a")
    assert s.insert("c", 4) == (True, ["b"]) and s.insert("x", 11) == (False, [])
    s.pinned = {"a", "c"}
    assert s.insert("d", 8, honour_pins=True) == (False, [])


def test_recipe_bytes(spark):
    c = K.recipe_bytes(F.lit(3), F.lit(1), F.lit(2), F.lit(4), F.lit(0), F.unhex(F.lit("ab" * 32)))
    got = bytes(one(spark, c.alias("b")).b)
    assert len(got) == 64 and got[:8] == b"RMR\0\x01\0\x01\0" and got[8:12] == b"\x03\0\0\0" and got[28:60] == b"\xab" * 32


def test_scan_keeps_all_rows_up_to_the_limit(spark):
    d = "/root/testdata/sf0.01"
    pages = plans.bindings.com_or_net(spark.read.parquet(f"{d}/pages.parquet")).collect()
    got = [r.page_id for r in plans.QUERIES["scan_filter_sort_max_items"](spark, d).collect()]
    assert len(pages) > 100 and got == [r.page_id for r in sorted(pages, key=lambda r: (r.url.lower(), r.page_id))]
    many = spark.range(C.MAX_ITEMS + 5).select(F.concat(F.lit("F"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("name"), "id")
    assert [r.id for r in C.first_by_name(many, F.col("name"), "id").collect()] == list(range(C.MAX_ITEMS))


def test_report_is_whole(spark):
    groups = {"a": [float(i % 7) for i in range(40)] + [500.0, -300.0], "b": [1.0, 2.0, 99.0], "c": [1.0] * 5 + [9.0], "d": [4.5]}
    rows = spark.createDataFrame([(k, i, v) for k, vs in groups.items() for i, v in enumerate(vs)], "k string, i int, v double")
    got = {r.k: r for r in A.report(rows, ["k"], "v", ["i"], resamples=200).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        mid = A._quantile(vs, 0.5)
        mad = A._quantile([abs(v - mid) for v in vs], 0.5)
        kept = [v for v in vs if len(vs) < 4 or (v == mid if mad == 0 else abs(0.67448975 * (v - mid) / mad) <= 3.5)]
        r = got[k]
        assert (r.n, r.n_used, r.outlier_count, r.mad_v) == (len(vs), len(kept), len(vs) - len(kept), mad)
        want = (None, None) if kept == vs else (A._quantile(kept, 0.5), A._quantile(kept, 0.95))
        assert (r.filtered_p50, r.filtered_p95) == pytest.approx(want)
        for x in A.STATISTICS:
            assert (r[f"{x}_ci_lo"], r[f"{x}_ci_hi"]) == (drawn_one_by_one(sorted(vs), x, 200, A.BASE_SEED) if len(vs) > 1 else (vs[0], vs[0]))
    assert (got["a"].outlier_count, got["c"].outlier_count, got["b"].outlier_count) == (2, 1, 0)


def test_cover_compares_whole_names(spark, tmp_path):
    head = "One opening line of twenty and more characters, "
    rows = [("s", 1, head + "b"), ("s", 2, head.upper() + "A"), ("s", 3, head + "c"), ("t", 5, head), ("t", 4, head), ("u", 6, "x" * 30), ("u", 7, "x" * 20)]
    spark.createDataFrame(rows, "source string, doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.source: r.cover for r in plans.QUERIES["cover_whole_name_per_group"](spark, str(tmp_path)).collect()} == {"s": 2, "t": 4, "u": 7}


def test_fingerprint_of_the_operators_own_sample(spark):
    """Texts up to 65,536 characters count whole: those of sf0.01 get one fingerprint only if they are equal."""
    d = "/root/testdata/sf0.01"
    assert K.SAMPLE == 65536
    rows = spark.createDataFrame([(1, "a" * 300 + "b" + "a" * 698), (2, "a" * 301 + "b" + "a" * 697), (3, "a" * 300 + "b" + "a" * 698)], "i int, text string")
    got = {r.i: r.f for r in rows.select("i", K.sampled_fingerprint(F.col("text")).alias("f")).collect()}
    assert got[1] == got[3] != got[2]
    docs = spark.read.parquet(f"{d}/documents.parquet").join(plans.QUERIES["sampled_fingerprint_64k"](spark, d), "doc_id")
    assert docs.select("text").distinct().count() == docs.select("fingerprint").distinct().count()
    assert all(r.offsets == [0] for r in plans.QUERIES["sample_offsets_64k"](spark, d).collect())


def test_running_total_equals_a_window(spark):
    rows = spark.createDataFrame([(i * 7 % 101, i, i % 5) for i in range(300)], "o int, i int, v int")
    got = {r.i: r.running_total for r in Q.running_total(rows, ["o", "i"], "v", buckets=7).collect()}
    total = 0
    for o, i, v in sorted((i * 7 % 101, i, i % 5) for i in range(300)):
        total += v
        assert got[i] == total


def test_empty_tables(spark):
    e = spark.createDataFrame([], "k string, i int, v double, ts timestamp")
    assert A.summary(e, ["k"], "v").count() == A.trimmed_mean(e, ["k"], "v", ["i"]).count() == 0
    assert Q.latest_wins(e, "k", ["ts"], ["i"]).count() == Q.running_total(e, ["i"], "v").count() == 0
    assert R.plan_tiling(100, 50, 32, 1) == {"tiles_x": 4, "tiles_y": 2, "layers": 8, "extent": 34, "bytes": 8 * 34 * 34 * 2}


def test_streams(spark, tmp_path):
    from emulsion.streaming import latest as L

    src = tmp_path / "in"
    spark.createDataFrame([("u", 1, "2024-01-01 00:00:00"), ("u", 2, "2024-01-01 00:00:01")], "k string, i int, t string").select("k", "i", F.to_timestamp("t").alias("ts")).write.parquet(str(src))
    stream = spark.readStream.schema("k string, i int, ts timestamp").parquet(str(src))
    q = L.latest_by_key(stream, "k", "ts", ["i"]).writeStream.format("memory").queryName("latest_q").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.k, r.latest.i) for r in spark.table("latest_q").collect()] == [("u", 2)]


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_queries_without_sql_run(spark, name):
    assert plans.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
