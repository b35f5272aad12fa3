"""Baselines, verdicts with intervals and file manifests."""

import hashlib
import json

from emulsion.operators import analytics as A
from emulsion.sources import benchlog as L


def test_baseline_of_both_forms(spark, tmp_path):
    groups = [{"fixture": "a", "mode": "m", "workers": 4, "p50": 1.0}, {"fixture": "b", "p50": 2.0}, {"fixture": "a", "mode": "m", "workers": 4, "p50": 3.0}]
    for name, body in (("list", groups), ("object", {"schema": 2, "groups": groups})):
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps(body))
        got = {(r.fixture, r["mode"], r.workers, r.backend): r.p50 for r in L.load_baseline(spark, str(path)).collect()}
        assert got == {("a", "m", "4", ""): 3.0, ("b", "", "", ""): 2.0}
    path = tmp_path / "none.json"
    path.write_text(json.dumps({"groups": []}))
    assert L.load_baseline(spark, str(path)).count() == 0


def test_verdicts(spark):
    old = spark.createDataFrame([("a", 10.0, 9.0, 11.0), ("b", 10.0, 9.9, 10.0), ("c", 10.0, 9.0, 11.0), ("d", 0.0, 0.0, 0.0), (None, 10.0, 0.0, 11.0), ("n", float("nan"), 1.0, 1.0)], "k string, v double, v_ci_lo double, v_ci_hi double")
    new = spark.createDataFrame([("a", 10.2), ("b", 10.3), ("c", 11.0), ("d", 1.0), (None, 9.0), ("n", 1.0), ("x", 1.0)], "k string, v double")
    got = {r.k: (r.status, r.ratio_lo and round(r.ratio_lo, 4), r.ratio_hi and round(r.ratio_hi, 4)) for r in A.verdicts(old, new, ["k"], ["v"]).collect()}
    assert got == {"a": ("inconclusive", 0.9273, 1.1333), "b": ("ok", 1.03, 1.0404), "c": ("regression", 1.0, 1.2222), None: ("improvement", 0.8182, None)}


def test_speedup_takes_the_first_of_two_cold_groups(spark):
    rows = spark.createDataFrame([("f", "cold-b", 4.0), ("f", "cold-a", 8.0), ("f", "warm", 2.0), ("g", "warm", 1.0)], "fixture string, mode string, p50 double")
    got = {(r.fixture, r["mode"]): r.speedup_vs_cold for r in A.speedup_vs_cold(rows, ["fixture"], "mode", ("cold-a", "cold-b"), "p50").collect()}
    assert got == {("f", "cold-a"): 1.0, ("f", "cold-b"): 2.0, ("f", "warm"): 4.0, ("g", "warm"): None}


def test_file_manifest(spark, tmp_path):
    # an empty file has no row: a gap of the reader, stated in its docstring and in the README
    for name, body in (("x.bin", b"\x00\xff" * 700), ("empty", b"")):
        (tmp_path / name).write_bytes(body)
    got = {r.name: (r.size_bytes, r.sha256) for r in L.file_manifest(spark, f"{tmp_path}/*").collect()}
    assert got == {n: (len(b), hashlib.sha256(b).hexdigest()) for n, b in (("x.bin", b"\x00\xff" * 700),)}
