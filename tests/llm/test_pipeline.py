"""The pipeline stage by stage against plain versions of what each stage decides."""

import os
import re

import corpus_pipeline as P
from emulsion.llm import _spark

SMALL = os.environ.get("EMULSION_SMALL", "/root/testdata/sf0.001")


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, kept = docs.columns, {r.doc_id: r for r in docs.collect()}
    scratch = _spark.Scratch(spark, "test")
    for name, stage in P.STAGES:
        docs = scratch.put(name, stage(spark, docs, SMALL))
        rows = {r.doc_id: r for r in docs.collect()}
        assert set(rows) <= set(kept)
        if name != "sentencepiece":
            assert docs.columns == columns
        if name in ("suffix_dedup", "sentencepiece"):
            assert set(rows) == set(kept)
        else:
            assert all(rows[i] == kept[i] for i in rows)
        if name == "minhash_dedup":
            sets = {i: _shingles(r.text) for i, r in kept.items()}
            for i in set(kept) - set(rows):
                assert any(_near(sets[i], sets[j]) for j in kept if j != i)
            for i in rows:
                assert not any(_near(sets[i], sets[j]) for j in rows if j < i)
        if name == "suffix_dedup":
            assert _no_repeats(rows)
        kept = rows
    assert all(r.decoded == r.text and r.n_tokens == len(r.token_ids) for r in kept.values())
    assert 0 < len(kept) < 200


def _shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def _near(a, b):
    n = len(a & b)
    return 100 * n >= 80 * (len(a) + len(b) - n)


def _no_repeats(rows):
    """After cutting, hardly any long passage is left in two documents (a cut may join what stood apart)."""
    seen, again = {}, 0
    for i in sorted(rows):
        t = rows[i].text
        own = {t[k : k + 60] for k in range(len(t) - 59)}
        again += any(seen.get(s, i) != i for s in own)
        for s in own:
            seen.setdefault(s, i)
    return again <= 2
