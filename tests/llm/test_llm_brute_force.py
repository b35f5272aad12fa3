"""The learned and sequential training-data operators against plain versions, and every operator and stage on odd tables."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline as P
from emulsion.llm import _stats, _text as X
from emulsion.llm import chat_format as chat, decontaminate, language_id as lang, minhash_dedup, quality_classifier as trees, quality_rules as rules, sentencepiece_codec, suffix_dedup, token_output

ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "word"), (4, "word"), (None, "no id at all"), (7, "été ñandú 日本 😀"), (8, "a long text of one kind " * 4000), (9, "x" * 70_000)]
CLASH = ["_key", "_first", "_spans", "token_ids", "n_tokens", "decoded", "gone_doc_id", "leaked_text_key", "label", "h", "spans", "seed", "at", "score", "kept", "a.b", "rep"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "s", None if t is None else len(t), *(f"{c}{i}" for c in CLASH)) for i, t in ODD]
    fields = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)
    return spark.createDataFrame(rows, fields)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder with empty labels and benchmark."""
    at = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


# ---- language
def plain_ranks(text, top):
    letters = "".join(c if c.isalpha() else " " for c in text)
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in letters)
    padded = " " + " ".join(low.split()) + " "
    grams = Counter(padded[i : i + n] for n in (1, 2, 3) for i in range(len(padded) - n + 1))
    del grams[" "]
    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - k) for k, c in enumerate(g))
    return sorted(grams, key=lambda g: (-grams[g], code(g)))[:top]


def test_language_equals_a_plain_out_of_place_distance(spark):
    learn = {"en": "the cat and the dog went to the house of the man", "de": "der hund und die katze gingen in das haus des mannes", "fr": "le chat et le chien sont dans la maison de l homme"}
    rng = random.Random(2)
    words = " ".join(learn.values()).split()
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 30))) + rng.choice(["", "!", " 12", "\n É"]) for _ in range(150)]
    top = 40
    profiles = {k: lang.ranked(lang.codes(v), top)[0] for k, v in learn.items()}
    plain = {k: plain_ranks(v, top) for k, v in learn.items()}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in lang.predict(df, profiles, top).collect()}
    for i, t in enumerate(texts):
        own = plain_ranks(t, top)
        cost = {k: sum(abs(p.index(g) - j) if g in p else top for j, g in enumerate(own)) for k, p in plain.items()}
        best = min(sorted(cost), key=cost.get)
        assert got[i][0] == best and math.isclose(got[i][1], 1 - cost[best] / (top * len(own)))


def test_language_sample_is_one_row_of_the_smallest_hashes(spark):
    from emulsion.llm import _spark as S

    rows = [(i, f"text {chr(97 + i % 26)} {i % 7}", "en") for i in range(300)] + [(5, "another text of five", "en")] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    ids = df.where(S.crc_fold("doc_id", 4) != 2).selectExpr("doc_id", "xxhash64(doc_id) h", "text", "xxhash64(text) t").collect()
    chosen = sorted({(r.h, r.doc_id) for r in ids})[:20]
    one = [min((r.t, r.text) for r in ids if r.doc_id == d)[1] for _, d in chosen]
    counts = Counter()
    for t in one:
        g, n = lang.ranked(lang.codes(t), 1 << 62)
        counts.update(dict(zip(g.tolist(), n.tolist())))
    want = sorted(counts, key=lambda g: (-counts[g], g))[:30]
    assert lang.fit(df, rows=20, top=30)["en"].tolist() == want


# ---- trees
def plain_tree(rows, g, h, edges, depth):
    """(feature, threshold) and leaf values by trying every split of every node; nodes as in a heap."""
    inner = 2**depth - 1
    nodes, members = [(0, np.inf)] * inner, {0: np.arange(len(rows))}
    for j in range(inner):
        m = members.get(j, np.zeros(0, int))
        best = (1e-6, None)
        total = g[m].sum() ** 2 / (h[m].sum() + trees.L2)
        for f, cut in enumerate(edges):
            for b in cut:
                right = rows[m, f] > b
                if min(right.sum(), (~right).sum()) < trees.MIN_ROWS:
                    continue
                gain = sum(g[m[s]].sum() ** 2 / (h[m[s]].sum() + trees.L2) for s in (right, ~right)) - total
                if gain > best[0] + 1e-12:
                    best = (gain, (f, b))
        right = rows[m, best[1][0]] > best[1][1] if best[1] else np.zeros(len(m), bool)
        nodes[j] = best[1] or nodes[j]
        members[2 * j + 1], members[2 * j + 2] = m[~right], m[right]
    leaf = [-trees.RATE * g[members[inner + k]].sum() / (h[members[inner + k]].sum() + trees.L2) for k in range(inner + 1)]
    return nodes, np.array(leaf), members


def test_trees_equal_a_plain_search(monkeypatch):
    monkeypatch.setattr(trees, "TREES", 4)
    monkeypatch.setattr(trees, "DEPTH", 3)
    monkeypatch.setattr(trees, "BINS", 8)
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(120, 5)).astype(np.float32)
    y = (rows[:, 1] + 0.5 * rows[:, 3] * rows[:, 0] + 0.3 * rng.normal(size=120) > 0).astype(float)
    model = trees.grow(rows, y)
    edges = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, 9)[1:-1]).astype(np.float32)) for f in range(5)]
    z = np.full(len(y), model.base)
    for t in range(4):
        p = 1 / (1 + np.exp(-z))
        nodes, leaf, members = plain_tree(rows, p - y, p * (1 - p), edges, 3)
        assert [(int(f), float(b)) for f, b in zip(model.feature[t], model.threshold[t])] == [(f, float(b)) for f, b in nodes]
        assert np.allclose(model.leaf[t], leaf)
        for k in range(8):
            z[members[7 + k]] += leaf[k]
    for i, row in enumerate(rows):  # one row at a time
        out = model.base
        for t in range(4):
            node = 0
            while node < 7:
                node = 2 * node + (2 if row[model.feature[t, node]] > model.threshold[t, node] else 1)
            out += model.leaf[t, node - 7]
        assert math.isclose(model.score(rows[i : i + 1])[0], 1 / (1 + math.exp(-out)), rel_tol=1e-9) and math.isclose(out, z[i], rel_tol=1e-9)


# ---- quality rules
def test_regression_equals_a_plain_descent():
    """The sparse fit against the same steps on a dense matrix, and the calibration against a finer search."""
    rng = np.random.default_rng(8)
    dense = np.zeros((60, 12))
    for i in range(60):
        dense[i, rng.choice(12, 4, replace=False)] = rng.random(4) * 3
    y = (dense[:, 2] > dense[:, 5]).astype(int)
    row, idx = np.nonzero(dense)
    model = rules.fit_rows(y, np.bincount(row, minlength=60), idx.astype(np.int32), dense[row, idx])
    train = np.arange(60) % 4 != 3
    share = np.where(y > 0, 0.5 / y[train].sum(), 0.5 / (1 - y[train]).sum()) * train
    w, b = np.zeros(12), 0.0
    state = [np.zeros(13), np.zeros(13)]
    for t in range(1, rules.EPOCHS + 1):
        e = share * (1 / (1 + np.exp(-(dense @ w + b))) - y)
        grad = np.append(dense.T @ e + 1e-6 * w, e.sum())
        state = [0.9 * state[0] + 0.1 * grad, 0.99 * state[1] + 0.01 * grad**2]
        step = 0.05 * np.sqrt(1 - 0.99**t) / (1 - 0.9**t) * state[0] / (np.sqrt(state[1]) + 1e-8)
        w, b = w - step[:12], b - step[12]
    assert np.allclose(model.weights[:12], w) and math.isclose(model.bias, b, rel_tol=1e-9)
    z, held = dense @ w + b, ~train
    pos, neg = y[held].sum(), (1 - y[held]).sum()
    target = np.where(y[held] > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))

    def loss(a, c):
        p = 1 / (1 + np.exp(-(a * z[held] + c)))
        return -(target * np.log(p) + (1 - target) * np.log(1 - p)).sum() + 5e-4 * ((a - 1) ** 2 + c**2)

    here = loss(model.slope, model.offset)
    assert all(here <= loss(model.slope + da, model.offset + dc) + 1e-9 for da in (-0.01, 0, 0.01) for dc in (-0.01, 0, 0.01))


def test_features_and_logits_equal_a_plain_count():
    rng = np.random.default_rng(4)
    model = rules.Model(rng.normal(size=rules.DIM), 0.25, 1.0, 0.0)
    texts = ["one two one two three", "é é", "", "abc", "a\nb  a b"]
    (_, n, buf, off), = X.slices(pa.array(texts))
    words = X.Words(buf, off)
    got = rules.logits(model, buf, off, words)
    number = lambda h: int(h) & (rules.DIM - 1)
    for d, t in enumerate(texts):
        h = X.Words(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())])).hash
        pairs = [X.mix(X.mix(np.array([int(a) * X._P + int(b) & (1 << 64) - 1], np.uint64)) ^ X.U(0xB16))[0] for a, b in zip(h, h[1:])]
        raw, fours = t.encode(), []
        for i in range(len(raw) - 3):
            g = int.from_bytes(raw[i : i + 4], "little") * 0x9E3779B1 & 0xFFFFFFFF
            fours.append(g ^ g >> 15)
        want = 0.25 + sum(rules.SCALE * sum(model.weights[number(x)] for x in kind) / max(1, len(kind)) for kind in (h, pairs, fours))
        assert math.isclose(got[d], want, rel_tol=1e-9)


def test_verdicts_on_held_out_rows(spark):
    """Fitted on half of the labels (about 200 rows), the verdict agrees with the other half."""
    import os

    at = os.environ.get("EMULSION_DATA", "/root/testdata/sf0.01")
    docs, labels = (spark.read.parquet(f"{at}/{t}.parquet") for t in ("documents", "labels"))
    model = rules.fit(docs, labels.where("doc_id % 2 = 0"))
    got = rules.score(docs.select("doc_id", "text"), model)
    told = {r.doc_id: r for r in got.collect()}
    other = [(told[r.doc_id], r.quality) for r in labels.where("doc_id % 2 = 1").collect() if r.doc_id in told]
    assert sum(r.kept == (q > 0 and not r.base_failed) for r, q in other) / len(other) > 0.9


# ---- chat
def path_score(c, path):
    out = chat.START[path[0]] + c.e[0][path[0]]
    for k in range(1, len(path)):
        out += c.t[k][path[k - 1], path[k]] + c.e[k][path[k]]
    return out


def some_turns(rng, n):
    text = lambda: rng.choice(["", "User: ", "Bot: ", "### System: "]) + "w " * rng.choice([1, 3, 60, 200]) + rng.choice(["", "?"])
    return [(t, rng.choice(["user", "assistant", "tool", None, None]), "\n".join(text() for _ in range(rng.choice([1, 1, 2])))) for t in range(n)]


def test_chat_path_is_the_best_of_all():
    rng = random.Random(3)
    lengths = np.log(np.array([[0.4, 0.3, 0.2, 0.1]] * 4) + np.arange(4)[:, None] * 0.01)
    for _ in range(60):
        c = chat.Chunk(some_turns(rng, rng.randrange(1, 5)), lengths)
        if len(c.e) > 6:
            continue
        best = max(path_score(c, p) for p in itertools.product(range(4), repeat=len(c.e)))
        assert math.isclose(path_score(c, c.decode(None, None)), best, rel_tol=1e-12)


@pytest.mark.parametrize("size", [8 << 20, 900])
def test_chat_chunks_keep_the_best_score(spark, monkeypatch, size):
    """Over several range partitions too, the path of each conversation has the best score of all paths (of equal ones any may be taken)."""
    monkeypatch.setattr(chat, "CHUNK_BYTES", size)
    rng = random.Random(8)
    by = {c: some_turns(rng, 25) for c in range(6)}
    df = spark.createDataFrame([(c, *r) for c, rows in by.items() for r in rows], "conv_id long, turn long, role string, text string")
    lengths = chat.length_rates(df)
    got = {}
    for r in sorted(chat.parse(df).collect(), key=lambda r: (r.conv_id, r.turn, r.part)):
        got.setdefault(r.conv_id, []).extend([chat.ROLES.index(r.role)] * (r.text.count("\n") + 1))
    for c, rows in by.items():
        whole = chat.Chunk(rows, lengths)
        assert len(got[c]) == len(whole.e)
        assert math.isclose(path_score(whole, got[c]), path_score(whole, whole.decode(None, None)), rel_tol=1e-12)


def test_chat_repeated_rows_are_spread(spark, monkeypatch):
    monkeypatch.setattr(chat, "CHUNK_BYTES", 2000)
    df = spark.createDataFrame([(1, None, "user", "the same row")] * 300, "conv_id long, turn long, role string, text string")
    out = chat.parse(df).collect()
    assert len(out) == 300 and {r.text for r in out} == {"the same row"}


# ---- odd tables
def test_token_files_of_odd_tables(spark, tmp_path):
    path = token_output.public_tokenizer("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    for name, rows in (("none", []), ("odd", ODD), ("same", [(3, f"text {i % 5}") for i in range(200)])):
        at = f"file://{tmp_path}/{name}"
        token_output.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), at, path, shard_tokens=100)
        got = sorted(token_output.read_documents(spark, at).collect(), key=lambda r: r.start)
        want = Counter((i, len(tok.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in rows)
        assert Counter((r.doc_id, r.n_tokens) for r in got) == want
        assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
        assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got]).tolist()][: len(got)]


def test_repair_ends_when_no_pair_repeats():
    """A grammar that stopped after some rounds, or left rare pairs, would fail here."""
    rng = np.random.default_rng(6)
    for ids in (rng.integers(0, 30, 5000), np.tile(rng.integers(0, 900, 700), 2), np.zeros(1000, int), np.repeat(np.arange(40), 3)):
        symbols, made = token_output.repair(ids.astype(np.uint32), 1000)
        assert (token_output.expand(symbols, made, 1000) == ids).all()
        seen, i = {}, 0
        pairs = list(zip(symbols[:-1].tolist(), symbols[1:].tolist()))
        for i, p in enumerate(pairs):
            assert i - seen.setdefault(p, i) < 2, "a pair stands in two places apart"
    symbols, made = token_output.repair(rng.integers(0, 50, 4000).astype(np.uint32), 50, limit=7)
    assert len(made) == 7


def test_operators_on_odd_and_empty_tables(odd, tables, spark):
    labels, bench = (spark.read.parquet(f"{tables}/{t}.parquet") for t in ("labels", "benchmark"))
    none = odd.limit(0)
    for df, n in ((odd, len(ODD)), (none, 0)):
        assert minhash_dedup.classify(df).count() == n
        assert lang.predict(df.select("doc_id", "text"), lang.fit(df)).count() == n
        assert trees.score(df.select("doc_id", "text"), trees.fit(df, labels)).count() == n
        assert rules.score(df.select("doc_id", "text"), rules.fit(df, labels)).count() == n
        assert suffix_dedup.digest(df.select("doc_id", "text")).count() == n
        assert decontaminate.find(df, bench).count() == n
        assert sentencepiece_codec.encode_ids(df, token_output.public_tokenizer("piece_bpe_32k.model")).count() == n
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string, extra string")
    assert chat.parse(turns).count() == 0


@pytest.mark.parametrize("stage", [name for name, _ in P.STAGES])
def test_stages_on_odd_and_empty_tables(odd, tables, spark, stage):
    """Nulls, empty and long texts, repeated rows, columns of clashing names, empty tables: each stage keeps what it should."""
    run = dict(P.STAGES)[stage]
    assert run(spark, odd.limit(0), tables).count() == 0
    out = run(spark, odd, tables)
    assert out.columns[: len(odd.columns)] == odd.columns
    got, all_rows = [tuple(r)[: len(odd.columns)] for r in out.collect()], [tuple(r) for r in odd.collect()]
    if stage == "quality_rules":  # only one text has twenty words and it repeats itself
        assert got == []
    elif stage == "minhash_dedup":  # rows that share an id stay together
        assert Counter(got) == Counter(all_rows)
    elif stage == "suffix_dedup":
        assert Counter(r[:1] + r[5:] for r in got) == Counter(r[:1] + r[5:] for r in all_rows) and {r[0]: r[1] for r in got} == dict(ODD)
    else:
        assert Counter(got) == Counter(all_rows)
    if stage == "sentencepiece":
        assert out.columns[len(odd.columns) :] == ["token_ids_", "n_tokens_", "decoded_"]


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def test_stage_decontamination_equals_a_plain_search(spark):
    import os

    at = os.environ.get("EMULSION_SMALL", "/root/testdata/sf0.001")
    docs = spark.read.parquet(f"{at}/documents.parquet")
    items = [w for w in (words(r.text) for r in spark.read.parquet(f"{at}/benchmark.parquet").collect()) if len(w) >= 8]

    def holds(a, b):
        span = min(len(b), 13)
        need = 11 if len(b) >= 13 else len(b)
        return any(sum(x == y for x, y in zip(a[i : i + span], b[j : j + span])) >= need for i in range(len(a) - span + 1) for j in range(len(b) - span + 1) if len(set(a[i : i + span]) & set(b[j : j + span])) >= 4)

    few = docs.where("n_chars < 700")
    kept = {r.doc_id for r in P.benchmark(spark, few, at).collect()}
    assert kept == {r.doc_id for r in few.collect() if not any(holds(words(r.text), b) for b in items)}


def test_stage_quality_equals_its_scores(spark):
    """What the stage keeps is what the base counts, taken plainly, and the regression's own score let through."""
    import os

    at = os.environ.get("EMULSION_SMALL", "/root/testdata/sf0.001")
    docs = spark.read.parquet(f"{at}/documents.parquet")
    model = rules.fit(docs, spark.read.parquet(f"{at}/labels.parquet"))
    score = {r.doc_id: r.score for r in rules.score(docs.select("doc_id", "text"), model).collect()}
    want = set()
    for r in docs.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        hit = {i + j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(8)}
        if len(w) >= 20 and 100 * len(hit) <= 30 * len(w) and score[r.doc_id] >= 0.5:
            want.add(r.doc_id)
    assert {r.doc_id for r in P.quality(spark, docs, at).collect()} == want
    assert _stats.WINDOW == 8


def test_regression_needs_little_beside_its_sample(monkeypatch):
    """The driver holds the sample; whatever a step needs beside it is as large as a block, and blocks don't change a bit."""
    import tracemalloc

    rng = np.random.default_rng(3)
    sizes = rng.integers(0, 2000, 600)
    idx, val = rng.integers(0, rules.DIM, sizes.sum()).astype(np.int32), rng.random(sizes.sum()).astype(np.float32)
    y = rng.integers(0, 2, 600).astype(np.int32)
    monkeypatch.setattr(rules, "EPOCHS", 3)
    monkeypatch.setattr(rules, "BLOCK_ENTRIES", 1 << 14, raising=False)
    tracemalloc.start()
    small = rules.fit_rows(y, sizes, idx, val)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < idx.nbytes + val.nbytes
    monkeypatch.setattr(rules, "BLOCK_ENTRIES", 1 << 40)
    whole = rules.fit_rows(y, sizes, idx, val)
    assert (small.weights == whole.weights).all() and (small.bias, small.slope, small.offset) == (whole.bias, whole.slope, whole.offset)
