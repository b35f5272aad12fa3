"""The training-data operators against brute force, round trips and held-out accuracy, on small tables and odd rows."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from emulsion.llm import _stats, _text as X
from emulsion.llm import chat_format, decontaminate, language_id, minhash_dedup, quality_classifier, quality_rules, sentencepiece_codec, sharding, suffix_dedup, token_output

DATA = os.environ.get("EMULSION_DATA", "/root/testdata/sf0.01")
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "word"), (5, "word"), (6, "Word"), (7, "été ñandú 日本 😀 x"), (8, "a b c d e f g h i j k l m n o p q r s t u v w x y z"),
    (9, "A B C d e f g h i j k l m n o p q r s t u v w x y z"), (10, "same line\nsame line\n\nsame line"), (11, "  two  spaces \n and odd   ones"), (None, "no id at all here"),
    (12, "long " * 5000), (13, "x" * 3000), (13, "x" * 3000), (14, "<|endoftext|> special ▁mark▁ text"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "q", 1, "s") for i, t in ODD], "doc_id long, text string, kept string, score int, source string")


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]


def words(text):
    return SPACE.findall(text or "")


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


# ---- kernels
def test_words_and_windows():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab \n\tc") for _ in range(rng.randrange(40))) for _ in range(300)]
    import pyarrow as pa

    for i, n, buf, off in X.slices(pa.array([*texts, None]), 500):
        w = X.Words(buf, off)
        for d in range(n):
            t = [*texts, ""][i + d]
            got = [bytes(buf[a:b]).decode() for a, b in zip(w.start[w.first[d] : w.first[d + 1]], w.end[w.first[d] : w.first[d + 1]])]
            assert got == words(t)
        seen = {}
        for k, h in enumerate(w.hash):
            assert seen.setdefault(bytes(buf[w.start[k] : w.end[k]]), h) == h
        assert len(set(seen.values())) == len(seen)


def test_long_span_hash(monkeypatch):
    buf = np.frombuffer(b"abc" * 1000, np.uint8)
    monkeypatch.setattr(X, "BLOCK_BYTES", 64)
    a = X.span_hashes(buf, np.array([0]), np.array([3000]))
    b = X.span_hashes(buf.copy(), np.array([0]), np.array([2999]))
    assert a != b


# ---- near-dedup
def exact_components(rows, k):
    sets = {}
    for i, t in rows:
        w = words(lower(t))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = {}
    for i, s in sets.items():
        for e in s:
            by.setdefault(e, []).append(i)
    shared = Counter()
    for ids in by.values():
        if len(ids) <= 60:
            shared.update((a, b) for a in ids for b in ids if a < b)
    for a, b in shared:
        n = len(sets[a] & sets[b])
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_minhash_matches_brute_force(spark, docs):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.op1_minhash_dedup(spark, DATA).collect()}
    want = exact_components(docs, 2)
    assert got == {i: (n, c, i == c) for i, (n, c) in want.items()}


def test_minhash_crowded_bucket(spark):
    """Copies around the threshold, so that stars leave components apart and the blocks have to close them."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.randrange(0, 7)):
            w[rng.randrange(60)] = f"n{rng.randrange(400)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash_dedup.classify(df, k=2).collect()}
    sets = {i: {tuple(w) for w in zip(t.split(), t.split()[1:])} for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            n = len(sets[a] & sets[b])
            if a < b and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert got == {i: find(i) for i in sets}


def all_pairs_components(sets):
    """Components by every pair of sets: no pair is left out for how common its items are."""
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    near = set()
    by_size = sorted(sets, key=lambda i: len(sets[i]))
    for j, a in enumerate(by_size):
        for b in by_size[j + 1 :]:
            if 100 * len(sets[a]) < 80 * len(sets[b]):
                break
            n = len(sets[a] & sets[b])
            if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                near.add((min(a, b), max(a, b)))
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}, near


def test_minhash_equals_all_pairs(spark, docs):
    """Unlike exact_components, which skips items of more than 60 documents."""
    sets = {}
    for i, t in docs:
        w = words(lower(t))
        sets[i] = frozenset(zip(w, w[1:])) if len(w) >= 2 else frozenset([tuple(w)] if w else [])
    some = {i: s for i, s in sets.items() if s}
    want = {i: i for i in sets} | all_pairs_components(some)[0]
    got = {r.doc_id: r.component_id for r in minhash_dedup.op1_minhash_dedup(spark, DATA).collect()}
    assert got == want


@pytest.mark.parametrize("block", [7, 16, 1000])
def test_closing_over_several_blocks(spark, block):
    rng = random.Random(9)
    sets = {}
    for i in range(90):
        kind = i % 3
        sets[i] = {1000 * kind + j for j in range(40)} - set(rng.sample(range(1000 * kind, 1000 * kind + 40), rng.randrange(5))) | set(rng.sample(range(5000, 9000), rng.randrange(5)))
    components, near = all_pairs_components(sets)
    rows = spark.createDataFrame([(0, i, len(s), i) for i, s in sets.items()], "lead long, rep long, n long, c long")
    items = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "doc_id long, items array<long>")
    links = {(min(r[0], r[1]), max(r[0], r[1])) for r in minhash_dedup.closing(rows, items, 80, block).collect()}
    assert links == near and 3 <= len(set(components.values())) < 90


def test_sketch_estimates_and_fills():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    for n in (1, 2, 17, 400):
        assert minhash_dedup.sketch(x[:n], 300).max() != ~np.uint64(0)
    a, b = minhash_dedup.sketch(x[:300], 300), minhash_dedup.sketch(x[100:], 300)
    assert abs((a == b).mean() - 0.5) < 0.12


def test_minhash_odd_rows(odd):
    got = {(r.doc_id, r.component_id, r.kept) for r in minhash_dedup.classify(odd, k=2).collect()}
    assert (4, 4, True) in got and (5, 4, False) in got and (6, 4, False) in got and (1, 1, True) in got and (9, 8, False) in got
    kept = minhash_dedup.dedup(odd)
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 3
    assert minhash_dedup.classify(odd.limit(0)).count() == 0


# ---- language, quality
def test_language_accuracy(spark):
    got = language_id.op2_language_id(spark, DATA)
    lang = spark.read.parquet(f"{DATA}/documents.parquet").selectExpr("doc_id as d", "lang")
    rows = got.join(lang, got.doc_id == lang.d).where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)


def test_language_odd_rows(spark, odd):
    profiles = {"a": language_id.ranked(language_id.codes("the cat and the dog"), 50)[0], "b": language_id.ranked(language_id.codes("der hund und die katze"), 50)[0]}
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(odd, profiles).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[7][0] in "ab"
    assert {r.lang_pred for r in language_id.predict(odd, {}).collect()} == {"und"}
    assert language_id.fit(odd.limit(0).withColumnRenamed("source", "lang")) == {}


def test_classifier_accuracy(spark):
    got = quality_classifier.op3_quality_classifier(spark, DATA)
    lab = spark.read.parquet(f"{DATA}/labels.parquet").selectExpr("doc_id as d", "quality")
    rows = got.join(lab, got.doc_id == lab.d).where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_classifier_odd_rows(spark, odd):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality_classifier.score(odd, quality_classifier.fit(odd, empty)).collect()
    assert len(got) == len(ODD) and {r.score for r in got} == {0.5}


def brute_base(text):
    text = text or ""
    w = words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {i + j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


LINE_FEEDS = ["abc\nabc\n", "abc\nabc", "abc\nabc\n\n", "abc\n", "\n", "\n\n", "", "x\nabc\nx\n", "abc\n abc\n", "abc\nabc\nabc\n", "x", "x\r\nx\r\n"]


@pytest.mark.parametrize("texts", [LINE_FEEDS, LINE_FEEDS[::-1], ["abc\nabc\n"]])
def test_duplicate_lines_before_a_last_line_feed(texts):
    import pyarrow as pa

    (_, _, buf, off), = X.slices(pa.array(texts))
    _, dups = _stats.dup_lines(buf, off)
    assert dups.tolist() == [brute_base(t)[3] for t in texts]


def test_quality_base_counts(spark, odd, docs):
    some = spark.createDataFrame(docs[:400], "doc_id long, text string")
    for df, rows in ((odd, ODD), (some, docs[:400])):
        got = Counter(tuple(r)[:6] for r in quality_rules.score(df, None).collect())
        assert got == Counter((i, *brute_base(t)) for i, t in rows)
    for r in quality_rules.score(some, None).collect():
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)


def test_quality_rules_reject_and_keep(spark):
    got = quality_rules.op8_quality_rules(spark, DATA)
    lab = spark.read.parquet(f"{DATA}/labels.parquet").selectExpr("doc_id as d", "quality", "toxic")
    rows = got.join(lab, got.doc_id == lab.d).collect()
    low = [r for r in rows if r.quality == 0]
    good = [r for r in rows if r.quality == 1 and not r.base_failed]
    assert sum(r.kept for r in low) / len(low) < 0.05 and sum(r.kept for r in good) / len(good) > 0.97


# ---- codecs
def test_sentencepiece_equals_the_library(docs):
    import sentencepiece

    path = token_output.public_tokenizer("piece_bpe_32k.model")
    lib, own = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_codec.codec(path)
    rng = random.Random(4)
    texts = [t or "" for _, t in docs[:60]] + [t or "" for _, t in ODD]
    texts += ["".join(rng.choice("      abcdeinorst▁\n\t.é日本ñß😀#*01") for _ in range(rng.randrange(70))) for _ in range(800)]
    for t in texts:
        ids = own.encode(t)
        assert ids == lib.encode(t)
        assert own.decode(ids) == lib.decode(ids)
    for t in texts[:10] + texts[-200:]:
        assert list(own.stream(own.model.normalise(t))) == lib.encode(t)


def test_unigram_path_is_the_best():
    def field(n, kind, v):
        return bytes([n << 3 | kind]) + v

    def piece(p, score, kind=1):
        b = p.encode()
        body = field(1, 2, bytes([len(b)]) + b) + field(2, 5, np.float32(score).tobytes()) + field(3, 0, bytes([kind]))
        return field(1, 2, bytes([len(body)]) + body)

    rng = random.Random(9)
    vocab = {"a": -3.0, "b": -3.1, "c": -3.2, "▁": -2.0}
    while len(vocab) < 30:
        vocab["".join(rng.choice("abc") for _ in range(rng.randrange(2, 5)))] = -rng.random() * 8
    data = piece("<unk>", 0, 2) + b"".join(piece(p, s) for p, s in vocab.items()) + field(2, 2, bytes([2]) + field(3, 0, b"\1")) + field(3, 2, bytes([2]) + field(3, 0, b"\0"))
    c = sentencepiece_codec.Codec(data)
    for _ in range(300):
        t = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 60)))
        best = [0.0] + [-1e9] * len(t)
        for i in range(len(t)):
            for n in range(1, 5):
                if t[i : i + n] in vocab and i + n <= len(t):
                    best[i + n] = max(best[i + n], best[i] + vocab[t[i : i + n]])
        ids = list(c.stream(t))
        assert "".join(c.model.pieces[i] for i in ids) == t
        assert abs(sum(vocab[c.model.pieces[i]] for i in ids) - best[-1]) < 1e-3


def test_sentencepiece_rows(odd):
    out = sentencepiece_codec.roundtrip(odd, token_output.public_tokenizer("piece_bpe_32k.model")).collect()
    assert len(out) == len(ODD) and all(r.decoded == (r.text or "").replace("▁", " ") and r.n_tokens == len(r.token_ids) for r in out)


def test_token_files(spark, docs):
    from tokenizers import Tokenizer

    path = token_output.public_tokenizer("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    rows = docs[:300] + [(10_000 + (i or 0), t) for i, t in ODD if i != 13]
    import tempfile

    at = "file://" + tempfile.mkdtemp() + "/t"
    token_output.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), at, path, shard_tokens=20_000)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_output.read_documents(spark, at).collect()}
    start = 0
    for i, t in sorted(rows):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert got[i] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_repair_random_access():
    rng = np.random.default_rng(3)
    ids = np.concatenate([rng.integers(0, 50, 20_000), np.tile(rng.integers(0, 500, 40), 300), np.zeros(3000, int)]).astype(np.uint32)
    shard = token_output.pack(ids, 500)
    assert len(shard["rules"]) and len(shard["symbols"]) < 1.4 * len(ids)
    assert (token_output.unpack(shard) == ids).all()
    for _ in range(200):
        a, b = sorted(rng.integers(0, len(ids) + 1, 2).tolist())
        assert (token_output.read_range(shard, a, b) == ids[a:b]).all()
    for few in ([], [7], [7] * 63):
        assert token_output.unpack(token_output.pack(np.array(few, np.uint32), 500)).tolist() == few


def test_repair_goes_on_with_rare_copies():
    """60 copies of a long text in a shard get rules, and symbols of more than 32 ids where copies pay."""
    rng = np.random.default_rng(1)
    text = rng.integers(0, 30_000, 3000)
    ids = np.concatenate([x for _ in range(60) for x in (text, rng.integers(0, 30_000, 300))]).astype(np.uint32)
    symbols, rules = token_output.repair(ids, 30_000)
    assert (token_output.expand(symbols, rules, 30_000) == ids).all()
    assert len(symbols) + 2 * len(rules) < 0.25 * len(ids)
    many = np.tile(rng.integers(0, 500, 640), 300).astype(np.uint32)
    symbols, rules = token_output.repair(many, 500)
    assert (token_output.expand(symbols, rules, 500) == many).all() and token_output.rule_sizes(rules, 500).max() > 32


# ---- sharding, decontamination, chat
def rows_of(df):
    return Counter(map(repr, df.collect()))


@pytest.fixture
def sharded(spark):
    from emulsion.llm import _spark

    return sharding.ShardedTable(spark, _spark.Scratch(spark, "t").root)


def test_sharding(odd, sharded):
    table = sharded
    assert table.version() == 0 and table.read(odd.schema).count() == 0 and table.locate(odd.schema).count() == 0
    table.append(odd.limit(0))
    assert table.version() == 1 and table.read(odd.schema).count() == 0
    for _ in range(3):
        table.append(odd.repartition(4))
    before = table.manifest().count()
    v = table.compact(odd.schema, target=1 << 20)
    assert table.manifest().count() < before and table.plan(1 << 20).count() == 0 and table.vacuum(keep=1, seconds=0) > 0
    assert rows_of(table.read(odd.schema)) == Counter({k: 3 * n for k, n in rows_of(odd).items()})
    assert table._commit(table.manifest(), v - 1) is None and table.version() == v
    assert table.compact(odd.schema) == v


def test_sharding_in_several_jobs(odd, sharded):
    for _ in range(4):
        sharded.append(odd.repartition(5))
    sharded.compact(odd.schema, target=1 << 20, most=3)
    assert sharded.plan(1 << 20).count() == 0 and sharded.read(odd.schema).count() == 4 * len(ODD)


def test_sharding_packs_whole_files_up_to_the_target(docs, spark, sharded):
    df = spark.createDataFrame(docs[:400], "doc_id long, text string").repartition(40)
    sharded.append(df)
    target = 6 * max(x.bytes for x in sharded.manifest().collect())
    sharded.compact(df.schema, target=target)
    rows = sharded.manifest().collect()
    assert 1 < len(rows) < 20 and sum(x.rows for x in rows) == 400 and rows_of(sharded.read(df.schema)) == rows_of(df)


def test_sharding_two_writers(odd, spark, sharded, monkeypatch):
    """A version that another writer publishes in between is taken up, by append and by compact; merged shards are not merged twice."""
    other = sharding.ShardedTable(spark, sharded.root)
    commit, between = sharded._commit, []

    def late(shards, base):
        if between:
            between.pop()()
        return commit(shards, base)

    monkeypatch.setattr(sharded, "_commit", late)
    between.append(lambda: other.append(odd))
    sharded.append(odd.repartition(3))
    assert sharded.version() == 2 and sharded.read(odd.schema).count() == 2 * len(ODD)
    between.append(lambda: other.append(odd))
    sharded.compact(odd.schema)
    assert sharded.read(odd.schema).count() == 3 * len(ODD)
    sharded.append(odd.repartition(3))
    between.append(lambda: other.compact(odd.schema))
    sharded.compact(odd.schema)
    assert rows_of(sharded.read(odd.schema)) == Counter({k: 4 * n for k, n in rows_of(odd).items()}) and sharded.plan().count() == 0


def test_sharding_vacuum_keeps_old_versions_and_young_files(odd, sharded):
    for _ in range(3):
        sharded.append(odd.repartition(2))
    old = sharded.version()
    sharded._store(odd, "append")  # a writer that has not committed yet
    sharded.compact(odd.schema)
    assert sharded.vacuum(keep=10) == 0 and sharded.read(odd.schema, old).count() == 3 * len(ODD)
    assert sharded.vacuum(keep=10, seconds=0) > 0  # the uncommitted files
    assert sharded.read(odd.schema, old).count() == 3 * len(ODD) == sharded.read(odd.schema).count()


def test_sharding_keeps_columns_of_any_name(spark, sharded):
    names = ["doc_id", "text", "merge_group", "merge_path", "shard_path", "shard_bytes", "path", "_metadata", "tier"]
    df = spark.createDataFrame([tuple(f"{n}{i}" for n in names) for i in range(20)], names)
    for part in (df.limit(9), df.subtract(df.limit(9)).repartition(3)):
        sharded.append(part)
    sharded.compact(df.schema)
    assert rows_of(sharded.read(df.schema).select(*names)) == rows_of(df)
    got = sharded.locate(df.schema)
    assert got.columns[: len(names)] == names and got.columns[len(names) :] == ["shard_path_", "shard_bytes_"]
    assert rows_of(got.select(*names)) == rows_of(df) and got.where("shard_bytes_ > 0 and shard_path_ like '%/_data/merge%'").count() == 20


def test_masks_survive_any_two_substitutions():
    import itertools

    for gone in itertools.combinations(range(decontaminate.STRETCH), decontaminate.MAX_SUBSTITUTIONS):
        assert any(all(p + o not in gone for o in m) for m in decontaminate.MASKS for p in range(decontaminate.STRETCH - decontaminate.SPAN + 1))


def test_decontamination_cases(spark, odd):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron".split()
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "one two three four five six seven eight nine"), (3, "too short"), (4, None)], "item_id long, text string")
    sub = list(item)
    sub[4], sub[9] = "X", "Y"
    three = list(item)
    three[2], three[7], three[12] = "X", "Y", "Z"
    rows = [(100, "pre " + " ".join(item).upper() + " post"), (101, " ".join(sub)), (102, " ".join(three)), (103, " ".join(item[:10])), (104, "x one two three four five six seven eight nine"), (105, "one two three four FIVE six seven eight ten")]
    df = odd.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: list(r.item_ids) for r in decontaminate.find(df, bench).collect()}
    assert got[100] == [1] and got[101] == [1] and got[102] == [] and got[103] == [] and got[104] == [2] and got[105] == []
    assert decontaminate.find(df, bench).count() == len(ODD) + len(rows)
    assert decontaminate.remove(df, bench).count() == len(ODD) + len(rows) - 3
    assert decontaminate.find(df, bench.limit(0)).where("contaminated").count() == 0


def test_chat(spark, monkeypatch):
    rows = [
        (1, 0, "system", "be kind"), (1, 1, "human", "hi?"), (1, 2, None, "a long answer " * 60), (1, 3, "user", "thanks"), (2, 0, None, "User: what is it?\nAssistant: it is\nthis\nUser: ok"),
        (3, 0, "user", None), (None, 0, "user", "x"), (4, None, "gpt", "y"), (4, None, "gpt", "y"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat_format.parse(df).collect()
    by = {(r.conv_id, r.turn, r.part): (r.role, r.text) for r in out}
    assert [by[1, i, 0][0] for i in range(4)] == ["system", "user", "assistant", "user"]
    assert [by[2, 0, p] for p in range(3)] == [("user", "what is it?"), ("assistant", "it is\nthis"), ("user", "ok")]
    assert len(out) == len(rows) + 2 and by[3, 0, 0] == ("user", "")
    assert chat_format.parse(df.limit(0)).count() == 0


# ---- suffix dedup
def brute_spans(rows):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            s = b[k : k + 50]
            first[s] = min(first.get(s, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        cut = np.zeros(len(b) + 1, int)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                cut[k] += 1
                cut[k + 50] -= 1
        gone = np.cumsum(cut)[:-1] > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("crowd", [suffix_dedup.CROWD, 20, 2])
def test_suffix_dedup_matches_brute_force(spark, docs, crowd):
    """Also with parts of an owner, and with contexts of crowded anchors, as they are on large tables."""
    rng = random.Random(6)
    rows = [(i, t) for i, t in ODD if i is not None] + [(100 + i, t) for i, t in docs[:60]]
    for k in range(60):
        a, b = rng.choice(docs[:80])[1], rng.choice(docs[:80])[1]
        p, q = rng.randrange(len(a)), rng.randrange(len(b))
        rows.append((1000 + k, a[p : p + rng.randrange(300)] + "é" + b[q : q + 55]))
    rows += [(2000 + k, "z" * (45 + k) + "ab" * k) for k in range(40)]
    got = Counter(tuple(r) for r in suffix_dedup.digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), crowd).collect())
    assert got == brute_spans(rows)


def test_suffix_dedup_of_contexts_that_differ_nearby(spark):
    """One passage of 30 bytes in every text, so that its anchors are crowded, with few kinds of text beside it."""
    rng = random.Random(12)
    rows = []
    for i in range(150):
        left, right = (f"{rng.randrange(6):025d}" * rng.randrange(3) for _ in range(2))
        rows.append((i, left + "the same thirty bytes in each!" + right + f"{i:040d}"))
    got = Counter(tuple(r) for r in suffix_dedup.digest(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect())
    assert got == brute_spans(rows)


def test_suffix_dedup_of_long_texts(spark):
    """Texts over a megabyte are hashed in overlapping pieces; the owner of many anchors has several parts."""
    rng = random.Random(13)
    long = "".join(rng.choice("abcdefghij ") for _ in range(1_300_000))
    rows = [(5, long), (6, "x" + long[500_000:1_100_000] + "yé" * 30), (7, long[524_250:524_330]), (8, long[:70] + long[-70:])]
    got = Counter(tuple(r) for r in suffix_dedup.digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect())
    assert got == brute_spans(rows)


def test_run_length_index_streams_what_is_there():
    rng = random.Random(14)
    for n in (60, 1500, 4000):
        words = ["".join(rng.choice("ab\xff") for _ in range(70)) for _ in range(5)]
        raw = "".join(rng.choice(words) for _ in range(n // 70 + 1)).encode("latin-1")[: n - 1] + b"Z"  # no string goes round the end
        text = np.frombuffer(raw, np.uint8)
        owner = np.sort(np.array([rng.randrange(40) for _ in range(n)]))[::-1].copy()
        least = {}
        for k in range(n - 49):
            least[raw[k : k + 50]] = min(least.get(raw[k : k + 50], 99), int(owner[k]))
        index = suffix_dedup.RunLengthIndex(text, owner)
        assert len(index.run) < n
        # the sample of a match is the document of the byte after its first one
        shifted = suffix_dedup.RunLengthIndex(text, np.roll(owner, 1))
        assert shifted.stream(text, 64).tolist()[: n - 49] == [least[raw[k : k + 50]] for k in range(n - 49)]


def test_suffix_strip(spark, odd):
    out = suffix_dedup.strip(odd)
    assert out.columns == odd.columns and out.count() == len(ODD)
    assert suffix_dedup.digest(odd.limit(0)).count() == 0
    passage = "this very passage is much longer than fifty bytes, and it repeats é"
    df = spark.createDataFrame([(1, "start " + passage + " end", 9), (2, passage, 9), (3, "x" + passage + "y", 9)], "doc_id long, text string, n_chars int")
    got = {r.doc_id: (r.text, r.n_chars) for r in suffix_dedup.strip(df).collect()}
    assert got == {1: ("start " + passage + " end", len(passage) + 10), 2: ("", 0), 3: ("xy", 2)}


def test_suffix_strip_makes_no_new_characters(spark):
    """The passage begins in the middle of one character and ends in the middle of another."""
    passage = "a passage of more than fifty bytes that stands in two of the texts"
    df = spark.createDataFrame([(1, "é" + passage + "é"), (3, "ĩ" + passage + "è"), (4, "中" + passage + "ĩx")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in suffix_dedup.strip(df).collect()}
    assert got == {1: "é" + passage + "é", 3: "", 4: "中ĩx"}


def test_suffix_strip_keeps_columns_of_any_name(spark):
    names = ["_key", "_first", "_spans", "_k1", "_k2", "_d", "spans", "tid", "text_key", "anchor", "a.b"]
    passage = "a passage of more than fifty bytes that stands in two of the texts"
    df = spark.createDataFrame([(i, t, *(f"{n}{i}" for n in names)) for i, t in ((1, passage), (2, "x" + passage), (None, passage), (3, None))], ["doc_id", "text", *names])
    out = suffix_dedup.strip(df)
    assert out.columns == df.columns
    assert {r[0]: r[1:] for r in out.collect()} == {r[0]: ("x" if r[0] == 2 else r[1], *r[2:]) for r in df.collect()}


def test_stats_slices_are_independent(docs):
    import pyarrow as pa

    col = pa.array([t for _, t in docs[:50]])
    whole = [_stats.features(buf, off) for _, _, buf, off in X.slices(col)]
    parts = [_stats.features(buf, off) for _, _, buf, off in X.slices(col, 1000)]
    assert np.array_equal(np.concatenate(whole), np.concatenate(parts))
