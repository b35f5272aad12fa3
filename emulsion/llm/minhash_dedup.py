"""MinHash near-dedup by fast similarity sketching, banding and exact verification.

Sketch (Dahlgaard, Knudsen, Thorup): in round i < t every element is hashed to one of t bins with a value in [i, i+1); in
round t + b every element goes to bin b, which fills whatever is still empty.  A coordinate is the smallest value that
reached its bin, so later rounds never change a filled bin, every coordinate is filled, and equal coordinates estimate the
Jaccard similarity with concentration bounds.  The t = BANDS * ROWS coordinates are cut into bands.

Links: documents with equal shingle sets are one class (represented by the smallest id).  Representatives that share a
band are candidates; every link is confirmed on full shingle sets.  A bucket first links its members to its smallest id;
buckets whose members are then still in different components are linked to a second, hashed member; what remains is
compared across components in blocks (``closing``), so no candidate of a bucket is dropped while a group of copies costs
one pair for each copy.

Defined cases: null texts and texts without a word have no shingles and link with nothing; a null id is kept by itself;
repeated rows are one class; an empty table gives an empty result; other columns, of any name, are passed through by ``dedup``; a text
of any length is sketched whole, in memory of a few times its size.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _spark as S
from . import _text as X

BANDS, ROWS = 50, 6
PERCENT = 80
#: Documents, and shingles, on either side of a block of comparisons.
BLOCK = 2048
BLOCK_ITEMS = 2_000_000
WORDS = 5
_SEEDS = X.mix(np.arange(1, 2 * 4096 + 1, dtype=np.uint64) * X.U(0xD1342543DE82EF95))


def sketch(items: np.ndarray, t: int) -> np.ndarray:
    """The t coordinates of a non-empty set of 64-bit hashes: round number in the high half, hash value in the low half."""
    out = np.full(t, ~X.U(0))
    step = max(1, 4096 // len(items))
    low = X.U(0xFFFFFFFF)
    i = 0
    while i < t:  # rounds past the filling one change nothing, so they may be taken several at a time
        r = np.arange(i, min(i + step, t))
        h = X.mix((items[None, :] ^ _SEEDS[r][:, None]).ravel())
        value = (h & low) | np.repeat(r.astype(np.uint64) << X.U(32), len(items))
        np.minimum.at(out, (((h >> X.U(32)) * X.U(t)) >> X.U(32)).astype(np.int64), value)
        i += step
        if out.max() != ~X.U(0):
            return out
    empty = np.flatnonzero(out == ~X.U(0))
    for b in empty:
        out[b] = (X.U(t + int(b)) << X.U(32)) | (X.mix(items ^ _SEEDS[t + b]) & low).min()
    return out


def band_keys(coordinates: np.ndarray, bands: int) -> np.ndarray:
    rows = coordinates.reshape(bands, -1)
    h = np.arange(bands, dtype=np.uint64)
    for j in range(rows.shape[1]):
        h = X.mix(h * X.U(0x9E3779B97F4A7C15) + rows[:, j])
    return h


def _sketches(k: int):
    def run(batches):
        for batch in batches:
            for i, n, buf, off in X.slices(batch.column("text")):
                size, key, bands = np.zeros(n, np.int64), [], []
                for d, items in enumerate(X.shingle_sets(X.Words(X.LOWER[buf], off), k)):
                    size[d] = len(items)
                    key.append(hashlib.blake2b(items.tobytes(), digest_size=16).digest() if len(items) else None)
                    bands.append(band_keys(sketch(items, BANDS * ROWS), BANDS) if len(items) else np.zeros(0, np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(i, n), pa.array(size), pa.array(key, pa.binary()),
                        X.list_array(pa.array(np.concatenate(bands).view(np.int64)), [len(b) for b in bands]),
                    ],
                    ["doc_id", "n_shingles", "set_key", "bands"],
                )

    return run


def _sets(k: int):
    def run(batches):
        for batch in batches:
            for i, n, buf, off in X.slices(batch.column("text")):
                got = list(X.shingle_sets(X.Words(X.LOWER[buf], off), k))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, n), X.list_array(pa.array(np.concatenate(got).view(np.int64)), [len(s) for s in got])],
                    ["doc_id", "items"],
                )

    return run


def components(edges: DataFrame, scratch: S.Scratch) -> DataFrame:
    """(node, component) for edges (a, b): large-star and small-star steps until nothing changes; the component is its smallest
    node.  Each step writes its edges, so a lost executor costs one step."""
    e = scratch.put("cc0", edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    step = 0
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        step += 1
        new = scratch.put(f"cc{step}", small.select("x.u", "x.v").where("u <> v").distinct())
        stars = new.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").limit(1).count() == 0
        # a node on both sides means another round; a forest of stars has none
        done = stars and new.select("u").join(new.select(F.col("v").alias("u")), "u", "left_semi").limit(1).count() == 0
        scratch.drop(f"cc{step - 1}")
        e = new
        if done:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))


def closing(rows: DataFrame, sets: DataFrame, percent: int, block: int = BLOCK, items: int = BLOCK_ITEMS) -> DataFrame:
    """Links (a, b) between members of different components of each group (lead, rep, n, c).

    The largest component of a group is its body; the others are queries, compared with all members in blocks of at
    most about ``block`` queries and members, with about ``items`` shingles.  No pair becomes a row: a block returns one link for each query and component."""
    by = rows.groupBy("lead", "c").agg(F.count("*").alias("k"), F.sum("n").alias("m"))
    largest = F.max(F.struct("k", -F.col("c"), "c", "m")).alias("top")
    body = by.groupBy("lead").agg(largest, F.sum("k").alias("all"), F.sum("m").alias("size"), F.count("*").alias("several")).where("several > 1")
    blocks = lambda k, m: F.ceil(F.greatest(k / block, m / items)).cast("int")
    body = body.select(
        "lead", F.col("top.c").alias("body"), blocks(F.col("all"), F.col("size")).alias("down"), blocks(F.col("all") - F.col("top.k"), F.col("size") - F.col("top.m")).alias("across")
    )
    told = rows.join(body, "lead")
    spot = lambda n: F.pmod(F.xxhash64("rep"), n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1))
    members = told.select("lead", "rep", "c", F.lit(False).alias("query"), spot(F.col("down")).alias("d"), every(F.col("across")).alias("x"))
    queries = told.where("c <> body").select("lead", "rep", "c", F.lit(True).alias("query"), spot(F.col("across")).alias("x"), every(F.col("down")).alias("d"))
    held = members.unionByName(queries).join(sets.select(F.col("doc_id").alias("rep"), "items"), "rep").select("lead", "x", "d", "query", "rep", "c", "items")

    def compare(group):
        body = [r for r in group if not r[0]]
        if not body:
            return
        size = np.array([len(r[3]) for r in body])
        owner = np.repeat(np.arange(len(body)), size)
        items = np.concatenate([r[3] for r in body])
        order = np.argsort(items, kind="stable")
        items, owner = items[order], owner[order]
        comp = np.array([r[2] for r in body])
        for _, rep, c, own in (r for r in group if r[0]):
            own = np.sort(own)
            lo, hi = np.searchsorted(items, own, "left"), np.searchsorted(items, own, "right")
            # a partner has all but a fifth of the query's items, so it has one of any fifth and one more: the rarest here
            rare = np.argsort(hi - lo, kind="stable")[: len(own) + percent * len(own) // -100 + 1]
            lo, k = lo[rare], (hi - lo)[rare]
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(k)[:-1]]), k) + np.arange(int(k.sum()))
            near = np.unique(owner[at])
            n = size[near]
            near = near[(comp[near] != c) & (100 * np.minimum(n, len(own)) >= percent * np.maximum(n, len(own)))]
            if not len(near):
                continue
            theirs = np.concatenate([body[j][3] for j in near])
            spot = np.minimum(np.searchsorted(own, theirs), len(own) - 1)
            common = np.add.reduceat((own[spot] == theirs).astype(np.int64), np.concatenate([[0], np.cumsum(size[near])[:-1]]))
            good = near[100 * common >= percent * (size[near] + len(own) - common)]
            _, first = np.unique(comp[good], return_index=True)
            for k in good[first]:
                yield rep, body[k][1]

    def run(batches):
        key, group = None, []
        for batch in batches:
            cols = [batch.column(x).to_pylist() for x in ("lead", "x", "d", "query", "rep", "c")]
            for i, (lead, x, d, query, rep, c) in enumerate(zip(*cols, strict=True)):
                if group and key != (lead, x, d):
                    yield from emit(compare(group))
                    group = []
                key = (lead, x, d)
                group.append((query, rep, c, batch.column("items")[i].values.to_numpy(zero_copy_only=False)))
        if group:
            yield from emit(compare(group))

    def emit(got):
        got = list(got)
        if got:
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in got], pa.int64()), pa.array([b for _, b in got], pa.int64())], ["a", "b"])

    return held.repartition("lead", "x", "d").sortWithinPartitions("lead", "x", "d").mapInArrow(run, "a long, b long").distinct()


def links(docs: DataFrame, k: int, percent: int, scratch: S.Scratch) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, rep) of every row and the (node, component) of linked representatives."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sk = scratch.put("sketch", docs.mapInArrow(_sketches(k), "doc_id long, n_shingles long, set_key binary, bands array<long>"))
    reps = sk.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"))
    members = scratch.put("members", sk.select("doc_id", "n_shingles", "set_key").join(reps, "set_key", "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep")))
    sizes = sk.select("doc_id", "n_shingles", "bands").join(members.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    # a doc_id that several rows share may have several sets; its bands count together
    banded = sizes.where("n_shingles > 0").select(F.explode("bands").alias("band"), F.col("doc_id").alias("rep"), F.col("n_shingles").cast("int").alias("n"))
    full = banded.groupBy("band").agg(F.min(F.struct("rep", "n")).alias("lead"), F.count("*").alias("c")).where("c > 1").select("band", "lead")
    shared = scratch.put("buckets", banded.join(full, "band").select("band", "rep", "n", "lead"))
    scratch.free_shuffles()

    fits = lambda x, y: (F.col(x) * 100 >= F.col(y) * percent) & (F.col(y) * 100 >= F.col(x) * percent)
    pair = lambda df: df.where(fits("na", "nb") & F.expr("a <> b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    first = scratch.put("pairs1", pair(shared.select(F.col("lead.rep").alias("a"), F.col("lead.n").alias("na"), F.col("rep").alias("b"), F.col("n").alias("nb"))))
    needed = shared.select(F.col("rep").alias("doc_id")).distinct()
    sets = scratch.put("sets", docs.join(needed, "doc_id", "left_semi").mapInArrow(_sets(k), "doc_id long, items array<long>"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        left = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("items").alias("x")), "a")
        both = left.join(sets.select(F.col("doc_id").alias("b"), F.col("items").alias("y")), "b")
        common = F.size(F.array_intersect("x", "y"))
        return both.select("a", "b", common.alias("i"), (F.size("x") + F.size("y")).alias("s")).where(f"100 * i >= {percent} * (s - i)").select("a", "b").distinct()

    edges = scratch.put("edges1", confirmed(first))
    scratch.free_shuffles()
    labels = components(edges, scratch)

    def open_buckets() -> DataFrame:
        """Members of buckets that still lie in several components."""
        rows = shared.select("band", "rep", "n").join(labels, shared.rep == labels.node, "left").select("band", "rep", "n", F.coalesce("component", "rep").alias("c"))
        several = rows.groupBy("band").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("m")).where("lo < hi and m > 2").select("band")
        return rows.join(several, "band", "left_semi")

    rows = scratch.put("open2", open_buckets())
    lead = rows.groupBy("band").agg(F.min(F.struct(F.xxhash64("band", "rep"), F.col("rep").alias("rep"), F.col("n").alias("n"), F.col("c").alias("c"))).alias("l"))
    second = pair(rows.join(lead, "band").where("c <> l.c").select(F.col("l.rep").alias("a"), F.col("l.n").alias("na"), F.col("rep").alias("b"), F.col("n").alias("nb")))
    edges2 = scratch.put("edges2", confirmed(second.join(first, ["a", "b"], "left_anti")))
    if edges2.limit(1).count():
        labels = components(edges.union(edges2), scratch)
    rows = scratch.put("open3", open_buckets().join(shared.select(F.col("band").alias("band2"), F.col("lead.rep").alias("lead")).distinct(), F.col("band") == F.col("band2")).select("lead", "rep", "n", "c").distinct())
    edges3 = scratch.put("edges3", closing(rows, sets, percent))
    if edges3.limit(1).count():
        labels = components(edges.union(edges2).union(edges3), scratch)
    return members, labels


def classify(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    scratch = S.Scratch(docs.sparkSession, "minhash")
    members, labels = links(docs, k, percent, scratch)
    out = members.join(labels, members.rep == labels.node, "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    out = scratch.put("result", out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))
    scratch.drop("sketch", "sets", "buckets", "members", "pairs1", "open2", "open3")
    return out


def dedup(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` whose document is the smallest id of its component; of rows that share an id, all stay."""
    name = S.free_name(docs.columns, "gone_doc_id")
    gone = classify(docs, k, percent).where("not kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone[name], "left_anti")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(S.table(spark, sf_dir, "documents", "doc_id", "text"), k=2)
