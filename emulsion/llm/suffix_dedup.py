"""Suffix-array dedup with a run-length index: every byte covered by a LENGTH-byte string that also starts in a document with
a smaller id is removed.

1. Equal texts: a text of LENGTH bytes or more that also stands under a smaller id is removed whole; one of each is kept on.
2. Anchors: of the K-byte strings inside each LENGTH-byte string the one with the smallest hash is its anchor, so equal
   strings have equal anchors at equal places.  Anchors that occur under one id only can be in no match and are dropped.
3. Segments: around the anchors that are left, texts are cut into segments and sent to the bucket of the anchor's first document, so
   that all occurrences of an anchor, hence of any string around it, meet in one bucket.  A document with many such rows has
   several buckets, each for a stretch of its anchors; an anchor with more than CROWD rows is split by what surrounds it.
4. In a bucket the distinct segments, the smallest document's last, get a run-compressed Burrows-Wheeler transform sorted to
   LENGTH - 1 bytes, with the documents of run ends as samples.  The segments are streamed backwards against it: a step drops the match's last
   byte and extends it by one, so the matching statistics stay capped at LENGTH, and the sample at the end of the match's last run tells the
   smallest document that has the string.  A match of LENGTH bytes in a smaller document marks its bytes.

Defined cases: a null text is empty; texts under LENGTH bytes lose nothing; rows that share an id are judged against smaller
ids only, never against one another; a null id is larger than none and loses nothing; an empty table gives an empty result; texts of
any length are taken whole; other columns, of any name, are not read by ``digest`` and kept by ``strip``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _spark as S
from . import _text as X

LENGTH = 50
K = 20
W = LENGTH - K + 1
#: Rows that an owner's anchors may have together in one part, and a crowded anchor's contexts in one bucket.
CROWD = 6_000
#: Places of a crowded anchor that are taken together, by level.
WIDTHS = (W, 8, 1)
SEGMENT = 1024
#: What one index can hold; a part has at most 2 * CROWD windows of 2 * LENGTH - K bytes.
MOST_BYTES = 1 << 20
BUCKET_BYTES = MOST_BYTES
SLICE = 1 << 18
_MASK = X.U((1 << 20) - 1)


# ---- anchors
def _anchors(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of the anchors of a slice under 2^20 bytes."""
    n = len(buf)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(X._BYTE[buf] * X._POW[:n], out=sums[1:])
    h = X.mix((sums[K:] - sums[:-K]) * X._IPOW[: n - K + 1])
    m = (h & ~_MASK) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while width * 2 <= W:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    if width < W:
        m = np.minimum(m[: len(m) - (W - width)], m[W - width :])
    ends = np.repeat(off[1:], np.diff(off))
    at = m[np.arange(len(m)) + LENGTH <= ends[: len(m)]] & _MASK
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = at[np.concatenate([[True], at[1:] != at[:-1]])].astype(np.int64)
    return at, h[at]


def anchors(column: pa.Array):
    """(first row, rows, position in the document, row, hash) for slices of a text column."""
    for i, n, buf, off in X.slices(column, SLICE):
        if len(buf) < 1 << 20:
            at, h = _anchors(buf, off)
            row = np.searchsorted(off, at, "right") - 1
            yield i + row, at - off[row], h
        else:  # one long text, in overlapping pieces
            for s in range(0, len(buf) - LENGTH + 1, 1 << 19):
                part = buf[s : s + (1 << 19) + LENGTH - 1]
                at, h = _anchors(part, np.array([0, len(part)]))
                yield np.full(len(at), i), at + s, h


def _first_pass(batches):
    for batch in batches:
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        for row, _, h in anchors(batch.column("text")):
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ids[row])], ["anchor", "doc_id"])


def _second_pass(batches):
    for batch in batches:
        ids = batch.column("tid").to_numpy(zero_copy_only=False)
        for row, at, h in anchors(batch.column("text")):
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ids[row]), pa.array(at.astype(np.int32))], ["anchor", "tid", "at"])


# ---- the run-length index
class Bits:
    """Bit vectors with ranks: 64 bits and a count of those before take 12 bytes."""

    def __init__(self, flags, rows: int, n: int):
        """flags: ``rows`` vectors of length ``n``, one after another."""
        self.width = n // 64 + 1
        packed = np.zeros((rows, 8 * self.width), np.uint8)
        for k, f in enumerate(flags):
            packed[k, : -(-n // 8)] = np.packbits(f, bitorder="little")
        words = packed.view("<u8")
        count = np.cumsum(np.bitwise_count(words), axis=1, dtype=np.int32)
        self.before = np.concatenate([np.zeros((rows, 1), np.int32), count[:, :-1]], 1).ravel()
        self.words = words.ravel()

    def rank(self, vector, i: np.ndarray) -> np.ndarray:
        """Ones of a vector before place i."""
        w = vector * self.width + (i >> 6)
        return self.before[w] + np.bitwise_count(self.words[w] & ((X.U(1) << (i & 63).astype(np.uint64)) - X.U(1)))


class RunLengthIndex:
    """Runs of the Burrows-Wheeler transform of a cyclic text, sorted to LENGTH - 1 bytes, with the documents of run ends as samples.

    Equal strings are in text order, so of the rows of a string that follow one byte the last is the last occurrence of the
    string with that byte before it.  Kept are arrays of one entry for each run or distinct string, and bit vectors that mark
    the rows where runs and strings begin and the runs of each byte."""

    def __init__(self, text: np.ndarray, owner: np.ndarray):
        """owner: the document of each byte of the text."""
        n = self.n = len(text)
        sa, starts = sorted_rotations(text)
        bwt = text[sa - 1]
        begins = np.concatenate([[True], bwt[1:] != bwt[:-1]])
        self.run_start = np.flatnonzero(begins).astype(np.int32)
        self.run_end = np.append(self.run_start[1:], np.int32(n))
        self.end_sample = owner[sa[self.run_end - 1]]
        self.string_end = np.append(starts[1:], n).astype(np.int32)
        self.string_sample = owner[sa[self.string_end - 1]]
        strings = np.zeros(n, bool)
        strings[starts] = True
        self.begin = Bits((begins, strings), 2, n)
        # runs by byte: of each the run and the row that its first row steps back to
        char = bwt[self.run_start]
        self.letters = np.flatnonzero(np.bincount(char, minlength=256))
        self.code = np.zeros(256, np.int64)
        self.code[self.letters] = np.arange(len(self.letters))
        self.heads = Bits((char == x for x in self.letters), len(self.letters), len(char))
        self.run = np.argsort(char, kind="stable").astype(np.int32)
        size = self.run_end - self.run_start
        self.step = (np.cumsum(size[self.run]) - size[self.run]).astype(np.int32)
        self.runs_below = np.cumsum(np.bincount(char, minlength=256)[self.letters]) - np.bincount(char, minlength=256)[self.letters]

    def runs_to(self, code: np.ndarray, run: np.ndarray) -> np.ndarray:
        """Which of the runs by byte is the last one of a byte up to a run; one less than the byte's first if there is none."""
        return self.runs_below[code] + self.heads.rank(code, run + 1) - 1

    def back(self, code: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often the byte stands in the transform before a row, plus the bytes below it."""
        run = self.begin.rank(0, row) - 1
        j = self.runs_to(code, run)
        none = j < self.runs_below[code]
        j = np.where(none, self.runs_below[code], j)
        r = self.run[j]
        return self.step[j] + np.where(none, 0, np.minimum(row, self.run_end[r]) - self.run_start[r])

    def stream(self, text: np.ndarray, strip: int = 256) -> np.ndarray:
        """For each position of a cyclic pattern whose strings all occur in the index: the document of the last occurrence (in text order) of its
        LENGTH-byte string.

        The pattern is streamed backwards in strips side by side.  The match of a strip grows to LENGTH - 1 bytes; from then on each step
        extends it by a byte and drops its last one, so its length stays at the cap.  The last row of the extended match comes from the
        last row of the match, if that has the byte, or from the end of the last run of the byte before it: a sample tells the document."""
        n = len(text)
        out = np.empty(n, np.int64)
        text = self.code[text]
        at = (np.arange(-(-n // strip)) + 1) * strip + LENGTH - 1
        low, high = np.zeros(len(at), np.int64), np.full(len(at), self.n)
        for _ in range(LENGTH - 1):
            at = at - 1
            code = text[at % n]
            low, high = self.back(code, low), self.back(code, high)
        string = self.begin.rank(1, low + 1) - 1
        at = at % n
        for _ in range(min(strip, n)):
            at = np.where(at == 0, n, at) - 1
            code = text[at]
            row = self.string_end[string] - 1
            run = self.begin.rank(0, row + 1) - 1
            j = self.runs_to(code, run)
            r = self.run[j]
            inside = r == run
            out[at] = np.where(inside, self.string_sample[string], self.end_sample[r])
            row = self.step[j] + np.where(inside, row, self.run_end[r] - 1) - self.run_start[r]
            string = self.begin.rank(1, row + 1) - 1
        return out


def sorted_rotations(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rotations in order of their first LENGTH - 1 bytes, equal ones in text order; rows at which a new such string begins).

    Prefix doubling; ranks and places share 64-bit words, which are sorted as they are, so texts go up to MOST_BYTES."""
    n = len(text)
    if n > MOST_BYTES:
        raise ValueError("text too long for one index")
    places = max(1, (n - 1).bit_length())
    place = np.arange(n, dtype=np.uint64)
    used = np.flatnonzero(np.bincount(text, minlength=256))
    code = np.zeros(256, np.uint64)
    code[used] = np.arange(len(used))
    bits = max(1, (len(used) - 1).bit_length())
    depth = min((64 - places) // bits, 32)
    ring = code[np.concatenate([text, np.resize(text, depth)])]
    key = np.zeros(n, np.uint64)
    for j in range(depth):
        key = (key << X.U(bits)) | ring[j : j + n]
    mask = X.U((1 << places) - 1)

    def ranks(key):
        word = np.sort((key << X.U(places)) | place)
        at, key = (word & mask).astype(np.int64), word >> X.U(places)
        new = np.empty(n, np.uint32)
        new[0] = 0
        np.cumsum(key[1:] != key[:-1], out=new[1:])
        return at, new

    while True:
        at, new = ranks(key)
        if depth == LENGTH - 1:
            return at, np.flatnonzero(np.diff(new, prepend=np.uint32(1)))
        rank = np.empty(n, np.uint32)
        rank[at] = new
        shift = min(depth, LENGTH - 1 - depth)
        key = (rank.astype(np.uint64) << X.U(places)) | np.roll(rank, -shift)
        depth += shift


# ---- segments and buckets
FOUND = "tid long, spans array<struct<lo: long, hi: long>>"
SEGMENTS = "key long, part long, doc_id long, tid long, start int, seg binary"
CONTEXTS = "key long, part long, seg binary, first long, docs array<long>, tids array<long>, starts array<long>, ats array<long>, batch long"


def _binary(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte spans of a buffer as a binary column."""
    size = end - start
    to = np.cumsum(size)
    flat = raw[np.repeat(start - to + size, size) + np.arange(int(to[-1]) if len(to) else 0)]
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(np.concatenate([[0], to]).astype(np.int32)), pa.py_buffer(flat)])


def _texts(batch: pa.RecordBatch):
    """(bytes of the texts, offsets) of a batch's text column."""
    col = batch.column("text").cast(pa.large_binary())
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    return np.frombuffer(col.buffers()[2], np.uint8) if off[-1] > off[0] else np.zeros(0, np.uint8), off


def _marks(batch: pa.RecordBatch, *names: str):
    """(row of each mark, the named fields) of a batch's column of lists of marks."""
    col = batch.column("marks")
    values = col.flatten()
    return np.repeat(np.arange(len(col)), col.value_lengths().to_numpy()), *(values.field(x).to_numpy(zero_copy_only=False) for x in names)


def _segments(batches):
    """SEGMENTS around the anchors of each text: what adjoining strings of one owner and part cover is one segment, cut so that
    every string lies in one piece."""
    for batch in batches:
        raw, off = _texts(batch)
        doc, tid = (batch.column(c).to_numpy() for c in ("doc_id", "tid"))
        row, at, owner, part = _marks(batch, "at", "owner", "part")
        order = np.lexsort((at, part, owner, row))
        row, at, owner, part = row[order], at[order].astype(np.int64), owner[order], part[order]
        size = np.diff(off)
        lo, hi = np.maximum(at - (W - 1), 0), np.minimum(at + LENGTH, size[row])
        if not len(at):
            continue
        new = np.ones(len(at), bool)
        new[1:] = (row[1:] != row[:-1]) | (owner[1:] != owner[:-1]) | (part[1:] != part[:-1]) | (lo[1:] > hi[:-1] - LENGTH + 1)
        b = np.flatnonzero(new)
        lo, hi, row, owner, part = lo[b], hi[np.append(b[1:], len(at)) - 1], row[b], owner[b], part[b]
        pieces = np.maximum(1, -(-(hi - lo - LENGTH + 1) // (SEGMENT - LENGTH + 1)))
        k = np.repeat(np.arange(len(lo)), pieces)
        lo = lo[k] + (np.arange(len(k)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * (SEGMENT - LENGTH + 1)
        hi, row, owner, part = np.minimum(hi[k], lo + SEGMENT), row[k], owner[k], part[k]
        for i in range(0, len(lo), 1 << 14):
            j = slice(i, i + (1 << 14))
            yield pa.RecordBatch.from_arrays(
                [pa.array(owner[j]), pa.array(part[j]), pa.array(doc[row[j]]), pa.array(tid[row[j]]), pa.array(lo[j].astype(np.int32)), _binary(raw, off[row[j]] + lo[j], off[row[j]] + hi[j])],
                ["key", "part", "doc_id", "tid", "start", "seg"],
            )


def _contexts(width: int):
    """Rows of CONTEXTS: what lies around crowded anchors.  For each group of ``width`` adjoining places that the anchor can have in a
    string, the strings that have it there, keyed by the bytes that all of them share; equal ones of a batch are one row (or a few)."""

    def run(batches):
        for number, batch in enumerate(batches):
            raw, off = _texts(batch)
            doc, tid = (batch.column(c).to_numpy() for c in ("doc_id", "tid"))
            row, at = _marks(batch, "at")
            name = (TaskContext.get().partitionId() << 32) + number
            anchor = np.zeros(len(at), np.uint64)
            for j in range(K):
                anchor = anchor * X.U(X._P) + X._BYTE[raw[off[row] + at + j]]
            at, size = at.astype(np.int64), np.diff(off)[row]
            for first in range(0, W, width):
                last = min(first + width, W) - 1
                lo, hi = np.maximum(at - last, 0), np.minimum(at - first + LENGTH, size)
                core_lo, core_hi = at - first, at - last + LENGTH
                good = np.flatnonzero((hi - lo >= LENGTH) & (core_lo >= 0) & (core_hi <= size))
                good = good[np.argsort(anchor[good], kind="stable")]  # what may be equal stands together
                for k in np.split(good, range(1 << 15, len(good), 1 << 15)):
                    known: dict[bytes, int] = {}
                    which = np.empty(len(k), np.int64)
                    for i, (a, b) in enumerate(zip((off[row[k]] + lo[k]).tolist(), (off[row[k]] + hi[k]).tolist(), strict=True)):
                        which[i] = known.setdefault(raw[a:b].tobytes(), len(known))
                    order = np.lexsort((doc[row[k]], which))
                    k, which = k[order], which[order]
                    one = np.flatnonzero(np.diff(which, prepend=-1))  # of each context its smallest document
                    head = k[one]
                    h = np.full(len(head), first, np.uint64)
                    for j in range(LENGTH - (last - first)):
                        h = h * X.U(X._P) + X._BYTE[raw[off[row[head]] + core_lo[head] + j]]
                    count = np.diff(np.append(one, len(k)))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(X.mix(h).view(np.int64)), pa.array(np.full(len(head), first)), pa.array(list(known), pa.binary()), pa.array(doc[row[head]]),
                            *(X.list_array(pa.array(x), count) for x in (doc[row[k]], tid[row[k]], lo[k], at[k])), pa.array(np.full(len(head), name)),
                        ],
                        [x.split()[0] for x in CONTEXTS.split(", ")],
                    )

    return run


def _heads(batches):
    """SEGMENTS and at of the places in the smallest document of each context, from CONTEXTS that hold it."""
    for batch in batches:
        k = np.repeat(np.arange(batch.num_rows), batch.column("docs").value_lengths().to_numpy())
        doc, tid, start, at = (batch.column(c).flatten() for c in ("docs", "tids", "starts", "ats"))
        head = np.flatnonzero(doc.to_numpy() == batch.column("first").to_numpy()[k])
        for i in range(0, len(head), 1 << 14):
            j = head[i : i + (1 << 14)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(k[j]) for c in ("key", "part")), doc.take(j), tid.take(j), start.take(j).cast(pa.int32()), batch.column("seg").take(k[j]), at.take(j).cast(pa.int32())],
                [*(x.split()[0] for x in SEGMENTS.split(", ")), "at"],
            )


def _copies(batches):
    """(tid, spans) of the places of contexts that a smaller document (least) has too, for rows sorted by batch: the texts of a batch
    stand in no other, so each of them gives one row."""

    def work(tid, lo, hi):
        tid, lo, hi = (np.concatenate(x) for x in (tid, lo, hi))
        order = np.lexsort((lo, tid))
        tid, lo, hi = tid[order], lo[order], hi[order]
        text = np.cumsum(np.diff(tid, prepend=tid[0]) != 0) << 40  # longer than any text
        reach = np.maximum.accumulate(text + hi)
        new = np.ones(len(tid), bool)
        new[1:] = (text + lo)[1:] > reach[:-1]
        b = np.flatnonzero(new)
        hi = np.maximum.reduceat(hi, b)
        tid, lo = tid[b], lo[b]
        one = np.flatnonzero(np.diff(tid, prepend=tid[0] - 1))
        both = pa.StructArray.from_arrays([pa.array(lo), pa.array(hi)], ["lo", "hi"])
        return pa.RecordBatch.from_arrays([pa.array(tid[one]), X.list_array(both, np.diff(np.append(one, len(tid))))], ["tid", "spans"])

    held, last = ([], [], []), None
    for batch in batches:
        n = batch.column("docs").value_lengths().to_numpy()
        k = np.repeat(np.arange(batch.num_rows), n)
        doc, tid, start = (batch.column(c).flatten().to_numpy() for c in ("docs", "tids", "starts"))
        copy = doc > batch.column("least").to_numpy()[k]
        k, tid, start = k[copy], tid[copy], start[copy]
        end = start + np.array([len(x) for x in batch.column("seg").to_pylist()], np.int64)[k]
        name = batch.column("batch").to_numpy()[k]
        edge = np.flatnonzero(np.diff(name)) + 1
        for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(name)], strict=True):
            if a == b:
                continue
            if held[0] and name[a] != last:
                yield work(*held)
                held = ([], [], [])
            last = name[a]
            for x, y in zip(held, (tid, start, end), strict=True):
                x.append(y[a:b])
    if held[0]:
        yield work(*held)


def match_bucket(doc: np.ndarray, segs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment number, start, end) of removed spans among the segments of a bucket; its distinct texts go into one index."""
    order = np.lexsort((np.arange(len(doc)), doc))
    head: dict[bytes, int] = {}
    whole, heads = [], []
    for i in order.tolist():
        h = head.setdefault(segs[i], i)
        if doc[h] == doc[i]:
            heads.append(i)
        elif len(segs[i]) >= LENGTH:  # equal to a segment of a smaller document
            whole.append(i)
    heads = np.array(heads[::-1])  # the smallest document last
    size = np.array([len(segs[i]) for i in heads])
    text = np.frombuffer(b"\xff".join([segs[i] for i in heads]) + b"\xff", np.uint8)
    start = np.cumsum(size + 1) - size - 1
    if doc[heads[0]] == doc[heads[-1]]:
        hit = np.zeros(0, np.int64)
    else:
        owner = np.repeat(doc[heads], size + 1)
        hit = np.flatnonzero(RunLengthIndex(text, owner).stream(text) < owner)
    seg = np.searchsorted(start, hit, "right") - 1
    inside = hit + LENGTH <= start[seg] + size[seg]
    hit, seg = hit[inside], seg[inside]
    # strings of two segments are further apart than LENGTH
    b = np.flatnonzero(np.diff(hit, prepend=-LENGTH - 1) > LENGTH)
    e = np.append(b[1:], len(hit)) - 1
    whole = np.array(whole, np.int64)
    long = np.array([len(segs[i]) for i in whole], np.int64)
    base = start[seg[b]]
    return np.concatenate([heads[seg[b]], whole]), np.concatenate([hit[b] - base, whole * 0]), np.concatenate([hit[e] + LENGTH - base if len(b) else hit, long])


def _buckets(batches):
    """Spans (tid, lo, hi) from SEGMENTS sorted by key and part; keys are taken together as long as an index can hold them."""
    held: list[tuple] = []
    size = 0

    def work():
        doc, tid, start = (np.concatenate(x) for x in list(zip(*held, strict=True))[:3])
        if doc.min() < doc.max():
            seg, lo, hi = match_bucket(doc, [s for x in held for s in x[3]])
            if len(seg):
                yield pa.RecordBatch.from_arrays([pa.array(tid[seg]), pa.array(start[seg] + lo), pa.array(start[seg] + hi)], ["tid", "lo", "hi"])

    group: list[tuple] = []
    weight, last = 0, None
    for batch in batches:
        key, part, doc, tid, start = (batch.column(c).to_numpy() for c in ("key", "part", "doc_id", "tid", "start"))
        segs = batch.column("seg").to_pylist()
        edge = np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1
        for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(key)], strict=True):
            now = (key[a], part[a])
            if group and now != last:
                if held and (size + weight > BUCKET_BYTES):
                    yield from work()
                    held, size = [], 0
                held, size, group, weight = held + group, size + weight, [], 0
            last = now
            group.append((doc[a:b], tid[a:b], start[a:b].astype(np.int64), segs[a:b]))
            weight += sum(map(len, segs[a:b])) + b - a
    if held and size + weight > BUCKET_BYTES:
        yield from work()
        held = []
    held = held + group
    if held:
        yield from work()


def _parts(texts: DataFrame, shared: DataFrame, crowd: int) -> DataFrame:
    """``shared`` with part: the anchors of one owner in order of their place in it, cut where they have about ``crowd`` rows together."""
    big = shared.groupBy("owner").agg(F.sum("n").alias("rows")).where(F.col("rows") > crowd).select(F.col("owner").alias("big"))
    owners = texts.join(big, texts["doc_id"] == big["big"], "left_semi").select(F.col("doc_id").alias("tid"), "text")
    places = owners.mapInArrow(_second_pass, "anchor long, tid long, at int").groupBy(F.col("anchor").alias("a"), F.col("tid").alias("o")).agg(F.min("at").alias("at"))
    told = shared.join(places, (F.col("anchor") == F.col("a")) & (F.col("owner") == F.col("o"))).select("a", "o", "at", "n")
    # the rows of a window are the anchors of one text
    before = F.sum("n").over(Window.partitionBy("o").orderBy("at", "a").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    told = told.select(F.col("a").alias("anchor"), F.col("o").alias("owner"), F.floor(before / crowd).cast("long").alias("part"))
    return shared.join(told, ["anchor", "owner"], "left").withColumn("part", F.coalesce("part", F.lit(0).cast("long")))


def _crowded(texts: DataFrame, marks: DataFrame, scratch: S.Scratch, crowd: int) -> DataFrame | None:
    """(tid, spans) around anchors of more than ``crowd`` rows, or None without such anchors.

    Their strings are split by what they share beyond the anchor, in groups of ever fewer places of the anchor; equal contexts are one
    by a partial aggregation, and a group that is still crowded is split once more.  In groups of one place all strings are equal."""
    out = None
    rest = marks.select("tid", F.filter("marks", lambda m: m["n"] > crowd).alias("marks")).where(F.size("marks") > 0)
    for level, width in enumerate(WIDTHS):
        pending = texts.join(rest, "tid").select("doc_id", "tid", "text", "marks")
        rows = scratch.put(f"crowd{level}", pending.mapInArrow(_contexts(width), CONTEXTS))
        least = rows.groupBy("key", "part", "seg").agg(F.min("first").alias("least"))
        told = scratch.put(f"told{level}", rows.join(least, ["key", "part", "seg"]))
        copies = told.select("batch", "seg", "least", "docs", "tids", "starts").repartition("batch").sortWithinPartitions("batch").mapInArrow(_copies, FOUND)
        heads = told.where("first = least").select(*(x.split()[0] for x in CONTEXTS.split(", "))).mapInArrow(_heads, SEGMENTS + ", at int")
        heads = scratch.put(f"heads{level}", heads)
        groups = heads.groupBy("key", "part").agg(F.count("*").alias("rows"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
        groups = scratch.put(f"groups{level}", groups.where("lo < hi"))  # of the heads of one document none is a match
        fits = F.col("rows") <= 2 * crowd  # as a part has at most
        tight, wide = groups.where(fits).select("key", "part"), groups.where(~fits).select("key", "part")
        found = heads.join(tight, ["key", "part"], "left_semi").select(*(x.split()[0] for x in SEGMENTS.split(", ")))
        found = found.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(_buckets, "tid long, lo long, hi long")
        got = copies.union(found.select("tid", F.array(F.struct("lo", "hi"))))
        out = got if out is None else out.union(got)
        if not wide.limit(1).count():
            return out
        rest = heads.join(wide, ["key", "part"], "left_semi").select("tid", "at").distinct().groupBy("tid").agg(F.collect_list(F.struct("at")).alias("marks"))
    return out


def spans(docs: DataFrame, scratch: S.Scratch, crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """(text_key, first) of every text, and (doc_id, text_key, spans) of the texts that lose some bytes but not all."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.col("text").cast("binary")).alias("text_key"), "text").where("doc_id is not null")
    first = keyed.groupBy("text_key").agg(F.min("doc_id").alias("first"))
    long = keyed.where(F.octet_length("text") >= LENGTH)
    one = first.select(F.col("text_key").alias("k"), F.col("first").alias("f"))
    # rows that are equal in id and text are one
    texts = long.join(one, (F.col("text_key") == F.col("k")) & (F.col("doc_id") == F.col("f")), "left_semi")
    texts = scratch.put("texts", texts.withColumn("tid", F.monotonically_increasing_id()))
    scratch.free_shuffles()
    seen = texts.select("doc_id", "text").mapInArrow(_first_pass, "anchor long, doc_id long").groupBy("anchor")
    seen = seen.agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("other"), F.count("*").alias("n")).where("owner < other")
    shared = scratch.put("anchors", seen.select("anchor", "owner", "n"))
    scratch.free_shuffles()
    few = shared.where(F.col("n") <= crowd)
    shared = scratch.put("parts", _parts(texts, few, crowd).unionByName(shared.where(F.col("n") > crowd).withColumn("part", F.lit(0).cast("long"))))
    marks = texts.select("tid", "text").mapInArrow(_second_pass, "anchor long, tid long, at int").join(shared, "anchor")
    marks = scratch.put("marks", marks.groupBy("tid").agg(F.collect_list(F.struct("at", "owner", "n", "part")).alias("marks")))
    rows, top = shared.agg(F.coalesce(F.sum(F.when(F.col("n") <= crowd, F.col("n"))), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    scratch.drop("anchors", "parts")
    scratch.free_shuffles()
    plain = marks.select("tid", F.filter("marks", lambda m: m["n"] <= crowd).alias("marks")).where(F.size("marks") > 0)
    cut = texts.join(plain, "tid").select("doc_id", "tid", "text", "marks").mapInArrow(_segments, SEGMENTS)
    parts = max(1, int(rows) * 32 // BUCKET_BYTES + 1)
    found = cut.repartition(parts, "key", "part").sortWithinPartitions("key", "part").mapInArrow(_buckets, "tid long, lo long, hi long")
    found = found.select("tid", F.array(F.struct("lo", "hi")).alias("spans"))
    if top > crowd:
        found = found.union(_crowded(texts, marks, scratch, crowd))
    by_text = found.groupBy("tid").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    out = scratch.put("spans", by_text.join(texts.select("tid", "doc_id", "text_key"), "tid").select("tid", "doc_id", "text_key", "spans"))
    scratch.drop("marks", *(f"{x}{k}" for x in ("crowd", "told", "heads", "groups") for k in range(len(WIDTHS))))
    scratch.free_shuffles()
    return first, out


def merge_spans(pairs) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(pairs):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def rest(raw: bytes, cut: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for lo, hi in cut:
        parts.append(raw[at:lo])
        at = hi
    return b"".join([*parts, raw[at:]])


def _cuts(column: pa.Array):
    for x in column:
        yield merge_spans((p["lo"], p["hi"]) for p in (x.as_py() or ()))


def digest(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    scratch = S.Scratch(docs.sparkSession, "suffix")
    first, cut = spans(docs, scratch, crowd)

    def run(batches):
        for batch in batches:
            rows = []
            for text, c in zip(batch.column("text"), _cuts(batch.column("spans")), strict=True):
                rows.append((sum(b - a for a, b in c), len(c), hashlib.sha256(rest(text.as_py().encode(), c)).hexdigest()))
            removed, count, sha = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(sha)],
                ["d", "k", "removed", "count", "sha"],
            )

    texts = docs.sparkSession.read.parquet(f"{scratch.root}/texts").select("tid", "text")
    part = cut.join(texts, "tid").select("doc_id", "text_key", "text", "spans").mapInArrow(run, "d long, k string, removed long, count long, sha string")
    part = scratch.put("part", part.distinct())
    raw = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.col("text").cast("binary")).alias("text_key"), F.length(raw).cast("long").alias("n_bytes"), F.sha2(raw, 256).alias("whole"))
    rows = rows.join(first, "text_key", "left").join(part, (F.col("doc_id") == F.col("d")) & (F.col("text_key") == F.col("k")), "left")
    copy = (F.col("n_bytes") >= LENGTH) & F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False))
    pick = lambda a, b, c: F.when(copy, a).otherwise(F.coalesce(b, c))
    out = rows.select(
        "doc_id", "n_bytes", pick(F.col("n_bytes"), F.col("removed"), F.lit(0).cast("long")).alias("n_removed"),
        pick(F.lit(1).cast("long"), F.col("count"), F.lit(0).cast("long")).alias("n_spans"),
        pick(F.lit(hashlib.sha256(b"").hexdigest()), F.col("sha"), F.col("whole")).alias("kept_sha256"),
    )
    return out


def at_characters(raw: bytes, cut: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans, widened to whole characters."""
    out = []
    for lo, hi in cut:
        while lo and raw[lo] & 0xC0 == 0x80:
            lo -= 1
        while hi < len(raw) and raw[hi] & 0xC0 == 0x80:
            hi += 1
        out.append((lo, hi))
    return merge_spans(out)


def strip(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """``docs`` with the marked bytes cut from text (a character that loses a byte goes whole) and n_chars, where it is, counted
    anew.  Rows stay, also those with nothing left, and so do all other columns."""
    scratch = S.Scratch(docs.sparkSession, "suffix")
    first, cut = spans(docs, scratch, crowd)
    schema = docs.schema
    key, first_id, lost, k1, k2, d = names = [S.free_name(schema.names, x) for x in ("_key", "_first", "_spans", "_k1", "_k2", "_d")]
    assert len(set(names)) == len(names)
    marked = docs.withColumn(key, F.md5(F.col("text").cast("binary"))).join(first.select(F.col("text_key").alias(k1), F.col("first").alias(first_id)), F.col(key) == F.col(k1), "left")
    cut = cut.select(F.col("doc_id").alias(d), F.col("text_key").alias(k2), F.col("spans").alias(lost)).dropDuplicates([d, k2])
    marked = marked.join(cut, (F.col("doc_id").cast("long") == F.col(d)) & (F.col(key) == F.col(k2)), "left")

    def run(batches):
        for batch in batches:
            ids, firsts = batch.column("doc_id").cast(pa.int64()).to_pylist(), batch.column(first_id).to_pylist()
            out = []
            for doc, f, text, c in zip(ids, firsts, batch.column("text"), _cuts(batch.column(lost)), strict=True):
                t = text.as_py()
                copy = t is not None and f is not None and doc is not None and f < doc and len(t.encode()) >= LENGTH
                if copy:
                    t = ""
                elif t is not None and c:
                    raw = t.encode()
                    t = rest(raw, at_characters(raw, c)).decode()
                out.append(t)
            cols = {name: batch.column(name) for name in schema.names}
            cols["text"] = pa.array(out, pa.string())
            if "n_chars" in cols:
                cols["n_chars"] = pa.array([None if t is None else len(t) for t in out], batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return S.map_batches(marked.select(*(F.col(f"`{c}`") for c in schema.names), first_id, lost), run, schema)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(S.table(spark, sf_dir, "documents", "doc_id", "text"))
