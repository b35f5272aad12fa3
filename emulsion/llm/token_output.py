"""Token-id output: byte-pair ids in shards compressed by Re-Pair, with random access, read back from the files.

File format: a Parquet table of shards in ascending document order.  A shard holds whole documents, about SHARD_TOKENS ids:
``symbols`` and ``rules`` (little-endian u16, or u32 where ids and rules don't fit), ``rule_sizes`` (u32 expansion lengths), ``starts``
(u32: ids before every STRIDE-th symbol), and the ids and id counts of its documents.  Symbols below ``vocab`` are ids; symbol
vocab + j expands to rule j.  ``read_range`` decodes any range of ids from ``starts`` and ``rule_sizes`` without expanding the rest.

Re-Pair: repeated adjacent pairs are replaced by nonterminals, the frequent ones first, until no pair repeats or the symbols of the
shard's width have run out; a round takes all pairs within a factor SPREAD of the most frequent one, left to right without overlap.

Defined cases: a null text is the empty text and has the end id alone; rows are ordered by (doc_id, hash of the text), nulls first, so
repeated rows and shared ids have a place and are spread over tasks; a text of any length is one document in one shard; an empty table
writes and returns nothing; other columns are not read.
"""

from __future__ import annotations

import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _spark as S
from . import _text as X

END_ID = 0
SHARD_TOKENS = 1 << 20
SPREAD = 8
STRIDE = 1024
GROUP = 1024
SLICE_DOCS_BYTES = 1 << 21
MEMO = 1_500_000
#: Chunks of a text that are looked up at a time.
RANGE = 1 << 17
_TABLE_BITS = 18
#: Bytes of ASCII letters; second bytes of the letters from U+00C0 to U+00FF; ASCII marks but for the apostrophe.
_LETTER, _AFTER_C3, _PUNCT = (np.isin(np.arange(256), np.array(x)) for x in (
    [*range(0x41, 0x5B), *range(0x61, 0x7B)], [c for c in range(0x80, 0xC0) if c not in (0x97, 0xB7)],
    [c for c in range(0x21, 0x7F) if c != 0x27 and not chr(c).isalnum()],
))
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

SHARDS = (
    "part int, block int, n_tokens long, vocab int, wide boolean, doc_ids array<long>, doc_tokens array<int>, "
    "symbols binary, rules binary, rule_sizes binary, starts binary"
)
#: ASCII white space.
_WHITE = np.isin(np.arange(256), [*range(0x09, 0x0E), *range(0x1C, 0x21)])
#: White space other than the plain space that may stand before one.
_ODD_SPACE = tuple(c.encode() for c in "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def public_tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ChunkTable:
    """Ids of chunks of up to 16 bytes, in an open-addressed table of flat arrays.

    The key is the chunk itself, as two little-endian words (no chunk holds a zero byte), so equal keys are equal chunks."""

    def __init__(self, kind):
        self.bits, self.n, self.used = 16, 0, 0
        self.low, self.high = (np.zeros(1 << 15, np.uint64) for _ in range(2))
        self.start, self.size = np.zeros(1 << 15, np.int64), np.zeros(1 << 15, np.int64)
        self.ids = np.zeros(1 << 17, kind)
        self.slot = np.full(1 << self.bits, -1, np.int32)

    def _spot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (((low ^ (high * X.U(0x9E3779B97F4A7C15))) * X.U(0xBF58476D1CE4E5B9)) >> X.U(64 - self.bits)).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The entry of each key, or -1."""
        mask = (1 << self.bits) - 1
        out = np.full(len(low), -1, np.int64)
        spot, todo = self._spot(low, high), np.arange(len(low))
        while len(todo):
            e = self.slot[spot]
            same = (e >= 0) & (self.low[e] == low[todo]) & (self.high[e] == high[todo])
            out[todo[same]] = e[same]
            on = (e >= 0) & ~same
            todo, spot = todo[on], (spot[on] + 1) & mask
        return out

    def _place(self, entries: np.ndarray) -> None:
        mask = (1 << self.bits) - 1
        spot = self._spot(self.low[entries], self.high[entries])
        while len(entries):
            free = self.slot[spot] < 0
            self.slot[spot[free]] = entries[free]  # of several that want a slot the last one gets it
            on = self.slot[spot] != entries
            entries, spot = entries[on], (spot[on] + 1) & mask

    def add(self, pieces: list[list[int]]) -> np.ndarray:
        """Store lists of ids; their entries (without a key yet)."""
        size = np.array([len(p) for p in pieces], np.int64)
        flat = np.array(list(chain.from_iterable(pieces)), self.ids.dtype)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n + len(pieces) > len(self.low):
            for name in ("low", "high", "start", "size"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.zeros_like(old)]))
        at = np.arange(self.n, self.n + len(pieces))
        self.ids[self.used : self.used + len(flat)] = flat
        self.start[at], self.size[at] = self.used + np.cumsum(size) - size, size
        self.used += len(flat)
        self.n += len(pieces)
        return at

    def key(self, entries: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        self.low[entries], self.high[entries] = low, high
        if 2 * self.n > 1 << self.bits:
            while 2 * self.n > 1 << self.bits:
                self.bits += 1
            self.slot = np.full(1 << self.bits, -1, np.int32)
            entries = np.flatnonzero(self.low[: self.n] != 0)
        self._place(entries)

    def gather(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the entries one after another, and how many each has."""
        size = self.size[entries]
        end = np.cumsum(size)
        at = np.repeat(self.start[entries] - end + size, size) + np.arange(int(end[-1]) if len(end) else 0)
        return self.ids[at], size


class Encoder:
    """The tokenizers library behind a memo of chunks.

    A byte-level BPE never merges across a space that follows a non-space, nor from a letter to a mark, so a text is cut there and
    equal chunks are encoded once.  The memo is emptied when it holds MEMO chunks, so its memory is bounded."""

    def __init__(self, path: str):
        import os

        from tokenizers import Tokenizer, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism; idle threads cost CPU
        self.tok = Tokenizer.from_file(path)
        self.vocab = self.tok.get_vocab_size(with_added_tokens=True)
        self.type = np.uint16 if self.vocab <= 1 << 16 else np.uint32
        line_end = self.tok.encode("\n", add_special_tokens=False).ids
        self.line_end = line_end[0] if len(line_end) == 1 else -1
        # the same tokenizer, which takes every line by itself
        self.by_line = Tokenizer.from_file(path)
        self.by_line.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split("\n", "isolated"), self.tok.pre_tokenizer])
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        kind = str(self.tok.pre_tokenizer)
        self.known = self.tok.normalizer is None and kind.startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in kind
        # how the library writes each byte of a piece
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        self.written = {b: b for b in plain} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in plain)}
        self._empty()

    def _empty(self) -> None:
        self.table = ChunkTable(self.type)
        self.long: dict[bytes, int] = {}

    def _raw(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.type) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _chunks(self, chunks: list[str]) -> list[list[int]]:
        """The ids of chunks, encoded as the lines of one text; a chunk with a line end is encoded by itself."""
        out: list = [None] * len(chunks)
        plain = [i for i, w in enumerate(chunks) if "\n" not in w] if self.line_end >= 0 else []
        for at in range(0, len(plain), 4096):
            part = plain[at : at + 4096]
            ids = np.array(self.by_line.encode_batch_fast(["\n".join([chunks[i] for i in part])], add_special_tokens=False)[0].ids, self.type)
            ends = np.flatnonzero(ids == self.line_end)
            if len(ends) == len(part) - 1:
                for i, a, b in zip(part, [0, *(ends + 1).tolist()], [*ends.tolist(), len(ids)], strict=True):
                    out[i] = ids[a:b].tolist()
        odd = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(odd, self._raw([chunks[i] for i in odd]) if odd else [], strict=True):
            out[i] = x.tolist()
        return out

    def _pieces(self, raw: list[bytes]) -> list[list[int]]:
        return self._chunks([x.decode() for x in raw])

    def _letters(self, words: list[bytes]) -> list[list[int]]:
        """The ids of words of letters with at most a space before them: such a word is one piece for the model."""
        merge = self.tok.model.tokenize
        return [[t.id for t in merge(w.decode("latin-1").translate(self.written))] for w in words]

    def _uncut(self, raw: list[bytes], together: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Texts that must be encoded whole, and texts that must not be cut at line ends.  (The zero byte pads the memo's keys.)"""
        whole, lined = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
        if not self.known:
            return ~whole, lined
        buf = np.frombuffer(together, np.uint8)
        off = X.lengths_to_offsets([len(r) for r in raw])
        row = lambda flags: np.searchsorted(off, np.flatnonzero(flags), "right") - 1
        whole[row(buf == 0)] = True
        if len(buf) > 1:
            same = np.ones(len(buf) - 1, bool)
            edge = off[1:-1]
            same[edge[(edge > 0) & (edge < len(buf))] - 1] = False  # two bytes of one text
            white, now, after = _WHITE[buf], buf[:-1], buf[1:]
            # a space after white space, and white space beside a line end
            whole[row(white[:-1] & (after == 0x20) & same)] = True
            lined[row(((white[:-1] & (after == 0x0A)) | ((now == 0x0A) & white[1:])) & same)] = True
            wide = row(((now == 0xC2) & ((after == 0x85) | (after == 0xA0))) | ((now >= 0xE1) & (now <= 0xE3) & np.isin(after, (0x80, 0x81, 0x9A))))
            for i in np.unique(wide).tolist():
                whole[i] |= any(s in raw[i] for s in _ODD_SPACE)
        for s in self.special:
            if s.encode() in together:
                whole |= np.array([s.encode() in r for r in raw])
        return whole, lined

    def _entries(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """Table entries of the chunks of a buffer that is padded by 24 bytes; letters: how many bytes of letters stand before each place."""
        size = end - start
        words = np.ndarray(len(buf) - 7, "<u8", buf, strides=(1,))
        short = size <= 16
        s, n = start[short], size[short]
        low = words[s] & _MASKS[np.minimum(n, 8)]
        high = words[s + 8] & _MASKS[np.maximum(n - 8, 0)]
        found = self.table.find(low, high)
        miss = np.flatnonzero(found < 0)
        if len(miss):
            # one of each new key, by sorting the keys' hashes and telling neighbours apart by the keys
            order = miss[np.lexsort((high[miss], low[miss]))]
            new = np.ones(len(order), bool)
            new[1:] = (low[order[1:]] != low[order[:-1]]) | (high[order[1:]] != high[order[:-1]])
            one = order[new]
            a, b = s[one], s[one] + n[one]
            word = letters[b] - letters[a] + (buf[a] == 0x20) == b - a
            text = buf.tobytes() if len(one) > 64 else buf
            got = [bytes(text[i:j]) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
            pieces: list = [None] * len(got)
            for at, encode in ((np.flatnonzero(word & (b - a > 1)), self._letters), (np.flatnonzero(~(word & (b - a > 1))), self._pieces)):
                for i, x in zip(at.tolist(), encode([got[i] for i in at.tolist()]), strict=True):
                    pieces[i] = x
            made = self.table.add(pieces)
            self.table.key(made, low[one], high[one])
            found[order] = made[np.cumsum(new) - 1]
        out = np.empty(len(start), np.int64)
        out[short] = found
        rest = np.flatnonzero(~short)
        if len(rest):
            raw = [buf[start[i] : end[i]].tobytes() for i in rest.tolist()]
            lacking = list({x for x in raw if x not in self.long})
            self.long.update(zip(lacking, self.table.add(self._pieces(lacking)).tolist(), strict=True))
            out[rest] = [self.long[x] for x in raw]
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        raw = [t.encode() for t in texts]
        together = b"".join(raw)  # holds whatever a text holds
        whole, lined = self._uncut(raw, together)
        odd = [i for i, w in enumerate(whole) if w]
        for i, x in zip(odd, self._raw([texts[i] for i in odd]) if odd else [], strict=True):
            out[i] = x
        cut = np.flatnonzero(~whole).tolist()
        raw = [raw[i] for i in cut]
        off = X.lengths_to_offsets([len(r) for r in raw])
        n = int(off[-1])
        buf = np.frombuffer((b"".join(raw) if odd else together) + bytes(24), np.uint8)
        begins = buf[:n] == 0x20
        ends = np.flatnonzero(buf[:n] == 0x0A)
        ends = ends[~lined[cut][np.searchsorted(off, ends, "right") - 1]]
        begins[ends] = True
        begins[ends[ends + 1 < n] + 1] = True
        begins[off[:-1][np.diff(off) > 0]] = True
        letter = _LETTER[buf]
        two = (buf[:-1] == 0xC3) & _AFTER_C3[buf[1:]]
        letter[:-1] |= two
        letter[1:] |= two
        # a piece of letters ends before a mark
        if n:
            begins[1:] |= letter[: n - 1] & _PUNCT[buf[1:n]]
        letters = np.zeros(len(buf) + 1, np.int32)
        np.cumsum(letter, out=letters[1:])
        start = np.flatnonzero(begins)
        end = np.append(start[1:], n)[: len(start)]
        first = np.searchsorted(start, off)
        ids, sizes = [], []
        for a in range(0, len(start), RANGE):
            if self.table.n + RANGE > MEMO:
                self._empty()
            got, size = self.table.gather(self._entries(buf, start[a : a + RANGE], end[a : a + RANGE], letters))
            ids.append(got)
            sizes.append(size)
        flat = np.concatenate(ids) if ids else np.zeros(0, self.type)
        edge = X.lengths_to_offsets(np.concatenate(sizes) if sizes else [])[first]
        for k, i in enumerate(cut):
            out[i] = flat[edge[k] : edge[k + 1]]
        return out


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def repair(ids: np.ndarray, vocab: int, limit: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, rules) with rules of shape (n, 2); rule j is symbol vocab + j.

    Ends when no pair has two places apart, or when the symbols of the width that fits ``vocab`` have run out (``limit``)."""
    seq = ids.astype(np.uint32)
    rules: list[np.ndarray] = []
    made = 0
    limit = limit if limit is not None else (1 << 16 if vocab < 1 << 16 else 1 << 32) - vocab
    least = len(seq)
    while made < limit and len(seq) > 1:
        n = len(seq)
        left, right = seq[:-1], seq[1:]
        slot = (left * np.uint32(0x9E3779B1) ^ right * np.uint32(0x85EBCA77)) >> np.uint32(32 - _TABLE_BITS)
        often = np.bincount(slot, minlength=1 << _TABLE_BITS)
        least = max(2, min(least, int(often.max()) // SPREAD))
        at = np.flatnonzero((often >= least)[slot])
        # in a run of one symbol every second place counts
        equal = (left[at] == right[at]) & (np.diff(at, prepend=-2) == 1)
        equal[1:] &= left[at[1:]] == left[at[:-1]]
        run = np.maximum.accumulate(np.where(equal, 0, np.arange(len(at))))
        at = at[(np.arange(len(at)) - run) % 2 == 0]
        pairs, which, count = _grouped(left[at], right[at])
        good = count >= least
        if not good.any():
            if least == 2:
                break
            least = max(2, least // SPREAD)
            continue
        take, named, taken = _places(at[good[which]], which[good[which]], len(pairs))
        if not (taken >= 2).any():  # places of different pairs overlap: the most frequent pair by itself
            top = which == np.where(good, count, 0).argmax()
            take, named, taken = _places(at[top], which[top], len(pairs))
        pays, room = taken >= 2, limit - made
        if pays.sum() > room:
            pays[np.argsort(-taken, kind="stable")[room:]] = False
        use = pays[named]
        take, named = take[use], named[use]
        used, name = np.unique(named, return_inverse=True)
        code = pairs[used]
        rules.append(np.stack([code >> np.uint64(32), code & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32))
        seq = seq.copy()
        seq[take] = vocab + made + name
        keep = np.ones(n, bool)
        keep[take + 1] = False
        seq = seq[keep]
        made += len(used)
    return seq, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)


def _grouped(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct pairs as left << 32 | right, the pair of each place, how often each occurs)."""
    if not len(left) or max(int(left.max()), int(right.max())) >= 1 << 16:
        return np.unique((left.astype(np.uint64) << np.uint64(32)) | right, return_inverse=True, return_counts=True)
    # pairs of 32 bits: sorting them with their places is faster than sorting places by them
    key = np.sort(((left << np.uint32(16) | right).astype(np.uint64) << np.uint64(32)) | np.arange(len(left), dtype=np.uint64))
    code = key >> np.uint64(32)
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    count = np.diff(np.append(first, len(code)))
    which = np.empty(len(code), np.int64)
    which[(key & np.uint64(0xFFFFFFFF)).astype(np.int64)] = np.repeat(np.arange(len(first)), count)
    pairs = code[first]
    return (pairs >> np.uint64(16)) << np.uint64(32) | (pairs & np.uint64(0xFFFF)), which, count


def _places(at: np.ndarray, which: np.ndarray, n_pairs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each run of adjacent places every second one, the pair of each, and how many every pair has got."""
    run = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) != 1, np.arange(len(at)), 0))
    take = (np.arange(len(at)) - run) % 2 == 0
    return at[take], which[take], np.bincount(which[take], minlength=n_pairs)


def expand(symbols: np.ndarray, rules: np.ndarray, vocab: int) -> np.ndarray:
    seq = symbols.astype(np.uint32)
    while True:
        deep = seq >= vocab
        if not deep.any():
            return seq
        at = np.zeros(len(seq), np.int64)
        np.cumsum(1 + deep[:-1], out=at[1:])
        out = np.empty(len(seq) + int(deep.sum()), np.uint32)
        out[at[~deep]] = seq[~deep]
        r = rules[seq[deep] - vocab]
        out[at[deep]], out[at[deep] + 1] = r[:, 0], r[:, 1]
        seq = out


def rule_sizes(rules: np.ndarray, vocab: int) -> np.ndarray:
    """Expansion lengths; a rule names earlier symbols only."""
    size = np.zeros(len(rules), np.uint32)
    todo = np.arange(len(rules))
    while len(todo):
        part = rules[todo].astype(np.int64) - vocab
        known = np.where(part < 0, 1, size[np.maximum(part, 0)])
        ready = (known > 0).all(1)
        size[todo[ready]] = known[ready].sum(1)
        todo = todo[~ready]
    return size


def pack(ids: np.ndarray, vocab: int) -> dict:
    symbols, rules = repair(ids, vocab)
    sizes = rule_sizes(rules, vocab)
    wide = vocab + len(rules) > 1 << 16
    kind = "<u4" if wide else "<u2"
    length = np.ones(len(symbols), np.int64)
    deep = symbols >= vocab
    length[deep] = sizes[symbols[deep] - vocab]
    before = np.cumsum(length) - length
    return {
        "vocab": vocab, "wide": wide, "symbols": symbols.astype(kind).tobytes(), "rules": rules.astype(kind).tobytes(),
        "rule_sizes": sizes.astype("<u4").tobytes(), "starts": before[::STRIDE].astype("<u4").tobytes(),
    }


def unpack(shard: dict) -> np.ndarray:
    """All ids of a shard."""
    kind = "<u4" if shard["wide"] else "<u2"
    return expand(np.frombuffer(shard["symbols"], kind), np.frombuffer(shard["rules"], kind).astype(np.uint32).reshape(-1, 2), shard["vocab"])


def read_range(shard: dict, lo: int, hi: int) -> np.ndarray:
    """Ids lo to hi of a shard; only the symbols that cover them are expanded."""
    kind = "<u4" if shard["wide"] else "<u2"
    starts = np.frombuffer(shard["starts"], "<u4")
    if lo >= hi or not len(starts):
        return np.zeros(0, np.uint32)
    i, j = max(0, int(np.searchsorted(starts, lo, "right")) - 1), int(np.searchsorted(starts, hi, "left"))
    symbols = np.frombuffer(shard["symbols"], kind)[i * STRIDE : j * STRIDE].astype(np.uint32)
    sizes, vocab = np.frombuffer(shard["rule_sizes"], "<u4"), shard["vocab"]
    length = np.ones(len(symbols), np.int64)
    length[symbols >= vocab] = sizes[symbols[symbols >= vocab] - vocab]
    at = int(starts[i]) + np.cumsum(length) - length
    cover = (at + length > lo) & (at < hi)
    rules = np.frombuffer(shard["rules"], kind).astype(np.uint32).reshape(-1, 2)
    ids = expand(symbols[cover], rules, vocab)
    skip = lo - int(at[cover][0]) if cover.any() else 0
    return ids[skip : skip + hi - lo]


def write(docs: DataFrame, path: str, tokenizer: str, shard_tokens: int = SHARD_TOKENS) -> None:
    """Write the shards of ``docs`` (doc_id, text) in ascending order of doc_id."""

    def run(batches):
        enc = encoder(tokenizer)
        part, block = TaskContext.get().partitionId(), 0
        ids, texts, size = [], [], 0
        done_ids, done, tokens = [], [], 0

        def flush():
            nonlocal done_ids, done, tokens, block
            flat = np.concatenate(done)
            row = {"part": part, "block": block, "n_tokens": len(flat), "doc_ids": done_ids, "doc_tokens": [len(x) for x in done], **pack(flat, enc.vocab)}
            done_ids, done, tokens, block = [], [], 0, block + 1
            return pa.RecordBatch.from_pylist([row], schema)

        def encode():
            nonlocal ids, texts, size, tokens
            end = np.array([END_ID], enc.type)
            for d, x in zip(ids, enc.encode(texts), strict=True):
                done_ids.append(d)
                done.append(np.concatenate([x, end]))
                tokens += len(x) + 1
                if tokens >= shard_tokens:
                    yield flush()
            ids, texts, size = [], [], 0

        for batch in batches:
            for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids.append(d)
                texts.append(t.as_py() or "")
                size += len(texts[-1])
                if size >= SLICE_DOCS_BYTES:
                    yield from encode()
        yield from encode()
        if done:
            yield flush()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(SHARDS))
    # rows that share an id, or are equal, can be split over tasks too
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("m"))
    ordered = keyed.repartitionByRange("doc_id", "h", "m").sortWithinPartitions("doc_id", "h", "m").select("doc_id", "text")
    ordered.mapInArrow(run, SHARDS).write.mode("overwrite").parquet(path)


def bases(shards: DataFrame) -> DataFrame:
    """(p, b, base): ids before each shard.  Sums are taken by shard, part and group of GROUP parts; only groups stand in one task."""
    up_to = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = shards.select("part", "block", "n_tokens")
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens")).withColumn("g", F.floor(F.col("part") / GROUP))
    groups = parts.groupBy("g").agg(F.sum("n_tokens").alias("n_tokens")).select("g", up_to(Window.orderBy("g")).alias("of_group"))
    parts = parts.select("part", "g", up_to(Window.partitionBy("g").orderBy("part")).alias("of_part")).join(groups, "g")
    rows = rows.select("part", "block", up_to(Window.partitionBy("part").orderBy("block")).alias("of_block")).join(parts, "part")
    return rows.select(F.col("part").alias("p"), F.col("block").alias("b"), (F.col("of_group") + F.col("of_part") + F.col("of_block")).alias("base"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    from pyspark.sql.types import StructType

    shards = spark.read.schema(StructType.fromDDL(SHARDS)).parquet(path)
    base = bases(shards)

    def run(batches):
        for batch in batches:
            for s in batch.to_pylist():
                ids = unpack(s).astype("<u4")
                off = np.cumsum([0, *s["doc_tokens"]])
                crc = [zlib.crc32(ids[off[i] : off[i + 1]].tobytes()) for i in range(len(s["doc_ids"]))]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([s["part"]] * len(crc), pa.int32()), pa.array([s["block"]] * len(crc), pa.int32()), pa.array(s["doc_ids"], pa.int64()),
                        pa.array(off[:-1]), pa.array(np.diff(off)), pa.array(crc, pa.int64()),
                    ],
                    ["part", "block", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    got = shards.mapInArrow(run, "part int, block int, doc_id long, at long, n_tokens long, ids_crc32 long")
    joined = got.join(base, (got["part"] == base["p"]) & (got["block"] == base["b"]))
    return joined.select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = S.Scratch(spark, "tokens")
    write(S.table(spark, sf_dir, "documents", "doc_id", "text"), f"{scratch.root}/shards", public_tokenizer("byte_bpe_50k.json"))
    scratch.free_shuffles()
    return read_documents(spark, f"{scratch.root}/shards")
