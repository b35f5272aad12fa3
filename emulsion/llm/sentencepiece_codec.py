"""SentencePiece encoding and decoding by a streaming Viterbi search.

The search keeps one best last piece for each position of a window no longer than the longest piece, with a backpointer to where
that piece begins.  Whenever all backpointer paths that survive in the window pass one boundary, the ids before it are
committed and forgotten, so a text of any length is encoded in memory bounded by the piece length.

Both kinds of model file are read from their own bytes:
- unigram models: the best path is the one of the greatest sum of piece scores;
- byte-pair models: the best last piece of a prefix is the one that is compatible with the best last piece before it, that is,
  byte-pair merging of the two pieces' text gives the two pieces back.  Merging is consistent on prefixes, so there is exactly
  one, and the path is what merging by score gives on the whole text.
Characters without a piece become byte pieces (or the unknown id).

A piece never continues across a word mark that follows another character, nor from a letter to a character that no piece
joins to letters, so all paths meet there and the search commits; what it gives for equal words between such places is
remembered (two generations of MEMO words at most).

Defined cases: a null text is the empty text and has no ids; rows stand for themselves, so ids may repeat or be null; an empty table gives
an empty result; texts of any length are encoded whole; ``roundtrip`` keeps all columns and appends underscores to the names of its own
where a column has them.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _spark as S
from ._text import list_array
from .token_output import public_tokenizer

MARK = "▁"
MEMO = 450_000
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _varint(data: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[i]
        i += 1
        value |= (b & 0x7F) << shift
        if b < 0x80:
            return value, i
        shift += 7


def _fields(data: bytes):
    """(number, value) of a protocol buffer message; fixed 32-bit values come as 4 bytes."""
    i = 0
    while i < len(data):
        tag, i = _varint(data, i)
        kind = tag & 7
        if kind == 0:
            value, i = _varint(data, i)
        elif kind == 2:
            n, i = _varint(data, i)
            value, i = data[i : i + n], i + n
        else:
            n = 4 if kind == 5 else 8
            value, i = data[i : i + n], i + n
        yield tag >> 3, value


class Model:
    """The pieces of a model file with the settings that encoding needs."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        self.kind, self.dummy_prefix, self.squeeze, self.escape, self.byte_fallback = UNIGRAM, True, True, True, False
        for number, value in _fields(data):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, v in _fields(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        score = float(np.frombuffer(v, "<f4")[0])
                    elif n == 3:
                        kind = v
                self.pieces.append(piece)
                self.scores.append(score)
                self.types.append(kind)
            elif number == 2:
                for n, v in _fields(value):
                    if n == 3:
                        self.kind = v
                    elif n == 35:
                        self.byte_fallback = bool(v)
            elif number == 3:
                for n, v in _fields(value):
                    if n == 2 and v:
                        raise ValueError("only identity normalisation is supported")
                    if n in (3, 4, 5):
                        setattr(self, {3: "dummy_prefix", 4: "squeeze", 5: "escape"}[n], bool(v))
        if self.kind not in (UNIGRAM, BPE) or USER in self.types:
            raise ValueError("only unigram and byte-pair models without user-defined pieces are supported")
        self.unknown = self.types.index(UNKNOWN)
        self.byte = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == BYTE}
        self.byte_value = {i: b for b, i in self.byte.items()}
        self.byte_fallback &= len(self.byte) == 256
        self.index = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == NORMAL}
        self.longest = max((len(p) for p in self.index), default=1)
        self.floor = min((self.scores[i] for i in self.index.values()), default=0.0) - 10.0

    def spaced(self, text: str) -> str:
        """The normalised text with spaces for word marks: most texts then take a byte for each character."""
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        if self.dummy_prefix:
            text = " " + text
        return text.replace(MARK, " ") if self.escape else text

    def normalise(self, text: str) -> str:
        text = self.spaced(text)
        return text.replace(" ", MARK) if self.escape else text


class Codec:
    def __init__(self, data: bytes):
        self.model = Model(data)
        self.pairs: dict[int, bool] = {}
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        m = self.model
        raw = [x.encode() for x in m.pieces]
        self.piece_bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.piece_size = np.array([len(x) for x in raw], np.int64)
        self.piece_start = np.cumsum(self.piece_size) - self.piece_size
        self.plain = np.array(m.types) == NORMAL
        # characters that pieces join only to one another (and to a mark before them)
        apart = {chr(c) for c in range(33, 127) if not chr(c).isalnum()} | set("\n\t\r")
        while True:
            joined = {c for p in m.index if len(p) > 1 and not set(p.lstrip(MARK)) <= apart for c in p}
            if not apart & joined:
                break
            apart -= joined
        apart = "".join(sorted(apart))
        apart = re.escape(apart)
        mark = " " if m.escape else MARK
        self.words = re.compile(f"{mark}*[^{mark}{apart}]+|{mark}*[{apart}]+|{mark}+")
        if m.kind == BPE:
            # a piece that merging its own characters does not give can be no part of a result
            self.parts: dict[int, tuple[int, int] | None] = {}
            for p, i in m.index.items():
                top = self._last_merge(p)
                if top is not None:
                    self.parts[i] = top or None
            self.usable = {p: i for p, i in m.index.items() if i in self.parts}
            self.born = {i: -1.0 if len(p) == 1 else -m.scores[i] for p, i in m.index.items()}
        else:
            self.usable = m.index
            m.scores = [np.float32(x) for x in m.scores]  # sums round as in the library
        # piece -> id, and -1 for what only ends a piece
        self.table = dict.fromkeys((p[n:] for p in self.usable for n in range(1, len(p))), -1) | self.usable

    # ---- byte-pair compatibility
    def _merge(self, symbols: list[str], until: int = 1) -> list[str]:
        """Merge the adjacent pair of the best score, leftmost first, until ``until`` symbols are left or no pair is a piece."""
        index, scores = self.model.index, self.model.scores
        while len(symbols) > until:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                k = index.get(symbols[i] + symbols[i + 1])
                if k is not None and (best is None or scores[k] > best):
                    best, at = scores[k], i
            if at < 0:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def _last_merge(self, piece: str):
        """The two pieces of a piece's last merge, () for a single character, None if merging does not give the piece."""
        if len(piece) == 1:
            return ()
        two = self._merge(list(piece), 2)
        if len(two) != 2 or any(x not in self.model.index for x in two):
            return None
        return self.model.index[two[0]], self.model.index[two[1]]

    def compatible(self, u: int, t: int) -> bool:
        """Does merging the text of the two pieces give them back?

        The merges of both are undone, the latest first; no pair across the seam may be a piece that was due before."""
        key = u << 32 | t
        known = self.pairs.get(key)
        if known is not None:
            return known
        pieces, index, born, parts = self.model.pieces, self.model.index, self.born, self.parts
        limit, known = float("inf"), True
        while True:
            k = index.get(pieces[u] + pieces[t])
            if k is not None and born[k] < limit:
                known = False
                break
            if born[u] > born[t]:
                limit, u = born[u], parts[u][1]
            elif parts[t] is None:
                break
            else:
                limit, t = born[t] + 1, parts[t][0]
        if len(self.pairs) > 4 * MEMO:
            self.pairs.clear()
        self.pairs[key] = known
        return known

    # ---- the search
    def unknown_ids(self, ch: str) -> tuple[int, ...]:
        m = self.model
        return tuple(m.byte[b] for b in ch.encode("utf-8", "surrogatepass")) if m.byte_fallback else (m.unknown,)

    def stream(self, chars):
        """Ids of normalised text, given as any iterable of characters and yielded as soon as they are certain.

        Positions count from the last commit.  last[p] is the best piece that ends at p, or None where no path ends;
        a character without a piece is a boundary that all paths share."""
        m, usable, bpe, table, pairs = self.model, self.usable, self.model.kind == BPE, self.table.get, self.pairs.get
        longest = m.longest
        window, p = "", 0
        last: list[int | None] = [None]
        back: list[int] = [0]
        cost: list[float] = [0.0]
        live: list[bool] = [True]

        def path(to: int) -> list[int]:
            out = []
            while to:
                out.append(last[to])
                to = back[to]
            return out[::-1]

        for ch in chars:
            window += ch
            p += 1
            best, frm, top = None, -1, 0.0
            for q in range(p - 1, max(p - longest, 0) - 1, -1):
                t = table(window[q:])
                if t is None:
                    break  # no longer piece ends so
                if t < 0 or not live[q]:
                    continue
                if bpe:
                    u = last[q]
                    if u is not None:
                        ok = pairs(u << 32 | t)
                        if not (ok or (ok is None and self.compatible(u, t))):
                            continue
                    best, frm = t, q
                    break
                s = cost[q] + m.scores[t]
                if best is None or s >= top:
                    best, frm, top = t, q, s
            single = usable.get(ch)
            if single is None:
                if bpe and best is None:
                    # nothing merges with such a character: all before it is settled
                    yield from path(p - 1)
                    yield from self.unknown_ids(ch)
                    window, p, last, back, cost, live = "", 0, [None], [0], [0.0], [True]
                    continue
                if not bpe and live[p - 1]:
                    s = cost[p - 1] + m.floor
                    if best is None or s > top:
                        best, frm, top = -ord(ch) - 1, p - 1, s
            last.append(best)
            back.append(frm)
            cost.append(top)
            live.append(best is not None)
            if p >= 4 * longest:
                # where the paths of all positions within reach of the next piece meet
                reach = [q for q in range(p - longest + 1, p + 1) if live[q]]
                heads = set(reach)
                while len(heads) > 1:
                    far = max(heads)
                    heads.remove(far)
                    heads.add(back[far])
                at = heads.pop()
                if at:
                    for t in path(at):
                        yield from (t,) if t >= 0 else self.unknown_ids(chr(-t - 1))
                    prior = last[at]
                    window, p = window[at:], p - at
                    last, back, cost, live = last[at:], [b - at for b in back[at:]], cost[at:], live[at:]
                    last[0], back[0] = (prior if bpe else None), 0
                    base = cost[0]
                    cost = [c - base for c in cost]
        for t in path(len(window)):
            yield from (t,) if t >= 0 else self.unknown_ids(chr(-t - 1))

    # ---- texts
    def _search(self, word: str) -> bytes:
        """The ids of a word, as little-endian 32-bit numbers."""
        known = self.new.get(word) or self.old.get(word) or np.fromiter(self.stream(word.replace(" ", MARK) if self.model.escape else word), "<i4").tobytes()
        if len(word) <= 64:
            if len(self.new) >= MEMO:
                self.old, self.new = self.new, {}
            self.new[word] = known
        return known

    def ids(self, text: str | None) -> np.ndarray:
        words = self.words.findall(self.model.spaced(text or ""))
        parts = list(map(self.new.get, words))
        if None in parts:
            parts = [self._search(w) if x is None else x for w, x in zip(words, parts, strict=True)]
        return np.frombuffer(b"".join(parts), "<i4")

    def encode(self, text: str | None) -> list[int]:
        return self.ids(text).tolist()

    def decode(self, ids) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD, one for each byte; control ids are silent."""
        m = self.model
        ids = np.asarray(ids, np.int64)
        if self.plain[ids].all():  # the pieces' bytes one after another
            size = self.piece_size[ids]
            end = np.cumsum(size)
            at = np.repeat(self.piece_start[ids] - end + size, size) + np.arange(int(end[-1]) if len(end) else 0)
            text = self.piece_bytes[at].tobytes().decode()
        else:
            text = self._decode_odd(ids.tolist())
        if m.escape:
            text = text.replace(MARK, " ")
        return text[1:] if m.dummy_prefix and text.startswith(" ") else text

    def _decode_odd(self, ids: list[int]) -> str:
        m = self.model
        parts: list[str] = []
        raw = bytearray()
        for i in ids:
            b = m.byte_value.get(i)
            if b is not None:
                raw.append(b)
                continue
            if raw:
                parts.append(_utf8(bytes(raw)))
                raw.clear()
            if m.types[i] == UNKNOWN:
                parts.append(" ⁇ ")
            elif m.types[i] != CONTROL:
                parts.append(m.pieces[i])
        if raw:
            parts.append(_utf8(bytes(raw)))
        return "".join(parts)


def _utf8(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[i : i + n].decode())
                    i += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                i += 1
        return "".join(out)


@lru_cache(2)
def codec(path: str) -> Codec:
    with open(path, "rb") as f:
        return Codec(f.read())


def encode_ids(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, same): the ids of every text and whether decoding gives the text back.

    The word mark itself reads back as a space, so a text that holds it is compared with its mark replaced."""

    def run(batches):
        c = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [x.as_py() or "" for x in part.column("text")]
                ids = [c.ids(t) for t in texts]
                same = [c.decode(i) == t.replace(MARK, " ") for i, t in zip(ids, texts, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), list_array(pa.array(np.concatenate(ids)), [len(i) for i in ids]), pa.array(same)], ["doc_id", "ids", "same"]
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>, same boolean")


def roundtrip(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with new columns token_ids (array<int>), n_tokens and decoded (the text read back from the ids)."""
    from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

    kinds = {"token_ids": ArrayType(IntegerType()), "n_tokens": LongType(), "decoded": StringType()}
    added = {S.free_name(docs.columns, name): kind for name, kind in kinds.items()}
    schema = StructType(list(docs.schema.fields))
    for name, kind in added.items():
        schema = schema.add(name, kind)

    def run(batches):
        c = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [c.ids(x.as_py()) for x in part.column("text")]
                size = [len(i) for i in ids]
                cols = [list_array(pa.array(np.concatenate(ids)), size), pa.array(size, pa.int64()), pa.array([c.decode(i) for i in ids], pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns, *cols], [*part.schema.names, *added])

    return S.map_batches(docs, run, schema)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of the ids as little-endian u32) and whether decoding gives the text back."""

    def run(batches):
        c = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for x in part.column("text"):
                    t = x.as_py() or ""
                    ids = c.ids(t)
                    rows.append((len(ids), zlib.crc32(ids.tobytes()), c.decode(ids) == t.replace(MARK, " ")))
                n, crc, same = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(same)], ["doc_id", "n_pieces", "ids_crc32", "decodes"])

    path = public_tokenizer("piece_bpe_32k.model")
    docs = S.table(spark, sf_dir, "documents", "doc_id", "text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, decodes boolean")
