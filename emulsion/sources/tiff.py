"""TIFF and BigTIFF directories from bytes, by the public TIFF 6.0 and BigTIFF layouts."""

from __future__ import annotations

import struct
from dataclasses import dataclass
from functools import cached_property

# Type number -> struct code; 2 is text, 7 opaque, 13 and 18 directory offsets
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
CLASSIC, BIG = (42, 0x4F52, 0x5352, 0x55), 43
UNSIGNED = (1, 3, 4, 13, 16, 18)
SUB_IFDS = 330
MAX_DIRECTORIES, MAX_DEPTH, MAX_ENTRIES = 256, 32, 65536


class FormatError(ValueError):
    """A file that breaks its format; ``kind`` is a short name."""

    def __init__(self, kind: str, message: str = ""):
        super().__init__(message or kind)
        self.kind = kind


@dataclass(frozen=True)
class Entry:
    tag: int
    type: int
    count: int
    raw: bytes
    order: str

    @cached_property
    def values(self) -> tuple:
        """Numbers of the entry: integers, floats, or quotients of rationals."""
        code = TYPES[self.type]
        if self.type == 2:
            raise FormatError("type", f"tag {self.tag} is text")
        flat = struct.unpack(self.order + code[0] * (self.count * len(code)), self.raw)
        if len(code) == 1:
            return flat
        if not all(flat[1::2]):
            raise FormatError("zero_denominator", f"tag {self.tag}")
        return tuple(n / d for n, d in zip(flat[::2], flat[1::2], strict=True))

    @property
    def unsigned(self) -> tuple[int, ...]:
        if self.type not in UNSIGNED:
            raise FormatError("type", f"tag {self.tag} has type {self.type}")
        return self.values

    @property
    def text(self) -> str:
        if self.type != 2:
            raise FormatError("type", f"tag {self.tag} is no text")
        return self.raw.split(b"\0", 1)[0].decode("ascii", "replace")


class Directory:
    """One directory; a tag that stands twice is an error where it is looked up."""

    def __init__(self, offset: int, depth: int, entries: list[Entry], following: int):
        self.offset, self.depth, self.entries, self.following = offset, depth, entries, following

    def get(self, tag: int) -> Entry | None:
        found = [e for e in self.entries if e.tag == tag]
        if len(found) > 1:
            raise FormatError("duplicate_tag", f"tag {tag}")
        return found[0] if found else None

    def need(self, tag: int) -> Entry:
        if (e := self.get(tag)) is None:
            raise FormatError("missing_tag", f"tag {tag}")
        return e

    def scalar(self, tag: int, default: int | None = None) -> int:
        e = self.get(tag) if default is not None else self.need(tag)
        if e is None:
            return default
        if e.count != 1:
            raise FormatError("tag_count", f"tag {tag} has {e.count} values")
        return e.unsigned[0]


class Tiff:
    def __init__(self, data: bytes):
        self.data = data
        self.order = {b"II": "<", b"MM": ">"}.get(data[:2])
        if not self.order or len(data) < 8:
            raise FormatError("header", "no byte order mark")
        magic = self._read("H", 2)
        self.big = magic == BIG
        if self.big:
            if self._read("HH", 4) != (8, 0):
                raise FormatError("header", "BigTIFF offset size")
            self.first = self._read("Q", 8)
        elif magic in CLASSIC:
            self.first = self._read("I", 4)
        else:
            raise FormatError("header", f"magic {magic}")

    def _read(self, code: str, at: int):
        size = struct.calcsize(self.order + code)
        if at < 0 or at + size > len(self.data):
            raise FormatError("bounds", f"{size} bytes at {at}")
        got = struct.unpack_from(self.order + code, self.data, at)
        return got[0] if len(got) == 1 else got

    def slice(self, at: int, size: int) -> bytes:
        if at + size > len(self.data):
            raise FormatError("bounds", f"{size} bytes at {at}")
        return bytes(self.data[at : at + size])

    def directory(self, at: int, depth: int = 0) -> Directory:
        n, step, head = (self._read("Q", at), 20, 8) if self.big else (self._read("H", at), 12, 2)
        if n > MAX_ENTRIES:
            raise FormatError("limit", f"{n} entries")
        entries, inline, word = [], 8 if self.big else 4, "Q" if self.big else "I"
        for i in range(n):
            p = at + head + i * step
            tag, kind = self._read("HH", p)
            count = self._read(word, p + 4)
            if kind not in TYPES:
                continue
            size = count * (1 if kind == 2 else struct.calcsize("<" + TYPES[kind]))
            value = p + 4 + inline
            entries.append(Entry(tag, kind, count, self.slice(value if size <= inline else self._read(word, value), size), self.order))
        return Directory(at, depth, entries, self._read(word, at + head + n * step))

    def directories(self) -> list[Directory]:
        """Breadth-first over next-directory chains and sub-directories; a cycle, depth or number beyond the limits is an error."""
        queue, seen, out = [(self.first, 0)], set(), []
        while queue:
            at, depth = queue.pop(0)
            if at in seen:
                raise FormatError("cycle", f"directory at {at}")
            if depth > MAX_DEPTH or len(seen) >= MAX_DIRECTORIES:
                raise FormatError("limit", "directories")
            seen.add(at)
            d = self.directory(at, depth)
            out.append(d)
            if d.following:
                queue.append((d.following, depth))
            if sub := d.get(SUB_IFDS):
                queue.extend((o, depth + 1) for o in sub.unsigned if o)
        return out
