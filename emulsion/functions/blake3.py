"""BLAKE3 from its published specification: hash and derive-key modes, in plain integers."""

from __future__ import annotations

import struct

# The initial state and message permutation of the specification
IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
PERMUTE = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
CHUNK_START, CHUNK_END, PARENT, ROOT, KEY_CONTEXT, KEY_MATERIAL = 1, 2, 4, 8, 32, 64
M = 0xFFFFFFFF


def _g(v, a, b, c, d, x, y):
    v[a] = (v[a] + v[b] + x) & M
    t = v[d] ^ v[a]
    v[d] = (t >> 16 | t << 16) & M
    v[c] = (v[c] + v[d]) & M
    t = v[b] ^ v[c]
    v[b] = (t >> 12 | t << 20) & M
    v[a] = (v[a] + v[b] + y) & M
    t = v[d] ^ v[a]
    v[d] = (t >> 8 | t << 24) & M
    v[c] = (v[c] + v[d]) & M
    t = v[b] ^ v[c]
    v[b] = (t >> 7 | t << 25) & M


def _compress(cv, block: bytes, counter: int, flags: int) -> list[int]:
    m = list(struct.unpack("<16I", block.ljust(64, b"\0")))
    v = [*cv, *IV[:4], counter & M, counter >> 32 & M, len(block), flags]
    for r in range(7):
        for i in range(4):
            _g(v, i, 4 + i, 8 + i, 12 + i, m[2 * i], m[2 * i + 1])
        for i in range(4):
            _g(v, i, 4 + (i + 1) % 4, 8 + (i + 2) % 4, 12 + (i + 3) % 4, m[8 + 2 * i], m[9 + 2 * i])
        if r < 6:
            m = [m[p] for p in PERMUTE]
    return [v[i] ^ v[i + 8] for i in range(8)]


def _node(data: bytes, key, flags: int, counter: int, root: bool) -> list[int]:
    if len(data) <= 1024:
        cv = list(key)
        blocks = [data[i : i + 64] for i in range(0, len(data), 64)] or [b""]
        for i, b in enumerate(blocks):
            f = flags | (CHUNK_START if i == 0 else 0)
            if i == len(blocks) - 1:
                f |= CHUNK_END | (ROOT if root else 0)
            cv = _compress(cv, b, counter, f)
        return cv
    chunks = -(-len(data) // 1024)
    left = 1 << (chunks - 1).bit_length() - 1
    a = _node(data[: left * 1024], key, flags, counter, False)
    b = _node(data[left * 1024 :], key, flags, counter + left, False)
    return _compress(key, struct.pack("<16I", *a, *b), 0, flags | PARENT | (ROOT if root else 0))


def blake3(data: bytes) -> bytes:
    return struct.pack("<8I", *_node(data, IV, 0, 0, True))


def derive_key(context: str, material: bytes) -> bytes:
    key = _node(context.encode(), IV, KEY_CONTEXT, 0, True)
    return struct.pack("<8I", *_node(material, key, KEY_MATERIAL, 0, True))
