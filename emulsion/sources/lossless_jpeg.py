"""Lossless JPEG (ITU-T T.81, SOF3) on numpy.

Huffman decoding is sequential, but what a code at a given bit would be isn't: for every bit position of the entropy data
the length of a code and its extra bits is looked up at once, and only the walk from code to code is a loop.
"""

from __future__ import annotations

import struct

import numpy as np

from .tiff import FormatError

SOI, EOI, SOF3, DHT, SOS, DRI = 0xD8, 0xD9, 0xC3, 0xC4, 0xDA, 0xDD
MAX_SAMPLES = 128 << 20
BLOCK = 1 << 17  #: bytes whose bit positions are tabulated at a time


def _table(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Code length (0: no code) and category for each 16-bit prefix."""
    length, category = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
    code, k = 0, 0
    for bits, n in enumerate(counts, 1):
        for _ in range(n):
            if code >> bits or symbols[k] > 16:
                raise FormatError("huffman", "overfull table or category over 16")
            at = slice(code << 16 - bits, code + 1 << 16 - bits)
            length[at], category[at] = bits, symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return length, category


def _entropy(data: bytes, at: int) -> tuple[list[np.ndarray], int]:
    """Unstuffed entropy data between restart markers, and where the next other marker stands."""
    b = np.frombuffer(data, np.uint8)
    ff = at + np.flatnonzero(b[at:-1] == 255)
    marks = ff[(b[ff + 1] != 0) & (b[ff + 1] != 255)]
    rst = (b[marks + 1] & 0xF8) == 0xD0
    stop = np.flatnonzero(~rst)
    end = int(marks[stop[0]]) if len(stop) else len(data)
    cuts = marks[: stop[0]] if len(stop) else marks
    if [int(x) & 7 for x in b[cuts + 1]] != [i & 7 for i in range(len(cuts))]:
        raise FormatError("restart", "restart markers out of order")
    parts, start = [], at
    for cut in [*map(int, cuts), end]:
        part = b[start:cut]
        keep = np.ones(len(part), bool)
        keep[1:] = ~((part[:-1] == 255) & (part[1:] == 0))
        parts.append(part[keep])
        start = cut + 2
    return parts, end


def _differences(part: np.ndarray, tables: list, n: int) -> np.ndarray:
    """``n`` differences, whose tables take turns."""
    total = 8 * len(part)
    b = np.concatenate([part, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.empty(n, np.int64)
    done, bit = 0, 0
    k = len(tables)
    while done < n:
        if bit >= total:
            raise FormatError("truncated", "entropy data ends early")
        first = bit >> 3
        last = min(first + BLOCK, len(part))
        w = b[first:last] << 16 | b[first + 1 : last + 1] << 8 | b[first + 2 : last + 2]
        window = (w[:, None] >> np.arange(8, 0, -1, dtype=np.uint64) & 0xFFFF).reshape(-1)
        step = []
        for length, category in tables:
            ln, cat = length[window], category[window]
            step.append(np.where(ln == 0, 0, ln + np.where(cat == 16, 0, cat)).tolist())
        p, limit, at, base = bit - 8 * first, 8 * (last - first), [], done
        if k == 1:
            s = step[0]
            while p < limit and base + len(at) < n:
                at.append(p)
                p += s[p] or limit
        else:
            while p < limit and base + len(at) < n:
                at.append(p)
                p += step[(base + len(at) - 1) % k][p] or limit
        pos = np.asarray(at, np.int64)
        turn = (base + np.arange(len(pos))) % k
        for t, (length, category) in enumerate(tables):
            mine = pos[turn == t]
            ln, cat = length[window[mine]].astype(np.int64), category[window[mine]].astype(np.int64)
            if (ln == 0).any():
                raise FormatError("huffman", "no such code")
            q = mine + 8 * first + ln
            byte = q >> 3
            word = np.zeros(len(q), np.uint64)
            for j in range(4):
                word = word << 8 | b[np.minimum(byte + j, len(b) - 1)]
            extra = (word >> (32 - (q & 7) - cat).clip(0).astype(np.uint64)).astype(np.int64) & (1 << cat) - 1
            extra = np.where(cat == 16, 32768, extra)
            low = (cat > 0) & (cat < 16) & (extra < 1 << np.maximum(cat - 1, 0))
            got = np.where(low, extra - (1 << cat) + 1, extra)
            out[done : done + len(pos)][turn == t] = np.where(cat == 0, 0, got)
        done, bit = done + len(pos), p + 8 * first
    if bit > total:
        raise FormatError("truncated", "entropy data ends early")
    return out


def _predict(d: np.ndarray, selection: int, seed: int, precision: int) -> np.ndarray:
    """Rows of one component from differences: seed, left in the first row, above in the first column, modulo 2**16."""
    d = d.copy()
    d[0, 0] += seed
    if selection == 1:
        d[:, 0] = np.cumsum(d[:, 0])
        out = np.cumsum(d, 1) & 0xFFFF
    else:
        out = np.zeros(d.shape, np.int64)
        out[0] = np.cumsum(d[0]) & 0xFFFF
        left = np.cumsum(np.concatenate([out[0, :1], d[1:, 0]])) & 0xFFFF
        for y in range(1, len(d)):
            above, row = out[y - 1], d[y]
            if selection == 2:
                line = row + above
            elif selection == 3:
                line = row + np.concatenate([above[:1], above[:-1]])
            elif selection in (4, 5):
                lean = above[1:] - above[:-1]
                line = row.copy()
                line[1:] += lean if selection == 4 else lean >> 1
                line[0] = left[y]
                line = np.cumsum(line)
            else:
                line, a, diff = np.empty_like(row), above.tolist(), row.tolist()
                x = int(left[y])
                line[0] = x
                for i in range(1, len(diff)):
                    x = diff[i] + (a[i] + (x - a[i - 1] >> 1) if selection == 6 else x + a[i] >> 1) & 0xFFFF
                    line[i] = x
            line[0] = left[y]
            out[y] = line & 0xFFFF
    if (out >> precision).any():
        raise FormatError("range", f"sample over {precision} bits")
    return out


def decode(data: bytes) -> tuple[np.ndarray, int]:
    """Samples of shape (height, width, components) as uint16, and the precision."""
    if data[:2] != b"\xff\xd8":
        raise FormatError("marker", "no start of image")
    at, tables, frame, interval, out, seen = 2, {}, None, 0, None, set()
    while True:
        while data[at : at + 2] == b"\xff\xff":
            at += 1
        if at + 2 > len(data) or data[at] != 255:
            raise FormatError("marker", f"no marker at {at}")
        mark = data[at + 1]
        if mark == EOI:
            break
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        if size < 2 or len(body) != size - 2:
            raise FormatError("bounds", f"segment at {at}")
        at += 2 + size
        try:
            if mark == DHT:
                while body:
                    n = sum(body[1:17])
                    if body[0] > 3 or len(body) < 17 + n or not n:
                        raise FormatError("huffman", "table header")
                    tables[body[0]] = _table(body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif mark == DRI:
                (interval,) = struct.unpack(">H", body)
            elif mark == SOF3:
                precision, h, w, n = struct.unpack_from(">BHHB", body)
                ids = [body[6 + 3 * i] for i in range(n)]
                if frame or not 2 <= precision <= 16 or not 1 <= n <= 4 or not h or not w or h * w * n > MAX_SAMPLES or len(set(ids)) != n:
                    raise FormatError("frame", "unsupported frame")
                if any(body[7 + 3 * i] != 0x11 for i in range(n)):
                    raise FormatError("subsampling", "components must have one size")
                frame, out = (precision, h, w, ids), np.zeros((h, w, n), np.uint16)
            elif 0xC0 <= mark <= 0xCF and mark != 0xCC:
                raise FormatError("frame", f"frame type {mark:#x} isn't lossless Huffman")
            elif mark == SOS:
                if not frame:
                    raise FormatError("scan", "scan before frame")
                precision, h, w, ids = frame
                n = body[0]
                chosen = [(ids.index(body[1 + 2 * i]), body[2 + 2 * i] >> 4) for i in range(n)]
                selection, shift = body[1 + 2 * n], body[3 + 2 * n] & 15
                if not 1 <= selection <= 7 or body[3 + 2 * n] >> 4 or shift >= precision or any(c in seen for c, _ in chosen):
                    raise FormatError("scan", "scan header")
                if interval % w:
                    raise FormatError("restart", "interval isn't whole rows")
                parts, at = _entropy(data, at)
                rows = interval // w or h
                if len(parts) != -(-h // rows):
                    raise FormatError("restart", "number of intervals")
                for i, part in enumerate(parts):
                    y0, y1 = i * rows, min(h, (i + 1) * rows)
                    d = _differences(part, [tables[t] for _, t in chosen], (y1 - y0) * w * n).reshape(y1 - y0, w, n)
                    for j, (c, _) in enumerate(chosen):
                        out[y0:y1, :, c] = _predict(d[:, :, j], selection, 1 << precision - shift - 1, precision - shift) << shift
                seen |= {c for c, _ in chosen}
        except (KeyError, IndexError, ValueError, struct.error) as e:
            raise e if isinstance(e, FormatError) else FormatError("segment", f"marker {mark:#x}: {e}") from e
    if frame is None or len(seen) != len(frame[3]):
        raise FormatError("scan", "components without a scan")
    return out, frame[0]
