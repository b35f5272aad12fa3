"""Files built here by the public formats, decoded and compared with the samples that went in."""

import struct

import numpy as np
import pytest

from emulsion.operators import stages
from emulsion.sources import bmff, dng, lossless_jpeg, packed
from emulsion.sources.tiff import FormatError, Tiff

RNG = np.random.default_rng(7)


def pack(rows, bits, lsb=False):
    out = b""
    for row in rows:
        b = "".join((f"{v:0{bits}b}"[::-1] if lsb else f"{v:0{bits}b}") for v in map(int, row))
        b += "0" * (-len(b) % 8)
        out += bytes(int(b[i : i + 8][::-1] if lsb else b[i : i + 8], 2) for i in range(0, len(b), 8))
    return out


def ljpeg(img, precision, selection=1, shift=0, restart=0):
    """A plain encoder: every category has a code of five bits."""
    h, w, n = img.shape
    bits, parts = "", []
    v = img.astype(int) >> shift
    for y in range(h):
        top = y == 0 or restart and y % restart == 0
        if top and y:
            parts.append(bits)
            bits = ""
        for x in range(w):
            for c in range(n):
                a, b, d = (int(v[y, x - 1, c]) if x else 0), (int(v[y - 1, x, c]) if y else 0), (int(v[y - 1, x - 1, c]) if x and y else 0)
                p = (1 << precision - shift - 1) if top and not x else a if top else b if not x else [a, b, d, a + b - d, a + (b - d >> 1), b + (a - d >> 1), a + b >> 1][selection - 1]
                e = (int(v[y, x, c]) - p) & 0xFFFF
                e = e - 65536 if e > 32768 else e
                k = abs(e).bit_length()
                bits += f"{k:05b}" + ("" if k in (0, 16) else f"{e if e > 0 else e + (1 << k) - 1:0{k}b}")
    parts.append(bits)
    body = b""
    for i, b in enumerate(parts):
        b += "1" * (-len(b) % 8)
        raw = bytes(int(b[j : j + 8], 2) for j in range(0, len(b), 8)).replace(b"\xff", b"\xff\0")
        body += raw + (bytes([255, 0xD0 + i % 8]) if i + 1 < len(parts) else b"")
    seg = lambda m, p: bytes([255, m]) + struct.pack(">H", len(p) + 2) + p
    out = b"\xff\xd8" + seg(0xC4, bytes([0, 0, 0, 0, 0, 17] + [0] * 11) + bytes(range(17)))
    out += seg(0xC3, struct.pack(">BHHB", precision, h, w, n) + b"".join(bytes([i + 1, 0x11, 0]) for i in range(n)))
    if restart:
        out += seg(0xDD, struct.pack(">H", restart * w))
    return out + seg(0xDA, bytes([n]) + b"".join(bytes([i + 1, 0]) for i in range(n)) + bytes([selection, 0, shift])) + body + b"\xff\xd9"


def make_dng(segments, h, w, bits, compression, tile=None, rows=None, order="<", curve=None, version=(1, 4, 0, 0), twice=False):
    tags = [
        (254, 4, [0]), (256, 4, [w]), (257, 4, [h]), (258, 3, [bits]), (259, 3, [compression]), (262, 3, [32803]), (277, 3, [1]), (33421, 3, [2, 2]), (33422, 1, [0, 1, 1, 2]),
        (50706, 1, list(version)), (50728, 5, [1, 2, 1, 1, 1, 4]), (271, 2, b"Maker\0"),
    ]
    if curve is not None:
        tags.append((50712, 3, list(curve)))
    lengths = [len(s) for s in segments]
    tags += [(322, 4, [tile[1]]), (323, 4, [tile[0]]), (325, 4, lengths), (324, 4, None)] if tile else [(278, 4, [rows]), (279, 4, lengths), (273, 4, None)]
    tags.sort()
    head = 8 + 2 + 12 * len(tags) + 4
    extra, entries = b"", b""
    blobs = {}
    code = {1: "B", 3: "H", 4: "I", 5: "I"}
    for tag, kind, vals in tags:
        n = len(segments) if vals is None else len(vals)
        blobs[tag] = vals if kind == 2 else None if vals is None else struct.pack(order + code[kind] * n, *vals)
    size = sum(len(b) for b in blobs.values() if b and len(b) > 4) + (4 * len(segments) if len(segments) > 1 else 0)
    at = head + size
    offsets = []
    for s in segments:
        offsets.append(at)
        at += len(s)
    if twice and len(offsets) > 1:
        offsets[1] = offsets[0]
    for tag, kind, vals in tags:
        b = blobs[tag] if blobs[tag] is not None else struct.pack(order + "I" * len(offsets), *offsets)
        n = len(b) // {1: 1, 2: 1, 3: 2, 4: 4, 5: 8}[kind]
        if len(b) > 4:
            entries += struct.pack(order + "HHII", tag, kind, n, head + len(extra))
            extra += b
        else:
            entries += struct.pack(order + "HHI", tag, kind, n) + b.ljust(4, b"\0")
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8) + struct.pack(order + "H", len(tags)) + entries + struct.pack(order + "I", 0) + extra + b"".join(segments)


@pytest.mark.parametrize("bits", range(8, 17))
@pytest.mark.parametrize("lsb", [False, True])
def test_unpack(bits, lsb):
    rows = RNG.integers(0, 1 << bits, (3, 7))
    if bits == 16:
        assert (packed.unpack(rows.astype(">u2").tobytes(), 3, 7, 16, False) == rows).all()
    elif not (lsb and bits == 8):
        assert (packed.unpack(pack(rows, bits, lsb), 3, 7, bits, True, lsb) == rows).all()
    with pytest.raises(FormatError):
        packed.unpack(b"\0" * 5, 3, 7, bits, True)


def test_other_packings():
    rows = RNG.integers(0, 4096, (4, 8))
    raw = pack(rows, 12)
    swapped = b"".join(raw[i : i + 4][::-1] for i in range(0, len(raw), 4))
    assert (packed.unpack_swapped12(swapped, 4, 8) == rows).all()
    mosaic = RNG.integers(0, 999, (4, 6)).astype(np.uint16)
    assert (packed.interleave([mosaic[i // 2 :: 2, i % 2 :: 2] for i in range(4)]) == mosaic).all()
    wide = np.arange(28).reshape(4, 7)
    stored = np.concatenate([wide[:, :3].ravel(), wide[:, 3:6].ravel(), wide[:, 6:].ravel()])
    assert (packed.scatter_slices(stored, 4, 2, 3, 1) == wide).all()


@pytest.mark.parametrize("selection", range(1, 8))
@pytest.mark.parametrize("n", [1, 2])
def test_lossless_jpeg(selection, n):
    for precision, shift, restart in ((8, 0, 0), (14, 0, 2), (16, 0, 0), (12, 2, 3)):
        img = (RNG.integers(0, 1 << precision, (7, 9, n)) >> shift << shift).astype(np.uint16)
        got, p = lossless_jpeg.decode(ljpeg(img, precision, selection, shift, restart))
        assert p == precision and (got == img).all()


def test_lossless_jpeg_errors():
    good = ljpeg(RNG.integers(0, 256, (5, 5, 1)).astype(np.uint16), 8)
    for bad in (b"", b"\xff\xd8", good[:20], good[:-12], good[:2] + good[60:], good.replace(b"\xff\xc3", b"\xff\xc0")):
        with pytest.raises(FormatError):
            lossless_jpeg.decode(bad)


def test_lossless_jpeg_over_block_borders(monkeypatch):
    monkeypatch.setattr(lossless_jpeg, "BLOCK", 16)
    img = RNG.integers(0, 1 << 14, (20, 11, 3)).astype(np.uint16)
    assert (lossless_jpeg.decode(ljpeg(img, 14))[0] == img).all()


def test_dng(spark):
    h, w = 5, 7
    img = RNG.integers(0, 4096, (h, w)).astype(np.uint16)
    strips = [pack(img[y : y + 2], 12) for y in range(0, h, 2)]
    pad = np.zeros((8, 8), np.uint16)
    pad[:h, :w] = img
    cut = [pad[y : y + 4, x : x + 4] for y in (0, 4) for x in (0, 4)]
    curve = [3, 5, 9]
    files = [
        ("strips", make_dng(strips, h, w, 12, 1, rows=2)),
        ("tiles", make_dng([ljpeg(t.reshape(4, 2, 2), 12) for t in cut], h, w, 12, 7, tile=(4, 4), order=">")),
        ("curve", make_dng([(img % 5).astype("<u2").tobytes()], h, w, 16, 1, rows=h, curve=curve)),
        ("overlap", make_dng(strips, h, w, 12, 1, rows=2, twice=True)),
        ("version", make_dng(strips, h, w, 12, 1, rows=2, version=(1, 7, 2, 0))),
        ("short", make_dng(strips, h, w, 12, 1, rows=2)[:-1]),
        ("junk", b"junk"), ("empty", b""), ("none", None),
    ]
    df = spark.createDataFrame([(p, bytearray(c) if c is not None else None) for p, c in files], "path string, content binary")
    got = dng.decode(df).collect()
    bad = {r.path: r.error.kind for r in got if r.error}
    assert bad == {"overlap": "overlap", "version": "version", "short": "bounds", "junk": "header", "empty": "header", "none": "unreadable"}
    want = {"strips": img, "tiles": img, "curve": np.asarray(curve)[np.minimum(img % 5, 2)]}
    for name, image in want.items():
        out = np.full((h, w), -1)
        for r in got:
            if r.path == name:
                out[r.y : r.y + r.height, r.x : r.x + r.width] = np.reshape(r.samples, (r.height, r.width))
        assert (out == image).all(), name
    cells = {(r.y, r.x): r.value for r in dng.pixels(dng.decode(df.where("path = 'tiles'"))).collect()}
    assert len(cells) == h * w and all(cells[y, x] == img[y, x] for y in range(h) for x in range(w))
    meta = {r.path: r for r in dng.metadata(df).collect()}
    m = meta["strips"]
    assert (m.make, m.width, m.height, m.cfa, m.white, m.white_balance) == ("Maker", w, h, [0, 1, 1, 2], [4095.0], [2.0, 1.0, 4.0])
    assert meta["junk"].error.kind == "header"
    assert dng.directories(df.where("path = 'strips'")).count() == 15
    assert dng.decode(df.where("false")).count() == 0


def test_tiff_cycle():
    loop = b"II*\0" + struct.pack("<IHI", 8, 0, 8)
    with pytest.raises(FormatError, match="directory"):
        Tiff(loop).directories()


def test_sample_locations(spark):
    box = lambda kind, body: struct.pack(">I", 8 + len(body)) + kind + body
    full = lambda kind, *words: box(kind, b"\0" * 4 + struct.pack(f">{len(words)}I", *words))
    stbl = box(b"stbl", full(b"stsz", 0, 5, 10, 20, 30, 40, 50) + full(b"stsc", 2, 1, 2, 1, 3, 1, 1) + full(b"stco", 3, 100, 200, 300))
    trak = box(b"trak", full(b"tkhd", 0, 0, 7) + box(b"mdia", box(b"minf", stbl)))
    data = box(b"ftyp", b"crx ") + box(b"moov", trak) + struct.pack(">I", 0) + b"mdat" + b"xyz"
    files = spark.createDataFrame([("a", bytearray(data)), ("bad", bytearray(b"\0\0\0\x40moov"))], "path string, content binary")
    tree = bmff.box_table(files).where("path = 'a'").orderBy("box").collect()
    assert [r.kind for r in tree][:4] == ["ftyp", "moov", "trak", "tkhd"] and tree[-1].length == 3
    tables = bmff.sample_tables(files)
    assert tables.where("path = 'bad'").first().error.kind == "bounds"
    got = {r["sample"]: (r.track, r.start, r.length) for r in bmff.sample_locations(tables).collect()}
    assert got == {0: (7, 100, 10), 1: (7, 110, 20), 2: (7, 200, 30), 3: (7, 230, 40), 4: (7, 300, 50)}


def test_fail_stages(spark):
    rows = [
        ("a", 0, "done"), ("a", 1, "pending"), ("a", 2, "running"), ("a", 3, "pending"), ("b", 0, "pending"), ("b", 1, "pending"),
        ("c", 0, "failed"), ("c", 1, "pending"), ("d", 0, "done"), (None, 0, "running"), ("e", 0, None),
    ]
    out = stages.fail_stages(spark.createDataFrame(rows, "k string, i int, s string"), "k", "i", "s").collect()
    got = {(r.k, r.i): r.s for r in out}
    assert len(out) == len(rows) and [got["a", i] for i in range(4)] == ["done", "pending", "failed", "skipped"]
    assert (got["b", 0], got["b", 1], got["c", 1], got["d", 0], got[None, 0], got["e", 0]) == ("failed", "skipped", "pending", "done", "failed", None)


def test_admission(spark):
    log = [
        (1, 0, "attempt", None), (2, 10, "request", 1), (3, 20, "attempt", None), (4, 30, "request", 2), (5, 40, "finish", 1), (6, 500, "attempt", None),
        (7, 600, "finish", 2), (8, 800, "attempt", None), (9, 801, "attempt", None), (10, 801, "begin", None), (11, 900, "attempt", None), (12, 950, "end", None),
        (13, 960, "attempt", None), (14, 970, "defer", None), (15, 1000, "attempt", None),
    ]
    df = spark.createDataFrame([("g", *r) for r in log], "gate string, seq int, ms int, kind string, epoch int")
    got = {r.seq: r.admitted for r in stages.admit(df, "gate", ["seq"], df["ms"]).collect()}
    assert got == {1: True, 3: False, 6: False, 8: False, 9: True, 11: False, 13: True, 15: False}
    assert stages.first_latch(df, "gate", ["seq"], "epoch").first().epoch == 1
