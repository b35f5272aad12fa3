"""Sample packings as numpy: whole rows at once, exact row lengths required."""

from __future__ import annotations

import numpy as np

from .tiff import FormatError


def row_bytes(width: int, bits: int) -> int:
    return -(-width * bits // 8)


def _bits(rows: np.ndarray, width: int, bits: int, order: str) -> np.ndarray:
    b = np.unpackbits(rows, axis=1, bitorder=order)[:, : width * bits].reshape(len(rows), width, bits)
    weight = 1 << np.arange(bits, dtype=np.uint32)
    return (b @ (weight[::-1] if order == "big" else weight)).astype(np.uint16)


def unpack(data: bytes, height: int, width: int, bits: int, little: bool, lsb_first: bool = False) -> np.ndarray:
    """Rows of 8-bit, 16-bit (in the container's order) or packed samples; each row starts on a byte."""
    if not 8 <= bits <= 16:
        raise FormatError("bits", f"{bits} bits a sample")
    per_row = row_bytes(width, bits)
    if len(data) != height * per_row:
        raise FormatError("segment_length", f"{len(data)} bytes for {height} rows of {per_row}")
    rows = np.frombuffer(data, np.uint8).reshape(height, per_row)
    if bits == 8:
        return rows.astype(np.uint16)
    if bits == 16:
        return rows.view("<u2" if little else ">u2").astype(np.uint16)
    return _bits(rows, width, bits, "little" if lsb_first else "big")


def unpack_swapped12(data: bytes, height: int, width: int) -> np.ndarray:
    """Twelve-bit samples, high bits first, in 32-bit words whose bytes are reversed; bytes past the end are 0."""
    per_row = row_bytes(width, 12)
    padded = np.frombuffer(data.ljust(-(-max(len(data), height * per_row) // 4) * 4, b"\0"), np.uint8)
    words = padded.reshape(-1, 4)[:, ::-1].reshape(-1)[: height * per_row]
    return _bits(words.reshape(height, per_row), width, 12, "big")


def interleave(planes: list[np.ndarray]) -> np.ndarray:
    """Four parity planes, in the order of the cells of a 2x2 block, to one mosaic."""
    h, w = planes[0].shape
    if len(planes) != 4 or any(p.shape != (h, w) for p in planes):
        raise FormatError("planes", "four planes of one shape are needed")
    out = np.empty((2 * h, 2 * w), np.uint16)
    for i, p in enumerate(planes):
        out[i // 2 :: 2, i % 2 :: 2] = p
    return out


def scatter_slices(samples: np.ndarray, height: int, count: int, width: int, last: int) -> np.ndarray:
    """Samples stored as vertical slices, ``count`` of ``width`` columns and one of ``last``, to rows."""
    if samples.size != height * (count * width + last):
        raise FormatError("slices", "slices don't cover the image")
    cut = count * width * height
    body = samples[:cut].reshape(count, height, width).transpose(1, 0, 2).reshape(height, count * width)
    return np.hstack([body, samples[cut:].reshape(height, last)])
