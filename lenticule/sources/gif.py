"""GIF89a bytes of looping animations, and PNG bytes of single pictures."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from ..operators.raster import palette, to_indices


def lzw(codes: bytes, depth: int) -> bytes:
    """GIF's variable-length LZW of palette indices, in sub-blocks."""
    clear, end = 1 << depth, (1 << depth) + 1
    table: dict[tuple[int, int], int] = {}
    nxt, size, acc, bits = end + 1, depth + 1, 0, 0
    out = bytearray()

    def put(code: int) -> None:
        nonlocal acc, bits
        acc |= code << bits
        bits += size
        while bits >= 8:
            out.append(acc & 255)
            acc >>= 8
            bits -= 8

    put(clear)
    prefix = -1
    for c in codes:
        if prefix < 0:
            prefix = c
            continue
        known = table.get((prefix, c))
        if known is not None:
            prefix = known
            continue
        put(prefix)
        if nxt < 4096:
            table[prefix, c] = nxt
            if nxt == 1 << size and size < 12:
                size += 1
            nxt += 1
        else:
            put(clear)
            table, nxt, size = {}, end + 1, depth + 1
        prefix = c
    if prefix >= 0:
        put(prefix)
    put(end)
    if bits:
        out.append(acc & 255)
    return b"".join(bytes([len(b)]) + b for b in (bytes(out[i : i + 255]) for i in range(0, len(out), 255))) + b"\x00"


def loop_order(n: int) -> list[int]:
    return [0, 1, 2, 1] if n == 3 else list(range(n))


def encode_gif(frames: list[np.ndarray], delay_ms: int | list[int] = 100, dither: bool = True, sample: int = 10) -> bytes:
    """An endless loop over frames of equal size, with one palette for all of them."""
    if not frames or len({f.shape for f in frames}) != 1:
        raise ValueError("frames of one size are needed")
    h, w = frames[0].shape[:2]
    colours = palette(frames, 256, sample)
    depth = max(2, (len(colours) - 1).bit_length())
    table = np.zeros((1 << depth, 3), np.uint8)
    table[: len(colours)] = colours
    out = [b"GIF89a", struct.pack("<HHBBB", w, h, 0x80 | 0x70 | (depth - 1), 0, 0), table.tobytes(), b"\x21\xff\x0bNETSCAPE2.0\x03\x01\x00\x00\x00"]
    packed = [lzw(to_indices(f, colours, dither).tobytes(), depth) for f in frames]
    order = loop_order(len(frames))
    delays = delay_ms if isinstance(delay_ms, list) else [delay_ms] * len(order)
    for i, ms in zip(order, delays, strict=True):
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 4, (ms + 5) // 10, 0, 0))
        out.append(struct.pack("<BHHHHB", 0x2C, 0, 0, w, h, 0) + bytes([depth]) + packed[i])
    return b"".join(out) + b"\x3b"


def encode_png(rgb: np.ndarray) -> bytes:
    h, w = rgb.shape[:2]
    colour = {1: 0, 3: 2, 4: 6}[1 if rgb.ndim == 2 else rgb.shape[2]]
    rows = np.concatenate([np.zeros((h, 1), np.uint8), rgb.reshape(h, -1)], axis=1)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")
