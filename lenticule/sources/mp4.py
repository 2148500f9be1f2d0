"""HEVC in MP4: splitting byte streams into units, a stand-in encoder, and the boxes around the samples."""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass

from .gif import loop_order

VPS, SPS, PPS, AUD, IDR, TRAIL = 32, 33, 34, 35, 19, 1

# Units that the stand-in encoder emits whatever the pixels are.
STAND_IN = {
    VPS: bytes.fromhex("40010c01ffff01600000030000030000030000 78ac09"),
    SPS: bytes.fromhex("420101016000000300000300000300 0078a0028080 2d16595e492b01010140"),
    PPS: bytes.fromhex("4401c0f3c0"),
    IDR: bytes.fromhex("2601af084a311122 3344"),
    TRAIL: bytes.fromhex("0201d00425185566 7788"),
}


@dataclass(frozen=True)
class Unit:
    data: bytes

    @property
    def kind(self) -> int:
        return (self.data[0] >> 1) & 0x3F

    @property
    def key(self) -> bool:
        return 16 <= self.kind <= 23


def split_units(stream: bytes) -> list[Unit]:
    """Units between start codes of three or four bytes; bytes before the first are passed over."""
    parts = re.split(rb"\x00?\x00\x00\x01", stream)[1:]
    return [Unit(p) for p in parts if p]


class StandInEncoder:
    """Emits parameter sets and a key picture for key frames, and one other picture otherwise."""

    def __init__(self) -> None:
        self.count = 0

    def encode(self, key: bool) -> list[Unit]:
        kinds = (VPS, SPS, PPS, IDR) if key or not self.count else (TRAIL,)
        self.count += 1
        return [Unit(STAND_IN[k]) for k in kinds]


@dataclass(frozen=True)
class Sample:
    units: tuple[Unit, ...]
    duration_ms: int
    key: bool


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I", 8 + len(body)) + kind + body


def full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


def runs(values: list[int]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for v in values:
        if out and out[-1][1] == v:
            out[-1][0] += 1
        else:
            out.append([1, v])
    return [(n, v) for n, v in out]


_UNITY = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def _decoder_record(sets: dict[int, bytes]) -> bytes:
    sps = sets[SPS]
    level = sps[12] if len(sps) > 12 else 120
    head = struct.pack(">BBI6sBHBBBBHBB", 1, min(max((sps[1] >> 1) & 0x1F, 1), 2), 0x60000000, bytes(6), level, 0xF000, 0xFC, 0xFD, 0xF8, 0xF8, 0, 0x0F, 3)
    return box(b"hvcC", head, *(struct.pack(">BHH", 0x80 | k, 1, len(sets[k])) + sets[k] for k in (VPS, SPS, PPS)))


def mux(samples: list[Sample], sets: dict[int, bytes], width: int, height: int) -> bytes:
    """ftyp, moov and mdat at a thousand ticks a second; units are length-prefixed, without parameter sets and delimiters."""
    bodies = [b"".join(struct.pack(">I", len(u.data)) + u.data for u in s.units if u.kind not in (VPS, SPS, PPS, AUD)) for s in samples]
    lasting = [max(s.duration_ms, 1) for s in samples]
    total = sum(lasting)
    keys = [i + 1 for i, s in enumerate(samples) if s.key] or [1]
    entry = box(
        b"hvc1", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", width & 0xFFFF, height & 0xFFFF, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 24, -1), _decoder_record(sets)
    )
    timing = runs(lasting)
    brands = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41hvc1")

    def movie(offset: int) -> bytes:
        tables = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">I", len(timing)), *(struct.pack(">II", *t) for t in timing)),
            full(b"stss", struct.pack(">I", len(keys)), *(struct.pack(">I", k) for k in keys)),
            full(b"stsc", struct.pack(">IIII", 1, 1, len(samples), 1)),
            full(b"stsz", struct.pack(">II", 0, len(samples)), *(struct.pack(">I", len(b)) for b in bodies)),
            full(b"stco", struct.pack(">II", 1, offset)),
        )
        where = box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1)))
        media = box(b"minf", full(b"vmhd", bytes(8), flags=1), where, tables)
        track = box(
            b"trak",
            full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, total), bytes(8), struct.pack(">HHHH", 0, 0, 0, 0), _UNITY, struct.pack(">II", width << 16, height << 16), flags=3),
            box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 1000, total, 0x55C4, 0)), full(b"hdlr", bytes(4), b"vide", bytes(12), b"video\x00"), media),
        )
        head = full(b"mvhd", struct.pack(">IIII", 0, 0, 1000, total), struct.pack(">IH", 0x10000, 0x100), bytes(10), _UNITY, bytes(24), struct.pack(">I", 2))
        return box(b"moov", head, track)

    start = len(brands) + len(movie(0)) + 8
    return brands + movie(start) + box(b"mdat", *bodies)


def encode_mp4(n: int, width: int, height: int, delay_ms: int = 100, loops: int = 4, delays: tuple[int, int] | None = None) -> bytes:
    """A loop over n frames, played ``loops`` times, from the stand-in encoder; the first step is a key frame."""
    encoder, sets, samples = StandInEncoder(), dict.fromkeys((VPS, SPS, PPS), b""), []
    for step, _ in enumerate(loop_order(n) * max(loops, 1)):
        units = encoder.encode(step == 0)
        sets |= {u.kind: u.data for u in units if u.kind in sets}
        ms = delay_ms if delays is None or n != 3 else delays[0] if step % 4 in (0, 3) else delays[1]
        samples.append(Sample(tuple(u for u in units if u.kind not in sets), ms, step == 0))
    return mux(samples, sets, width + width % 2, height + height % 2)
