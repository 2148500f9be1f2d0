"""Images in, animations out."""

import os
import struct

import numpy as np
import pytest

from lenticule.plans.batch import BatchRequest, run_batch
from lenticule.sources import gif, mp4
from lenticule.sources.images import decode_png, list_files


def unpack_lzw(data: bytes, depth: int) -> list[int]:
    raw, at = bytearray(), 0
    while data[at]:
        raw += data[at + 1 : at + 1 + data[at]]
        at += 1 + data[at]
    bits = int.from_bytes(bytes(raw), "little")
    clear, end, pos, size, table, prev, out = 1 << depth, (1 << depth) + 1, 0, depth + 1, {}, None, []
    while True:
        code = (bits >> pos) & ((1 << size) - 1)
        pos += size
        if code == clear:
            table, size, prev = {i: [i] for i in range(clear)}, depth + 1, None
            nxt = end + 1
        elif code == end:
            return out
        else:
            entry = table[code] if code in table else [*prev, prev[0]]
            out += entry
            if prev is not None and nxt < 4096:
                table[nxt] = [*prev, entry[0]]
                nxt += 1
                if nxt == 1 << size and size < 12:
                    size += 1
            prev = entry


@pytest.mark.parametrize("n", [1, 2, 300, 60_000])
def test_lzw_round_trip(n):
    codes = np.random.default_rng(n).integers(0, 200, n).astype(np.uint8).tobytes()
    assert bytes(unpack_lzw(gif.lzw(codes, 8), 8)) == codes


def test_gif_frames():
    frames = [np.full((100, 96, 3), v, np.uint8) for v in (10, 120, 250)]
    data = gif.encode_gif(frames, 100)
    assert data[:6] == b"GIF89a" and struct.unpack("<HH", data[6:10]) == (96, 100)
    assert data.count(b"\x21\xf9\x04") == 4 and data[-1:] == b"\x3b"


@pytest.mark.parametrize("shape", [(5, 7), (5, 7, 3), (5, 7, 4)])
def test_png_round_trip(shape):
    px = np.random.default_rng(1).integers(0, 256, shape).astype(np.uint8)
    assert (decode_png(gif.encode_png(px)).reshape(shape) == px).all()


def test_units_and_boxes():
    stream = b"".join(b"\x00\x00\x00\x01" + mp4.STAND_IN[k] for k in (mp4.VPS, mp4.SPS, mp4.PPS, mp4.IDR))
    units = mp4.split_units(stream)
    assert [u.kind for u in units] == [32, 33, 34, 19] and units[-1].key
    data = mp4.encode_mp4(3, 64, 64, loops=2)
    assert data[4:8] == b"ftyp" and len(data) > 100
    at, kinds = 0, []
    while at < len(data):
        size = struct.unpack(">I", data[at : at + 4])[0]
        kinds.append(data[at + 4 : at + 8])
        at += size
    assert kinds == [b"ftyp", b"moov", b"mdat"] and at == len(data)
    where = struct.unpack(">I", data[data.index(b"stco") + 12 : data.index(b"stco") + 16])[0]
    assert where == data.index(b"mdat") + 4
    assert mp4.runs([80, 80, 120, 80]) == [(2, 80), (1, 120), (1, 80)]


def test_batch(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "flat.png").write_bytes(gif.encode_png(np.full((100, 300, 3), 200, np.uint8)))
    (source / "square.png").write_bytes(gif.encode_png(np.full((40, 40, 3), 200, np.uint8)))
    (source / "broken.png").write_bytes(b"no picture")
    (source / "notes.txt").write_text("not an image")
    assert {os.path.basename(r["path"]) for r in list_files(spark, str(source)).collect()} == {"flat.png", "square.png", "broken.png"}
    assert run_batch(spark, str(source), str(tmp_path / "out"), BatchRequest(debug=True)) == {"total": 3, "succeeded": 1, "failed": 2}
    assert (tmp_path / "out/flat_wiggle.gif").read_bytes()[:6] == b"GIF89a"
    assert (tmp_path / "out/flat_roi_overlay.png").exists()
    run_batch(spark, str(source), str(tmp_path / "video"), BatchRequest(mp4=True))
    assert (tmp_path / "video/flat_wiggle.mp4").exists() and not (tmp_path / "video/flat_wiggle.gif").exists()


def test_drop_folder(spark, tmp_path):
    from lenticule.streaming.drop_folder import watch

    source = tmp_path / "in"
    source.mkdir()
    (source / "flat.png").write_bytes(gif.encode_png(np.full((60, 200, 3), 90, np.uint8)))
    query = watch(spark, str(source), str(tmp_path / "out"), str(tmp_path / "state"), once=True)
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).filter("ok").count() == 1


def test_command_line(spark, tmp_path, capsys):
    from lenticule.cli import main

    (tmp_path / "flat.png").write_bytes(gif.encode_png(np.full((60, 200, 3), 90, np.uint8)))
    assert main(["-i", str(tmp_path / "flat.png"), "-o", str(tmp_path / "out"), "--no-dither"]) == 0
    assert "1 done" in capsys.readouterr().out
    assert main(["-i", "x", "-o", "y", "--enable-nvenc"]) == 2
