"""Scans as a source: files of known kinds, decoded by Spark's image reader or, for 16-bit PNGs, by own code."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Extensions that are read.
EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "tiff", "tif", "webp")
IMAGES = "path string, image_id string, width int, height int, n_channels int, data binary, ok boolean, error string"


def is_supported(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*EXTENSIONS)


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length and sha256 of the image files in a folder (not below it) or of one file."""
    files = spark.read.format("binaryFile").load(path)
    return files.filter(is_supported(F.col("path"))).select("path", "length", F.sha2("content", 256).alias("sha256"))


def read_images(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row for each image file; channels in the order red, green, blue (and alpha). What can't be decoded has ok = false."""
    files = spark.read.format("image").load(path).select(F.col("image.origin").alias("path"), F.col("image").alias("i")).filter(is_supported(F.col("path")))

    def unpack(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for path_, w, h, n, data in zip(pdf["path"], pdf["width"], pdf["height"], pdf["n"], pdf["data"], strict=True):
                name = path_.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                if w <= 0 or h <= 0:
                    rows.append((path_, name, 0, 0, 0, b"", False, "undecodable"))
                    continue
                px = np.frombuffer(data, np.uint8).reshape(h, w, n)
                if n >= 3:
                    px = px[:, :, [2, 1, 0, *range(3, n)]]
                rows.append((path_, name, w, h, n, px.tobytes(), True, None))
            yield pd.DataFrame(rows, columns=["path", "image_id", "width", "height", "n_channels", "data", "ok", "error"])

    flat = files.select("path", F.col("i.width").alias("width"), F.col("i.height").alias("height"), F.col("i.nChannels").alias("n"), F.col("i.data").alias("data"))
    return flat.mapInPandas(unpack, IMAGES)


def decode_png(content: bytes) -> np.ndarray:
    """Pixels (height, width, channels) of a PNG that isn't interlaced or indexed; 16-bit samples lose their low byte."""
    if content[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, packed = 8, []
    while at < len(content):
        (size,), kind = struct.unpack(">I", content[at : at + 4]), content[at + 4 : at + 8]
        body = content[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", body)
            if depth not in (8, 16) or colour not in (0, 2, 4, 6) or interlace:
                raise ValueError("this kind of PNG isn't read")
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    channels = {0: 1, 2: 3, 4: 2, 6: 4}[colour]
    step = channels * depth // 8
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, 1 + width * step)
    out = np.zeros((height, width, step), np.int32)
    for y in range(height):
        kind, line = raw[y, 0], raw[y, 1:].reshape(width, step).astype(np.int32)
        up = out[y - 1] if y else np.zeros((width, step), np.int32)
        if kind == 0:
            out[y] = line
        elif kind == 1:
            out[y] = np.cumsum(line, axis=0) & 255
        elif kind == 2:
            out[y] = (line + up) & 255
        else:
            left, corner = np.zeros(step, np.int32), np.zeros(step, np.int32)
            for x in range(width):
                if kind == 3:
                    guess = (left + up[x]) // 2
                else:
                    a, b, c = np.abs(up[x] - corner), np.abs(left - corner), np.abs(left + up[x] - 2 * corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up[x], corner))
                left = out[y, x] = (line[x] + guess) & 255
                corner = up[x]
    if depth == 16:
        out = out[:, :, ::2]
    return out.astype(np.uint8)
