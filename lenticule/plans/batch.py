"""Batches of scans: from image files to looping animations, and how it went.

Each step is a DataFrame by image: luma profiles are made where an image is decoded, partitioned by windows over all images at once,
and joined back to crop and encode. A failed image is a row with ok = false; it never stops the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import overlay, raster
from ..operators.partition import partition_engine
from ..sources.gif import encode_gif, encode_png
from ..sources.images import read_images
from ..sources.mp4 import encode_mp4


@dataclass(frozen=True)
class BatchRequest:
    """Options of a batch; ``mp4`` writes MP4 instead of GIF."""

    frames: int = 3
    gif_delay: int = 100
    dither: bool = True
    mp4: bool = False
    mp4_loops: int = 4
    mp4_crf: int = 18
    debug: bool = False


OUTPUTS = "image_id string, kind string, name string, content binary, ok boolean, error string"


def summarise(results: DataFrame) -> DataFrame:
    """total, succeeded and failed from a column ok."""
    good = F.coalesce(F.col("ok"), F.lit(False)).cast("long")
    return results.agg(F.count("*").alias("total"), F.coalesce(F.sum(good), F.lit(0)).alias("succeeded"), F.coalesce(F.sum(1 - good), F.lit(0)).alias("failed"))


def _pixels(data: bytes, width: int, height: int, channels: int) -> np.ndarray:
    px = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(px, 3, axis=2) if channels == 1 else px[:, :, :3]


def profiles(images: DataFrame) -> DataFrame:
    """key, pos and v (contrast of the slice) along the longer side of each image; squares give no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, w, h, n, data in zip(pdf["path"], pdf["width"], pdf["height"], pdf["n_channels"], pdf["data"], strict=True):
                if w == h:
                    continue
                small, _ = raster.scaled_luma(_pixels(data, w, h, n))
                axis = 1 if w > h else 0
                stats = raster.profile(raster.gamma_stretch(raster.median_3x3(small), axis=axis), axis)
                v = np.maximum(stats[:, 5] - stats[:, 4], 0).astype(np.int32)
                yield pd.DataFrame({"key": key, "pos": np.arange(len(v), dtype=np.int32), "v": v})

    return images.filter("ok").select("path", "width", "height", "n_channels", "data").mapInPandas(run, "key string, pos int, v int")


def regions(images: DataFrame, frames: int = 3) -> DataFrame:
    """key, strategy, confidence and rects (start and length as shares of the longer side), one row for each image."""
    curves = profiles(images)
    cut = partition_engine(curves, frames)
    rows = cut.withColumn("s", F.struct("frame", (F.col("start") / F.col("n")).alias("start"), (F.col("length") / F.col("n")).alias("length")))
    return rows.groupBy("key", "strategy", "confidence").agg(F.array_sort(F.collect_list("s")).alias("rects"))


def encode(images: DataFrame, cut: DataFrame, request: BatchRequest = BatchRequest(), shifts: DataFrame | None = None) -> DataFrame:
    """Outputs (image_id, kind, name, content, ok, error). ``shifts`` has (key, shifts: array of (dx, dy) by frame) where known; frames
    without stay where they are."""
    joined = images.join(cut.withColumnRenamed("key", "path"), "path", "left")
    if shifts is None:
        joined = joined.withColumn("shifts", F.lit(None).cast("array<struct<dx:double,dy:double>>"))
    else:
        joined = joined.join(shifts.withColumnRenamed("key", "path"), "path", "left")

    def one(row) -> Iterator[tuple]:
        if not row.ok:
            yield row.image_id, "gif", None, None, False, row.error
            return
        if row.width == row.height:
            yield row.image_id, "gif", None, None, False, "SquareImageNotSupported"
            return
        px = _pixels(row.data, row.width, row.height, row.n_channels)
        side = max(row.width, row.height)
        spans = [(int(raster.half_up(r["start"] * side)), int(raster.half_up(r["length"] * side))) for r in row.rects]
        rects = [(s, 0, n, row.height) if row.width > row.height else (0, s, row.width, n) for s, n in spans]
        crops = [px[y : y + h, x : x + w] for x, y, w, h in rects]
        w, h = min(c.shape[1] for c in crops), min(c.shape[0] for c in crops)
        moves = [(m["dx"], m["dy"]) for m in row.shifts] if row.shifts is not None else [(0.0, 0.0)] * len(crops)
        crops = raster.align_and_crop([c[:h, :w] for c in crops], moves)
        h, w = crops[0].shape[:2]
        if request.mp4:
            yield row.image_id, "mp4", f"{row.image_id}_wiggle.mp4", encode_mp4(len(crops), w, h, request.gif_delay, request.mp4_loops), True, None
        else:
            yield row.image_id, "gif", f"{row.image_id}_wiggle.gif", encode_gif(crops, request.gif_delay, request.dither), True, None
        if request.debug:
            yield row.image_id, "overlay", f"{row.image_id}_roi_overlay.png", encode_png(overlay.rois(px, rects)), True, None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                try:
                    out = list(one(row))
                except Exception as why:  # a failed image is data
                    out = [(row.image_id, "gif", None, None, False, f"{type(why).__name__}: {why}")]
                yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUTS.split(", ")])

    return joined.mapInPandas(run, OUTPUTS)


def write_files(outputs: DataFrame, folder: str) -> int:
    """Write each output as a file of its own through Hadoop's file systems, one at a time; the number written."""
    spark = outputs.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(conf)
    fs.mkdirs(root)
    count = 0
    for row in outputs.filter("ok").select("name", "content").toLocalIterator():
        stream = fs.create(jvm.org.apache.hadoop.fs.Path(root, row["name"]), True)
        stream.write(bytearray(row["content"]))
        stream.close()
        count += 1
    return count


def run_batch(spark: SparkSession, source: str, folder: str, request: BatchRequest = BatchRequest()) -> dict[str, int]:
    """Process all images of ``source`` into ``folder``; counts of images."""
    images = read_images(spark, source)
    table = f"{folder.rstrip('/')}/_outputs"
    encode(images, regions(images, request.frames), request).write.mode("overwrite").parquet(table)
    done = spark.read.schema(OUTPUTS).parquet(table)
    write_files(done, folder)
    return summarise(done.filter("kind <> 'overlay'")).first().asDict()
