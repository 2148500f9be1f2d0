"""Scores, boxes and anchors of face detection as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stride of each grid and the sides of its two anchors, in pixels.
ANCHORS = ((8, (16, 32)), (16, (64, 128)), (32, (256, 512)))
#: Variances of centre and size.
VARIANCES = (0.1, 0.2)


def salience(x: Column, y: Column, w: Column, h: Column, score: Column, sigma: float = 0.5) -> Column:
    """Score times the root of the area, less the further the box is from the middle (half the image is 1 away)."""
    dx, dy = (x + w / 2 - 0.5) / 0.5, (y + h / 2 - 0.5) / 0.5
    return score * F.sqrt(w * h) * F.exp(-(dx * dx + dy * dy) / (2.0 * sigma * sigma))


def iou(a: Column, b: Column) -> Column:
    """Of structs (x, y, width, height); 0 where the union is 1e-6 or less."""
    w = F.greatest(F.least(a["x"] + a["width"], b["x"] + b["width"]) - F.greatest(a["x"], b["x"]), F.lit(0.0))
    h = F.greatest(F.least(a["y"] + a["height"], b["y"] + b["height"]) - F.greatest(a["y"], b["y"]), F.lit(0.0))
    union = a["width"] * a["height"] + b["width"] * b["height"] - w * h
    return F.when(union <= 1e-6, 0.0).otherwise(w * h / F.when(union <= 1e-6, 1.0).otherwise(union))


def face_score(c0: Column, c1: Column) -> Column:
    """The second output where the two are probabilities already, else their softmax."""
    return F.when((F.abs(c0 + c1 - 1.0) <= 1e-3) & (c0 >= 0) & (c1 >= 0), c1).otherwise(1.0 / (1.0 + F.exp(c0 - c1)))


def anchors(spark: SparkSession, side: int = 640) -> DataFrame:
    """anchor (from 0), cx, cy, width and height, all relative to the side, by grid, row, column and size."""
    out = None
    base = 0
    for stride, sizes in ANCHORS:
        n = -(-side // stride)
        cells = spark.range(n * n * len(sizes))
        cell = F.floor(F.col("id") / len(sizes))
        size = F.element_at(F.array(*(F.lit(float(s)) for s in sizes)), (F.col("id") % len(sizes) + 1).cast("int"))
        one = cells.select(
            (F.col("id") + base).alias("anchor"),
            ((cell % n + 0.5) * stride / side).alias("cx"),
            ((F.floor(cell / n) + 0.5) * stride / side).alias("cy"),
            (size / side).alias("width"),
            (size / side).alias("height"),
        )
        base += n * n * len(sizes)
        out = one if out is None else out.unionByName(one)
    return out


def decode_box(cx: Column, cy: Column, w: Column, h: Column, d: list[Column]) -> Column:
    """Box (x, y, width, height) from an anchor and its four outputs, held in the unit square; null if a side is 1e-4 or less."""
    bx, by = cx + d[0] * VARIANCES[0] * w, cy + d[1] * VARIANCES[0] * h
    bw, bh = w * F.exp(d[2] * VARIANCES[1]), h * F.exp(d[3] * VARIANCES[1])
    unit = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
    x0, y0, x1, y1 = unit(bx - bw / 2), unit(by - bh / 2), unit(bx + bw / 2), unit(by + bh / 2)
    return F.when((x1 - x0 > 1e-4) & (y1 - y0 > 1e-4), F.struct(x0.alias("x"), y0.alias("y"), (x1 - x0).alias("width"), (y1 - y0).alias("height")))
