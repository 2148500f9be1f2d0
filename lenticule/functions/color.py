"""Pixel arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weights of red, green and blue.
BT709 = (0.2126, 0.7152, 0.0722)
EQUAL = (1 / 3, 1 / 3, 1 / 3)
# The ramp's corners (position, red, green, blue) from near to far disparity.
RAMP = ((0.0, 30, 80, 255), (0.25, 0, 220, 255), (0.5, 40, 230, 80), (0.75, 255, 210, 0), (1.0, 255, 35, 35))


def byte(value: Column) -> Column:
    """Rounded half away from zero, held in 0 to 255."""
    return F.least(F.greatest(F.round(value), F.lit(0.0)), F.lit(255.0)).cast("int")


def luma_value(r: Column, g: Column, b: Column, weights: tuple[float, float, float] = BT709) -> Column:
    """Weighted sum, not rounded."""
    return r * F.lit(weights[0]) + g * F.lit(weights[1]) + b * F.lit(weights[2])


def luma(r: Column, g: Column, b: Column, weights: tuple[float, float, float] = BT709) -> Column:
    if weights == EQUAL:  # one division keeps whole means exact
        return byte((r + g + b) / F.lit(3.0))
    return byte(luma_value(r, g, b, weights))


# Rows of the full-range BT.709 conversion to luma and the two colour differences.
YUV = {"y": (0.2126, 0.7152, 0.0722), "u": (-0.1146, -0.3854, 0.5), "v": (0.5, -0.4542, -0.0458)}


def yuv420(pixels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (image_id, x, y, r, g, b) of whole images: the luma plane, padded to even sides by its last column and row, and the
    two colour planes from means of two by two pixels (edges repeated)."""
    size = pixels.groupBy("image_id").agg(F.max("x").alias("mx"), F.max("y").alias("my"))
    held = pixels.join(size, "image_id")
    # an edge pixel of an odd side stands for its padding as well
    xs = F.when((F.col("x") == F.col("mx")) & (F.col("mx") % 2 == 0), F.array("x", F.col("x") + 1)).otherwise(F.array("x"))
    ys = F.when((F.col("y") == F.col("my")) & (F.col("my") % 2 == 0), F.array("y", F.col("y") + 1)).otherwise(F.array("y"))
    full = held.withColumn("px", F.explode(xs)).withColumn("py", F.explode(ys)).select("image_id", F.col("px").alias("x"), F.col("py").alias("y"), "r", "g", "b")
    rgb = [F.col("r"), F.col("g"), F.col("b")]
    y_plane = full.select("image_id", "x", "y", byte(luma_value(*rgb, YUV["y"])).alias("luma"))
    block = full.groupBy("image_id", F.floor(F.col("x") / 2).alias("cx"), F.floor(F.col("y") / 2).alias("cy")).agg(*(F.avg(c).alias(c) for c in "rgb"))
    uv = block.select("image_id", "cx", "cy", byte(luma_value(*rgb, YUV["u"]) + 128).alias("u"), byte(luma_value(*rgb, YUV["v"]) + 128).alias("v"))
    return y_plane, uv


def heat_ramp(value: Column) -> Column:
    """Struct (r, g, b) of a value in 0 to 1, linear between the ramp's corners."""
    t = F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))
    parts = []
    for channel in (1, 2, 3):
        out = F.lit(float(RAMP[-1][channel]))
        for low, high in reversed(list(zip(RAMP, RAMP[1:], strict=False))):
            share = (t - low[0]) / (high[0] - low[0])
            out = F.when(t < high[0], low[channel] + share * (high[channel] - low[channel])).otherwise(out)
        parts.append(F.round(out).cast("int").alias("rgb"[channel - 1]))
    return F.struct(*parts)


def inverse_gamma(v: Column, baseline: Column, gamma: float = 1.12) -> Column:
    """0 up to the baseline; above it, stretched to the whole range by a power. A gamma of 0.1 or less means 1."""
    power = gamma if gamma > 0.1 else 1.0
    share = (v - baseline) / F.greatest(F.lit(255) - baseline, F.lit(1))
    return F.when(v <= baseline, 0).otherwise(byte(F.lit(255.0) * F.pow(share, F.lit(power))))
