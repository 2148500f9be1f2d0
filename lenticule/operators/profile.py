"""Statistics of slices along the major axis, and filters over profiles and rasters.

Samples are rows of (image, major, v). Everything is grouped by image and slice, so that tables of any number of images and
slices spread evenly; percentiles come from counts of the 256 values, never from sorted samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _keys(by: list[str], *more: str) -> list[str]:
    return [*by, *more]


def value_counts(samples: DataFrame, by: list[str], v: str = "v") -> DataFrame:
    return samples.groupBy(*by, F.col(v).cast("int").alias("v")).agg(F.count("*").alias("n"))


def histogram_percentile(counts: DataFrame, by: list[str], shares: dict[str, float]) -> DataFrame:
    """From counts (v, n): for each share p the first value whose running count reaches min(round(n p), n - 1)."""
    run = Window.partitionBy(*by).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    stepped = counts.withColumn("__run", F.sum("n").over(run)).withColumn("__all", F.sum("n").over(Window.partitionBy(*by)))
    rank = lambda p: F.least(F.round(F.col("__all") * F.lit(p)), F.col("__all") - 1)
    return stepped.groupBy(*by).agg(*(F.min(F.when(F.col("__run") >= rank(min(max(p, 0.0), 1.0)), F.col("v"))).alias(name) for name, p in shares.items()))


def axis_profile(samples: DataFrame, by: list[str], v: str = "v") -> DataFrame:
    """n, min, max, avg, std (population, not below 0), p5 and p98 of each slice, all from one shuffle of value counts."""
    counts = value_counts(samples, by, v)
    whole = counts.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
        (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("avg"),
        (F.sum(F.col("v") * F.col("v") * F.col("n")) / F.sum("n")).alias("__sq"),
    )
    whole = whole.withColumn("std", F.sqrt(F.greatest(F.col("__sq") - F.col("avg") * F.col("avg"), F.lit(0.0)))).drop("__sq")
    return whole.join(histogram_percentile(counts, by, {"p5": 0.05, "p98": 0.98}), by)


def contrast(profile: DataFrame) -> DataFrame:
    """Add p98 less p5, not below 0."""
    return profile.withColumn("contrast", F.greatest(F.col("p98") - F.col("p5"), F.lit(0)))


def percentile_of_percentiles(samples: DataFrame, image: list[str], major: str, inner: float = 0.05, outer: float = 0.01, v: str = "v") -> DataFrame:
    """The outer percentile, over an image's slices, of each slice's inner percentile."""
    each = histogram_percentile(value_counts(samples, [*image, major], v), [*image, major], {"v": inner})
    return histogram_percentile(value_counts(each, image), image, {"baseline": outer})


def matched_filter(series: DataFrame, by: list[str], pos: str, value: str, inner: int, outer: int) -> DataFrame:
    """Mean of the two margins less the mean of the trough between them; 0 where there is no margin. Ends are clipped."""
    w = Window.partitionBy(*by).orderBy(pos)
    trough, left, right = w.rowsBetween(-inner, inner), w.rowsBetween(-outer, -inner - 1), w.rowsBetween(inner + 1, outer)
    margin_n = F.count(value).over(left) + F.count(value).over(right)
    margin = F.coalesce(F.sum(value).over(left), F.lit(0.0)) + F.coalesce(F.sum(value).over(right), F.lit(0.0))
    response = F.when(margin_n > 0, margin / F.when(margin_n > 0, margin_n).otherwise(1) - F.avg(value).over(trough)).otherwise(0.0)
    return series.select(*by, pos, response.alias("response"))


def median_3x3(pixels: DataFrame, image: list[str], x: str = "x", y: str = "y", v: str = "v") -> DataFrame:
    """Median of nine for inner pixels, the value itself at the edges and in images with a side under 3."""
    row = Window.partitionBy(*image, y).orderBy(x)
    three = F.array(F.lag(v).over(row), F.col(v), F.lead(v).over(row))
    held = pixels.withColumn("__three", three)
    column = Window.partitionBy(*image, x).orderBy(y)
    nine = F.concat(F.lag("__three").over(column), F.col("__three"), F.lead("__three").over(column))
    held = held.withColumn("__nine", nine)
    inner = F.col("__nine").isNotNull() & ~F.exists("__nine", lambda e: e.isNull())
    return held.select(*image, x, y, F.when(inner, F.element_at(F.array_sort("__nine"), 5)).otherwise(F.col(v)).alias(v))


def rescale_nearest(pixels: DataFrame, image: str, scale: Column, width: Column, height: Column) -> DataFrame:
    """Nearest-neighbour rescaling: every target pixel joins the source pixel at min(round(i / scale), side - 1)."""
    sizes = pixels.groupBy(image).agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    grid = sizes.withColumn("s", scale).withColumn("tw", width).withColumn("th", height)
    grid = grid.withColumn("tx", F.explode(F.sequence(F.lit(0), F.col("tw") - 1))).withColumn("ty", F.explode(F.sequence(F.lit(0), F.col("th") - 1)))
    source = lambda t, side: F.least(F.round(F.col(t) / F.col("s")).cast("int"), F.col(side) - 1)
    want = grid.select(image, "tx", "ty", source("tx", "w").alias("x"), source("ty", "h").alias("y"))
    return want.join(pixels, [image, "x", "y"]).select(image, F.col("tx").alias("x"), F.col("ty").alias("y"), "v")
