"""Non-maximum suppression and choice of boxes and keypoints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.faces import iou, salience


def box_nms(boxes: DataFrame, by: list[str], most: float = 0.4) -> DataFrame:
    """Greedy, by falling score (the lower box_id on ties): a box stays unless one that stays overlaps it by more than ``most``.

    Boxes are rows (.., box_id, x, y, width, height, score). A group is one frame's detections.
    """
    item = F.struct((-F.col("score")).alias("neg"), "box_id", "x", "y", "width", "height")
    ranked = boxes.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("all"))
    none = F.filter("all", lambda x: F.lit(False))
    kept = F.aggregate("all", none, lambda acc, c: F.when(F.exists(acc, lambda k: iou(k, c) > most), acc).otherwise(F.array_append(acc, c)))
    return ranked.select(*by, F.explode(kept).alias("b")).select(*by, "b.box_id", "b.x", "b.y", "b.width", "b.height", (-F.col("b.neg")).alias("score"))


def pixel_nms(scores: DataFrame, by: list[str], radius: int, least: float, border: int, width: int, height: int) -> DataFrame:
    """Pixels (x, y, score) of at least ``least``, inside the border, with no other within the radius that scores as much.

    Each pixel meets the pixels of its own and the neighbouring tiles of side ``radius``, so the join is an equi-join of bounded groups.
    """
    side = max(radius, 1)
    inside = F.col("x").between(border, width - 1 - border) & F.col("y").between(border, height - 1 - border)
    strong = scores.filter((F.col("score") >= least) & inside)
    tile = lambda c: F.floor(F.col(c) / side).cast("int")
    around = lambda c: F.explode(F.sequence(tile(c) - 1, tile(c) + 1))
    left = strong.withColumn("__tx", tile("x")).withColumn("__ty", tile("y"))
    right = scores.filter(F.col("score") >= least).withColumn("__tx", around("x")).withColumn("__ty", around("y"))
    right = right.select(*by, "__tx", "__ty", F.col("x").alias("__x"), F.col("y").alias("__y"), F.col("score").alias("__s"))
    near = (F.abs(F.col("x") - F.col("__x")) <= radius) & (F.abs(F.col("y") - F.col("__y")) <= radius) & ((F.col("x") != F.col("__x")) | (F.col("y") != F.col("__y")))
    keys = [*by, "__tx", "__ty"]
    on = [left[k].eqNullSafe(right[k]) if k in by else left[k] == right[k] for k in keys]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return left.join(right, cond & near & (F.col("__s") >= F.col("score")), "left_anti").drop("__tx", "__ty")


def dominant(boxes: DataFrame, by: list[str], sigma: float = 0.5) -> DataFrame:
    """The box of the highest salience of each group (the last on ties)."""
    rated = boxes.withColumn("salience", salience(F.col("x"), F.col("y"), F.col("width"), F.col("height"), F.col("score"), sigma))
    best = F.max(F.struct("salience", "box_id", "x", "y", "width", "height", "score")).alias("b")
    return rated.groupBy(*by).agg(best).select(*by, "b.box_id", "b.x", "b.y", "b.width", "b.height", "b.score", "b.salience")


def priority_box(dominants: DataFrame, image: str = "image_id", frame: str = "frame_index") -> DataFrame:
    """One box of an image: frame 1's, or else that of the first frame that has one."""
    order = F.struct((F.col(frame) != 1).cast("int"), F.col(frame))
    rest = [c for c in dominants.columns if c != image]
    return dominants.groupBy(image).agg(F.min_by(F.struct(*rest), order).alias("b")).select(image, "b.*")
