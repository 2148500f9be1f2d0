"""Matching keypoints across frames: nearest neighbours, mutual matches, cycles of three and pair statistics.

Keypoints are rows (image_id, frame_index, kp_index, x, y, score, descriptor). Matching takes the strongest 4096 of a frame, as detection
does, so an image's similarity blocks fit a task; images are what is spread over the cluster. Everything after the dot products
is equi-joins on (image, frame, index).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MATCHES = "image_id string, frame_a int, frame_b int, index_a int, index_b int, similarity double, distance_ratio double"


@dataclass(frozen=True)
class MatchConfig:
    least_similarity: float = 0.55
    most_ratio: float = 0.88
    block: int = 1024
    most_keypoints: int = 4096


def match_pairs(keypoints: DataFrame, pairs: list[tuple[int, int]], config: MatchConfig = MatchConfig()) -> DataFrame:
    """For each keypoint of frame a, its nearest in frame b by dot product (the first on ties), if similar enough and clearly nearest."""
    wanted = sorted(set(pairs))
    frames = sorted({f for p in wanted for f in p})

    names = [c.split()[0] for c in MATCHES.split(", ")]

    def solve(image: pa.Table) -> pa.Table:
        image = image.combine_chunks().sort_by([("frame_index", "ascending"), ("kp_index", "ascending")])
        frame, index = (image[c].to_numpy() for c in ("frame_index", "kp_index"))
        flat = pc.list_flatten(image["descriptor"]).to_numpy().astype(np.float64).reshape(len(frame), -1)
        sides = {f: (index[frame == f], flat[frame == f]) for f in np.unique(frame).tolist()}
        out = [[] for _ in names[1:]]
        for a, b in wanted:
            if a not in sides or b not in sides:
                continue
            ids_a, da = sides[a]
            ids_b, db = sides[b]
            for at in range(0, len(ids_a), config.block):
                dots = da[at : at + config.block] @ db.T
                row = np.arange(len(dots))
                first = dots.argmax(axis=1)
                best = dots[row, first]
                if dots.shape[1] > 1:
                    dots[row, first] = -np.inf
                    second = dots.max(axis=1)
                else:
                    second = np.full(len(dots), -1.0)
                good = (best >= config.least_similarity) & ((second <= 0) | (1 - best <= config.most_ratio * (1 - second)))
                told = (second > 0) & (np.abs(1 - second) > 1e-6)
                ratio = np.where(told, (1 - best) / np.where(told, 1 - second, 1.0), np.nan)
                found = (np.full(good.sum(), a), np.full(good.sum(), b), ids_a[at : at + config.block][good], ids_b[first][good], best[good], ratio[good])
                for column, values in zip(out, found, strict=True):
                    column.append(values)
        flat_out = [np.concatenate(c) if c else np.empty(0) for c in out]
        kinds = [pa.int32()] * 4 + [pa.float64()] * 2
        columns = [pa.array(c.astype(k.to_pandas_dtype()), k) for c, k in zip(flat_out, kinds, strict=True)]
        return pa.Table.from_arrays([pa.array([image["image_id"][0].as_py()] * len(columns[0]), pa.string()), *columns], names=names)

    usable = keypoints.filter(F.col("descriptor").isNotNull() & F.col("frame_index").isin(frames))
    if "score" in keypoints.columns:  # the budget of detection: rows beyond it are weaker keypoints than any that an image's detector returns
        usable = strongest(usable, config.most_keypoints, ["image_id", "frame_index"])
    found = usable.select("image_id", "frame_index", "kp_index", "descriptor").groupBy("image_id").applyInArrow(solve, MATCHES)
    return found.withColumn("distance_ratio", F.when(~F.isnan("distance_ratio"), F.col("distance_ratio")))


def mutual_matches(keypoints: DataFrame, pairs: list[tuple[int, int]], config: MatchConfig = MatchConfig()) -> DataFrame:
    """Matches found from both sides; confidence is the smaller similarity. Columns (image_id, frame_a, frame_b, index_a, index_b, confidence)."""
    every = match_pairs(keypoints, [p for a, b in pairs for p in ((a, b), (b, a))], config)
    key = ["image_id", "frame_a", "frame_b", "index_a", "index_b"]
    turned = F.col("frame_a") > F.col("frame_b")
    swap = lambda a, b: F.when(turned, F.col(b)).otherwise(F.col(a))
    level = every.select("image_id", swap("frame_a", "frame_b").alias("frame_a"), swap("frame_b", "frame_a").alias("frame_b"), swap("index_a", "index_b").alias("index_a"), swap("index_b", "index_a").alias("index_b"), "similarity")
    return level.groupBy(*key).agg(F.min("similarity").alias("confidence"), F.count("*").alias("__n")).filter("__n = 2").drop("__n")


def dyadic_pairs(frames: DataFrame, n: str = "n") -> DataFrame:
    """All pairs (i, i + 2^k) inside 0 to n - 1, and (0, n - 1), once each."""
    steps = F.filter(F.transform(F.sequence(F.lit(0), F.lit(30)), lambda k: F.shiftleft(F.lit(1), 0) * F.pow(F.lit(2.0), k).cast("int")), lambda s: s < F.col(n))
    rows = frames.withColumn("step", F.explode(steps)).withColumn("frame_a", F.explode(F.sequence(F.lit(0), F.col(n) - 1 - F.col("step"))))
    near = rows.select(*frames.columns, "frame_a", (F.col("frame_a") + F.col("step")).cast("int").alias("frame_b"))
    ends = frames.filter(F.col(n) > 1).select(*frames.columns, F.lit(0).alias("frame_a"), (F.col(n) - 1).cast("int").alias("frame_b"))
    return near.unionByName(ends).dropDuplicates()


def cyclic_triplets(matches: DataFrame, frames: tuple[int, int, int] = (0, 1, 2)) -> DataFrame:
    """Keypoints i0, i1, i2 that match around the whole cycle; confidence is the cube root of the product.

    Within a pair of frames a keypoint has one match at most, as mutual matches are. So the sides of a cycle meet in two aggregates, first by
    the keypoint in the middle, then by the outer ones, and the matches, which are dear, are made once.
    """
    f0, f1, f2 = frames
    side = lambda a, b: (F.col("frame_a") == a) & (F.col("frame_b") == b)
    first, second, outer = side(f0, f1), side(f1, f2), side(f0, f2)
    middle = F.when(first, F.col("index_b")).when(second, F.col("index_a"))
    one = matches.filter(first | second | outer).groupBy("image_id", middle.alias("i1"), F.when(outer, F.struct("index_a", "index_b")).alias("ends")).agg(
        *(F.max(F.when(on, F.col(c))).alias(name) for name, on, c in (("i0", first, "index_a"), ("i2", second, "index_b"), ("c01", first, "confidence"), ("c12", second, "confidence"), ("c02", outer, "confidence")))
    )
    one = one.withColumns({"i0": F.coalesce("i0", "ends.index_a"), "i2": F.coalesce("i2", "ends.index_b")}).filter("i0 is not null and i2 is not null")
    both = one.groupBy("image_id", "i0", "i2").agg(*(F.max(c).alias(c) for c in ("i1", "c01", "c12", "c02"))).filter("i1 is not null and c02 is not null")
    return both.select("image_id", "i0", "i1", "i2", F.cbrt(F.col("c01") * F.col("c12") * F.col("c02")).alias("confidence"))


def with_points(triplets: DataFrame, keypoints: DataFrame) -> DataFrame:
    """Add x0, y0 to x2, y2; indices without a keypoint are dropped."""
    for f in range(3):
        points = keypoints.filter(F.col("frame_index") == f).select("image_id", F.col("kp_index").alias(f"i{f}"), F.col("x").alias(f"x{f}"), F.col("y").alias(f"y{f}"))
        triplets = triplets.join(points, ["image_id", f"i{f}"])
    return triplets


@dataclass(frozen=True)
class GateConfig:
    cross: float = 25.0
    cascade: float = 5.0
    sure: float = 4.0
    radial: float = 1.5


def verify_triplets(triplets: DataFrame, config: GateConfig = GateConfig(), base: str = "x", size: tuple[Column, Column] | None = None) -> DataFrame:
    """Keep triplets whose offsets agree, adding disparity_01, disparity_12 and cascade_error.

    Limits widen with the distance of the first point from the image's middle if its ``size`` is given. Offsets along the base have to
    point the same way where both exceed ``sure`` pixels.
    """
    cross = "y" if base == "x" else "x"
    d = lambda axis, i, j: F.col(f"{axis}{i}") - F.col(f"{axis}{j}")
    slack = F.lit(1.0)
    if size is not None:
        w, h = size
        r2 = F.pow(F.col("x0") - w / 2, F.lit(2.0)) + F.pow(F.col("y0") - h / 2, F.lit(2.0))
        most = F.pow(w / 2, F.lit(2.0)) + F.pow(h / 2, F.lit(2.0))
        slack = 1.0 + config.radial * F.least(r2 / most, F.lit(1.0))
    d01, d12, d02 = d(base, 0, 1), d(base, 1, 2), d(base, 0, 2)
    level = F.greatest(F.abs(d(cross, 0, 1)), F.abs(d(cross, 1, 2)), F.abs(d(cross, 0, 2))) <= config.cross * slack
    against = lambda a, b: (F.abs(a) > config.sure) & (F.abs(b) > config.sure) & (a * b < 0)
    error = F.abs(d02 - (d01 + d12))
    kept = triplets.filter(level & ~against(d01, d12) & ~against(d02, d01) & (error <= config.cascade * slack))
    return kept.withColumns({"disparity_01": F.abs(d01), "disparity_12": F.abs(d12), "cascade_error": error})


def pair_observations(matches: DataFrame, keypoints: DataFrame, base: str = "x") -> DataFrame:
    """Median offset along the base (source less target) and across it (target less source) of each pair of frames, and its matches."""
    cross = "y" if base == "x" else "x"
    a = keypoints.select("image_id", F.col("frame_index").alias("frame_a"), F.col("kp_index").alias("index_a"), F.col(base).alias("ba"), F.col(cross).alias("ca"))
    b = keypoints.select("image_id", F.col("frame_index").alias("frame_b"), F.col("kp_index").alias("index_b"), F.col(base).alias("bb"), F.col(cross).alias("cb"))
    turned = F.col("frame_a") > F.col("frame_b")
    swap = lambda p, q: F.when(turned, F.col(q)).otherwise(F.col(p))
    level = matches.select("image_id", swap("frame_a", "frame_b").alias("frame_a"), swap("frame_b", "frame_a").alias("frame_b"), swap("index_a", "index_b").alias("index_a"), swap("index_b", "index_a").alias("index_b"))
    both = level.join(a, ["image_id", "frame_a", "index_a"]).join(b, ["image_id", "frame_b", "index_b"])
    return both.groupBy("image_id", "frame_a", "frame_b").agg(F.median(F.col("ba") - F.col("bb")).alias("base"), F.median(F.col("cb") - F.col("ca")).alias("cross"), F.count("*").alias("n"))


def chassis(triplets: DataFrame) -> DataFrame:
    """Per image, from triplets with points: medians of the offsets, sag, ratio of the two baselines, rmse of the cascade and inliers."""
    m = lambda c: F.coalesce(F.median(c), F.lit(0.0))
    b = lambda i, j: F.col(f"x{i}") - F.col(f"x{j}")
    c = lambda i, j: F.col(f"y{j}") - F.col(f"y{i}")
    one = triplets.groupBy("image_id").agg(
        m(b(0, 1)).alias("base_01"), m(c(0, 1)).alias("cross_01"), m(b(1, 2)).alias("base_12"), m(c(1, 2)).alias("cross_12"), m(b(0, 2)).alias("base_02"), m(c(0, 2)).alias("cross_02"),
        F.sqrt(F.avg(F.col("cascade_error") * F.col("cascade_error"))).alias("rmse"), F.count("*").alias("inliers"),
    )
    safe = F.abs(F.col("base_12")) > 1e-4
    return one.withColumn("sag", F.col("cross_01") - 0.5 * F.col("cross_02")).withColumn("ratio", F.when(safe, F.col("base_01") / F.when(safe, F.col("base_12")).otherwise(1.0)).otherwise(1.0))


def strongest(keypoints: DataFrame, k: int, by: list[str], score: str = "score", index: str = "kp_index") -> DataFrame:
    """The k keypoints of each group with the highest scores; the lower index wins ties."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), index)
    return keypoints.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= k).drop("__r")
