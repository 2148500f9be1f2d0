"""Suppression and choice of boxes and pixels, batch counts and file digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import boxes as b
from . import derive as d
from .registry import query

_SALIENCE = f"SELECT *, score * sqrt(width * height) * exp(-(pow((x + width / 2 - 0.5) / 0.5, 2) + pow((y + height / 2 - 0.5) / 0.5, 2)) / 0.5) AS salience FROM ({d.BOXES})"


@query(
    f"""WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY image_id, frame_index ORDER BY score DESC, box_id) AS i FROM ({d.BOXES})),
g(image_id, frame_index, i, kept) AS (SELECT image_id, frame_index, 1, [struct_pack(box_id, x, y, width, height)] FROM r WHERE i = 1
 UNION ALL SELECT r.image_id, r.frame_index, r.i, CASE WHEN len(list_filter(kept, lambda k: greatest(least(k.x + k.width, r.x + r.width) - greatest(k.x, r.x), 0) * greatest(least(k.y + k.height, r.y + r.height) - greatest(k.y, r.y), 0)
   > 0.2 * (k.width * k.height + r.width * r.height - greatest(least(k.x + k.width, r.x + r.width) - greatest(k.x, r.x), 0) * greatest(least(k.y + k.height, r.y + r.height) - greatest(k.y, r.y), 0)))) > 0 THEN kept
   ELSE list_append(kept, struct_pack(box_id := r.box_id, x := r.x, y := r.y, width := r.width, height := r.height)) END FROM g JOIN r ON r.image_id = g.image_id AND r.frame_index = g.frame_index AND r.i = g.i + 1)
SELECT image_id, frame_index, unnest(list_transform(arg_max(kept, i), lambda k: k.box_id)) AS box_id FROM g GROUP BY image_id, frame_index"""
)
def box_nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.box_nms(d.boxes(spark, sf_dir), ["image_id", "frame_index"], 0.2).select("image_id", "frame_index", "box_id")


@query(
    f"""WITH p AS (SELECT image_id, x, y, r / 255.0::DOUBLE AS score FROM ({d.PIXELS})) SELECT image_id, x, y, round(score, 6) AS score FROM p WHERE score >= 0.3 AND x BETWEEN 1 AND 8 AND y BETWEEN 1 AND 8
 AND NOT EXISTS (SELECT 1 FROM p q WHERE q.image_id = p.image_id AND abs(q.x - p.x) <= 2 AND abs(q.y - p.y) <= 2 AND (q.x <> p.x OR q.y <> p.y) AND q.score >= p.score)"""
)
def pixel_nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = d.pixels(spark, sf_dir).select("image_id", "x", "y", (F.col("r") / 255.0).alias("score"))
    return b.pixel_nms(p, ["image_id"], 2, 0.3, 1, 10, 10).withColumn("score", F.round("score", 6))


@query(f"SELECT image_id, frame_index, box_id, round(salience, 6) AS salience FROM (SELECT *, row_number() OVER (PARTITION BY image_id, frame_index ORDER BY salience DESC, box_id DESC) AS r FROM ({_SALIENCE})) WHERE r = 1")
def dominant_face(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.dominant(d.boxes(spark, sf_dir), ["image_id", "frame_index"]).select("image_id", "frame_index", "box_id", F.round("salience", 6).alias("salience"))


@query(
    f"""WITH m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, frame_index ORDER BY salience DESC, box_id DESC) AS r FROM ({_SALIENCE})) WHERE r = 1)
SELECT image_id, frame_index, box_id FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY (frame_index <> 1), frame_index) AS q FROM m) WHERE q = 1"""
)
def priority_face(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.priority_box(b.dominant(d.boxes(spark, sf_dir), ["image_id", "frame_index"])).select("image_id", "frame_index", "box_id")


@query(f"SELECT count(*) AS total, CAST(sum(CASE WHEN width > height AND height > 0 OR height > width AND width > 0 THEN 1 ELSE 0 END) AS BIGINT) AS succeeded, CAST(sum(CASE WHEN width > height AND height > 0 OR height > width AND width > 0 THEN 0 ELSE 1 END) AS BIGINT) AS failed FROM ({d.SIZES})")
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.geometry import orientation
    from ..plans.batch import summarise

    rows = d.sizes(spark, sf_dir).select(orientation(F.col("width"), F.col("height")).isin("Horizontal", "Vertical").alias("ok"))
    return summarise(rows)


@query("SELECT p_partkey AS id, sha256(p_name) AS digest FROM part")
def sha256_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.sha2("p_name", 256).alias("digest"))


@query("SELECT p_partkey AS id FROM part WHERE regexp_matches(lower(p_name || '.' || CASE p_partkey % 4 WHEN 0 THEN 'JPG' WHEN 1 THEN 'webp' WHEN 2 THEN 'gif' ELSE 'tiff' END), '\\.(jpg|jpeg|png|bmp|tiff|tif|webp)$')")
def supported_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.images import is_supported

    ext = F.element_at(F.array(*(F.lit(x) for x in ("JPG", "webp", "gif", "tiff"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    named = d.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit("."), ext).alias("path"))
    return named.filter(is_supported(F.col("path"))).select("id")


@query()
def harris_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corner peaks of small rasters, a raster to a group; dense numeric work, so there is no SQL."""
    import numpy as np
    import pandas as pd

    from ..operators import raster

    def run(part: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros((10, 10), np.uint8)
        image[part["y"], part["x"]] = part["r"]
        found = raster.peaks(raster.harris(image), 2, 0.0005, 2)
        return pd.DataFrame([(part["image_id"].iloc[0], *p) for p in found], columns=["image_id", "x", "y", "score"])

    p = d.pixels(spark, sf_dir).select("image_id", "x", "y", "r")
    return p.groupBy("image_id").applyInPandas(run, "image_id long, x int, y int, score double").withColumn("score", F.round("score", 6))


@query()
def gif_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Animations of three shifted views of each raster: size and first bytes."""
    import numpy as np
    import pandas as pd

    from ..sources.gif import encode_gif

    def run(part: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros((10, 10, 3), np.uint8)
        image[part["y"], part["x"]] = part[["r", "g", "b"]].to_numpy()
        content = encode_gif([np.roll(image, s, axis=1) for s in (0, 1, 2)], dither=False)
        return pd.DataFrame([(part["image_id"].iloc[0], len(content), content[:6].decode())], columns=["image_id", "size", "magic"])

    return d.pixels(spark, sf_dir).groupBy("image_id").applyInPandas(run, "image_id long, size int, magic string")
