"""Scalar functions over derived pixels, rectangles, points, series and poses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color, faces, geometry
from . import derive as d
from .registry import query


def r6(c):
    return F.round(c, 6)


@query(f"SELECT id, CAST(least(greatest(round(0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b), 0), 255) AS INT) AS luma FROM ({d.PIXELS})")
def luma_bt709(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.pixels(spark, sf_dir).select("id", color.luma(F.col("r"), F.col("g"), F.col("b")).alias("luma"))


@query(f"SELECT id, CAST(round((r + g + b) / 3.0::DOUBLE) AS INT) AS luma FROM ({d.PIXELS})")
def luma_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.pixels(spark, sf_dir).select("id", color.luma(F.col("r"), F.col("g"), F.col("b"), color.EQUAL).alias("luma"))


@query(
    f"""WITH q AS (SELECT image_id, x // 2 AS cx, y // 2 AS cy, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM ({d.PIXELS}) GROUP BY ALL)
SELECT image_id, CAST(cx AS BIGINT) AS cx, CAST(cy AS BIGINT) AS cy, CAST(least(greatest(round(-0.1146::DOUBLE * r + -0.3854::DOUBLE * g + 0.5::DOUBLE * b + 128), 0), 255) AS INT) AS u,
 CAST(least(greatest(round(0.5::DOUBLE * r + -0.4542::DOUBLE * g + -0.0458::DOUBLE * b + 128), 0), 255) AS INT) AS v FROM q"""
)
def yuv420_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return color.yuv420(d.pixels(spark, sf_dir).select("image_id", "x", "y", "r", "g", "b"))[1]


@query(
    f"""WITH t AS (SELECT id, r / 255.0::DOUBLE AS t FROM ({d.PIXELS})), s AS (SELECT id, t, CASE WHEN t < 0.25 THEN [30,80,255] WHEN t < 0.5 THEN [0,220,255] WHEN t < 0.75 THEN [40,230,80] ELSE [255,210,0] END AS a,
 CASE WHEN t < 0.25 THEN [0,220,255] WHEN t < 0.5 THEN [40,230,80] WHEN t < 0.75 THEN [255,210,0] ELSE [255,35,35] END AS e, (t - CASE WHEN t < 0.25 THEN 0 WHEN t < 0.5 THEN 0.25 WHEN t < 0.75 THEN 0.5 ELSE 0.75 END) / 0.25::DOUBLE AS q FROM t)
SELECT id, CAST(round(a[1] + q * (e[1] - a[1])) AS INT) AS r, CAST(round(a[2] + q * (e[2] - a[2])) AS INT) AS g, CAST(round(a[3] + q * (e[3] - a[3])) AS INT) AS b FROM s"""
)
def heat_ramp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.pixels(spark, sf_dir).select("id", color.heat_ramp(F.col("r") / 255.0).alias("c")).select("id", "c.r", "c.g", "c.b")


@query(f"SELECT id, CASE WHEN r <= 20 THEN 0 ELSE CAST(least(greatest(round(255.0::DOUBLE * pow((r - 20) / 235.0::DOUBLE, 1.12)), 0), 255) AS INT) END AS v FROM ({d.PIXELS})")
def gamma_lut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.pixels(spark, sf_dir).select("id", color.inverse_gamma(F.col("r"), F.lit(20)).alias("v"))


@query(f"SELECT image_id, CASE WHEN width <= 0 OR height <= 0 THEN 'ImageTooSmall' WHEN width > height THEN 'Horizontal' WHEN height > width THEN 'Vertical' ELSE 'SquareImageNotSupported' END AS orientation FROM ({d.SIZES})")
def strip_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.sizes(spark, sf_dir).select("image_id", geometry.orientation(F.col("width"), F.col("height")).alias("orientation"))


@query(f"SELECT box_id, x + width * 1.6 <= 1.0001 AND y + height * 1.8 <= 1.0001 AS valid FROM ({d.BOXES})")
def rect_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.boxes(spark, sf_dir).select("box_id", geometry.rect_is_valid(F.col("x"), F.col("y"), F.col("width") * 1.6, F.col("height") * 1.8).alias("valid"))


_RECTS = f"SELECT box_id, CAST(round(x * 1237) AS INT) AS px, CAST(round(y * 811) AS INT) AS py, CAST(least(round(width * 1237), 1237 - round(x * 1237)) AS INT) AS pw, CAST(least(round(height * 811), 811 - round(y * 811)) AS INT) AS ph FROM ({d.BOXES})"


def _rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = d.boxes(spark, sf_dir).select("box_id", geometry.rect(F.col("x"), F.col("y"), F.col("width"), F.col("height")).alias("r"))
    return b.select("box_id", "r", geometry.rect_pixels(F.col("r"), F.lit(1237), F.lit(811)).alias("p"))


@query(_RECTS)
def rect_to_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rects(spark, sf_dir).select("box_id", F.col("p.x").alias("px"), F.col("p.y").alias("py"), F.col("p.width").alias("pw"), F.col("p.height").alias("ph"))


@query(f"SELECT box_id, px + CAST(box_id % 50 AS BIGINT) AS gx, py + CAST(box_id % 30 AS BIGINT) AS gy FROM ({_RECTS})")
def coord_to_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("box_id")
    return _rects(spark, sf_dir).select("box_id", geometry.to_global(k % 50, k % 30, F.col("p")).alias("g")).select("box_id", F.col("g.x").alias("gx"), F.col("g.y").alias("gy"))


@query(f"SELECT box_id, 600 - px AS lx, 400 - py AS ly FROM ({_RECTS}) WHERE 600 >= px AND 600 < px + pw AND 400 >= py AND 400 < py + ph")
def coord_to_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = _rects(spark, sf_dir).select("box_id", geometry.to_local(F.lit(600), F.lit(400), F.col("p")).alias("l")).filter("l is not null")
    return inside.select("box_id", F.col("l.x").alias("lx"), F.col("l.y").alias("ly"))


@query(f"SELECT box_id, 0.4 BETWEEN x AND x + width AND 0.35 BETWEEN y AND y + height AS inside FROM ({d.BOXES})")
def rect_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.boxes(spark, sf_dir).select("box_id", geometry.contains(F.struct("x", "y", "width", "height"), F.lit(0.4), F.lit(0.35)).alias("inside"))


def _basis_sql(matrix: tuple) -> str:
    terms = [f"round((({matrix[0][j]!r}::DOUBLE * t + {matrix[1][j]!r}::DOUBLE) * t + {matrix[2][j]!r}::DOUBLE) * t + {matrix[3][j]!r}::DOUBLE + 1e-9, 5) + 0.0 AS b{j}" for j in range(4)]
    return f"SELECT box_id, {', '.join(terms)} FROM (SELECT box_id, score AS t FROM ({d.BOXES}))"


def _basis(spark: SparkSession, sf_dir: str, matrix: tuple) -> DataFrame:
    weights = geometry.spline_basis(F.col("score"), matrix)
    return d.boxes(spark, sf_dir).select("box_id", *(F.round(w + 1e-9, 5).alias(f"b{i}") for i, w in enumerate(weights)))


@query(_basis_sql(geometry.BSPLINE))
def bspline_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _basis(spark, sf_dir, geometry.BSPLINE)


@query(_basis_sql(geometry.CATMULL_ROM))
def catmull_rom_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _basis(spark, sf_dir, geometry.CATMULL_ROM)


@query(
    f"""WITH w AS (SELECT key, pos, lag(value) OVER o AS p0, value AS p1, lead(value) OVER o AS p2, lead(value, 2) OVER o AS p3 FROM ({d.SERIES}) WINDOW o AS (PARTITION BY key ORDER BY pos))
SELECT key, pos, round(-0.0703125 * p0 + 0.8671875 * p1 + 0.2265625 * p2 - 0.0234375 * p3 + 1e-9, 4) AS value FROM w WHERE p0 IS NOT NULL AND p3 IS NOT NULL AND p2 IS NOT NULL AND p1 IS NOT NULL"""
)
def spline_interp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.spline_over(d.series(spark, sf_dir), "key", "pos", "value", 0.25, geometry.CATMULL_ROM).withColumn("value", F.round(F.col("value") + 1e-9, 4))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = (F.col("r") / 255.0) * 0.75
    other = (F.col("g") / 255.0) * 0.75
    q = lambda h, axis: F.struct(F.cos(h).alias("w"), *((F.sin(h) if a == axis else F.lit(0.0)).alias(a) for a in "xyz"))
    return d.pixels(spark, sf_dir).select("id", q(half, "z").alias("a"), q(other, "z").alias("b"), half.alias("ha"), other.alias("hb"), F.col("b").alias("blue"))


@query(
    f"""WITH h AS (SELECT id, r / 255.0::DOUBLE * 0.75 AS h1, g / 255.0::DOUBLE * 0.75 AS h2 FROM ({d.PIXELS})), m AS (SELECT id, cos(h1 - h2) > 0.9995 AS near, 0.7 * h1 + 0.3 * h2 AS h, 0.7 * cos(h1) + 0.3 * cos(h2) AS w, 0.7 * sin(h1) + 0.3 * sin(h2) AS z FROM h)
SELECT id, round(CASE WHEN near THEN w / sqrt(w * w + z * z) ELSE cos(h) END, 5) AS w, round(CASE WHEN near THEN z / sqrt(w * w + z * z) ELSE sin(h) END, 5) AS z FROM m"""
)
def quat_slerp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select("id", geometry.quat_slerp(F.col("a"), F.col("b"), F.lit(0.3)).alias("q")).select("id", F.round("q.w", 5).alias("w"), F.round("q.z", 5).alias("z"))


@query(f"SELECT id, round(2 * (r / 255.0::DOUBLE * 0.75), 5) AS z FROM ({d.PIXELS})")
def quat_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select("id", F.round(geometry.quat_log(F.col("a"))["z"], 5).alias("z"))


@query(f"SELECT id, round(cos(2 * h), 5) AS m00, round(sin(2 * h), 5) AS m10, round(cos(h), 5) AS w, round(sin(h), 5) AS z FROM (SELECT id, r / 255.0::DOUBLE * 0.75 AS h FROM ({d.PIXELS}))")
def quat_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _turns(spark, sf_dir).select("id", geometry.quat_to_matrix(F.col("a")).alias("m"))
    back = m.select("id", "m", geometry.quat_from_matrix(F.col("m")).alias("q"))
    return back.select("id", F.round(F.col("m")[0][0], 5).alias("m00"), F.round(F.col("m")[1][0], 5).alias("m10"), F.round("q.w", 5).alias("w"), F.round("q.z", 5).alias("z"))


@query(f"SELECT id, round(sqrt(b * b + 0.5 * pow(2 * (g / 255.0::DOUBLE * 0.75 - r / 255.0::DOUBLE * 0.75), 2)), 5) AS distance FROM ({d.PIXELS})")
def se3_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda x: F.struct(x.alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    poses = _turns(spark, sf_dir).select("id", t(F.lit(0.0)).alias("ta"), F.col("a").alias("qa"), t(F.col("blue") * 1.0).alias("tb"), F.col("b").alias("qb"))
    return geometry.with_se3_distance(poses, alpha=0.5).select("id", F.round("distance", 5).alias("distance"))


@query(
    """WITH s AS (SELECT o_custkey AS key, o_orderkey AS pos, o_totalprice AS dist, sum(o_totalprice) OVER w AS total, count(*) OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey)),
p AS (SELECT *, greatest(CAST(CASE WHEN total <= 1e-4 THEN floor(400 / n) ELSE round(400 * dist / total) END AS BIGINT), 20) AS ms FROM s),
q AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms DESC, pos DESC) AS r, 400 - sum(ms) OVER (PARTITION BY key) AS rest FROM p)
SELECT key, pos, CAST(CASE WHEN r = 1 AND total > 1e-4 THEN greatest(ms + rest, 20) ELSE ms END AS BIGINT) AS delay_ms FROM q"""
)
def frame_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = d.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("pos"), F.col("o_totalprice").alias("dist"))
    return geometry.frame_delays(steps, "key", "pos", "dist").select("key", "pos", "delay_ms")


@query(f"SELECT box_id, round(score * sqrt(width * height) * exp(-(pow((x + width / 2 - 0.5) / 0.5, 2) + pow((y + height / 2 - 0.5) / 0.5, 2)) / 0.5), 6) AS salience FROM ({d.BOXES})")
def face_salience(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.boxes(spark, sf_dir).select("box_id", r6(faces.salience(*(F.col(c) for c in ("x", "y", "width", "height", "score")))).alias("salience"))


@query(
    f"""SELECT box_id, round(CASE WHEN abs(c0 + score - 1) <= 1e-3 AND c0 >= 0 AND score >= 0 THEN score ELSE exp(score) / (exp(score) + exp(c0)) END, 6) AS s
FROM (SELECT box_id, score, CASE WHEN box_id % 2 = 0 THEN 1 - score ELSE x * 3 - 0.5 END AS c0 FROM ({d.BOXES}))"""
)
def face_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even boxes hold probabilities, odd ones raw outputs, some of them below zero."""
    c0 = F.when(F.col("box_id") % 2 == 0, 1.0 - F.col("score")).otherwise(F.col("x") * 3 - 0.5)
    return d.boxes(spark, sf_dir).select("box_id", r6(faces.face_score(c0, F.col("score"))).alias("s"))


@query(
    f"""WITH b AS ({d.BOXES}), p AS (SELECT a.box_id AS a_id, b.box_id AS b_id, greatest(least(a.x + a.width, b.x + b.width) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.height, b.y + b.height) - greatest(a.y, b.y), 0) AS i,
 a.width * a.height + b.width * b.height AS s FROM b a JOIN b ON a.image_id = b.image_id AND a.frame_index = b.frame_index AND a.box_id < b.box_id) SELECT a_id, b_id, round(CASE WHEN s - i <= 1e-6 THEN 0 ELSE i / (s - i) END, 6) AS iou FROM p"""
)
def box_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = d.boxes(spark, sf_dir).select("image_id", "frame_index", "box_id", F.struct("x", "y", "width", "height").alias("r"))
    pairs = b.withColumnsRenamed({"box_id": "a_id", "r": "ra"}).join(b.withColumnsRenamed({"box_id": "b_id", "r": "rb"}), ["image_id", "frame_index"]).filter("a_id < b_id")
    return pairs.select("a_id", "b_id", r6(faces.iou(F.col("ra"), F.col("rb"))).alias("iou"))


@query(
    """WITH g AS (SELECT * FROM (VALUES (8, 16.0::DOUBLE, 32.0::DOUBLE, 0), (16, 64.0, 128.0, 12800), (32, 256.0, 512.0, 16000)) t(s, a, b, base)), c AS (SELECT *, CAST(640 // s AS BIGINT) AS n FROM g),
e AS (SELECT *, unnest(range(n * n * 2)) AS i FROM c)
SELECT CAST(base + i AS BIGINT) AS anchor, round(((i // 2) % n + 0.5) * s / 640, 6) AS cx, round((((i // 2) // n) + 0.5) * s / 640, 6) AS cy, round(CASE WHEN i % 2 = 0 THEN a ELSE b END / 640, 6) AS width FROM e"""
)
def face_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return faces.anchors(spark).select("anchor", r6(F.col("cx")).alias("cx"), r6(F.col("cy")).alias("cy"), r6(F.col("width")).alias("width"))


@query(
    """WITH a AS (SELECT id, (id * 37 % 97) / 97.0::DOUBLE AS cx, (id * 53 % 89) / 89.0::DOUBLE AS cy, 0.1::DOUBLE AS s, ((id % 11) - 5)::DOUBLE AS v FROM (SELECT p_partkey AS id FROM part)),
b AS (SELECT id, cx + v * 0.1 * s AS x, cy - v * 0.1 * s AS y, s * exp(v * 0.2) AS w, s * exp(v * 0.1 * 0.2) AS h FROM a),
c AS (SELECT id, greatest(least(x - w / 2, 1), 0) AS x0, greatest(least(y - h / 2, 1), 0) AS y0, greatest(least(x + w / 2, 1), 0) AS x1, greatest(least(y + h / 2, 1), 0) AS y1 FROM b)
SELECT id, round(x0, 6) AS x, round(y0, 6) AS y, round(x1 - x0, 6) AS width, round(y1 - y0, 6) AS height FROM c WHERE x1 - x0 > 1e-4 AND y1 - y0 > 1e-4"""
)
def decode_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    v = (k % 11 - 5).cast("double")
    box = faces.decode_box(k * 37 % 97 / 97.0, k * 53 % 89 / 89.0, F.lit(0.1), F.lit(0.1), [v, -v, v, v * 0.1])
    return d.table(spark, sf_dir, "part").select(k.alias("id"), box.alias("b")).filter("b is not null").select("id", *(r6(F.col(f"b.{c}")).alias(c) for c in ("x", "y", "width", "height")))


