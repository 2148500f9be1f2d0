"""Relations of the image model derived from the star schema, in Spark and, letter for letter, in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import let


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        F.floor(k / 100).alias("image_id"), ((k % 100) % 10).cast("int").alias("x"), F.floor((k % 100) / 10).cast("int").alias("y"),
        (k * 7 % 256).cast("int").alias("r"), (F.col("p_size") * 5 % 256).alias("g"), (F.floor("p_retailprice") % 256).cast("int").alias("b"), k.alias("id"),
    )


PIXELS = """SELECT p_partkey // 100 AS image_id, CAST((p_partkey % 100) % 10 AS INT) AS x, CAST((p_partkey % 100) // 10 AS INT) AS y,
  CAST(p_partkey * 7 % 256 AS INT) AS r, CAST(p_size * 5 % 256 AS INT) AS g, CAST(CAST(floor(p_retailprice) AS BIGINT) % 256 AS INT) AS b, p_partkey AS id FROM part"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 4).alias("image_id"), F.col("l_suppkey").alias("major"), (F.floor("l_quantity") * 5).cast("int").alias("v"))


SAMPLES = "SELECT l_suppkey % 4 AS image_id, l_suppkey AS major, CAST(floor(l_quantity) * 5 AS INT) AS v FROM lineitem"


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("pos"), F.col("value"))


SERIES = "SELECT user_id AS key, event_id AS pos, value FROM events"


def strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strips of 300 positions in three frames, with gutters whose place and depth vary by strip."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(k.alias("key"), F.explode(F.sequence(F.lit(0), F.lit(299))).alias("pos"))
    k = F.col("key")
    gutter = F.col("pos").between(95 + k % 4, 104 + k % 6) | F.col("pos").between(195 - k % 3, 203 + k % 5)
    return rows.select("key", F.col("pos").cast("int").alias("pos"), F.when(gutter, (k % 30) + F.col("pos") % 3).otherwise(120 + (F.col("pos") * 7 + k * 11) % 90).cast("int").alias("v"))


STRIPS = """SELECT key, CAST(pos AS INT) AS pos, CAST(CASE WHEN pos BETWEEN 95 + key % 4 AND 104 + key % 6 OR pos BETWEEN 195 - key % 3 AND 203 + key % 5
  THEN key % 30 + pos % 3 ELSE 120 + (pos * 7 + key * 11) % 90 END AS INT) AS v
  FROM (SELECT p_partkey AS key, unnest(range(300)) AS pos FROM part)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.floor(k / 60).alias("image_id"), (k % 3).cast("int").alias("frame_index"), k.alias("box_id"),
        (k * 37 % 700 / 1000.0).alias("x"), (k * 53 % 600 / 1000.0).alias("y"), ((50 + k * 13 % 200) / 1000.0).alias("width"), ((50 + k * 29 % 250) / 1000.0).alias("height"), (k * 71 % 1000 / 1000.0).alias("score"),
    )


BOXES = """SELECT c_custkey // 60 AS image_id, CAST(c_custkey % 3 AS INT) AS frame_index, c_custkey AS box_id, (c_custkey * 37 % 700) / 1000.0::DOUBLE AS x,
  (c_custkey * 53 % 600) / 1000.0::DOUBLE AS y, (50 + c_custkey * 13 % 200) / 1000.0::DOUBLE AS width, (50 + c_custkey * 29 % 250) / 1000.0::DOUBLE AS height,
  (c_custkey * 71 % 1000) / 1000.0::DOUBLE AS score FROM customer"""


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("image_id"), (k * 31 % 1900).cast("int").alias("width"), (k * 17 % 1900).cast("int").alias("height"), F.col("o_totalprice").alias("price"))


SIZES = "SELECT o_orderkey AS image_id, CAST(o_orderkey * 31 % 1900 AS INT) AS width, CAST(o_orderkey * 17 % 1900 AS INT) AS height, o_totalprice AS price FROM orders"


#: Embeddings of one image.
PER_IMAGE = 250


def _placed(k: Column, f: Column) -> list[Column]:
    return [(300.0 + k * 37 % 500 - f * (5 + k % 40)).alias("x"), (100.0 + k * 91 % 400 + f * F.when(k % 11 == 0, 40).otherwise(1)).alias("y")]


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the keypoints lie: image_id, frame_index, kp_index, x, y, without their descriptors."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("f"))
    return rows.select(_image(F.col("id")).alias("image_id"), F.col("f").alias("frame_index"), F.col("id").cast("int").alias("kp_index"), *_placed(F.col("id"), F.col("f")))


def _image(k: Column) -> Column:
    return F.concat(F.lit("views"), F.floor(k / PER_IMAGE).cast("string"))


def keypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three views of every embedding: the first as it is, the others mixed with another embedding of its image (or itself, where the image has
    none in that place), at places that shift by frame."""
    base = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("e"))
    k, f = F.col("id"), F.col("f")
    frames = base.withColumn("f", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    frames = frames.withColumn("other", F.floor(k / PER_IMAGE) * PER_IMAGE + (k % PER_IMAGE + 17 * f) % PER_IMAGE)
    both = frames.join(base.select(k.alias("other"), F.col("e").alias("o")), "other", "left")
    mixed = F.zip_with("e", F.coalesce("o", "e"), lambda a, b: a + F.when(f == 0, 0.0).otherwise(0.35) * b)
    # bound, or the norm would be worked out again for every element
    length = lambda m: F.sqrt(F.aggregate(m, F.lit(0.0), lambda s, x: s + x * x))
    unit = let(mixed, lambda m: let(length(m), lambda norm: F.transform(m, lambda x: x / norm)))
    return both.select(
        _image(k).alias("image_id"), f.alias("frame_index"), k.cast("int").alias("kp_index"), *_placed(k, f),
        (k * 13 % 101 / 101.0).alias("score"), unit.alias("descriptor"),
    )


KEYPOINTS = """SELECT 'views' || (id // 250) AS image_id, f AS frame_index, CAST(id AS INT) AS kp_index, 300.0::DOUBLE + id * 37 % 500 - f * (5 + id % 40) AS x,
  100.0::DOUBLE + id * 91 % 400 + f * CASE WHEN id % 11 = 0 THEN 40 ELSE 1 END AS y, (id * 13 % 101) / 101.0::DOUBLE AS score,
  list_transform(m, lambda v: v / sqrt(list_sum(list_transform(m, lambda w: w * w)))) AS descriptor
  FROM (SELECT a.id, a.f, list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] + CASE WHEN a.f = 0 THEN 0.0 ELSE 0.35 END * b.e[i]) AS m
    FROM (SELECT vec_id AS id, embedding::DOUBLE[] AS e, unnest([0, 1, 2]) AS f FROM embeddings) a
    LEFT JOIN (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings) b0 ON b0.id = a.id // 250 * 250 + (a.id % 250 + 17 * a.f) % 250, LATERAL (SELECT coalesce(b0.e, a.e) AS e) b)"""
