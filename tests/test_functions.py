"""Fixed examples of the scalar functions."""

import math

import pytest
from pyspark.sql import functions as F

from lenticule.functions import color, faces, geometry


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_luma(spark):
    v = lambda r, g, b, w=color.BT709: color.luma(F.lit(r), F.lit(g), F.lit(b), w)
    assert tuple(one(spark, v(255, 255, 255), v(0, 0, 0), v(0, 255, 0))) == (255, 0, 182)
    assert tuple(one(spark, v(30, 60, 90, color.EQUAL), v(100, 150, 200, color.EQUAL))) == (60, 150)


def test_yuv_pads_odd_images_and_white_is_neutral(spark):
    px = spark.range(101 * 75).select(F.lit("a").alias("image_id"), (F.col("id") % 101).alias("x"), F.floor(F.col("id") / 101).alias("y"), F.lit(100).alias("r"), F.lit(150).alias("g"), F.lit(200).alias("b"))
    y, uv = color.yuv420(px)
    assert (y.count(), uv.count()) == (102 * 76, 51 * 38)
    white = px.filter("x < 4 and y < 4").withColumns({c: F.lit(255) for c in "rgb"})
    y, uv = color.yuv420(white)
    assert {tuple(r) for r in y.select("luma").collect()} == {(255,)}
    assert {tuple(r) for r in uv.select("u", "v").collect()} == {(128, 128)}


def test_coordinates(spark):
    r = geometry.rect(F.lit(0.25), F.lit(0.1), F.lit(0.5), F.lit(0.8))
    p = geometry.rect_pixels(r, F.lit(1000), F.lit(500))
    row = one(spark, geometry.to_global(F.lit(50), F.lit(100), p), geometry.to_local(F.lit(300), F.lit(150), p), geometry.to_local(F.lit(10), F.lit(10), p), geometry.normalised_to_global(F.lit(0.1), F.lit(0.25), r))
    assert tuple(row[0]) == (300, 150) and tuple(row[1]) == (50, 100) and row[2] is None
    assert tuple(row[3]) == pytest.approx((0.30, 0.30), abs=1e-6)


def test_invalid_rectangles_are_null(spark):
    bad = [(-0.1, 0.0, 0.5, 0.5), (0.0, 0.0, 0.0, 0.5), (0.6, 0.0, 0.5, 0.5), (float("nan"), 0.0, 0.5, 0.5), (0.0, 0.0, float("inf"), 0.5)]
    assert tuple(one(spark, *(geometry.rect(*map(F.lit, b)) for b in bad))) == (None,) * 5


def test_splines(spark):
    for i in range(11):
        basis = one(spark, *geometry.spline_basis(F.lit(i / 10), geometry.BSPLINE))
        assert sum(basis) == pytest.approx(1, abs=1e-9) and min(basis) >= -1e-12
    pts = [F.lit(float(v)) for v in (0, 10, 20, 30)]
    assert tuple(one(spark, geometry.spline(F.lit(0.0), pts, geometry.CATMULL_ROM), geometry.spline(F.lit(1.0), pts, geometry.CATMULL_ROM))) == (10.0, 20.0)


def test_slerp_halves_a_right_angle(spark):
    q = lambda h: F.struct(F.lit(math.cos(h)).alias("w"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(math.sin(h)).alias("z"))
    held = spark.range(1).select(geometry.quat_slerp(q(0.0), q(math.pi / 4), F.lit(0.5)).alias("q"))
    assert held.select(geometry.quat_log(F.col("q"))["z"]).first()[0] == pytest.approx(math.pi / 4, abs=1e-4)


def test_matrix_products(spark):
    m = F.array(*(F.array(*map(F.lit, r)) for r in ((1.0, 2.0, 3.0), (0.0, 1.0, 4.0), (5.0, 6.0, 0.0))))
    row = one(spark, geometry.mat_vec(m, F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))), geometry.mat_mat(m, m))
    assert row[0] == [14.0, 14.0, 17.0]
    assert row[1] == [[16.0, 22.0, 11.0], [20.0, 25.0, 4.0], [5.0, 16.0, 39.0]]


def test_delays(spark):
    df = spark.createDataFrame([("a", 0, 10.0), ("a", 1, 30.0), ("b", 0, 0.0), ("b", 1, 0.0)], "k string, p int, d double")
    got = {(r["k"], r["p"]): r["delay_ms"] for r in geometry.frame_delays(df, "k", "p", "d").collect()}
    assert got == {("a", 0): 100, ("a", 1): 300, ("b", 0): 200, ("b", 1): 200}


def test_salience_prefers_the_middle(spark):
    s = lambda x: faces.salience(F.lit(x), F.lit(x), F.lit(0.3), F.lit(0.3), F.lit(0.9))
    a, b = one(spark, s(0.35), s(0.02))
    assert a > b


def test_anchor_counts(spark):
    a = faces.anchors(spark)
    assert a.count() == 16_800
    assert a.filter("cx < 0 or cx > 1 or cy < 0 or cy > 1").count() == 0
