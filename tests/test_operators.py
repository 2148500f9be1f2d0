"""Fixed examples of profiles, partitions, matching, surfaces, boxes and extrinsics."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lenticule.operators import boxes, extrinsics, matching, partition, profile, raster, surface


def test_profile_percentiles(spark):
    df = spark.range(100).select(F.lit(0).alias("k"), F.col("id").cast("int").alias("v"))
    r = profile.axis_profile(df, ["k"]).first()
    assert (r["min"], r["max"], r["avg"], r["p5"], r["p98"]) == (0, 99, 49.5, 4, 97)
    few = spark.createDataFrame([(0, v) for v in (10, 20, 30, 40, 50)], "k int, v int")
    assert profile.axis_profile(few, ["k"]).first()["avg"] == 30


def test_matched_filter(spark):
    df = spark.range(100).select(F.lit(0).alias("k"), F.col("id").alias("p"), F.when(F.col("id").between(47, 53), 20.0).otherwise(180.0).alias("v"))
    rows = profile.matched_filter(df, ["k"], "p", "v", 3, 10).collect()
    best = max(rows, key=lambda r: r["response"])
    assert best["p"] == 50 and best["response"] == pytest.approx(160)
    flat = profile.matched_filter(df.withColumn("v", F.lit(7.0)), ["k"], "p", "v", 5, 10)
    assert flat.agg(F.max(F.abs("response"))).first()[0] < 1e-9


def strip(spark, gutters):
    on = F.lit(False)
    for a, b in gutters:
        on = on | F.col("id").between(a, b)
    return spark.range(300).select(F.lit("s").alias("key"), F.col("id").cast("int").alias("pos"), F.when(on, 0).otherwise(200).alias("v"))


def test_threshold_partition(spark):
    r = partition.threshold_partition(strip(spark, [(96, 104), (196, 204)]), 3).first()
    assert [tuple(s) for s in r["spans"]] == [(0, 96), (105, 91), (205, 95)]
    assert (r["threshold"], r["confidence"]) == (1, 1.0)


def test_engine_takes_the_first_that_holds(spark):
    rows = partition.partition_engine(strip(spark, [(96, 104), (196, 204)]), 3).collect()
    assert {r["strategy"] for r in rows} == {"TopologicalThreshold"} and len(rows) == 3
    short = strip(spark, []).filter("pos < 40")
    assert {r["strategy"] for r in partition.partition_engine(short, 3).collect()} == {"EvenSplit"}


def test_optimal_grid_finds_gutters(spark):
    g = {r["gutter"]: r["center"] for r in partition.gutter_spans(strip(spark, [(95, 105), (195, 205)]), 3).collect()}
    assert abs(g[1] - 100) <= 5 and abs(g[2] - 200) <= 5


@pytest.mark.parametrize(
    ("points", "want"),
    [
        (((100, 50), (80, 50), (60, 50)), (20, 20, 0)),
        (((100, 50), (80, 80), (60, 50)), None),
        (((100, 50), (120, 50), (60, 50)), None),
        (((100, 50), (80, 50), (75, 50)), (20, 5, 0)),
        (((100, 50), (80, 50), (60, 80)), None),
    ],
)
def test_triplet_gate(spark, points, want):
    df = spark.createDataFrame([tuple(float(c) for p in points for c in p)], "x0 double, y0 double, x1 double, y1 double, x2 double, y2 double")
    r = matching.verify_triplets(df).select("disparity_01", "disparity_12", "cascade_error").first()
    assert (None if r is None else tuple(r)) == want


def test_cycle_and_shift(spark):
    kp = [(0, 0, 10, 20), (0, 1, 30, 40), (1, 0, 15, 22), (1, 1, 35, 42), (2, 0, 20, 24), (2, 1, 40, 44)]
    keypoints = spark.createDataFrame([("a", f, i, float(x), float(y)) for f, i, x, y in kp], "image_id string, frame_index int, kp_index int, x double, y double")
    m = spark.createDataFrame([("a", a, b, i, i, c) for (a, b), c in {(0, 1): 0.95, (1, 2): 0.9, (0, 2): 0.92}.items() for i in (0, 1)], "image_id string, frame_a int, frame_b int, index_a int, index_b int, confidence double")
    tri = matching.cyclic_triplets(m)
    assert tri.agg(F.max("confidence"), F.count("*")).first() == (pytest.approx((0.95 * 0.9 * 0.92) ** (1 / 3)), 2)
    shifts = surface.surface_shifts(surface.displacements(matching.verify_triplets(matching.with_points(tri, keypoints))), 0.005, 0.0).first()
    assert tuple(shifts)[1:] == (2, 5.0, 2.0, -5.0, -2.0)


def test_pair_shift_and_least_displacement(spark):
    kp = [("a", 0, 0, 10, 20), ("a", 0, 1, 30, 40), ("a", 1, 0, 13, 24), ("a", 1, 1, 33, 44), ("b", 0, 0, 10, 20), ("b", 1, 0, 10.3, 20.4)]
    keypoints = spark.createDataFrame([(i, f, k, float(x), float(y)) for i, f, k, x, y in kp], "image_id string, frame_index int, kp_index int, x double, y double")
    m = spark.createDataFrame([("a", 0, 1, 0, 0), ("a", 0, 1, 1, 1), ("b", 0, 1, 0, 0)], "image_id string, frame_a int, frame_b int, index_a int, index_b int")
    got = surface.pair_shifts(m, keypoints, 0.005, 0.0).orderBy("image_id").collect()
    assert [tuple(r) for r in got] == [("a", 0, 1, 2, 3.0, 4.0), ("b", 0, 1, 0, 0.0, 0.0)]  # half a pixel and less is no displacement


def test_decimals_of_the_report(spark):
    rng = np.random.default_rng(7)
    ties = [k / 32 for k in range(33)] + [n / m for m in (160, 800, 2000, 16000) for n in range(1, 60, 2)]
    odd = [0.99995, 0.99996, 1e12 + 0.03125, 2.0**53, 2.0**62, 5e-324, 1e-310, 0.0, -0.0, -0.03125, -0.00004, -1.00005]
    values = [float(v) for v in [*ties, *odd, *(np.array(ties) * 100), *rng.random(500), *(rng.integers(0, 10**6, 2000) / 2e4), *rng.normal(0, 1e6, 200)]]
    df = spark.createDataFrame(list(enumerate(values)), "i long, x double")
    got = df.select("x", *(surface.fixed(F.col("x"), p).alias(f"p{p}") for p in (2, 3, 4))).collect()
    assert [tuple(r)[1:] for r in got] == [tuple(f"{r['x']:.{p}f}" for p in (2, 3, 4)) for r in got]
    bins = spark.createDataFrame([("a", 0, 7), ("a", 1, 217)], "k string, bin long, n long")
    hist = surface.histogram(bins, "k", 0.004, 0.01)
    shifts = spark.createDataFrame([("a", 0.0625, -0.0625, 0.1875, 3.0)], "k string, dx0 double, dy0 double, dx2 double, dy2 double")
    lines = [r["line"] for r in surface.csv_report(hist, shifts, "k", 0.004, 0.01).orderBy("line_number").collect()]
    assert lines[1] == "# shift_0=(0.062,-0.062),shift_1=(0.000,0.000),shift_2=(0.188,3.000)"
    assert lines[3:] == ["0,0.0000,0.0040,0.0020,7,0.0312,3.12,0,1", "1,0.0040,0.0080,0.0060,217,0.9688,96.88,0,1"]


def test_common_canvas_and_crop(spark):
    df = spark.createDataFrame([("a", d, 0.0, 100, 100) for d in (2.0, 0.0, -2.0)], "image_id string, dx double, dy double, width int, height int")
    assert tuple(surface.common_canvas(df).first()) == ("a", 2, 0, 96, 100)
    frames = raster.align_and_crop([np.zeros((100, 100, 3), np.uint8)] * 3, [(2, 0), (0, 0), (-2, 0)])
    assert {f.shape for f in frames} == {(100, 96, 3)}


def test_box_suppression_and_choice(spark):
    rows = [("f", 0, 0.2, 0.2, 0.3, 0.3, 0.95), ("f", 1, 0.21, 0.21, 0.29, 0.29, 0.8), ("f", 2, 0.7, 0.7, 0.2, 0.2, 0.9)]
    df = spark.createDataFrame(rows, "g string, box_id int, x double, y double, width double, height double, score double")
    assert sorted(r["score"] for r in boxes.box_nms(df, ["g"]).collect()) == [0.9, 0.95]
    two = spark.createDataFrame([("f", 0, 0.01, 0.1, 0.05, 0.05, 0.95), ("f", 1, 0.3, 0.2, 0.4, 0.5, 0.88)], df.schema)
    assert boxes.dominant(two, ["g"]).first()["box_id"] == 1


def test_pixel_suppression(spark):
    px = spark.createDataFrame([("a", 5, 5, 0.9), ("a", 6, 5, 0.8)], "image_id string, x int, y int, score double")
    assert [tuple(r) for r in boxes.pixel_nms(px, ["image_id"], 2, 0.5, 1, 10, 10).collect()] == [("a", 5, 5, 0.9)]
    tie = px.withColumn("score", F.lit(0.9))
    assert boxes.pixel_nms(tie, ["image_id"], 2, 0.5, 1, 10, 10).count() == 0


def test_dyadic_pairs(spark):
    got = matching.dyadic_pairs(spark.createDataFrame([("a", 6)], "id string, n int")).select("frame_a", "frame_b").collect()
    assert sorted(map(tuple, got)) == sorted({(i, i + s) for s in (1, 2, 4) for i in range(6 - s)} | {(0, 5)})


def test_matches_need_distinct_neighbours(spark):
    e = np.eye(4)
    rows = [("a", f, i, 0.0, 0.0, 1.0, e[i].tolist()) for f in (0, 1) for i in range(4)]
    kp = spark.createDataFrame(rows, "image_id string, frame_index int, kp_index int, x double, y double, score double, descriptor array<double>")
    got = matching.mutual_matches(kp, [(0, 1)]).collect()
    assert sorted((r["index_a"], r["index_b"]) for r in got) == [(i, i) for i in range(4)]
    same = kp.withColumn("descriptor", F.array(*(F.lit(x) for x in (1.0, 0.0, 0.0, 0.0))))
    assert matching.mutual_matches(same, [(0, 1)]).count() == 4 * 0 + matching.match_pairs(same, [(0, 1)]).filter("index_a = index_b").count()


class TestExtrinsics:
    def test_three_cameras(self):
        r = extrinsics.solve(3, {(0, 1): (20, 2, 2), (1, 2): (20, -2, 2), (0, 2): (40, 0, 2)})
        assert r["positions"] == pytest.approx(np.array([[0, 0], [20, 2], [40, 0]]), abs=1e-3)
        assert r["sags"] == pytest.approx([2], abs=1e-3) and r["rmse_after"] < 0.01

    def test_four_cameras(self):
        p = [(100, 50), (80, 51), (60, 52), (40, 50)]
        seen = {(i, j): (p[i][0] - p[j][0], p[j][1] - p[i][1], 1) for i in range(4) for j in range(i + 1, 4)}
        r = extrinsics.solve(4, seen)
        assert len(r["adjacent"]) == 3 and len(r["sags"]) == 2 and r["rmse_after"] < 0.05

    def test_a_wrong_pair_is_pruned(self):
        r = extrinsics.solve(3, {(0, 1): (20, 0, 2), (1, 2): (20, 0, 2), (0, 2): (90, 0, 2)})
        assert r["pruned"] == 1 and r["fallback"] is None and r["positions"][1, 0] == pytest.approx(20, abs=1)

    def test_fallback_keeps_the_nominal_baseline(self):
        c = extrinsics.ExtrinsicsConfig(most_rmse_px=1e-6)
        r = extrinsics.solve(3, {(0, 1): (20, 0, 2), (1, 2): (20, 0, 2)}, c)
        if r["fallback"]:
            assert r["positions"].tolist() == [[0, 0], [20, 0], [40, 0]]
        else:
            assert r["rmse_after"] <= 1e-6


def test_refinement():
    y, x = np.mgrid[:64, :64]
    board = np.where((x < 32) == (y < 32), 240, 15).astype(np.uint8)
    cx, cy, status = raster.refine(board, 32.4, 31.7, epsilon=0.005)
    assert status == "Refined" and (cx, cy) == pytest.approx((31.5, 31.5), abs=0.05)
    flat = np.full((64, 64), 128, np.uint8)
    assert [raster.refine(flat, a, b)[2] for a, b in ((32, 32), (1, 1), (63, 63))] == ["PoorConditioning", "BoundarySkipped", "BoundarySkipped"]
    assert raster.refine(board, 32.3, 32.2, most_drift=0.4) == (32.3, 32.2, "DriftRejected")


def test_raster_filters():
    spots = np.full((100, 200), 80, np.uint8)
    spots[50, 50], spots[20, 20] = 255, 0
    assert (raster.median_3x3(spots) == 80).all()
    pixel = np.zeros((3, 3), np.uint8)
    pixel.ravel()[:] = [10, 50, 30, 90, 20, 80, 70, 40, 60]
    assert raster.median_3x3(pixel)[1, 1] == 50
    small, scale = raster.scaled_luma(np.full((2000, 6000, 3), 120, np.uint8))
    assert small.shape == (1080, 3240) and (small == 120).all() and scale == 0.54
    score = np.zeros((10, 10))
    score[5, 5], score[5, 6] = 0.9, 0.8
    assert raster.peaks(score, 2, 0.5, 1) == [(5, 5, 0.9)]
