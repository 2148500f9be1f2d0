"""Matches, triplets, surfaces and shifts over three views of the embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import matching, surface
from . import derive as d
from .registry import query

PAIRS = [(0, 1), (1, 2), (0, 2)]
BIN, TOLERANCE = 0.004, 0.01

_K = f"k AS MATERIALIZED ({d.KEYPOINTS})"
_MATCH = """dots AS MATERIALIZED (SELECT a.frame_index AS frame_a, b.frame_index AS frame_b, a.image_id AS image_id, a.kp_index AS index_a, b.kp_index AS index_b, list_inner_product(a.descriptor, b.descriptor) AS s FROM k a JOIN k b ON a.image_id = b.image_id AND a.frame_index <> b.frame_index),
top AS (SELECT *, row_number() OVER w AS r, lead(s) OVER w AS s2 FROM dots WINDOW w AS (PARTITION BY image_id, frame_a, frame_b, index_a ORDER BY s DESC, index_b)),
found AS MATERIALIZED (SELECT image_id, frame_a, frame_b, index_a, index_b, s, s2 FROM top WHERE r = 1 AND s >= 0.55 AND (s2 <= 0 OR 1 - s <= 0.88 * (1 - s2))),
mutual AS MATERIALIZED (SELECT p.image_id, p.frame_a, p.frame_b, p.index_a, p.index_b, least(p.s, q.s) AS confidence FROM found p JOIN found q ON p.image_id = q.image_id AND p.frame_a = q.frame_b AND p.frame_b = q.frame_a AND p.index_a = q.index_b AND p.index_b = q.index_a WHERE p.frame_a < p.frame_b)"""
_TRIPLE = """tri AS (SELECT a.image_id, a.index_a AS i0, a.index_b AS i1, b.index_b AS i2, cbrt(a.confidence * b.confidence * c.confidence) AS confidence FROM mutual a JOIN mutual b ON a.image_id = b.image_id AND a.index_b = b.index_a JOIN mutual c ON c.image_id = a.image_id AND c.index_a = a.index_a AND c.index_b = b.index_b
 WHERE a.frame_a = 0 AND a.frame_b = 1 AND b.frame_a = 1 AND b.frame_b = 2 AND c.frame_a = 0 AND c.frame_b = 2),
pts AS (SELECT tri.*, k0.x AS x0, k0.y AS y0, k1.x AS x1, k1.y AS y1, k2.x AS x2, k2.y AS y2 FROM tri JOIN k k0 ON k0.image_id = tri.image_id AND k0.frame_index = 0 AND k0.kp_index = i0 JOIN k k1 ON k1.image_id = tri.image_id AND k1.frame_index = 1 AND k1.kp_index = i1 JOIN k k2 ON k2.image_id = tri.image_id AND k2.frame_index = 2 AND k2.kp_index = i2),
gate AS (SELECT *, 1 + 1.5 * least((pow(x0 - 500, 2) + pow(y0 - 300, 2)) / (250000 + 90000), 1) AS slack FROM pts),
kept AS MATERIALIZED (SELECT *, abs(x0 - x1) AS disparity_01, abs(x1 - x2) AS disparity_12, abs((x0 - x2) - ((x0 - x1) + (x1 - x2))) AS cascade FROM gate WHERE greatest(abs(y0 - y1), abs(y1 - y2), abs(y0 - y2)) <= 25 * slack AND NOT (abs(x0 - x1) > 4 AND abs(x1 - x2) > 4 AND (x0 - x1) * (x1 - x2) < 0)
 AND NOT (abs(x0 - x2) > 4 AND abs(x0 - x1) > 4 AND (x0 - x2) * (x0 - x1) < 0))"""
_BASE = f"WITH {_K}, {_MATCH}, {_TRIPLE}"
_DISP = "disp AS (SELECT image_id, (sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) + sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))) / 2 AS d, x1 - x0 AS dx0, y1 - y0 AS dy0, x1 - x2 AS dx2, y1 - y2 AS dy2, x1, y1 FROM kept)"
_CHOSEN = f"""bins AS (SELECT image_id, CAST(floor(1.0 / d / {BIN}::DOUBLE) AS BIGINT) AS bin, count(*) AS n FROM disp WHERE d > 0.5 GROUP BY ALL),
cl AS (SELECT image_id, bin, n, sum(new) OVER (PARTITION BY image_id ORDER BY bin ROWS UNBOUNDED PRECEDING) AS cluster FROM (SELECT *, CASE WHEN bin - lag(bin) OVER (PARTITION BY image_id ORDER BY bin) > greatest(ceil({TOLERANCE / BIN}), 1) THEN 1 ELSE 0 END AS new FROM bins)),
st AS (SELECT image_id, min(bin) AS s FROM (SELECT *, sum(n) OVER (PARTITION BY image_id) AS total FROM bins) WHERE n >= greatest(ceil(total * 0.01), 1) GROUP BY ALL),
up AS (SELECT image_id, bin, CASE WHEN bin > s AND (bin - lag(bin) OVER w <> 1 OR n < max(n) OVER (PARTITION BY image_id ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) THEN 1 ELSE 0 END AS brk FROM bins JOIN st USING (image_id) WHERE bin >= s WINDOW w AS (PARTITION BY image_id ORDER BY bin)),
tg AS (SELECT image_id, max(bin) AS target FROM (SELECT image_id, bin, sum(brk) OVER (PARTITION BY image_id ORDER BY bin ROWS UNBOUNDED PRECEDING) AS stop FROM up) WHERE stop = 0 GROUP BY ALL),
ch AS (SELECT image_id, cluster AS chosen FROM cl JOIN tg USING (image_id) WHERE bin = target)"""
_SURFACE = f"{_BASE}, {_DISP}, {_CHOSEN}"


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.mutual_matches(d.keypoints(spark, sf_dir), PAIRS)


def _triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    tri = matching.with_points(matching.cyclic_triplets(_matches(spark, sf_dir)), d.points(spark, sf_dir))
    return matching.verify_triplets(tri, size=(F.lit(1000.0), F.lit(600.0)))


@query(f"WITH {_K}, {_MATCH} SELECT image_id, index_a, index_b, round(s, 5) AS similarity, round(CASE WHEN s2 > 0 AND abs(1 - s2) > 1e-6 THEN (1 - s) / (1 - s2) END, 5) AS distance_ratio FROM found WHERE frame_a = 0 AND frame_b = 1")
def descriptor_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matching.match_pairs(d.keypoints(spark, sf_dir), [(0, 1)])
    return m.select("image_id", "index_a", "index_b", F.round("similarity", 5).alias("similarity"), F.round("distance_ratio", 5).alias("distance_ratio"))


@query(f"WITH {_K}, {_MATCH} SELECT image_id, frame_a, frame_b, index_a, index_b, round(confidence, 5) AS confidence FROM mutual")
def mutual_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir).select("image_id", "frame_a", "frame_b", "index_a", "index_b", F.round("confidence", 5).alias("confidence"))


@query(f"{_BASE} SELECT image_id, i0, i1, i2, round(confidence, 5) AS confidence FROM tri")
def triplet_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.cyclic_triplets(_matches(spark, sf_dir)).select("image_id", "i0", "i1", "i2", F.round("confidence", 5).alias("confidence"))


@query(f"{_BASE} SELECT image_id, i0, i1, i2, disparity_01, disparity_12, round(cascade, 6) AS cascade_error FROM kept")
def triplet_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _triplets(spark, sf_dir).select("image_id", "i0", "i1", "i2", "disparity_01", "disparity_12", F.round("cascade_error", 6).alias("cascade_error"))


@query(f"WITH {_K}, {_MATCH} SELECT m.image_id, m.frame_a, m.frame_b, median(p.x - q.x) AS base, median(q.y - p.y) AS \"cross\", count(*) AS n FROM mutual m JOIN k p ON p.image_id = m.image_id AND p.frame_index = m.frame_a AND p.kp_index = m.index_a JOIN k q ON q.image_id = m.image_id AND q.frame_index = m.frame_b AND q.kp_index = m.index_b GROUP BY ALL")
def pair_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.pair_observations(_matches(spark, sf_dir), d.points(spark, sf_dir))


@query(f"{_BASE} SELECT image_id, median(x0 - x1) AS base_01, median(y1 - y0) AS cross_01, median(x1 - x2) AS base_12, median(x0 - x2) AS base_02, median(y1 - y0) - 0.5 * median(y2 - y0) AS sag, round(median(x0 - x1) / median(x1 - x2), 6) AS ratio, round(sqrt(avg(cascade * cascade)), 6) AS rmse, count(*) AS inliers FROM kept GROUP BY image_id")
def chassis_extrinsics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.chassis(_triplets(spark, sf_dir)).select("image_id", "base_01", "cross_01", "base_12", "base_02", "sag", F.round("ratio", 6).alias("ratio"), F.round("rmse", 6).alias("rmse"), "inliers")


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surface.displacements(_triplets(spark, sf_dir))


def _far(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(spark, sf_dir).filter(F.col("d") > surface.LEAST_DISPLACEMENT)


@query(f"{_SURFACE}, r AS (SELECT image_id, unnest(range(min(bin), max(bin) + 1)) AS bin, sum(n) AS total FROM bins GROUP BY image_id) SELECT r.image_id, r.bin, round((r.bin + 0.5) * {BIN}::DOUBLE, 6) AS bin_center, coalesce(n, 0) AS n, round(coalesce(n, 0) / total, 6) AS fraction, coalesce(cluster = chosen, FALSE) AS selected FROM r LEFT JOIN cl ON cl.image_id = r.image_id AND cl.bin = r.bin LEFT JOIN ch ON ch.image_id = r.image_id")
def disparity_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = surface.histogram(surface.bin_counts(_far(spark, sf_dir), "image_id", "d", BIN), "image_id", BIN, TOLERANCE)
    return h.select("image_id", "bin", F.round("bin_center", 6).alias("bin_center"), "n", F.round("fraction", 6).alias("fraction"), "selected")


@query(
    f"""WITH s AS (SELECT user_id AS key, value AS d FROM events WHERE value > 0), b AS (SELECT key, CAST(floor(1.0 / d / 0.002::DOUBLE) AS BIGINT) AS bin, count(*) AS n FROM s GROUP BY ALL)
SELECT key, bin, n, CAST(sum(new) OVER (PARTITION BY key ORDER BY bin ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster FROM (SELECT *, CASE WHEN bin - lag(bin) OVER (PARTITION BY key ORDER BY bin) > 5 THEN 1 ELSE 0 END AS new FROM b)"""
)
def bin_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = d.series(spark, sf_dir).filter("value > 0").select("key", F.col("value").alias("d"))
    return surface.clusters(surface.bin_counts(points, "key", "d", 0.002), "key", 0.002, 0.01)


@query(
    """WITH s AS (SELECT user_id AS key, value AS d FROM events WHERE value > 0), b AS (SELECT key, CAST(floor(1.0 / d / 0.002::DOUBLE) AS BIGINT) AS bin, count(*) AS n FROM s GROUP BY ALL),
t AS (SELECT key, min(bin) AS s FROM (SELECT *, sum(n) OVER (PARTITION BY key) AS a FROM b) WHERE n >= greatest(ceil(a * 0.01), 1) GROUP BY key),
u AS (SELECT key, bin, CASE WHEN bin > s AND (bin - lag(bin) OVER w <> 1 OR n < max(n) OVER (PARTITION BY key ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) THEN 1 ELSE 0 END AS brk FROM b JOIN t USING (key) WHERE bin >= s WINDOW w AS (PARTITION BY key ORDER BY bin))
SELECT key, max(bin) AS target FROM (SELECT key, bin, sum(brk) OVER (PARTITION BY key ORDER BY bin ROWS UNBOUNDED PRECEDING) AS stop FROM u) WHERE stop = 0 GROUP BY key"""
)
def foreground_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = d.series(spark, sf_dir).filter("value > 0").select("key", F.col("value").alias("d"))
    return surface.foreground_bin(surface.bin_counts(points, "key", "d", 0.002), "key")


@query(f"{_SURFACE} SELECT disp.image_id, count(*) AS n, round(avg(dx0), 4) AS dx0, round(avg(dy0), 4) AS dy0, round(avg(dx2), 4) AS dx2, round(avg(dy2), 4) AS dy2 FROM disp JOIN cl ON cl.image_id = disp.image_id AND cl.bin = floor(1.0 / d / {BIN}::DOUBLE) JOIN ch ON ch.image_id = disp.image_id AND cluster = chosen WHERE d > 0.5 GROUP BY disp.image_id")
def surface_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = surface.surface_shifts(_points(spark, sf_dir), BIN, TOLERANCE)
    return s.select("image_id", "n", *(F.round(c, 4).alias(c) for c in ("dx0", "dy0", "dx2", "dy2")))


@query(
    f"""{_SURFACE}, r AS (SELECT image_id, unnest(range(min(bin), max(bin) + 1)) AS bin, sum(n) AS total, min(bin) AS first FROM bins GROUP BY image_id),
h AS (SELECT r.*, coalesce(n, 0) AS n, cluster, coalesce(cluster = chosen, FALSE) AS selected FROM r LEFT JOIN cl ON cl.image_id = r.image_id AND cl.bin = r.bin LEFT JOIN ch ON ch.image_id = r.image_id),
g AS (SELECT image_id, sum(n) AS total, max(cluster) FILTER (selected) AS chosen, coalesce(sum(n) FILTER (selected), 0) AS points FROM h GROUP BY image_id),
v AS (SELECT disp.image_id, avg(dx0) AS dx0, avg(dy0) AS dy0, avg(dx2) AS dx2, avg(dy2) AS dy2 FROM disp JOIN cl ON cl.image_id = disp.image_id AND cl.bin = floor(1.0 / d / {BIN}::DOUBLE) JOIN ch ON ch.image_id = disp.image_id AND cluster = chosen WHERE d > 0.5 GROUP BY disp.image_id)
SELECT image_id, 0::BIGINT AS line_number, '# metric=inv_disparity,bin_size={BIN:.4f},cluster_tolerance={TOLERANCE:.4f},total_samples=' || CAST(total AS BIGINT) || ',selected_cluster=' || coalesce('Some(' || chosen || ')', 'None') || ',selected_points=' || CAST(points AS BIGINT) AS line FROM g
UNION ALL SELECT image_id, 1, printf('# shift_0=(%.3f,%.3f),shift_1=(0.000,0.000),shift_2=(%.3f,%.3f)', coalesce(dx0, 0), coalesce(dy0, 0), coalesce(dx2, 0), coalesce(dy2, 0)) FROM g LEFT JOIN v USING (image_id)
UNION ALL SELECT image_id, 2, '{surface.CSV_COLUMNS}' FROM g
UNION ALL SELECT image_id, 3 + bin - first, printf('%d,%.4f,%.4f,%.4f,%d,%.4f,%.2f,%s,%d', bin, bin * {BIN}::DOUBLE, (bin + 1) * {BIN}::DOUBLE, (bin + 0.5) * {BIN}::DOUBLE, n, n / total, n / total * 100, coalesce(CAST(cluster AS VARCHAR), ''), CAST(selected AS INT)) FROM h"""
)
def disparity_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = surface.histogram(surface.bin_counts(_far(spark, sf_dir), "image_id", "d", BIN), "image_id", BIN, TOLERANCE)
    return surface.csv_report(h, surface.surface_shifts(_points(spark, sf_dir), BIN, TOLERANCE), "image_id", BIN, TOLERANCE)


@query(
    f"""WITH {_K}, {_MATCH}, moved AS (SELECT m.image_id || ':' || frame_a || ':' || frame_b AS image_id, q.x - p.x AS dx, q.y - p.y AS dy FROM mutual m JOIN k p ON p.image_id = m.image_id AND p.frame_index = m.frame_a AND p.kp_index = m.index_a JOIN k q ON q.image_id = m.image_id AND q.frame_index = m.frame_b AND q.kp_index = m.index_b),
disp AS (SELECT image_id, sqrt(dx * dx + dy * dy) AS d, dx, dy FROM moved WHERE sqrt(dx * dx + dy * dy) > 0.5), {_CHOSEN},
v AS (SELECT disp.image_id, count(*) AS n, avg(dx) AS dx, avg(dy) AS dy FROM disp JOIN cl ON cl.image_id = disp.image_id AND cl.bin = floor(1.0 / d / {BIN}::DOUBLE) JOIN ch ON ch.image_id = disp.image_id AND cluster = chosen GROUP BY disp.image_id)
SELECT image_id AS pair, coalesce(n, 0) AS n, round(coalesce(dx, 0), 4) AS dx, round(coalesce(dy, 0), 4) AS dy FROM (SELECT DISTINCT image_id FROM moved) LEFT JOIN v USING (image_id)"""
)
def pair_surface_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = surface.pair_shifts(_matches(spark, sf_dir), d.points(spark, sf_dir), BIN, TOLERANCE)
    return s.select(F.concat_ws(":", "image_id", "frame_a", "frame_b").alias("pair"), "n", F.round("dx", 4).alias("dx"), F.round("dy", 4).alias("dy"))


@query(f"{_SURFACE} SELECT disp.image_id, count(*) AS n, round(avg(dx0), 4) AS dx0, round(avg(dy0), 4) AS dy0, round(avg(dx2), 4) AS dx2, round(avg(dy2), 4) AS dy2 FROM disp WHERE x1 BETWEEN 400 AND 600 AND y1 BETWEEN 200 AND 350 GROUP BY disp.image_id")
def face_priority_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = d.points(spark, sf_dir).select("image_id").distinct().select("image_id", F.lit(400.0).alias("x"), F.lit(200.0).alias("y"), F.lit(200.0).alias("width"), F.lit(150.0).alias("height"))
    s = surface.face_priority_shifts(_points(spark, sf_dir), box, BIN, TOLERANCE)
    return s.select("image_id", "n", *(F.round(c, 4).alias(c) for c in ("dx0", "dy0", "dx2", "dy2")))


@query(
    """WITH n AS (SELECT s_suppkey AS id, CAST(2 + s_suppkey % 9 AS INT) AS n FROM supplier), s AS (SELECT *, unnest([1, 2, 4, 8]) AS step FROM n), p AS (SELECT id, n, unnest(range(n - step)) AS a, step FROM s WHERE step < n)
SELECT DISTINCT id, n, CAST(a AS INT) AS frame_a, CAST(a + step AS INT) AS frame_b FROM (SELECT id, n, a, step FROM p UNION SELECT id, n, 0, n - 1 FROM n)"""
)
def dyadic_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = d.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (2 + F.col("s_suppkey") % 9).cast("int").alias("n"))
    return matching.dyadic_pairs(n)


@query(f"SELECT image_id, frame_index, kp_index, score FROM (SELECT *, row_number() OVER (PARTITION BY image_id, frame_index ORDER BY score DESC, kp_index) AS r FROM ({d.KEYPOINTS})) WHERE r <= 50")
def keypoint_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.strongest(d.keypoints(spark, sf_dir), 50, ["image_id", "frame_index"]).select("image_id", "frame_index", "kp_index", "score")


@query(
    """WITH f AS (SELECT o_custkey AS image_id, CAST(round((o_orderkey * 13 % 41 - 20) / 2.0) AS INT) AS dx, CAST(round((o_orderkey * 7 % 31 - 15) / 2.0) AS INT) AS dy, CAST(60 + o_orderkey % 20 AS INT) AS w, CAST(50 + o_orderkey % 15 AS INT) AS h FROM orders),
c AS (SELECT image_id, greatest(max(dx), 0) AS x, greatest(max(dy), 0) AS y, min(dx + w) AS x1, min(dy + h) AS y1 FROM f GROUP BY ALL)
SELECT image_id, x, y, x1 - x AS width, y1 - y AS height FROM c WHERE x1 > x AND y1 > y"""
)
def align_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    f = d.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("image_id"), ((k * 13 % 41 - 20) / 2.0).alias("dx"), ((k * 7 % 31 - 15) / 2.0).alias("dy"), (60 + k % 20).cast("int").alias("width"), (50 + k % 15).cast("int").alias("height"))
    return surface.common_canvas(f).filter("x is not null")


_STEPS = """SELECT id, n, CAST(step AS INT) AS step, CAST(o[step + 1] AS INT) AS frame FROM (SELECT *, unnest(range(len(o))) AS step FROM (SELECT id, n, list_concat(o, o) AS o FROM (SELECT s_suppkey AS id, CAST(2 + s_suppkey % 4 AS INT) AS n,
  CASE WHEN 2 + s_suppkey % 4 = 3 THEN [0, 1, 2, 1] ELSE range(2 + s_suppkey % 4) END AS o FROM supplier)))"""


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = d.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (2 + F.col("s_suppkey") % 4).cast("int").alias("n"))
    return surface.playback(n, loops=2)


@query(_STEPS)
def playback_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _steps(spark, sf_dir)


@query(
    f"""WITH s AS (SELECT id, step, CASE WHEN step % 4 IN (0, 3) THEN 80 + id % 2 ELSE 120 END AS dur FROM ({_STEPS})), m AS (SELECT *, CASE WHEN dur = lag(dur) OVER (PARTITION BY id ORDER BY step) THEN 0 ELSE 1 END AS new FROM s),
r AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY step ROWS UNBOUNDED PRECEDING) AS run FROM m) SELECT id, CAST(run - 1 AS INT) AS run, count(*) AS count, CAST(any_value(dur) AS BIGINT) AS duration FROM r GROUP BY id, run"""
)
def sample_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = _steps(spark, sf_dir).withColumn("duration", surface.step_duration(F.col("step"), F.lit(100), 80 + F.col("id") % 2, F.lit(120).cast("long")))
    return surface.duration_runs(steps, "id")


@query()
def irls_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Camera positions of the three views; iterative, so there is no SQL."""
    from ..operators import extrinsics

    r = extrinsics.estimate(matching.pair_observations(_matches(spark, sf_dir), d.points(spark, sf_dir)))
    return r.select("image_id", F.posexplode(F.arrays_zip("x", "y")).alias("camera", "p"), F.round("rmse_after", 4).alias("rmse")).select("image_id", "camera", F.round("p.x", 4).alias("x"), F.round("p.y", 4).alias("y"), "rmse")
