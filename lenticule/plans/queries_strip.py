"""Profiles and partitions of strips."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import partition, profile
from . import derive as d
from .registry import query

_COUNTS = f"SELECT image_id, major, v, count(*) AS n FROM ({d.SAMPLES}) GROUP BY ALL"


def _percentile(counts: str, keys: str, share: float, name: str) -> str:
    return f"""SELECT {keys}, min(v) AS {name} FROM (SELECT *, sum(n) OVER (PARTITION BY {keys} ORDER BY v) AS run, sum(n) OVER (PARTITION BY {keys}) AS total FROM ({counts}))
 WHERE run >= least(round(total * {share}::DOUBLE), total - 1) GROUP BY ALL"""


@query(
    f"""WITH c AS ({_COUNTS}), a AS (SELECT image_id, major, CAST(sum(n) AS BIGINT) AS n, min(v) AS min, max(v) AS max, sum(v * n) / sum(n)::DOUBLE AS avg, sum(v * v * n) / sum(n)::DOUBLE AS sq FROM c GROUP BY ALL)
SELECT a.image_id, a.major, n, min, max, round(avg, 6) AS avg, round(sqrt(greatest(sq - avg * avg, 0)), 6) AS std, p5, p98 FROM a
JOIN ({_percentile("FROM c", "image_id, major", 0.05, "p5")}) p USING (image_id, major) JOIN ({_percentile("FROM c", "image_id, major", 0.98, "p98")}) q USING (image_id, major)"""
)
def axis_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = profile.axis_profile(d.samples(spark, sf_dir), ["image_id", "major"])
    return p.withColumn("avg", F.round("avg", 6)).withColumn("std", F.round("std", 6))


@query(_percentile(_COUNTS, "image_id, major", 0.25, "q25"))
def hist_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = profile.value_counts(d.samples(spark, sf_dir), ["image_id", "major"])
    return profile.histogram_percentile(counts, ["image_id", "major"], {"q25": 0.25})


@query(_percentile(f"SELECT image_id, v, count(*) AS n FROM ({_percentile(_COUNTS, 'image_id, major', 0.05, 'v')}) GROUP BY ALL", "image_id", 0.01, "baseline"))
def p1_of_p5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.percentile_of_percentiles(d.samples(spark, sf_dir), ["image_id"], "major")


@query(
    f"""WITH s AS (SELECT key, pos, count(value) OVER l + count(value) OVER r AS n, coalesce(sum(value) OVER l, 0) + coalesce(sum(value) OVER r, 0) AS m, avg(value) OVER c AS t FROM ({d.SERIES})
 WINDOW l AS (PARTITION BY key ORDER BY pos ROWS BETWEEN 10 PRECEDING AND 4 PRECEDING), r AS (PARTITION BY key ORDER BY pos ROWS BETWEEN 4 FOLLOWING AND 10 FOLLOWING), c AS (PARTITION BY key ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))
SELECT key, pos, round(CASE WHEN n > 0 THEN m / n - t ELSE 0 END, 4) AS response FROM s"""
)
def matched_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.matched_filter(d.series(spark, sf_dir), ["key"], "pos", "value", 3, 10).withColumn("response", F.round("response", 4))


@query(
    f"""WITH p AS (SELECT image_id, x, y, r AS v FROM ({d.PIXELS})), n AS (SELECT a.image_id, a.x, a.y, any_value(a.v) AS own, list_sort(list(b.v)) AS l FROM p a JOIN p b ON a.image_id = b.image_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY ALL)
SELECT image_id, x, y, CASE WHEN len(l) = 9 THEN l[5] ELSE own END AS v FROM n"""
)
def median3x3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.median_3x3(d.pixels(spark, sf_dir).select("image_id", "x", "y", F.col("r").alias("v")), ["image_id"])


@query(
    f"""WITH p AS (SELECT image_id, x, y, g AS v FROM ({d.PIXELS})), s AS (SELECT image_id, max(x) + 1 AS w, max(y) + 1 AS h FROM p GROUP BY ALL), t AS (SELECT *, unnest(range(6)) AS tx FROM s), u AS (SELECT *, unnest(range(6)) AS ty FROM t)
SELECT u.image_id, CAST(tx AS INT) AS x, CAST(ty AS INT) AS y, v FROM u JOIN p ON p.image_id = u.image_id AND p.x = least(round(tx / 0.6::DOUBLE), w - 1) AND p.y = least(round(ty / 0.6::DOUBLE), h - 1)"""
)
def rescale_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = d.pixels(spark, sf_dir).select("image_id", "x", "y", F.col("g").alias("v"))
    return profile.rescale_nearest(p, "image_id", F.lit(0.6), F.lit(6), F.lit(6))


_RUNS = """SELECT key{t}, flag, start, length FROM (SELECT key{t}, flag, run, min(pos) AS start, count(*) AS length FROM (SELECT *, sum(new) OVER (PARTITION BY key{t} ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run
 FROM (SELECT *, CASE WHEN flag = lag(flag) OVER (PARTITION BY key{t} ORDER BY pos) THEN 0 ELSE 1 END AS new FROM ({src}))) GROUP BY ALL)"""


@query(_RUNS.format(t="", src=f"SELECT key, pos, value >= 50 AS flag FROM ({d.SERIES})"))
def run_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition.run_lengths(d.series(spark, sf_dir), ["key"], "pos", F.col("value") >= 50).select("key", "flag", "start", "length")


_FIT = f"""WITH s AS ({d.STRIPS}), g AS (SELECT key, list(v ORDER BY pos) AS vs, count(*) AS n FROM s GROUP BY key),
f AS (SELECT *, list_min(vs) AS low, list_sort(vs)[n * 4 // 5 + 1] AS high, list_sort(vs)[n // 2 + 1] AS med FROM g),
t AS (SELECT *, unnest(range(low + 1, high + 1)) AS t FROM f WHERE high > low AND n >= 60),
j AS (SELECT key, t, n, low, med, list_filter(range(1, n), lambda i: (vs[i + 1] >= t) <> (vs[i] >= t)) AS cuts FROM t WHERE vs[1] >= t),
e AS (SELECT *, list_concat(list_concat([0], cuts), [n]) AS edges FROM j WHERE len(cuts) = 4),
q AS (SELECT *, list_transform(range(1, 6), lambda i: edges[i + 1] - edges[i]) AS sign FROM e),
ok AS (SELECT * FROM q WHERE len(list_filter(range(1, 6), lambda i: CASE WHEN i % 2 = 1 THEN sign[i] BETWEEN 0.65 * n / 3 AND 1.35 * n / 3 ELSE sign[i] BETWEEN greatest(round(0.008 * n / 3), 4) AND greatest(round(0.1 * n / 3), 8) END)) = 5),
c AS (SELECT *, count(*) OVER (PARTITION BY key, sign) AS times, min(t) OVER (PARTITION BY key) AS lo, max(t) OVER (PARTITION BY key) AS hi FROM ok),
best AS (SELECT *, list_transform([1, 3, 5], lambda i: struct_pack(start := edges[i], length := sign[i])) AS spans FROM c QUALIFY row_number() OVER (PARTITION BY key ORDER BY (times >= 3) DESC, CASE WHEN times >= 3 THEN 0 ELSE -times END, t) = 1)"""


@query(_FIT + " SELECT key, CAST(t AS INT) AS threshold, list_aggregate(list_transform(spans, lambda x: x.start || '+' || x.length), 'string_agg', ';') AS spans, round(least(greatest(2.0 * (hi - lo + 1) / greatest(med - low, 1), 0), 1), 6) AS confidence FROM best")
def threshold_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = partition.threshold_partition(d.strips(spark, sf_dir), 3)
    text = F.array_join(F.transform("spans", lambda x: F.concat(x["start"], F.lit("+"), x["length"])), ";")
    return p.select("key", "threshold", text.alias("spans"), F.round("confidence", 6).alias("confidence"))


_GUTTERS = f"""SELECT * FROM (WITH s AS ({d.STRIPS}), k AS (SELECT key, count(*) AS n, count(*) / 3.0::DOUBLE AS pitch FROM s GROUP BY key), g AS (SELECT *, unnest([1, 2]) AS gutter FROM k),
p AS (SELECT *, round(gutter * pitch) AS nominal, greatest(round(0.12 * pitch), 8) AS seek, greatest(round(0.04 * pitch), 4) AS reach, greatest(round(0.01 * pitch), 2) AS half FROM g),
c AS (SELECT p.key, gutter, any_value(n) AS n, any_value(reach) AS reach, any_value(half) AS half, min(struct_pack(v, pos)) AS m FROM p JOIN s ON s.key = p.key AND abs(s.pos - nominal) <= seek GROUP BY p.key, gutter),
a AS (SELECT c.key, gutter, any_value(n) AS n, any_value(half) AS half, any_value(m.pos) AS center, any_value(m.v) AS low, coalesce(max(s.pos) FILTER (s.v > least(m.v + 12, 32) AND s.pos < m.pos) + 1, min(s.pos)) AS a,
 coalesce(min(s.pos) FILTER (s.v > least(m.v + 12, 32) AND s.pos > m.pos) - 1, max(s.pos)) AS b FROM c JOIN s ON s.key = c.key AND abs(s.pos - m.pos) <= reach GROUP BY c.key, gutter)
SELECT key, gutter, n, center, CAST(CASE WHEN a = b THEN greatest(center - half, 0) ELSE a END AS INT) AS start, CAST(CASE WHEN a = b THEN least(center + half, n - 1) ELSE b END AS INT) AS "end", low FROM a)"""


@query(f'SELECT key, gutter, center, start, "end", CAST("end" - start + 1 AS INT) AS width, low FROM ({_GUTTERS})')
def gutter_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition.gutter_spans(d.strips(spark, sf_dir), 3).drop("n")


_MARGINS = f"""SELECT * FROM (WITH s AS ({d.STRIPS}), m AS (SELECT key, avg(low) AS mean, any_value(n) AS n FROM ({_GUTTERS}) GROUP BY key),
e AS (SELECT s.key, any_value(n) AS n, greatest(round(0.02 * any_value(n)), 2) AS most, min(pos) FILTER (v > least(mean + 6, 24)) AS a, max(pos) FILTER (v > least(mean + 6, 24)) AS b FROM s JOIN m USING (key) GROUP BY s.key)
SELECT key, CAST(least(coalesce(a, most), most) AS INT) AS first, CAST(greatest(coalesce(b, n - 1 - most), n - 1 - most) AS INT) AS last FROM e)"""


@query(_MARGINS)
def scan_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition.scan_margins(d.strips(spark, sf_dir), 3)


_GRID = f"""SELECT * FROM (WITH g AS ({_GUTTERS}), e AS (SELECT key, gutter, start, "end" FROM g UNION ALL SELECT key, 0, 0, first - 1 FROM ({_MARGINS}) UNION ALL SELECT key, 3, last + 1, 0 FROM ({_MARGINS})),
w AS (SELECT key, gutter AS frame, "end" + 1 AS start, lead(start) OVER (PARTITION BY key ORDER BY gutter) AS nxt FROM e)
SELECT key, frame, start, nxt - start AS length, score FROM w JOIN (SELECT key, avg(low) AS score FROM g GROUP BY key) USING (key) WHERE nxt - start >= 10)"""


@query(f"SELECT key, frame, start, length, round(score, 6) AS score FROM ({_GRID})")
def grid_optimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = partition.optimal_grid(d.strips(spark, sf_dir), 3)
    return g.select("key", "frame", "start", "length", F.round("score", 6).alias("score"))


_HOLDS = """SELECT key, count(*) = 3 AND bool_and(length BETWEEN round(n / 3.0 * 0.7) AND round(n / 3.0 * 1.3) AND start >= 0 AND start + length <= n AND (ps IS NULL OR (start >= ps + pl AND abs(length - pl) <= greatest(0.15 * pl, 18)))) AS reasonable
 FROM (SELECT *, lag(start) OVER w AS ps, lag(length) OVER w AS pl FROM ({src}) WINDOW w AS (PARTITION BY key ORDER BY start)) GROUP BY key"""


@query(_HOLDS.format(src=f"SELECT key, 300 AS n, start, length FROM ({_GRID})"))
def partition_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition.reasonable(partition.optimal_grid(d.strips(spark, sf_dir), 3), 3)


@query(
    f"""{_FIT}, th AS (SELECT key, unnest(spans) AS s, round(least(greatest(2.0 * (hi - lo + 1) / greatest(med - low, 1), 0), 1), 6) AS confidence FROM best),
a AS (SELECT key, 'TopologicalThreshold' AS strategy, confidence, s.start AS start, s.length AS length FROM th), b AS (SELECT key, 'BoundedValleyGrid' AS strategy, 0.5 AS confidence, start, length FROM ({_GRID})),
va AS ({_HOLDS.format(src="SELECT key, 300 AS n, start, length FROM a")}), vb AS ({_HOLDS.format(src="SELECT key, 300 AS n, start, length FROM b")}),
keys AS (SELECT DISTINCT key FROM s), ca AS (SELECT a.* FROM a JOIN va USING (key) WHERE reasonable), cb AS (SELECT b.* FROM b JOIN vb USING (key) WHERE reasonable AND key NOT IN (SELECT key FROM ca)),
cc AS (SELECT key, 'EvenSplit' AS strategy, 0.1 AS confidence, f * 100 AS start, 100 AS length FROM (SELECT key, unnest([0, 1, 2]) AS f FROM keys WHERE key NOT IN (SELECT key FROM ca) AND key NOT IN (SELECT key FROM cb)))
SELECT key, strategy, CAST(confidence AS DOUBLE) AS confidence, CAST(start AS INT) AS start, CAST(length AS INT) AS length FROM (FROM ca UNION ALL FROM cb UNION ALL FROM cc)"""
)
def partition_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = partition.partition_engine(d.strips(spark, sf_dir), 3)
    return e.select("key", "strategy", F.round("confidence", 6).alias("confidence"), "start", "length")


@query(f"SELECT image_id, CAST(f AS INT) AS frame, round(f / 3.0, 6) AS start, round(1 / 3.0, 6) AS width FROM (SELECT image_id, unnest([0, 1, 2]) AS f FROM ({d.SIZES}) WHERE width > 0)")
def even_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = partition.even_split(d.sizes(spark, sf_dir).filter("width > 0"), 3, "image_id", "width")
    return e.select("image_id", "frame", F.round("start", 6).alias("start"), F.round("width", 6).alias("width"))
