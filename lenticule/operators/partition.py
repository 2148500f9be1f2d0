"""Splitting a strip into frames from its profile of contrasts.

A series is rows of (key, pos, v) with positions 0 to n - 1 for each key. Rows are gathered into one array for each key once (a strip has
as many positions as its scan has pixels along one side), and everything else about a key is array work on that, in Arrow batches of
keys: a search over all thresholds is one comparison of a matrix, not a row for each threshold and position.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

THRESHOLD, GRID, EVEN = "TopologicalThreshold", "BoundedValleyGrid", "EvenSplit"


def _half_up(x: float) -> int:
    """Rounding of what is not negative, halves upwards."""
    return int(np.floor(x + 0.5))


def run_lengths(series: DataFrame, by: list[str], pos: str, flag: Column) -> DataFrame:
    """Gaps and islands: one row (flag, start, length) for each run of equal flags."""
    w = Window.partitionBy(*by).orderBy(pos)
    marked = series.withColumn("flag", flag)
    marked = marked.withColumn("__new", F.coalesce((F.col("flag") != F.lag("flag").over(w)).cast("int"), F.lit(1)))
    marked = marked.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = marked.groupBy(*by, "__run").agg(F.first("flag").alias("flag"), F.min(pos).alias("start"), F.count("*").alias("length"))
    return runs.drop("__run")


def _each_series(series: DataFrame, fn: Callable[[np.ndarray], list[tuple]], schema: str, key: str, pos: str, v: str) -> DataFrame:
    """The rows that ``fn`` makes of each key's values in order of position, after the key."""
    kind = series.schema[key].dataType.simpleString()
    gathered = series.groupBy(key).agg(F.collect_list(F.struct(F.col(pos).cast("int").alias("p"), F.col(v).cast("int").alias("v"))).alias("s"))
    named = f"`{key}` {kind}, {schema}"
    names = [key, *(c.split()[0].strip("`") for c in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            owner: list[int] = []
            for i, one in enumerate(batch.column(1)):
                p, x = (one.values.field(c).to_numpy(zero_copy_only=False) for c in (0, 1))
                made = fn(x[np.argsort(p, kind="stable")].astype(np.int64))
                rows += made
                owner += [i] * len(made)
            if rows:
                columns = [pa.array(list(c)) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), *columns], names=names)

    def typed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(batches):
            yield pa.RecordBatch.from_arrays([c.cast(pa.int32()) if pa.types.is_int64(c.type) and i else c for i, c in enumerate(out.columns)], names=out.schema.names)

    return gathered.mapInArrow(typed, named)


def threshold_runs(v: np.ndarray, frames: int) -> tuple[int, list[tuple[int, int]], float] | None:
    """Threshold, spans (start, length) and confidence; None where no threshold fits."""
    n, pitch = len(v), len(v) / frames
    if frames < 2 or n < 20 * frames:
        return None
    ordered = np.sort(v)
    low, high, median = int(ordered[0]), int(ordered[4 * n // 5]), int(ordered[n // 2])
    thresholds = np.arange(low + 1, high + 1)
    above = v >= thresholds[:, None]
    turns = above[:, 1:] != above[:, :-1]
    likely = np.flatnonzero((turns.sum(axis=1) == 2 * frames - 2) & above[:, 0])
    if not len(likely):
        return None
    cuts = np.nonzero(turns[likely])[1].reshape(len(likely), -1) + 1
    edges = np.concatenate([np.zeros((len(likely), 1), np.int64), cuts, np.full((len(likely), 1), n)], axis=1)
    sizes = np.diff(edges, axis=1)
    inside, between = sizes[:, ::2], sizes[:, 1::2]
    gap = max(_half_up(0.008 * pitch), 4), max(_half_up(0.10 * pitch), 8)
    fits = ((inside >= 0.65 * pitch) & (inside <= 1.35 * pitch)).all(axis=1) & ((between >= gap[0]) & (between <= gap[1])).all(axis=1)
    if not fits.any():
        return None
    fit, edges, sizes = thresholds[likely][fits], edges[fits], sizes[fits]
    signs = sizes.tolist()
    often: dict[tuple, int] = {}
    for x in signs:
        often[tuple(x)] = often.get(tuple(x), 0) + 1
    times = np.array([often[tuple(x)] for x in signs])
    best = int(np.flatnonzero(times >= 3)[0]) if (times >= 3).any() else int(times.argmax())
    sure = 2.0 * (int(fit[-1]) - int(fit[0]) + 1) / max(median - low, 1)
    return int(fit[best]), [(int(edges[best, 2 * i]), int(sizes[best, 2 * i])) for i in range(frames)], min(max(sure, 0.0), 1.0)


def find_gutters(v: np.ndarray, frames: int) -> list[tuple[int, int, int, int, int]]:
    """(gutter, center, start, end, value at the center) for the gutters 1 to frames - 1."""
    n, pitch = len(v), len(v) / frames
    seek, reach, half = (max(_half_up(share * pitch), least) for share, least in ((0.12, 8), (0.04, 4), (0.01, 2)))
    found = []
    for k in range(1, frames):
        nominal = _half_up(k * pitch)
        first = max(nominal - seek, 0)
        near = v[first : nominal + seek + 1]
        if not len(near):
            continue
        center = first + int(near.argmin())
        low = int(v[center])
        far = v > min(low + 12, 32)
        a, b = max(center - reach, 0), min(center + reach, n - 1)
        left, right = np.flatnonzero(far[a:center]), np.flatnonzero(far[center + 1 : b + 1])
        start = a + int(left[-1]) + 1 if len(left) else a
        end = center + int(right[0]) if len(right) else b
        if start == end:
            start, end = max(center - half, 0), min(center + half, n - 1)
        found.append((k, center, start, end, low))
    return found


def find_margins(v: np.ndarray, mean: float) -> tuple[int, int]:
    """First and last position inside the margins, given the mean of the gutters' minima."""
    n = len(v)
    most = max(_half_up(0.02 * n), 2)
    lit = np.flatnonzero(v > min(mean + 6, 24))
    first, last = (int(lit[0]), int(lit[-1])) if len(lit) else (most, n - 1 - most)
    return min(first, most), max(last, n - 1 - most)


def find_grid(v: np.ndarray, frames: int, least: int = 10) -> tuple[list[tuple[int, int, int]], float]:
    """(frame, start, length) of the spans between gutters, and the mean of the gutters' minima."""
    gutters = find_gutters(v, frames)
    if not gutters:
        return [], 0.0
    mean = sum(g[4] for g in gutters) / len(gutters)
    first, last = find_margins(v, mean)
    # a gutter before the first frame and one after the last stand for the margins
    edges = [(0, 0, first - 1), *((k, start, end) for k, _, start, end, _ in gutters), (frames, last + 1, 0)]
    spans = [(a[0], a[2] + 1, b[1] - a[2] - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [x for x in spans if x[2] >= least], mean


def holds(spans: list[tuple[int, int]], n: int, frames: int) -> bool:
    """As ``reasonable``, for the spans (start, length) of one series."""
    pitch, spans = n / frames, sorted(spans)
    low, high = _half_up(pitch * 0.7), _half_up(pitch * 1.3)
    alone = all(low <= size <= high and start >= 0 and start + size <= n for start, size in spans)
    return len(spans) == frames and alone and all(b[0] >= a[0] + a[1] and abs(b[1] - a[1]) <= max(0.15 * a[1], 18.0) for a, b in zip(spans, spans[1:], strict=False))


def first_that_holds(v: np.ndarray, frames: int) -> tuple[str, float, list[tuple[int, int]]]:
    """Strategy, confidence and spans: threshold runs, then the valley grid, then an even split, which needs no proof."""
    n = len(v)
    found = threshold_runs(v, frames)
    if found and holds(found[1], n, frames):
        return THRESHOLD, found[2], found[1]
    grid = [(start, size) for _, start, size in find_grid(v, frames)[0]]
    if holds(grid, n, frames):
        return GRID, 0.5, grid
    cut = [_half_up(f * n / frames) for f in range(frames + 1)]
    return EVEN, 0.1, [(a, b - a) for a, b in zip(cut, cut[1:], strict=False)]


def threshold_partition(series: DataFrame, frames: int, key: str = "key", pos: str = "pos", v: str = "v") -> DataFrame:
    """Frames as the runs at or above a threshold, for the thresholds at which runs alternate frame, gutter, ..., frame with fit widths.

    Of those thresholds, the lowest one whose run lengths occur at three or more of them wins, or else the lowest of those whose run
    lengths occur most often. Result: key, threshold, spans, confidence; keys for which no threshold fits are left out.
    """

    def one(x: np.ndarray) -> list[tuple]:
        found = threshold_runs(x, frames)
        return [(found[0], *map(list, zip(*found[1], strict=True)), found[2])] if found else []

    out = _each_series(series, one, "threshold int, start array<bigint>, length array<bigint>, confidence double", key, pos, v)
    spans = F.arrays_zip(F.col("start").cast("array<int>").alias("start"), F.col("length").cast("array<int>").alias("length"))
    return out.select(key, "threshold", spans.alias("spans"), "confidence")


def even_split(lengths: DataFrame, frames: int, key: str = "key", n: str = "n") -> DataFrame:
    """frame, start and width of equal parts, relative to the length; confidence 1."""
    each = lengths.select(key, F.posexplode(F.sequence(F.lit(0), F.lit(frames - 1))).alias("frame", "__i"))
    return each.select(key, "frame", (F.col("frame") / frames).alias("start"), F.lit(1.0 / frames).alias("width"), F.lit(1.0).alias("confidence"))


def gutter_spans(series: DataFrame, frames: int, key: str = "key", pos: str = "pos", v: str = "v") -> DataFrame:
    """Gutter k (from 1): center, start, end (inclusive), width and the value at its center.

    The center is the first minimum around the nominal place; it grows both ways over values up to min(minimum + 12, 32),
    to the first that is larger, but not beyond its reach, or has a default width if it can't grow.
    """

    def one(x: np.ndarray) -> list[tuple]:
        return [(k, len(x), center, start, end, end - start + 1, low) for k, center, start, end, low in find_gutters(x, frames)]

    return _each_series(series, one, "gutter int, n int, center int, start int, end int, width int, low int", key, pos, v)


def scan_margins(series: DataFrame, frames: int, key: str = "key", pos: str = "pos", v: str = "v") -> DataFrame:
    """key, first and last position inside the margins: edges with values up to min(mean gutter minimum + 6, 24) go, 2 % of the
    length at most."""

    def one(x: np.ndarray) -> list[tuple]:
        lows = [g[4] for g in find_gutters(x, frames)]
        return [find_margins(x, sum(lows) / len(lows))] if lows else []

    return _each_series(series, one, "first int, last int", key, pos, v)


def optimal_grid(series: DataFrame, frames: int, key: str = "key", pos: str = "pos", v: str = "v", least: int = 10) -> DataFrame:
    """n, frame, start and length of the spans between neighbouring gutters (those under ``least`` are left out), and the mean gutter
    minimum as the score."""

    def one(x: np.ndarray) -> list[tuple]:
        spans, score = find_grid(x, frames, least)
        return [(len(x), *span, score) for span in spans]

    return _each_series(series, one, "n int, frame int, start int, length int, score double", key, pos, v)


def reasonable(spans: DataFrame, frames: int, key: str = "key") -> DataFrame:
    """From rows (key, n, frame, start, length): whether a partition holds.

    There must be as many spans as frames, each within 30 % of the pitch, in order, inside the axis, and no two neighbours may differ
    by more than 15 % of the earlier one (18 at least).
    """
    w = Window.partitionBy(key).orderBy("start")
    before = F.lag(F.struct("start", "length")).over(w)
    pitch = F.col("n") / frames
    one = spans.withColumn("__b", before)
    ok = F.col("length").between(F.round(pitch * 0.7), F.round(pitch * 1.3)) & (F.col("start") >= 0) & (F.col("start") + F.col("length") <= F.col("n"))
    ordered = F.col("__b").isNull() | (F.col("start") >= F.col("__b.start") + F.col("__b.length"))
    alike = F.col("__b").isNull() | (F.abs(F.col("length") - F.col("__b.length")) <= F.greatest(0.15 * F.col("__b.length"), F.lit(18.0)))
    return one.groupBy(key).agg(((F.count("*") == frames) & F.bool_and(ok & ordered & alike)).alias("reasonable"))


def partition_engine(series: DataFrame, frames: int, key: str = "key", pos: str = "pos", v: str = "v") -> DataFrame:
    """The first strategy whose spans are reasonable: threshold runs, then the valley grid, then an even split (which needs no proof).

    Rows: key, n, strategy, confidence, frame, start, length.
    """

    def one(x: np.ndarray) -> list[tuple]:
        strategy, confidence, spans = first_that_holds(x, frames)
        return [(len(x), strategy, confidence, frame, *span) for frame, span in enumerate(spans)]

    return _each_series(series, one, "n int, strategy string, confidence double, frame int, start int, length int", key, pos, v)
