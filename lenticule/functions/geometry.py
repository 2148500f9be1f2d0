"""Rectangles, coordinates, splines, rotations and frame timing as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How far a normalised rectangle or coordinate may pass 1.
SLACK = 1.0001


def orientation(width: Column, height: Column) -> Column:
    """Horizontal or Vertical, or the name of the error for squares and empty images."""
    return F.when((width <= 0) | (height <= 0), "ImageTooSmall").when(width > height, "Horizontal").when(height > width, "Vertical").otherwise("SquareImageNotSupported")


def rect_is_valid(x: Column, y: Column, w: Column, h: Column) -> Column:
    finite = ~(F.isnan(x) | F.isnan(y) | F.isnan(w) | F.isnan(h)) & (F.abs(x) + F.abs(y) + F.abs(w) + F.abs(h) < F.lit(float("inf")))
    return finite & (x >= 0) & (y >= 0) & (w > 0) & (h > 0) & (x + w <= SLACK) & (y + h <= SLACK)


def rect(x: Column, y: Column, w: Column, h: Column) -> Column:
    """Normalised rectangle with its origin and size held in the unit square, or null where it isn't valid."""
    cx, cy = F.least(x, F.lit(1.0)), F.least(y, F.lit(1.0))
    made = F.struct(cx.alias("x"), cy.alias("y"), F.least(w, 1.0 - cx).alias("width"), F.least(h, 1.0 - cy).alias("height"))
    return F.when(rect_is_valid(x, y, w, h), made)


def rect_pixels(r: Column, width: Column, height: Column) -> Column:
    """Pixel rectangle of a normalised one: rounded, its size cut at the image's edge."""
    x, y = (F.round(r["x"] * width)).cast("int"), (F.round(r["y"] * height)).cast("int")
    return F.struct(
        x.alias("x"),
        y.alias("y"),
        F.least(F.round(r["width"] * width).cast("int"), width - x).alias("width"),
        F.least(F.round(r["height"] * height).cast("int"), height - y).alias("height"),
    )


def contains(r: Column, x: Column, y: Column) -> Column:
    return x.between(r["x"], r["x"] + r["width"]) & y.between(r["y"], r["y"] + r["height"])


def to_global(x: Column, y: Column, p: Column) -> Column:
    """A point of a region in the whole strip; ``p`` is the region's pixel rectangle."""
    return F.struct((x + p["x"]).alias("x"), (y + p["y"]).alias("y"))


def to_local(x: Column, y: Column, p: Column) -> Column:
    """A point of the strip in a region, or null outside its half-open rectangle."""
    inside = (x >= p["x"]) & (x < p["x"] + p["width"]) & (y >= p["y"]) & (y < p["y"] + p["height"])
    return F.when(inside, F.struct((x - p["x"]).alias("x"), (y - p["y"]).alias("y")))


def normalised_to_global(x: Column, y: Column, r: Column) -> Column:
    return F.struct((r["x"] + x * r["width"]).alias("x"), (r["y"] + y * r["height"]).alias("y"))


def normalised_to_local(x: Column, y: Column, r: Column) -> Column:
    lx, ly = (x - r["x"]) / r["width"], (y - r["y"]) / r["height"]
    inside = (lx >= 0) & (ly >= 0) & (lx <= SLACK) & (ly <= SLACK)
    return F.when(inside, F.struct(F.least(lx, F.lit(1.0)).alias("x"), F.least(ly, F.lit(1.0)).alias("y")))


def major(o: Column, horizontal: Column, vertical: Column) -> Column:
    """The one that lies along the strip: for a vertical strip the second."""
    return F.when(o == "Vertical", vertical).otherwise(horizontal)


# Rows belong to t cubed, t squared, t and 1; columns to the four control points.
BSPLINE = ((-1 / 6, 3 / 6, -3 / 6, 1 / 6), (3 / 6, -6 / 6, 3 / 6, 0.0), (-3 / 6, 0.0, 3 / 6, 0.0), (1 / 6, 4 / 6, 1 / 6, 0.0))
CATMULL_ROM = ((-0.5, 1.5, -1.5, 0.5), (1.0, -2.5, 2.0, -0.5), (-0.5, 0.0, 0.5, 0.0), (0.0, 1.0, 0.0, 0.0))


def spline_basis(t: Column, matrix: tuple) -> list[Column]:
    """Weights of the four control points; t is held in 0 to 1."""
    u = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    return [((F.lit(matrix[0][j]) * u + matrix[1][j]) * u + matrix[2][j]) * u + matrix[3][j] for j in range(4)]


def spline(t: Column, points: list[Column], matrix: tuple) -> Column:
    return sum((w * p for w, p in zip(spline_basis(t, matrix), points, strict=True)), F.lit(0.0))


def spline_over(series: DataFrame, key: str, pos: str, value: str, t: float, matrix: tuple) -> DataFrame:
    """The spline at ``t`` of every four neighbours in a series; rows without all four are left out."""
    w = Window.partitionBy(key).orderBy(pos)
    four = [F.lag(value, 1).over(w), F.col(value), F.lead(value, 1).over(w), F.lead(value, 2).over(w)]
    held = series.select(key, pos, *(p.alias(f"__p{i}") for i, p in enumerate(four))).na.drop(subset=[f"__p{i}" for i in range(4)])
    return held.select(key, pos, spline(F.lit(t), [F.col(f"__p{i}") for i in range(4)], matrix).alias("value"))


def _quat(w: Column, x: Column, y: Column, z: Column) -> Column:
    return F.struct(w.alias("w"), x.alias("x"), y.alias("y"), z.alias("z"))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it occurs there; keeps expressions from growing into each other."""
    return F.transform(F.array(value), use)[0]


def quat_normalize(q: Column) -> Column:
    """Unit quaternion; the identity where the squared norm is 1e-12 or less."""
    one = _quat(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0))

    def scaled(v: Column) -> Column:
        square = v["w"] * v["w"] + v["x"] * v["x"] + v["y"] * v["y"] + v["z"] * v["z"]
        return let(F.sqrt(square), lambda n: F.when(n <= 1e-6, one).otherwise(_quat(v["w"] / n, v["x"] / n, v["y"] / n, v["z"] / n)))

    return let(q, scaled)


def quat_slerp(a: Column, b: Column, t: Column) -> Column:
    """Between unit quaternions the short way round; linear, then normalised, where they nearly agree."""

    def weights(p: Column) -> Column:
        dot = p["a"]["w"] * p["b"]["w"] + p["a"]["x"] * p["b"]["x"] + p["a"]["y"] * p["b"]["y"] + p["a"]["z"] * p["b"]["z"]

        def between(d: Column) -> Column:
            near = F.abs(d) > 0.9995
            sign = F.when(d < 0, -1.0).otherwise(1.0)

            def mix(angle: Column) -> Column:
                s = F.when(near, 1.0).otherwise(F.sin(angle))
                wa = F.when(near, 1.0 - t).otherwise(F.sin((1.0 - t) * angle) / s)
                wb = F.when(near, t).otherwise(F.sin(t * angle) / s) * sign
                return let(F.struct(wa.alias("a"), wb.alias("b")), lambda w: _quat(*(w["a"] * p["a"][c] + w["b"] * p["b"][c] for c in "wxyz")))

            return let(F.acos(F.least(F.abs(d), F.lit(1.0))), mix)

        return let(dot, between)

    return quat_normalize(let(F.struct(a.alias("a"), b.alias("b")), weights))


def quat_log(q: Column) -> Column:
    """Rotation vector: axis times angle; zero for the identity."""

    def turned(n: Column) -> Column:
        size = F.sqrt(n["x"] * n["x"] + n["y"] * n["y"] + n["z"] * n["z"])
        sign = F.when(n["w"] < 0, -1.0).otherwise(1.0)

        def scaled(s: Column) -> Column:
            scale = F.when(s < 1e-6, 2.0).otherwise(2.0 * F.atan2(s, F.abs(n["w"])) / F.when(s < 1e-6, 1.0).otherwise(s)) * sign
            return let(scale, lambda k: F.struct(*((n[c] * k).alias(c) for c in "xyz")))

        return let(size, scaled)

    return let(quat_normalize(q), turned)


def quat_relative(b: Column, a: Column) -> Column:
    """``b`` times the inverse of the unit quaternion ``a``."""
    aw, ax, ay, az = a["w"], -a["x"], -a["y"], -a["z"]
    return _quat(
        b["w"] * aw - b["x"] * ax - b["y"] * ay - b["z"] * az,
        b["w"] * ax + b["x"] * aw + b["y"] * az - b["z"] * ay,
        b["w"] * ay - b["x"] * az + b["y"] * aw + b["z"] * ax,
        b["w"] * az + b["x"] * ay - b["y"] * ax + b["z"] * aw,
    )


def quat_to_matrix(q: Column) -> Column:
    """Rotation matrix as an array of three rows."""
    w, x, y, z = (q[c] for c in "wxyz")
    one = F.lit(1.0)
    return F.array(
        F.array(one - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)),
        F.array(2 * (x * y + w * z), one - 2 * (x * x + z * z), 2 * (y * z - w * x)),
        F.array(2 * (x * z - w * y), 2 * (y * z + w * x), one - 2 * (x * x + y * y)),
    )


def quat_from_matrix(m: Column) -> Column:
    """Unit quaternion of a rotation matrix, from the largest of its four squared components."""

    def made(m: Column) -> Column:
        a, b, c = m[0][0], m[1][1], m[2][2]
        squares = {"w": 1 + a + b + c, "x": 1 + a - b - c, "y": 1 - a + b - c, "z": 1 - a - b + c}
        mixed = {("w", "x"): m[2][1] - m[1][2], ("w", "y"): m[0][2] - m[2][0], ("w", "z"): m[1][0] - m[0][1], ("x", "y"): m[0][1] + m[1][0], ("x", "z"): m[0][2] + m[2][0], ("y", "z"): m[1][2] + m[2][1]}

        def chosen(best: Column) -> Column:
            s = 2 * F.sqrt(F.greatest(best, F.lit(1e-12)))
            out = None
            for own in "zyxw":
                parts = _quat(*((s / 4) if k == own else mixed[tuple(sorted((own, k), key="wxyz".index))] / s for k in "wxyz"))
                out = parts if out is None else F.when(squares[own] >= best, parts).otherwise(out)
            return out

        return let(F.greatest(*squares.values()), chosen)

    return quat_normalize(let(m, made))


def mat_vec(m: Column, v: Column) -> Column:
    return F.transform(m, lambda row: F.aggregate(F.zip_with(row, v, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p))


def mat_mat(a: Column, b: Column) -> Column:
    columns = F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda j: F.transform(b, lambda row: F.element_at(row, j + 1)))
    return F.transform(a, lambda row: mat_vec(columns, row))


def with_se3_distance(poses: DataFrame, alpha: float = 1.0, names: tuple[str, str, str, str] = ("ta", "qa", "tb", "qb")) -> DataFrame:
    """Add the distance of two poses: translations are structs (x, y, z), rotations unit quaternions.

    Each step is a projection of its own, which keeps the expressions from growing into each other.
    """
    ta, qa, tb, qb = (F.col(n) for n in names)
    held = poses.withColumn("__turn", quat_relative(qb, qa))
    size = F.sqrt(F.col("__turn.x") * F.col("__turn.x") + F.col("__turn.y") * F.col("__turn.y") + F.col("__turn.z") * F.col("__turn.z"))
    # the length of the rotation vector is the angle itself
    held = held.withColumn("__angle", 2.0 * F.atan2(size, F.abs(F.col("__turn.w"))))
    move = sum(((tb[c] - ta[c]) * (tb[c] - ta[c]) for c in "xyz"), F.lit(0.0))
    return held.withColumn("distance", F.sqrt(move + F.lit(alpha) * F.col("__angle") * F.col("__angle"))).drop("__turn", "__angle")


def frame_delays(steps: DataFrame, key: str, pos: str, distance: str, period: int = 400, least: int = 20) -> DataFrame:
    """Whole milliseconds for each step of a key, in proportion to its distance.

    Each is at least ``least``; what rounding leaves of the period goes to the largest delay (the last on ties), which does
    not fall below ``least`` either. Distances that add up to almost nothing share the period evenly.
    """
    own = Window.partitionBy(key)
    total, n = F.sum(distance).over(own), F.count("*").over(own)
    shared = steps.withColumn("__total", total).withColumn("__n", n)
    even = F.col("__total") <= 1e-4
    portion = F.when(even, F.floor(F.lit(period) / F.col("__n"))).otherwise(F.round(period * F.col(distance) / F.when(even, 1.0).otherwise(F.col("__total"))))
    shared = shared.withColumn("delay_ms", F.greatest(portion.cast("long"), F.lit(least)))
    order = Window.partitionBy(key).orderBy(F.desc("delay_ms"), F.desc(pos))
    shared = shared.withColumn("__first", F.row_number().over(order) == 1).withColumn("__rest", period - F.sum("delay_ms").over(own))
    fixed = F.when(F.col("__first") & ~even, F.greatest(F.col("delay_ms") + F.col("__rest"), F.lit(least))).otherwise(F.col("delay_ms"))
    return shared.withColumn("delay_ms", fixed).select(key, pos, distance, "delay_ms")
