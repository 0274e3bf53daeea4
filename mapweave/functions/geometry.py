"""Geometry as column expressions: voxel keys, boxes, frusta, polygons, rotations. Everything stays inside generated code."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def f32(c: Column | float) -> Column:
    return (c if isinstance(c, Column) else F.lit(c)).cast("float")


def voxel_key(c: Column, size: float) -> Column:
    """floor(c / size) in 32-bit arithmetic, toward minus infinity: the quotient must be cast back or keys on the grid go wrong."""
    return F.floor((f32(c) / f32(size)).cast("float")).cast("long")


def voxel_center(key: Column, size: float) -> Column:
    return ((f32(key) + f32(0.5)).cast("float") * f32(size)).cast("float")


def in_box(x: Column, y: Column, z: Column, center: tuple, size: tuple, yaw: float = 0.0) -> Column:
    """Inside a box turned by yaw about its center; faces count."""
    if min(size) <= 0:
        raise ValueError("box sizes must be positive")
    c, s = math.cos(yaw), math.sin(yaw)
    dx, dy, dz = (a.cast("double") - b for a, b in zip((x, y, z), center, strict=True))
    u, v = dx * c + dy * s, dy * c - dx * s
    return (F.abs(u) <= size[0] / 2) & (F.abs(v) <= size[1] / 2) & (F.abs(dz) <= size[2] / 2)


def in_view(x: Column, y: Column, z: Column, matrix: list[float]) -> Column:
    """Inside the frustum of a column-major 4 x 4 matrix."""
    row = lambda r: x.cast("double") * matrix[r] + y.cast("double") * matrix[4 + r] + z.cast("double") * matrix[8 + r] + matrix[12 + r]
    w = row(3)
    return (w > 0) & (F.abs(row(0)) <= w) & (F.abs(row(1)) <= w) & (F.abs(row(2)) <= w)


def in_polygon(x: Column, y: Column, corners: list[tuple[float, float]]) -> Column:
    """Even-odd rule, unrolled over the edges."""
    hits = []
    for (ax, ay), (bx, by) in zip(corners, corners[-1:] + corners[:-1], strict=True):
        if ay != by:
            hits.append(F.when(((F.lit(ay) > y) != (F.lit(by) > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax), 1).otherwise(0))
    return reduce(lambda a, b: a + b, hits) % 2 == 1


def polygon_area(corners: Column) -> Column:
    """Shoelace area of an array of (x, y) structs."""
    n = F.size(corners)
    terms = F.transform(corners, lambda p, i: p["x"] * F.element_at(corners, (i + 1) % n + 1)["y"] - F.element_at(corners, (i + 1) % n + 1)["x"] * p["y"])
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)) / 2


def segment_distance(x: Column, y: Column, a: tuple[float, float], b: tuple[float, float]) -> Column:
    dx, dy = b[0] - a[0], b[1] - a[1]
    length = dx * dx + dy * dy
    t = F.lit(0.0) if length == 0 else F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - a[0]) * dx + (y - a[1]) * dy) / length))
    px, py = x - (a[0] + t * dx), y - (a[1] + t * dy)
    return F.sqrt(px * px + py * py)


def in_stroke(x: Column, y: Column, path: list[tuple[float, float]], radius: float) -> Column:
    parts = list(zip(path, path[1:], strict=False)) or [(path[0], path[0])]
    return reduce(F.least, [segment_distance(x, y, a, b) for a, b in parts]) <= radius if len(parts) > 1 else segment_distance(x, y, *parts[0]) <= radius


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: nested rotations would otherwise repeat their arguments without end."""
    return F.element_at(F.transform(F.array(value), body), 1)


def quaternion(q: Column) -> Column:
    """Normalized (x, y, z, w) struct; nearly zero is the identity."""
    norm = lambda v: F.sqrt(v["x"] * v["x"] + v["y"] * v["y"] + v["z"] * v["z"] + v["w"] * v["w"])
    unit = lambda s, c, zero: F.when(s["n"] < 1e-9, F.lit(zero)).otherwise(s["q"][c] / s["n"]).alias(c)
    return let(let(q, lambda v: F.struct(v.alias("q"), norm(v).alias("n"))), lambda s: F.struct(unit(s, "x", 0.0), unit(s, "y", 0.0), unit(s, "z", 0.0), unit(s, "w", 1.0)))


def multiply(p: Column, q: Column) -> Column:
    return F.struct(
        (p["w"] * q["x"] + p["x"] * q["w"] + p["y"] * q["z"] - p["z"] * q["y"]).alias("x"),
        (p["w"] * q["y"] - p["x"] * q["z"] + p["y"] * q["w"] + p["z"] * q["x"]).alias("y"),
        (p["w"] * q["z"] + p["x"] * q["y"] - p["y"] * q["x"] + p["z"] * q["w"]).alias("z"),
        (p["w"] * q["w"] - p["x"] * q["x"] - p["y"] * q["y"] - p["z"] * q["z"]).alias("w"),
    )


def conjugate(q: Column) -> Column:
    return F.struct((-q["x"]).alias("x"), (-q["y"]).alias("y"), (-q["z"]).alias("z"), q["w"].alias("w"))


def rotate(q: Column, p: Column) -> Column:
    """p turned by the unit quaternion q."""
    tx, ty, tz = 2 * (q["y"] * p["z"] - q["z"] * p["y"]), 2 * (q["z"] * p["x"] - q["x"] * p["z"]), 2 * (q["x"] * p["y"] - q["y"] * p["x"])
    return F.struct(
        (p["x"] + q["w"] * tx + q["y"] * tz - q["z"] * ty).alias("x"),
        (p["y"] + q["w"] * ty + q["z"] * tx - q["x"] * tz).alias("y"),
        (p["z"] + q["w"] * tz + q["x"] * ty - q["y"] * tx).alias("z"),
    )


def place(t: Column, q: Column, p: Column) -> Column:
    """q turns p, then t moves it."""
    r = rotate(q, p)
    return F.struct(*[(r[c] + t[c]).alias(c) for c in "xyz"])


def compose(t1: Column, q1: Column, t2: Column, q2: Column) -> Column:
    """The struct (t, q) of the second pose seen through the first."""
    args = F.struct(t1.alias("t1"), q1.alias("q1"), t2.alias("t2"), q2.alias("q2"))
    return let(args, lambda s: F.struct(place(s["t1"], s["q1"], s["t2"]).alias("t"), multiply(s["q1"], s["q2"]).alias("q")))


def invert(t: Column, q: Column) -> Column:
    """The struct (t, q) of the inverse pose."""

    def body(s: Column) -> Column:
        back = conjugate(s["q"])
        return let(rotate(back, s["t"]), lambda r: F.struct(F.struct(*[(-r[c]).alias(c) for c in "xyz"]).alias("t"), back.alias("q")))

    return let(F.struct(t.alias("t"), q.alias("q")), body)


def slerp(a: Column, b: Column, u: Column) -> Column:
    """Between unit quaternions along the shorter arc; nearly opposite ones fall back to the nearer end."""

    def weights(s: Column) -> Column:
        d = F.least(F.abs(s["d"]), F.lit(1.0))
        return let(
            F.struct(F.acos(d).alias("angle"), d.alias("d"), F.when(s["d"] < 0, -1.0).otherwise(1.0).alias("sign"), s["u"].alias("u"), s["a"].alias("a"), s["b"].alias("b")),
            lambda v: F.struct(
                F.when(v["d"] > 1 - 1e-12, 1 - v["u"]).when(F.sin(v["angle"]) < 1e-9, F.when(v["u"] < 0.5, 1.0).otherwise(0.0)).otherwise(F.sin((1 - v["u"]) * v["angle"]) / F.sin(v["angle"])).alias("wa"),
                (v["sign"] * F.when(v["d"] > 1 - 1e-12, v["u"]).when(F.sin(v["angle"]) < 1e-9, F.when(v["u"] < 0.5, 0.0).otherwise(1.0)).otherwise(F.sin(v["u"] * v["angle"]) / F.sin(v["angle"]))).alias("wb"),
                v["a"].alias("a"),
                v["b"].alias("b"),
            ),
        )

    dot = lambda s: reduce(lambda x, y: x + y, [s["a"][c] * s["b"][c] for c in "xyzw"])
    ready = let(F.struct(a.alias("a"), b.alias("b"), u.alias("u")), lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), s["u"].alias("u"), dot(s).alias("d")))
    return let(let(ready, weights), lambda v: F.struct(*[(v["wa"] * v["a"][c] + v["wb"] * v["b"][c]).alias(c) for c in "xyzw"]))


def yaw(q: Column) -> Column:
    return F.atan2(2 * (q["w"] * q["z"] + q["x"] * q["y"]), 1 - 2 * (q["y"] * q["y"] + q["z"] * q["z"]))


def pose_distance(t1: Column, q1: Column, t2: Column, q2: Column, weight: float) -> Column:
    """Metres between the positions, and weight metres per radian between the orientations."""
    d = F.sqrt(reduce(lambda a, b: a + b, [(t1[c] - t2[c]) * (t1[c] - t2[c]) for c in "xyz"]))
    dot = F.abs(reduce(lambda a, b: a + b, [q1[c] * q2[c] for c in "xyzw"]))
    return d + weight * 2 * F.acos(F.least(dot, F.lit(1.0)))


def huber(r: Column, delta: float) -> Column:
    return F.when(r <= delta, 1.0).otherwise(delta / r)
