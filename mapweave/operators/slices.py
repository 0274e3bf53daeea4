"""What a slice of a map shows: the crop, its raster and the voxel under a ray."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def heights(low: float | None, high: float | None, band: tuple[float, float] | None = None) -> tuple[float, float]:
    """The heights that a slice and a storey's band both show; without either there is no end."""
    lows, highs = [v for v in (low, band and band[0]) if v is not None], [v for v in (high, band and band[1]) if v is not None]
    return max(lows, default=-math.inf), min(highs, default=math.inf)


def shown(x: Column, y: Column, z: Column, low: float | None = None, high: float | None = None, box: tuple[float, float, float, float] | None = None, yaw: float = 0.0, band: tuple[float, float] | None = None) -> Column:
    """Within the heights, and within box (x0, y0, x1, y1) of the map turned by yaw; edges count."""
    bottom, top = heights(low, high, band)
    out = (z >= bottom) & (z <= top)
    if box is not None:
        c, s = math.cos(yaw), math.sin(yaw)
        u, v = x * c - y * s, x * s + y * c
        out = out & u.between(box[0], box[2]) & v.between(box[1], box[3])
    return out


def raster(points: DataFrame, cell: float, low: float, high: float, follow: bool, near: float = 0.1) -> DataFrame:
    """cx, cy, value of the pixels that points fall into: 2 where one is between low and high (over the floor if follow, else as it is), else 1 where one is within `near` of the floor. points: x, y, z, floor (null: unknown)."""
    at = F.col("z") - F.col("floor") if follow else F.col("z")
    value = F.when(at.between(low, high), 2).when(F.abs(F.col("z") - F.col("floor")) <= near, 1)
    keys = [F.floor(F.col(a) / cell).cast("long").alias(f"c{a}") for a in "xy"]
    return points.select(*keys, value.alias("value")).groupBy("cx", "cy").agg(F.max("value").alias("value")).where("value is not null")


def picked(points: DataFrame, origin: tuple[float, float, float], direction: tuple[float, float, float], voxel: float) -> DataFrame:
    """The point that a ray meets first (then the smaller id), or none: those ahead and off it by less than one and a half voxels (5 cm at least) and 0.4 % of their distance. direction: a unit vector."""
    d = points.withColumn("along", sum((F.col(a) - o) * v for a, o, v in zip("xyz", origin, direction, strict=True)))
    off = F.sqrt(sum((o + v * F.col("along") - F.col(a)) * (o + v * F.col("along") - F.col(a)) for a, o, v in zip("xyz", origin, direction, strict=True)))
    return d.where((F.col("along") > 0) & (off < max(1.5 * voxel, 0.05) + F.col("along") * 0.004)).orderBy("along", "id").limit(1)
