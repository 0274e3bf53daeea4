"""Voxel grids: group-bys on integer keys, region predicates and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mapweave.functions.geometry import voxel_center, voxel_key

KEYS = ["kx", "ky", "kz"]


def keyed(points: DataFrame, size: float) -> DataFrame:
    return points.withColumns({f"k{a}": voxel_key(F.col(a), size) for a in "xyz"})


def mean(points: DataFrame, size: float) -> DataFrame:
    """A point per voxel: the mean, summed in 64 bits. Partial sums are made before the shuffle."""
    return keyed(points, size).groupBy(*KEYS).agg(F.count("*").alias("n"), *[F.avg(F.col(a).cast("double")).alias(a) for a in "xyz"])


def first(points: DataFrame, size: float, order: list[str]) -> DataFrame:
    """A point per voxel: the first in the given order."""
    one = F.min(F.struct(*order, "x", "y", "z")).alias("one")
    return keyed(points, size).groupBy(*KEYS).agg(one).select(*KEYS, *[F.col(f"one.{c}").alias(c) for c in [*order, "x", "y", "z"]])


def centers(points: DataFrame, size: float) -> DataFrame:
    """The occupied voxels and their centers."""
    return keyed(points, size).select(*KEYS).distinct().withColumns({a: voxel_center(F.col(f"k{a}"), size) for a in "xyz"})


def bounds(points: DataFrame) -> DataFrame:
    return points.agg(F.count("*").alias("n"), *[f(a).alias(f"{n}_{a}") for a in "xyz" for n, f in (("min", F.min), ("max", F.max))])


def summary(points: DataFrame) -> DataFrame:
    """Count, corners, horizontal and vertical voxels of a region."""
    horizontal = F.abs("nz") > 0.8
    vertical = (F.abs("nz") < 0.3) & ((F.col("nx") != 0) | (F.col("ny") != 0))
    corners = [f(a).alias(f"{n}_{a}") for a in "xyz" for n, f in (("min", F.min), ("max", F.max))]
    return points.agg(F.count("*").alias("n"), *corners, F.count_if(horizontal).alias("horizontal"), F.count_if(vertical).alias("vertical"))


def levels(points: DataFrame, bin_size: float, share: float, facing: Column) -> DataFrame:
    """Peaks of the height histogram: a bin with at least as many as the one below, more than the one above, and `share` of all. Histograms are small, so the window is."""
    up = points.where(facing)
    bins = up.groupBy(F.floor(F.col("z").cast("double") / bin_size).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    w = Window.orderBy("bin")
    near = lambda f, d: F.when(f("bin", 1).over(w) == F.col("bin") + d, f("n", 1).over(w)).otherwise(0)
    d = bins.withColumns({"below": near(F.lag, -1), "above": near(F.lead, 1), "total": F.sum("n").over(Window.partitionBy())})
    peak = (F.col("n") >= F.col("below")) & (F.col("n") > F.col("above")) & (F.col("n") >= share * F.col("total"))
    return d.where(peak).select("bin", "n", ((F.col("bin") + 0.5) * bin_size).alias("height"))


def storeys(peaks: list[tuple[float, int]], top_points, gap: float = 1.8, share: float = 0.15, least: int = 50) -> list[float]:
    """Levels kept heaviest first when `gap` apart and `share` of the heaviest; a top level with fewer than `least` vertical points above it goes.

    peaks: (height, n), heaviest first (a histogram's, so few); top_points: a function of a height that counts vertical points above it.
    """
    kept: list[float] = []
    for height, n in peaks:
        if n >= share * peaks[0][1] and all(abs(height - k) >= gap for k in kept):
            kept.append(height)
    kept.sort()
    if len(kept) > 1 and top_points(kept[-1] + 0.3) < least:
        kept.pop()
    return kept


def floor_points(points: DataFrame, heights: list[float], thickness: float) -> DataFrame:
    """Horizontal voxels within thickness of a level."""
    near = F.exists(F.array(*[F.lit(float(h)) for h in heights]), lambda h: F.abs(F.col("z") - h) <= thickness)
    return points.where((F.abs("nz") > 0.7) & near)


def wall_points(points: DataFrame, heights: list[float], least: float) -> DataFrame:
    """Vertical voxels at least so high above the level under them (else the first level); unknown normals are no walls."""
    a = F.array(*[F.lit(float(h)) for h in heights])
    under = F.coalesce(F.array_max(F.filter(a, lambda h: h <= F.col("z") + 0.1)), F.lit(float(heights[0])))
    known = (F.col("nx") != 0) | (F.col("ny") != 0) | (F.col("nz") != 0)
    return points.where(known & (F.abs("nz") < 0.3) & (F.col("z") - under >= least))


def wall_angles(points: DataFrame) -> DataFrame:
    """Weighted histogram of wall directions by degree, modulo 90: bin, n, weight. Normals with a flat part of at most 0.5 do not vote."""
    flat = F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny"))
    degree = F.degrees(F.atan2("ny", "nx"))
    turned = degree - 90 * F.floor(degree / 90)
    d = points.where((F.abs("nz") < 0.3) & (flat > 0.5))
    return d.groupBy(F.least(F.floor(turned), F.lit(89)).cast("long").alias("bin")).agg(F.count("*").alias("n"), F.sum(flat).alias("weight"))


def dominant_angle(histogram: list[tuple[int, float]], votes: int, least: int = 50) -> float | None:
    """Of a 90-bin histogram (driver side): smoothed over two bins either way, the last maximum, refined over three, folded to [-45, 45)."""
    if votes < least:
        return None
    h = [0.0] * 90
    for b, w in histogram:
        h[b] += w
    smooth = [sum(h[(i + d) % 90] for d in range(-2, 3)) for i in range(90)]
    top = max(range(90), key=lambda i: (smooth[i], i))
    weight = sum(h[(top + d) % 90] for d in range(-3, 4))
    angle = top + 0.5 + (sum(d * h[(top + d) % 90] for d in range(-3, 4)) / weight if weight else 0.0)
    return (angle + 45) % 90 - 45


def raster(points: DataFrame, x0: float, y0: float, cell: float, width: int, height: int, floor: float, above: float | None) -> DataFrame:
    """Plan cells (cx, cy, value): obstacles 100 win over floor 0; cells without either are unknown and left out."""
    top = floor + 1.8 if above is None else min(floor + 1.8, above - 0.1)
    z = F.col("z").cast("double")
    value = F.when(z.between(floor + 0.15, top), 100).when(F.abs(z - floor) <= 0.12, 0)
    at = lambda a, o, n: F.least(((F.col(a).cast("double") - o) / cell).cast("int"), F.lit(n - 1)).cast("long")  # noqa: E731  truncation, and the last cell takes the edge
    inside = (F.col("x") >= x0) & (F.col("y") >= y0) & (F.col("x") <= x0 + width * cell) & (F.col("y") <= y0 + height * cell)
    d = points.where(inside).select(at("x", x0, width).alias("cx"), at("y", y0, height).alias("cy"), value.alias("value"))
    return d.where("value is not null").groupBy("cx", "cy").agg(F.max("value").cast("long").alias("value"))


def densify(cells: DataFrame, width: int, height: int) -> DataFrame:
    """All width x height cells; unknown ones are -1. The grid is made by a range, not by a join of two sides."""
    grid = cells.sparkSession.range(width * height).select((F.col("id") % width).alias("cx"), F.expr(f"id div {width}").alias("cy"))
    return grid.join(cells, ["cx", "cy"], "left").select("cx", "cy", F.coalesce("value", F.lit(-1)).cast("long").alias("value"))
